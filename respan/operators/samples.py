"""Document/measurement pairing and per-document targets.

Measurement tables are the large side (many rows per document).  Every operator
here aggregates or filters them *before* the join so that the join sees one row
per document; document text is joined last and only when asked for.

Skew: a single document may own a large share of all measurements.  The summary
aggregate is partial (map-side combine), so the shuffle carries at most one row
per (document, map task); the row-level pairing (J2) is a left-semi join on the
document key, which AQE's skew handling splits when one key dominates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_null_measurements(meas: DataFrame, required=("response_time",)) -> DataFrame:
    """Keep rows whose required columns are all non-null."""
    return meas.na.drop(subset=list(required))


def summary_targets(meas: DataFrame, key: str = "base_name", value: str = "response_time") -> DataFrame:
    """A1: per-document mean/min/max of the response time (nulls ignored)."""
    return (drop_null_measurements(meas, [value])
            .groupBy(key)
            .agg(F.avg(value).alias("avg_resp_time"),
                 F.min(value).alias("min_resp_time"),
                 F.max(value).alias("max_resp_time"),
                 F.count(F.lit(1)).alias("n_measurements")))


def summary_samples(docs: DataFrame, meas: DataFrame, with_text: bool = False,
                    key: str = "base_name") -> DataFrame:
    """J1 + P2: documents paired with their aggregated measurements.

    Documents without measurements, and measurement groups whose values are all
    null, disappear (inner join after the null drop).
    """
    targets = summary_targets(meas, key)
    doc_cols = [key, "tpcm_text"] if with_text else [key]
    return docs.select(*doc_cols).join(targets, key, "inner")


def require_samples(df: DataFrame) -> DataFrame:
    """P2 driver check: zero samples overall is an error, as in the reference."""
    if df.isEmpty():
        raise ValueError("No valid samples found.")
    return df


def timeseries_samples(docs: DataFrame, meas: DataFrame, key: str = "base_name") -> DataFrame:
    """One row per measurement with both time and response present, for documents
    that exist.  Text is not repeated per row; join it late when needed."""
    rows = drop_null_measurements(meas, ["response_time", "point_in_time"])
    return (rows.join(docs.select(key), key, "left_semi")
            .select(key, *[c for c in rows.columns if c != key])
            .withColumnRenamed("point_in_time", "time_value"))


def pending_documents(docs: DataFrame, done: DataFrame, key: str = "base_name",
                      force: bool = False) -> DataFrame:
    """Documents not processed yet (anti join on the key) unless forced."""
    if force:
        return docs
    return docs.join(done.select(key), key, "left_anti")
