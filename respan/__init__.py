"""respan — Spark-native analytics for document/measurement regression studies.

Modules are grouped by role:

* ``sources``   – scans and sinks (text files, measurement CSVs, run logs, Parquet caches)
* ``functions`` – reusable Column expressions (hash uniforms, tokenisers, array helpers)
* ``operators`` – DataFrame -> DataFrame building blocks (pairing, splits, metrics,
  run analytics, text features, vectors, model fitting)
* ``plans``     – compositions of operators used end to end (train/evaluate slice)
* ``streaming`` – incremental (availableNow) variants of batch operators
"""

__version__ = "0.1.0"
