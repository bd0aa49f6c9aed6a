"""Process only new documents: the skip-already-done behaviour (J3) as a file-source
stream with ``trigger(availableNow=True)``.  The stream checkpoint records which
files were consumed, so a rerun processes only files added since; each micro-batch
is encoded and written to its own ``batch=<epoch>`` folder of a Parquet store; a
retried batch overwrites its folder, so the store holds each batch exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respan.operators import text as T
from respan.operators import vectors as V
from respan.session import stored
from respan.sources.files import read_files
from respan.sources.scans import _path_key, _plain_path

#: Files of one micro-batch: each batch has a fixed cost, and the driver holds the names of one batch.
FILES_PER_BATCH = 50_000
#: New files that the driver keeps from one batch for the next ones, before it looks through all names again.
FILES_KEPT = 10 * FILES_PER_BATCH
#: The columns of a stream of files.
FILES = "path string, modificationTime timestamp, length long, content binary"
#: Settings of the stream.  Spark lists the files of a batch again, by default in a task for each up to
#: 10 000, and puts 32 files into a task of the scan; a task costs as much as reading hundreds of them.
SMALL_FILES = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "64", "spark.sql.files.openCostInBytes": str(64 << 10)}


def embed_new_documents(spark: SparkSession, docs_folder: str, out_path: str, checkpoint: str,
                        glob: str = "*.txt", strip_sep: str | None = "\n") -> int:
    """Run one availableNow pass; returns the number of rows in the store afterwards."""
    # without the column of contents Spark opens no file; tasks read them
    stream = (spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
              .option("maxFilesPerTrigger", FILES_PER_BATCH).option("maxCachedFiles", FILES_KEPT).load(docs_folder))
    path = _plain_path(F.col("_metadata.file_path"))
    docs = stream.select(path.alias("path"), "length")
    text = F.col("content").cast("string")
    if strip_sep:
        text = F.regexp_replace(text, F.lit(strip_sep + "$"), F.lit(""))

    def batch(df: DataFrame, epoch: int) -> None:
        df = read_files(df, docs_folder).select(_path_key(F.col("path")).alias("base_name"), text.alias("text"))
        df = stored(df, "stream-texts")  # small files are opened once; chunks and metadata read the table
        chunks = T.chunk_table(df, "plain", key="base_name")
        vecs = V.pool_chunks(V.hash_encode_chunks(chunks, key="base_name"), "mean", key="base_name")
        meta = T.document_metadata(df, key="base_name")
        out = vecs.groupBy("base_name").agg(
            F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("vec"))
        # one folder per epoch, overwritten on a retried batch: exactly-once output
        meta.join(out, "base_name", "left").write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")

    before = {name: spark.conf.get(name) for name in SMALL_FILES}
    try:
        for name, value in SMALL_FILES.items():
            spark.conf.set(name, value)
        q = (docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())  # the stream keeps the settings of its start
        q.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.parquet(out_path).count()
