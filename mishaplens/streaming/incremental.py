"""Keeping the vector table up to date from a stream of entry texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from mishaplens.embedding import Embedder, embedded


def embed_stream(entries: DataFrame, out: str, checkpoint: str, make: Callable[[], Embedder], once: bool = True) -> StreamingQuery:
    """Embed new entries of a stream (entry_id, text) and append them to ``out``.

    Each batch drops what the table has already, so a batch that is run again
    after a failure adds nothing twice; the checkpoint resumes the stream.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["entry_id"])
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(out).select("entry_id"), "entry_id", "left_anti")
        embedded(new, make).write.mode("append").parquet(out)

    w = entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def windowed_counts(spark: SparkSession, folder: str, schema, at: str, key: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per window and key of a Parquet stream, with a watermark for late rows."""
    rows = spark.readStream.schema(schema).parquet(folder).withWatermark(at, late)
    return rows.groupBy(F.window(at, window), key).agg(F.count("*").alias("n"))
