"""Writers: tables, JSON exports, versioned replacement and the incident report."""

from __future__ import annotations

import json
import os
import shutil
import time

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Rows of one file of a saved matrix, about.
NPY_ROWS = 100_000


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines that keep nulls; written by all tasks."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    """Delimited text with quotes where needed; blanks are kept, null is an unquoted empty field and an empty text a quoted one."""
    w = df.write.mode("overwrite").option("sep", sep).option("header", header).option("quote", '"').option("escape", '"')
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", '""').csv(path)


def _framed(df: DataFrame, first: str, last: str):
    """Each task's rows (line) as one JSON value: between brackets, with commas."""

    def run(frames):
        import pandas as pd

        yield pd.DataFrame({"value": [first]})
        comma = ""
        for f in frames:
            if len(f):
                yield pd.DataFrame({"value": [(comma if i == 0 else ",") + x for i, x in enumerate(f["line"])]})
                comma = ","
        yield pd.DataFrame({"value": [last]})

    return df.mapInPandas(run, "value string")


def write_json_array(df: DataFrame, path: str) -> None:
    """A folder of files that each hold a JSON array of records, nulls kept."""
    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
    _framed(lines, "[", "]").write.mode("overwrite").text(path)


def write_keyed_json(df: DataFrame, path: str, key: str = "ev_id") -> None:
    """A folder of files that each hold a JSON object of documents by id, nulls kept; rows without an id are left out."""
    doc = F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"})
    name = F.regexp_replace(F.to_json(F.struct(F.col(key).cast("string").alias("k"))), r'^\{"k":|\}$', "")
    lines = df.filter(F.col(key).isNotNull()).select(F.concat(name, F.lit(": "), doc).alias("line"))
    _framed(lines, "{", "}").write.mode("overwrite").text(path)


def write_npy(vectors: DataFrame, folder: str) -> int:
    """Vectors (entry_id, embedding of equal length) in the order of their ids as a folder of matrices; returns their number. A task that runs twice writes the same file."""

    def run(frames):
        import io

        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        from mishaplens.sources.tables import file_system

        rows = [x for f in frames for x in f["embedding"]]  # one range of ids, sized by write_npy
        if rows:
            out = io.BytesIO()
            np.save(out, np.array(rows, "float32"))
            system, at = file_system(folder)
            system.create_dir(at, recursive=True)
            context = TaskContext.get()
            part = f"{at}/.part-{context.taskAttemptId()}"
            with system.open_output_stream(part) as f:
                f.write(out.getbuffer())
            system.move(part, f"{at}/part-{context.partitionId():06d}.npy")
        yield pd.DataFrame({"n": [len(rows)]})

    n = vectors.count()
    ranges = vectors.select("entry_id", "embedding").repartitionByRange(max(1, -(-n // NPY_ROWS)), "entry_id").sortWithinPartitions("entry_id")
    ranges.mapInPandas(run, "n bigint").agg(F.sum("n")).first()
    return n


def publish(df: DataFrame, folder: str) -> str:
    """Write a new version beside the old ones, then point to it: readers never meet a half-written table, and the old version stays as backup."""
    spark = df.sparkSession
    version = f"{folder}/v{time.time_ns()}"
    df.write.parquet(version)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
    out = mark.getFileSystem(conf).create(mark, True)
    out.write(bytearray(version.rsplit("/", 1)[1].encode()))
    out.close()
    return version


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The version that ``publish`` pointed to last."""
    name = spark.read.text(f"{folder}/CURRENT").first().value
    return spark.read.parquet(f"{folder}/{name}")


def write_report(report: DataFrame, path: str, limit: int = 50) -> int:
    """The best incidents as one JSON file on the driver; its folder is made. At most ``limit`` rows, best first."""
    rows = report.orderBy(F.desc("cosine_similarity_score"), "EVID").limit(limit).collect()
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part = f"{path}.part"
    with open(part, "w") as f:
        json.dump([r.asDict() for r in rows], f, indent=4)
    shutil.move(part, path)
    return len(rows)
