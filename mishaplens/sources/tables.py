"""Parquet tables and other inputs."""

from __future__ import annotations

import codecs
import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def missing_inputs(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of ``paths`` that do not exist, on whatever file system they name."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if not path(p).getFileSystem(conf).exists(path(p))]


def select_or_null(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns in order; a column that ``df`` lacks becomes null of the given type."""
    return df.select([F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def select_where(df: DataFrame, predicate) -> DataFrame:
    """Columns whose name meets ``predicate``."""
    return df.select([c for c in df.columns if predicate(c)])


def delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: T.StructType | str | None = None, names: list[str] | None = None) -> DataFrame:
    """Comma- or tab-separated text with a double-quote quote character; ``names`` renames by position. Empty fields are null, quoted or not."""
    r = spark.read.option("sep", sep).option("header", header).option("quote", '"').option("escape", '"')
    df = (r.schema(schema) if schema else r.option("inferSchema", False)).csv(path)
    return df.toDF(*names) if names else df


def _files(spark: SparkSession, path: str) -> list[str]:
    """The data files at ``path``: itself, or those in it if it is a folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = [f.getPath().toString() for f in at.getFileSystem(conf).listStatus(at) if f.isFile()]
    return sorted(f for f in found if not f.rsplit("/", 1)[1].startswith(("_", ".")))


def file_system(path: str):
    """The file system that ``path`` names and the path on it, for use in a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _opened(path: str):
    """A seekable file, for use in a task."""
    system, at = file_system(path)
    return system.open_input_file(at)


def _per_file(spark: SparkSession, files: list[tuple], names: str, run, schema: str | T.StructType) -> DataFrame:
    """``run`` over descriptions of parts of files, one task each."""
    rows = spark.createDataFrame(files, names).repartition(max(1, len(files)))
    return rows.mapInPandas(run, schema)


def excel(spark: SparkSession, path: str, schema: T.StructType, sheet: str | None = None) -> DataFrame:
    """The named sheet of a workbook, else all its sheets one after the other, with the columns of ``schema`` by their header; columns that are missing, and cells of another type, are null.

    Each sheet is read by a task of its own, row by row, so that no workbook
    is held in memory; dates are numbers of days as the file has them.
    """
    from mishaplens.sources import xlsx

    files = [(f, s) for f in _files(spark, path) for s in xlsx.sheets(_opened(f)) if sheet in (None, s)]
    names = schema.fieldNames()

    def rows(frames):
        import pandas as pd

        for frame in frames:
            for file, s in zip(frame["file"], frame["sheet"]):
                held = []
                for record in xlsx.records(_opened(file), s):
                    held.append([record.get(c) for c in names])
                    if len(held) == 5000:
                        yield pd.DataFrame(held, columns=names, dtype=object)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names, dtype=object)

    text = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = _per_file(spark, files, "file string, sheet string", rows, text)
    return raw.select([F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) for f in schema])


def _members(file, size: int = 1 << 20):
    """(key, value as text) of a JSON object, read piece by piece: what is held is one member and a piece."""
    decode, take = codecs.getincrementaldecoder("utf-8")().decode, json.JSONDecoder().raw_decode
    text, ended = "", False

    def more():
        nonlocal text, ended
        raw = file.read(size)
        ended = not raw
        text += decode(raw, ended)

    def skip(signs):
        """Drop these signs from the front, reading on until something else comes."""
        nonlocal text
        text = text.lstrip(signs)
        while not text and not ended:
            more()
            text = text.lstrip(signs)

    def value():
        """The value at the front and its text, which is dropped. It is complete if a sign follows that ends it, as a number may go on."""
        nonlocal text
        while True:
            try:
                got, end = take(text)
                if ended or text[end : end + 1] in (" ", "\t", "\r", "\n", ",", ":", "}"):
                    raw, text = text[:end], text[end:]
                    return got, raw
            except ValueError:
                if ended:
                    raise
            more()

    skip(" \t\r\n{")
    while text and text[0] != "}":
        key, _ = value()
        skip(" \t\r\n:")
        yield key, value()[1]
        skip(" \t\r\n,")


def keyed_json(spark: SparkSession, path: str, value_schema: T.StructType, key: str = "ev_id") -> DataFrame:
    """JSON objects that map ids to documents, as one row per id. Each file is read by one task, piece by piece, so it may be larger than a cell."""

    def rows(frames):
        import pandas as pd

        for frame in frames:
            for file in frame["file"]:
                held = []
                for member in _members(_opened(file)):
                    held.append(member)
                    if len(held) == 1000:
                        yield pd.DataFrame(held, columns=[key, "_doc"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=[key, "_doc"])

    raw = _per_file(spark, [(f,) for f in _files(spark, path)], "file string", rows, f"`{key}` string, _doc string")
    return raw.select(key, F.from_json("_doc", value_schema).alias("_doc")).select(key, "_doc.*")


def json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def npy_matrix(spark: SparkSession, path: str, block_bytes: int = 64 << 20) -> DataFrame:
    """A saved two-dimensional array, or a folder of such, as (entry_id, embedding); the row position is the id and goes on from file to file. Ranges of rows are read by tasks of their own."""
    import numpy as np

    parts, before = [], 0
    for file in _files(spark, path):
        with _opened(file) as f:
            major = np.lib.format.read_magic(f)[0]
            shape, fortran, kind = (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(f)
            start = f.tell()
        if fortran or len(shape) != 2 or kind.hasobject:
            raise ValueError("a two-dimensional array in row order is needed")
        step = max(1, block_bytes // max(1, shape[1] * kind.itemsize))
        parts += [(file, kind.str, shape[1], start, before, lo, min(step, shape[0] - lo)) for lo in range(0, shape[0], step)]
        before += shape[0]

    def rows(frames):
        import pandas as pd

        for frame in frames:
            for file, descr, width, start, before, lo, n in frame.itertuples(index=False):
                row = width * np.dtype(descr).itemsize
                with _opened(file) as f:
                    for at in range(lo, lo + n, 1000):
                        take = min(1000, lo + n - at)
                        f.seek(start + at * row)
                        m = np.frombuffer(f.read(take * row), descr).reshape(take, -1).astype("float32")
                        yield pd.DataFrame({"entry_id": range(before + at, before + at + take), "embedding": list(m)})

    names = "file string, descr string, width bigint, start bigint, before bigint, first bigint, n bigint"
    return _per_file(spark, parts, names, rows, "entry_id bigint, embedding array<float>")


def setting(name: str, default: str | None = None) -> str:
    """An environment setting; an error names it if it is needed and unset."""
    found = os.environ.get(name, default)
    if not found:
        raise RuntimeError(f"setting {name} is needed")
    return found
