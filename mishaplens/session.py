"""Session factory and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: list[str] = []
_SCRATCH: dict[str, list[str]] = {}


#: What a session gets where nothing else is set; on a cluster the submitted settings stay.
_LOCAL = {"spark.driver.memory": os.environ.get("DRIVER_MEMORY", "8g"), "spark.sql.shuffle.partitions": os.environ.get("SHUFFLE_PARTITIONS", "8"), "spark.ui.enabled": "false"}
_ALWAYS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}


def _submitted() -> dict[str, str] | None:
    """The settings this program was submitted with, or None if it was started plainly."""
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return None
    SparkContext._ensure_initialized()
    return dict(SparkConf().getAll())


def get_session(cores: str = "8", app: str = "mishaplens", **conf: str) -> SparkSession:
    """The active session; else one with the submitted settings; else a local one.

    ``cores`` and the local settings apply only to the last. ``conf`` (with
    ``__`` for dots) is set in any case.
    """
    given = _submitted()
    builder = SparkSession.builder
    if SparkSession.getActiveSession() is None:
        wanted = dict(_ALWAYS)
        if given is None:
            wanted |= _LOCAL | {"spark.master": os.environ.get("MASTER", f"local[{cores}]")}
        for k, v in wanted.items():
            if k not in (given or {}):
                builder = builder.config(k, v)
        if "spark.app.name" not in (given or {}):
            builder = builder.appName(app)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    if given is None:
        spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; a folder of our own only where it is unset and there is one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIRS:
        _OWN_DIRS.append(tempfile.mkdtemp(prefix="mishaplens-"))
        atexit.register(shutil.rmtree, _OWN_DIRS[0], True)
    return f"file://{_OWN_DIRS[0]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back.

    A lost executor then costs at most the tasks it was running, and several
    branches of a plan can read the result without computing it again. The
    table stays until ``release``, the end of a ``scratch`` block or of the program.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that ``release`` deletes."""
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}/{label}"
    if not _SCRATCH:
        atexit.register(_release_all)
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession, keep: int = 0) -> int:
    """Delete the staged tables of this session but the first ``keep``; results that read them must have been consumed."""
    staged = _SCRATCH.get(spark.sparkContext.applicationId, [])
    paths = staged[keep:]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        parent = jvm.org.apache.hadoop.fs.Path(p).getParent()
        parent.getFileSystem(conf).delete(parent, True)
    del staged[keep:]
    return len(paths)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """A block at whose end the tables staged in it are deleted: run a query and consume its result inside."""
    before = len(_SCRATCH.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)


def _release_all() -> None:
    """At the end of the program, if its session still runs."""
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Exception):
        if spark is not None:
            release(spark)
