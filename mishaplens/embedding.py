"""Embedding of entry texts by a replaceable provider: batches, retries, resume."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Texts per request, tries and the pause between them.
BATCH, TRIES, PAUSE = 100, 3, 5.0

#: Vectors after which what has been embedded is written.
CHECKPOINT = 100_000

Embedder = Callable[[list[str]], list[list[float]]]


def hashed_embedder(dim: int = 64) -> Embedder:
    """A stand-in without a model: signed word hashes, normalised. Not comparable with a remote model."""

    def run(texts: list[str]) -> list[list[float]]:
        import numpy as np
        import xxhash

        out = np.zeros((len(texts), dim), "f4")
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dim] += 1 if h >> 40 & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0).tolist()

    return run


def with_retries(call: Embedder, tries: int = TRIES, pause: float = PAUSE) -> Embedder:
    """The call again after a failure, at most ``tries`` times in all; the last failure is raised."""

    def run(texts):
        for k in range(tries):
            try:
                return call(texts)
            except Exception:
                if k + 1 == tries:
                    raise
                time.sleep(pause)

    return run


def embedded(entries: DataFrame, make: Callable[[], Embedder], batch: int = BATCH, tries: int = TRIES, pause: float = PAUSE) -> DataFrame:
    """(entry_id, embedding) of (entry_id, text); ``make`` builds the client once per task."""

    def run(frames):
        import pandas as pd

        call = with_retries(make(), tries, pause)
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                yield pd.DataFrame({"entry_id": part["entry_id"].to_numpy(), "embedding": call(part["text"].tolist())})

    rows = entries.select("entry_id", "text").filter("entry_id is not null and text is not null")
    return rows.mapInPandas(run, "entry_id bigint, embedding array<float>")


def embed_missing(spark: SparkSession, entries: DataFrame, path: str, make: Callable[[], Embedder], chunks: int | None = None, every: int = CHECKPOINT, **options) -> int:
    """Embed what ``path`` lacks and append it, chunk by chunk, each of about ``every`` vectors unless ``chunks`` is given; an interrupted run loses at most the chunk it was in, and none is embedded twice.

    Rows are keyed, so vectors and texts cannot shift against each other.
    """
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    if chunks is None:
        chunks = max(1, -(-entries.count() // every))
    for k in range(chunks):
        part = entries.filter(F.pmod(F.xxhash64("entry_id"), F.lit(chunks)) == k) if chunks > 1 else entries
        try:
            part = part.join(spark.read.parquet(path).select("entry_id"), "entry_id", "left_anti")
        except AnalysisException:
            pass
        embedded(part, make, **options).write.mode("append").parquet(path)
    return spark.read.parquet(path).count()
