"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Where the vocabulary files of public tokenizers are, and which one is used unless a path is given.
FOLDER = os.environ.get("TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` with the number of tokens of a text column; null and empty texts have 0.

    Whole texts are counted, in Arrow batches. ``path`` is a vocabulary file
    on the executors.
    """
    file = path or os.path.join(FOLDER, VOCABULARY)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = load(file)
        for b in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in b], dtype="int64")

    return df.withColumn(out, F.pandas_udf(count, "bigint")(F.col(text)))

