"""Token counts by a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

#: Rank file of a public byte-level vocabulary; a parameter of every operator.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pre-tokenizer pattern that goes with that vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def encoding(path: str = TOKENIZER, pattern: str = PATTERN):
    """The encoder of a rank file, kept per worker process. A worker without the
    file at its path takes the copy that the driver sent along."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[path, pattern] = tiktoken.Encoding(
            "public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
    return _loaded[path, pattern]


def with_token_counts(df: DataFrame, text: str, path: str = TOKENIZER, name: str = "n_tokens") -> DataFrame:
    """Adds the tokens of column ``text``, whole texts, as int64; null and empty texts have 0."""
    if os.path.exists(path):
        df.sparkSession.sparkContext.addFile(path)

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for part in parts:
            yield part.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return df.withColumn(name, count(F.col(text)))
