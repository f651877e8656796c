"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str = RANKS):
    """The byte-level BPE of a rank file, once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, key: str, text: str, *keep: str, ranks: str = RANKS) -> DataFrame:
    """``key`` and the columns ``keep`` with ``n_tokens long``; null and empty texts have 0 tokens."""
    rest = [f.name for f in df.select(*keep).schema] if keep else []
    chosen = df.select(F.col(key).alias("__key"), *keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text"] + ["n_tokens long"])

    def run(batches):
        encode = encoder(ranks).encode_ordinary
        for batch in batches:
            n = [len(encode(x)) if x else 0 for x in batch.column("__text").to_pylist()]
            columns = [batch.column(c) for c in ("__key", *rest)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], ["__key", *rest, "n_tokens"])

    return chosen.mapInArrow(run, schema).withColumnRenamed("__key", key)
