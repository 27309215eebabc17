"""Token counts of texts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file of a byte-level BPE and the pattern that splits text before its merges (fixed values of that tokenizer).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    return len(encoding(path).encode_ordinary(text)) if text else 0


def with_token_counts(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), path: str = VOCABULARY) -> DataFrame:
    """(doc_id, keep..., tokens): whole texts are counted, once per key; a null or empty text has 0 tokens."""
    src = df.select(F.col(key).cast("long").alias("doc_id"), *keep, F.col(text).cast("string").alias("text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name != "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            pdf["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pdf.drop(columns="text")

    return src.mapInPandas(run, f"{kept}, tokens long").dropDuplicates(["doc_id"])
