"""Sizes of texts in tokens of a public tokenizer.

The vocabulary is a file of ranks on every machine, named by `vocabulary`; it is read once
by each worker and never copied.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_READ: dict[str, object] = {}


def encoding(vocabulary: str):
    if vocabulary not in _READ:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _READ[vocabulary] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _READ[vocabulary]


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`keep` and tokens: int, of the whole text; 0 for null and empty ones."""
    src = docs.select(*keep, F.col(text).alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: len(keep)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = encoding(vocabulary).encode_ordinary
        for b in batches:
            yield b[keep].assign(tokens=[len(count(t)) if t else 0 for t in b["__text"]])

    return src.mapInPandas(run, f"{head}, tokens int")
