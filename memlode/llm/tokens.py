"""Sizes of texts in tokens of a public byte-level tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the ranks of the vocabulary lie; every node needs the file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def letter_share(data: bytes) -> float:
    """The share of a text's bytes that are letters or spaces; bytes beyond ASCII count as letters."""
    b = np.frombuffer(data, dtype="u1")
    low = b | 0x20
    return float((((low >= 97) & (low <= 122)) | (b == 32) | (b >= 128)).mean()) if len(b) else 0.0


def token_sizes(rows: DataFrame, keep: tuple[str, ...], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """keep, n_tokens and letter_share of each text, over whole texts; a null text has 0 tokens."""
    picked = rows.select(*keep, rows[text].alias("_text"))
    kept = [f for f in picked.schema if f.name != "_text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long, letter_share double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            sizes = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
            shares = pa.array([letter_share(t.encode()) if t else 0.0 for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), sizes, shares], names=[*(f.name for f in kept), "n_tokens", "letter_share"])

    return picked.mapInArrow(run, schema)
