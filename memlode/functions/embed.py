"""A deterministic embedder without a model, and the cache of embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlode.functions.words import words


class Embedder(Protocol):
    """Anything that turns texts (a column of rows) into unit vectors."""

    model: str
    dims: int

    def embed(self, rows: DataFrame, id_col: str, text: str) -> DataFrame: ...


class HashingEmbedder:
    """Every word adds a signed one at a hashed place; sums are scaled to unit length. Texts without words give zeros."""

    def __init__(self, dims: int = 64):
        self.dims, self.model = dims, f"hashing-{dims}"

    def embed(self, rows: DataFrame, id_col: str, text: str) -> DataFrame:
        """(id, embedding); null texts give no row."""
        dims = self.dims
        hashed = rows.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.transform(words(text), lambda w: F.xxhash64(w)).alias("h"))
        schema = f"id {hashed.schema['id'].dataType.simpleString()}, embedding array<float>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("h")
                h = lists.flatten().to_numpy(zero_copy_only=False).view("u8")
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                out = np.zeros((batch.num_rows, dims))
                np.add.at(out, (row, (h >> np.uint64(1)) % np.uint64(dims)), np.where(h & np.uint64(1), 1.0, -1.0))
                n = np.sqrt((out * out).sum(1, keepdims=True))
                out = np.divide(out, n, where=n > 0, out=out).astype("f4")
                flat = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dims).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), flat], names=["id", "embedding"])

        return hashed.mapInArrow(run, schema)


def from_cache(rows: DataFrame, cache: DataFrame, id_col: str, text: str, model: str) -> DataFrame:
    """(id, embedding): rows with the cached vector of their text, null where there is none yet."""
    known = cache.where(F.col("model") == model).groupBy("text_hash").agg(F.max_by("embedding", F.struct("created_at", F.size("embedding"))).alias("embedding"))
    asked = rows.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("text_hash"))
    return asked.join(known, "text_hash", "left").select("id", "embedding")


def backfill(rows: DataFrame, cache: DataFrame, embedder: HashingEmbedder, id_col: str, text: str) -> DataFrame:
    """(id, embedding) of every row with a text: from the cache, else embedded once a distinct text."""
    hashed = rows.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("text_hash"), F.col(text).alias("text"))
    known = cache.where(F.col("model") == embedder.model).groupBy("text_hash").agg(F.max_by("embedding", "created_at").alias("embedding"))
    fresh = hashed.join(known, "text_hash", "left_anti").groupBy("text_hash").agg(F.first("text").alias("text"))
    vectors = known.unionByName(embedder.embed(fresh, "text_hash", "text").withColumnRenamed("id", "text_hash"))
    return hashed.select("id", "text_hash").join(vectors, "text_hash").select("id", "embedding")
