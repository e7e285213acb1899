"""Entities of queries and changes of topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions.text import STOP_WORDS, normalize_entity
from memlode.functions.vectors import cosine

ENTITY = r"[\p{L}\p{N}][\p{L}\p{N}_-]{2,}"


def entity_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({ENTITY})"), F.lit(1))


def snapshot(projects: DataFrame, memories: DataFrame, newest: int = 500, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(entity): words of project names, keywords of memories and words of the newest contents, normalized, without stop words."""
    names = projects.select(F.explode(entity_tokens(F.col("name"))).alias("e"))
    keys = memories.select(F.explode(F.from_json("keywords", "array<string>")).alias("e"))
    recent = memories.orderBy(F.desc("updated_at"), "id").limit(newest).select(F.explode(entity_tokens(F.col("content"))).alias("e"))
    every = names.unionByName(keys).unionByName(recent).select(normalize_entity(F.col("e")).alias("entity"))
    return every.where((F.length("entity") > 0) & ~F.col("entity").isin(*stop_words)).distinct()


def detect(queries: DataFrame, entities: DataFrame, most: int = 40) -> DataFrame:
    """(qid, entity): which of the first `most` words of each query (qid, text) are known entities, as written, each once."""
    tokens = queries.select("qid", F.explode(F.slice(entity_tokens(F.col("text")), 1, most)).alias("raw"))
    keyed = tokens.withColumn("entity", normalize_entity(F.col("raw")))
    return keyed.join(entities, "entity", "left_semi").select("qid", F.col("raw").alias("entity")).distinct()


def topic_changes(stream: DataFrame, key: str, order: list[str], entities: str = "entities", vector: str | None = None) -> DataFrame:
    """stream with changed: whether a row leaves the topic of the one before it under the same key.

    The first row of a key does not. The topic holds if the Jaccard index of the entities is 0.3 or more (two empty
    sets are equal), or else if the cosine of the vectors is 0.5 or more.
    """
    w = Window.partitionBy(key).orderBy(*order)
    now, before = F.coalesce(F.col(entities), F.array().cast("array<string>")), F.coalesce(F.col("_before"), F.array().cast("array<string>"))
    either = F.size(F.array_union(now, before))
    same = (either == 0) | (F.size(F.array_intersect(now, before)) / F.nullif(either, F.lit(0)) >= 0.3)
    rows = stream.withColumn("_before", F.lag(entities).over(w)).withColumn("_n", F.row_number().over(w))
    if vector:
        rows = rows.withColumn("_vector", F.lag(vector).over(w))
        same = same | F.coalesce(cosine(F.col(vector), F.col("_vector")) >= 0.5, F.lit(False))
    changed = (F.col("_n") > 1) & ~same
    return rows.withColumn("changed", changed).drop("_before", "_n", *(["_vector"] if vector else []))
