"""Curation: duplicates, contradictions and capped consolidation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Words of negation and pairs of opposites, both sought as substrings.
NEGATIONS = ("not", "don't", "doesn't", "won't", "can't", "isn't", "aren't", "wasn't", "never", "no", "none", "não", "nunca", "nenhum")
OPPOSITES = (
    ("include", "exclude"), ("enable", "disable"), ("accept", "reject"), ("increase", "decrease"), ("add", "remove"), ("start", "stop"), ("active", "inactive"),
    ("true", "false"), ("use", "avoid"), ("incluir", "excluir"), ("ativar", "desativar"), ("adicionar", "remover"), ("aceitar", "rejeitar"),
)


@dataclass(frozen=True)
class Preset:
    """Least similarity of duplicates and most deletions of a run."""

    threshold: float
    deletions: int


PRESETS = {"conservative": Preset(0.85, 0), "moderate": Preset(0.75, 50), "aggressive": Preset(0.65, 200)}


def exact_duplicates(rows: DataFrame, hashed: Column) -> DataFrame:
    """(memory_id, related_memory_id): every newer copy of a hash with the oldest row of it (by creation, then id)."""
    keyed = rows.select("id", "created_at", hashed.alias("h"))
    oldest = keyed.groupBy("h").agg(F.min_by("id", F.struct("created_at", "id")).alias("related_memory_id"))
    return keyed.join(oldest, "h").where(F.col("id") != F.col("related_memory_id")).select(F.col("id").alias("memory_id"), "related_memory_id")


def negated(a: Column, b: Column) -> Column:
    """Whether a word of negation is in exactly one of two texts."""
    la, lb = F.lower(a), F.lower(b)
    return reduce(lambda x, y: x | y, [la.contains(w) != lb.contains(w) for w in NEGATIONS])


def opposed(a: Column, b: Column) -> Column:
    """Whether one text has a word and the other its opposite."""
    la, lb = F.lower(a), F.lower(b)
    return reduce(lambda x, y: x | y, [(la.contains(p) & lb.contains(q)) | (la.contains(q) & lb.contains(p)) for p, q in OPPOSITES])


def contradictions(pairs: DataFrame, threshold: float = PRESETS["moderate"].threshold) -> DataFrame:
    """pairs (id, other, similarity, content, other_content) alike from 0.7 up to the threshold whose texts deny each other."""
    alike = (F.col("similarity") >= 0.7) & (F.col("similarity") < threshold)
    no, anti = negated(F.col("content"), F.col("other_content")), opposed(F.col("content"), F.col("other_content"))
    return pairs.where(alike & (no | anti)).withColumn("confidence", F.lit(0.6)).withColumn("reason", F.when(anti, "antonyms").otherwise("negation"))


def near_duplicates(pairs: DataFrame, threshold: float) -> DataFrame:
    """(memory_id, related_memory_id, similarity) of pairs (id, other, similarity, created_at, other_created_at) from the threshold on: the newer one is proposed, each pair once."""
    newer = F.struct("created_at", "id") > F.struct(F.col("other_created_at").alias("created_at"), F.col("other").alias("id"))
    kept = pairs.where(F.col("similarity") >= threshold)
    return kept.select(F.when(newer, F.col("id")).otherwise(F.col("other")).alias("memory_id"), F.when(newer, F.col("other")).otherwise(F.col("id")).alias("related_memory_id"), "similarity").distinct()


def report(actions: DataFrame, analyzed: int) -> DataFrame:
    """(memories_analyzed, exact, near, contradictions, proposed, applied) of actions (action_type, confidence, status)."""
    is_ = lambda t: F.count_if(F.col("action_type") == t)
    exact = F.count_if((F.col("action_type") == "dedup") & (F.col("confidence") == 1.0))
    return actions.agg(F.lit(analyzed).alias("memories_analyzed"), exact.alias("exact"), (is_("dedup") - exact).alias("near"), is_("contradiction").alias("contradictions"), F.count("*").alias("proposed"), F.count_if(F.col("status") == "applied").alias("applied"))


def consolidate(actions: DataFrame, preset: Preset) -> DataFrame:
    """actions (memory_id, action_type, confidence) with status: the deletions that the cap allows are applied, by confidence; contradictions are flagged.

    A memory is deleted once however many actions name it.
    """
    fit = (F.col("action_type") == "dedup") & (F.col("confidence") >= preset.threshold)
    targets = actions.where(fit).groupBy("memory_id").agg(F.max("confidence").alias("c")).orderBy(F.desc("c"), "memory_id").limit(preset.deletions)
    applied = targets.select("memory_id", F.lit(True).alias("_a"))
    status = F.when(F.col("action_type") == "contradiction", "flagged").when(fit & F.col("_a"), "applied").otherwise("skipped")
    return actions.join(applied, "memory_id", "left").withColumn("status", status).drop("_a")
