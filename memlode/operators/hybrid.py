"""Hybrid retrieval: rank fusion, temporal decay, project boost and diversification."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR_WEIGHT, TEXT_WEIGHT, LEAST_SCORE = 0.7, 0.3, 0.05
HALF_LIFE_DAYS, DIVERSITY = 30.0, 0.7


def fuse(legs: list[tuple[DataFrame, float]], least: float = LEAST_SCORE) -> DataFrame:
    """(qid, id, score): the sum of weight / rank over the legs, each (qid, id, rank); scores under `least` are dropped."""
    parts = None
    for leg, weight in legs:
        part = leg.select("qid", "id", (F.lit(weight) / F.col("rank")).alias("s"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("qid", "id").agg(F.sum("s").alias("score")).where(F.col("score") >= least)


def decay(score: Column, created: Column, as_of: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """score halved every half_life days of age; the future has age 0, a half-life of 0 or less is 30 days, a null date no age."""
    days = (F.unix_micros(as_of) - F.unix_micros(created)) / F.lit(86400e6)
    rate = math.log(2) / (half_life if half_life > 0 else HALF_LIFE_DAYS)
    return score * F.exp(-rate * F.greatest(F.coalesce(days, F.lit(0.0)), F.lit(0.0)))


def project_boost(score: Column, project: Column, wanted: Column) -> Column:
    """1.3 for the wanted project, 1.1 for rows of none, else 1; nothing is boosted where no project is wanted."""
    none = project.isNull() | (project == "")
    factor = F.when(wanted.isNull() | (wanted == ""), 1.0).when(none, 1.1).when(project == wanted, 1.3).otherwise(1.0)
    return score * factor


def diversify(scored: DataFrame, k: int, weight: float = DIVERSITY) -> DataFrame:
    """(qid, id, score, rank): per query the k rows that maximal marginal relevance picks.

    scored is (qid, id, score, content) with at most a few hundred rows a query. Each step takes the row of the
    largest weight * score - (1 - weight) * likeness to the nearest row taken, likeness being the Jaccard index of the words over
    two bytes; the first is the best score, ties go to the smaller id. weight over 1 counts as 1, 0 or less as 0.7.
    """
    weight = DIVERSITY if weight <= 0 else min(weight, 1.0)
    schema = "qid {}, id {}, score double, rank int".format(scored.schema["qid"].dataType.simpleString(), scored.schema["id"].dataType.simpleString())

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        sets = [frozenset(w for w in (c or "").lower().split() if len(w.encode()) > 2) for c in pdf["content"]]
        left, nearest, taken = list(range(len(pdf))), [0.0] * len(pdf), []
        while left and len(taken) < k:
            best = max(left, key=lambda i: (weight * pdf["score"][i] - (1 - weight) * nearest[i], -i)) if taken else 0
            left.remove(best)
            taken.append(best)
            for i in left:
                either = len(sets[i] | sets[best])
                nearest[i] = max(nearest[i], len(sets[i] & sets[best]) / either if either else 0.0)
        out = pdf.loc[taken, ["qid", "id", "score"]]
        return out.assign(rank=range(1, len(out) + 1))

    return scored.select("qid", "id", "score", "content").groupBy("qid").applyInPandas(pick, schema)


def scored(text_leg: DataFrame, vector_leg: DataFrame, memories: DataFrame, queries: DataFrame, *, as_of: Column, half_life: float = HALF_LIFE_DAYS, entity_boost: float = 1.1) -> DataFrame:
    """(qid, id, score, content): the fused ranks of both legs by age, project and entities of the query."""
    fused = fuse([(vector_leg, VECTOR_WEIGHT), (text_leg, TEXT_WEIGHT)])
    rows = fused.join(memories.select("id", "project_id", "created_at", "content"), "id").join(queries.select("qid", "project", "entities"), "qid")
    low = F.lower("content")
    known = F.coalesce(F.exists("entities", lambda e: low.contains(F.lower(e))), F.lit(False))
    score = decay(F.col("score"), F.col("created_at"), as_of, half_life)
    score = project_boost(score, F.col("project_id"), F.col("project")) * F.when(known, entity_boost).otherwise(1.0)
    return rows.select("qid", "id", score.alias("score"), "content")


def hybrid_search(text_leg: DataFrame, vector_leg: DataFrame, memories: DataFrame, queries: DataFrame, *, as_of: Column, k: int = 20, candidates: int = 160, half_life: float = HALF_LIFE_DAYS, diversity: float = DIVERSITY, entity_boost: float = 1.1) -> DataFrame:
    """(qid, id, score, rank) of the best k memories of each query.

    The legs are (qid, id, rank), cut by the caller after its filters; memories has id, project_id, created_at, content; queries has
    qid, project (may be null) and entities (array, may be null). Either leg may be empty.
    """
    from memlode.operators.search import best

    rows = scored(text_leg, vector_leg, memories, queries, as_of=as_of, half_life=half_life, entity_boost=entity_boost)
    return diversify(best(rows, candidates), k, diversity)
