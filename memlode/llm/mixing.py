"""Mixing sources to target weights: Efraimidis-Spirakis sampling in token budgets.

Each document draws an exponential key, divided by its quality weight; the smallest keys of a source are a weighted
sample without replacement. A source's budget is spent first on complete epochs, then on the documents whose prefix sum of
tokens, in order of the keys, fits into the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.llm.tokens import VOCABULARY, token_sizes
from memlode.session import cut


def exponential(seed: int, *names: str) -> Column:
    """A draw from the exponential distribution that the seed and the columns fix."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *names), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53)))


class Mix:
    """documents: (id, source, uses, n_tokens) of what is used; report: a row a target."""

    def __init__(self, documents: DataFrame, report: DataFrame):
        self.documents, self.report = documents, report


def mix_sources(rows: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", source: str = "source", text: str = "text", total_tokens: int | None = None, reach: float = 0.5, seed: int = 7, vocabulary: str = VOCABULARY, rows_per_window: int = 50_000) -> Mix:
    """A mix in which each source of targets (source, target_weight, max_repeats) has its share of the tokens.

    total_tokens is the wanted size; null takes the largest at which sources of the part `reach` of the wanted weight can fill
    their budgets: 1 is every source that has documents and may use them, less lets scarce sources repeat up to their cap and run short.
    A source that can't fill its budget within max_repeats gives all it may, and its reached share falls short.
    The quality weight is the share of letters and spaces in a text, at least 0.05.
    Documents of other or null sources, and those without a token, are not used; targets with a null or
    non-positive weight get nothing; a listed source without documents is reported with 0. Of targets a source may
    be listed once. The report has wanted_share (of all weights), reached_share, tokens, documents, most_uses.
    """
    wanted = targets.select(F.col(source).alias("source"), F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("most"))
    whole = wanted.agg(F.sum("weight")).first()[0] or 0.0
    wanted = wanted.select("source", (F.col("weight") / whole if whole > 0 else F.lit(0.0)).alias("wanted_share"), "most")
    listed = rows.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    sized = token_sizes(listed.join(wanted.select("source"), "source", "left_semi"), ("id", "source"), "text", vocabulary)
    docs = cut(sized.where("n_tokens > 0").select("id", "source", "n_tokens", F.greatest("letter_share", F.lit(0.05)).alias("quality")))
    plan_sources = docs.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count("*").alias("n"), F.avg("quality").alias("mean"))
    plan = wanted.join(plan_sources, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    if total_tokens is not None:
        size = float(total_tokens)
    else:  # a row a target
        able = plan.where((F.col("have") > 0) & (F.col("most") > 0) & (F.col("wanted_share") > 0)).select("wanted_share", (F.col("have") * F.col("most") / F.col("wanted_share")).alias("able"))
        filled = able.select("able", F.sum("wanted_share").over(Window.orderBy(F.desc("able"))).alias("share"), F.sum("wanted_share").over(Window.partitionBy()).alias("all"))
        size = filled.where(F.col("share") >= F.col("all") * reach - 1e-9).agg(F.max("able")).first()[0] or 0.0
    budget = F.least(F.floor(F.lit(size) * F.col("wanted_share") + 1e-6), F.col("have") * F.col("most"))
    plan = plan.withColumn("budget", budget).withColumn("epochs", F.when(F.col("have") > 0, F.floor(F.col("budget") / F.greatest("have", F.lit(1)))).otherwise(0).cast("int"))
    plan = cut(plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("have")))

    # ranges of the key, of about rows_per_window documents each, bound what a window holds
    keyed = docs.join(plan.select("source", "mean", "n", "epochs", "rest"), "source").withColumn("key", exponential(seed, "id") / F.col("quality"))
    ranges = F.ceil(F.col("n") / rows_per_window)
    keyed = keyed.withColumn("range", F.least(ranges - 1, F.floor(ranges * (1 - F.exp(-F.col("key") * F.col("mean"))))))
    sums = keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("t"))
    before = sums.select("source", "range", (F.sum("t").over(Window.partitionBy("source").orderBy("range")) - F.col("t")).alias("before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("source", "range").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0))
    summed = keyed.join(before, ["source", "range"]).withColumn("end", F.col("before") + inner)
    # the document that crosses the budget is taken if at least half of it lies inside
    uses = F.col("epochs") + F.when(F.col("end") - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    used = cut(summed.select(F.col("id").alias(id_col), "source", uses.alias("uses"), "n_tokens").where("uses > 0"))
    spent = used.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    everything = spent.agg(F.sum("tokens")).first()[0] or 1
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tokens", "documents", "most_uses")}
    report = plan.select("source", "wanted_share").join(spent, "source", "left").withColumns(zero)
    report = report.select("source", "wanted_share", (F.col("tokens") / everything).alias("reached_share"), "tokens", "documents", "most_uses")
    return Mix(used, report)
