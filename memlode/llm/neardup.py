"""Near-duplicate texts: vantage-point trees over fingerprints.

Texts collapse to word sets, sets become 256-bit fingerprints whose Hamming distance bounds the difference of
the sets (see sets.py). A set goes to the shard of every word of its prefix, so that the shards overlap wherever
a similar set can lie. In each shard a vantage-point tree splits the fingerprints by their distance from a vantage
point; the halves are compared only over the strips that the triangle inequality leaves open. The pairs left are
checked by their words. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlode.llm.sets import Similarity, classes, features, meet, postings, verify, word_order
from memlode.operators.graph import connected_components
from memlode.session import cut


def distance(fp: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the fingerprints at a from those at b, by broadcasting."""
    total = np.bitwise_count(fp[0][a] ^ fp[0][b]).astype("i2")
    for lane in fp[1:]:
        total += np.bitwise_count(lane[a] ^ lane[b])
    return total


class Shard:
    """The pairs of one shard within their radius. fp: lanes of fingerprints; n: sizes of the sets."""

    def __init__(self, fp: list[np.ndarray], n: np.ndarray, sim: Similarity, leaf: int = 64, block: int = 512):
        self.fp, self.n, self.sim, self.leaf, self.block = fp, n.astype("i4"), sim, leaf, block
        self.compared = 0

    def within(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs a[i], b[i] those whose sizes and fingerprints allow them."""
        na, nb = self.n[a], self.n[b]
        keep = np.flatnonzero(self.sim.sizes_fit(np.minimum(na, nb), np.maximum(na, nb)))
        a, b, both = a[keep], b[keep], (na + nb)[keep]
        self.compared += len(a)
        near = distance(self.fp, a, b) <= self.sim.radius(both)
        return a[near], b[near]

    def across(self, left: np.ndarray, dl: np.ndarray, right: np.ndarray, dr: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of left and right; dl and dr are their distances from one vantage point, which bound their own."""
        if not len(left) or not len(right):
            return
        left, dl = left[o := np.argsort(dl, kind="stable")], dl[o]
        right, dr = right[o := np.argsort(dr, kind="stable")], dr[o]
        most = int(self.sim.radius(np.int64(self.n[left].max()) + int(self.n[right].max())))
        for at in range(0, len(left), self.block):
            part, dp = left[at : at + self.block], dl[at : at + self.block]
            lo, hi = np.searchsorted(dr, dp[0] - most, "left"), np.searchsorted(dr, dp[-1] + most, "right")
            for to in range(lo, hi, 4 * self.block):
                other, do = right[to : min(hi, to + 4 * self.block)], dr[to : min(hi, to + 4 * self.block)]
                radius = self.sim.radius(self.n[part][:, None] + self.n[other][None, :])
                i, j = np.nonzero(np.abs(dp[:, None] - do[None, :]) <= radius)
                yield self.within(part[i], other[j])

    def pairs(self, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of items, by a vantage-point tree."""
        stack = [items]
        while stack:
            s = stack.pop()
            if len(s) <= self.leaf:
                i, j = np.triu_indices(len(s), 1)
                yield self.within(s[i], s[j])
                continue
            d = distance(self.fp, s[:1], s).astype("i4")
            mu = int(np.median(d))
            inner = d <= mu if (d > mu).any() else d < mu
            if not inner.any():  # all are as far from the vantage point: it tells nothing apart
                half = len(s) // 2
                inner = np.arange(len(s)) < half
            a, b = s[inner], s[~inner]
            stack += [a, b]
            yield from self.across(a, d[inner], b, d[~inner])


def shard_pairs(w: np.ndarray, n: np.ndarray, fp: list[np.ndarray], sim: Similarity, leaf: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of all shards; rows are sorted by (w, n). Small shards, each a leaf, are compared side by side."""
    starts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
    sizes = np.diff(np.append(starts, len(w)))
    shard = Shard(fp, n, sim, leaf)
    left, right = [], []
    small = np.repeat(sizes <= leaf, sizes)
    ends = np.repeat(starts + sizes, sizes)
    active, step = np.flatnonzero(small), 1
    while len(active):
        active = active[active + step < ends[active]]
        active = active[sim.sizes_fit(n[active], n[active + step])]
        a, b = shard.within(active, active + step)
        left.append(a)
        right.append(b)
        step += 1
    for start, size in zip(starts[sizes > leaf], sizes[sizes > leaf]):
        for a, b in shard.pairs(np.arange(start, start + size)):
            left.append(a)
            right.append(b)
    none = np.zeros(0, dtype="i8")
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def prepare(rows: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members (key, id), word sets) of the texts; a row repeated under its id counts once, rows without an id not at all."""
    picked = rows.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).where(F.col("_id").isNotNull())
    feats = cut(features(picked, ("_id",), "_text"))
    return feats.select("key", F.col("_id").alias("id")).distinct(), cut(classes(feats))


def links(sets: DataFrame, similarity: float | str = 0.8, frequent: int = 65_536, hot: int = 4096) -> DataFrame:
    """(key_a, key_b, similarity) of all pairs of different word sets that are similar enough."""
    sim = Similarity.of(similarity)
    order = word_order(sets, frequent)
    fresh = sets.withColumn("old", F.lit(False))
    met = meet(postings(sets, order, sim, hot), lambda _: fresh, order, sim, hot, lambda w, n, fp, old: shard_pairs(w, n, fp, sim))
    return verify(met, fresh, sim).drop("old")


def near_duplicates(rows: DataFrame, *, id_col: str = "id", text: str = "content", similarity: float | str = 0.8) -> DataFrame:
    """One row (id, class, links, group) an id: its word set, how many other word sets are similar, its group.

    Ids with the same word set are a class, classes joined by links a group (named by its smallest class). Texts that
    are null or without words belong to no class and give no row; an empty table gives an empty one.
    Copies are never expanded into pairs.
    """
    members, sets = prepare(rows, id_col, text)
    found = cut(links(sets, similarity))
    ends = found.select(F.explode(F.array("key_a", "key_b")).alias("key")).groupBy("key").count()
    groups = connected_components(found, "key_a", "key_b")
    out = members.join(ends, "key", "left").join(groups.withColumnRenamed("node", "key"), "key", "left")
    return out.select("id", F.hex("key").alias("class"), F.coalesce("count", F.lit(0)).alias("links"), F.hex(F.coalesce("component", "key")).alias("group"))


def id_pairs(rows: DataFrame, *, id_col: str = "id", text: str = "content", similarity: float | str = 0.8, block: int = 4096) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all similar rows, copies included: for results that must name every pair.

    The search runs over word sets; only this last step multiplies members of the classes found. A class of more
    than `block` members is spread: one side is cut into blocks, the other sent to each, so that no task pairs more
    than a block with a class.
    """
    members, sets = prepare(rows, id_col, text)
    found = links(sets, similarity)
    sized = members.join(members.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks")), "key")
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks"))).otherwise(F.lit(0))
    one = sized.select("key", F.col("id").alias("a"), own.alias("s"))
    each = sized.select("key", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("s"))
    same = one.join(each, ["key", "s"]).where("a < b").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    # the members of key_a in their blocks, then those of key_b in theirs; a pair of classes becomes one of blocks
    blocks = sized.select("key", "blocks").distinct()
    ends = found.join(blocks.withColumnsRenamed({"key": "key_a", "blocks": "_a"}), "key_a").join(blocks.withColumnsRenamed({"key": "key_b", "blocks": "_b"}), "key_b")
    count = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    ends = ends.select("key_a", "key_b", F.explode(count("_a")).alias("s_a"), "_b").select("key_a", "key_b", "s_a", F.explode(count("_b")).alias("s_b"))
    a, b = (one.select(F.col("key").alias(f"key_{x}"), F.col("s").alias(f"s_{x}"), F.col("a").alias(x)) for x in "ab")
    across = ends.join(a, ["key_a", "s_a"]).join(b, ["key_b", "s_b"]).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    return across.unionByName(same)
