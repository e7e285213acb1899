"""Deduplicating new batches against all history: multi-key sorted-neighbourhood runs.

The index keeps every accepted word set under one key per prefix word (see sets.py), in runs: files cut into key
ranges and sorted by (key, size of the set). A batch is sorted the same way and merged with the key ranges it touches;
a new record is compared only with the window around it, the sets under the same key whose size a similar set may
have. The windows hold every similar set, so nothing is lost and nothing is capped. What is accepted becomes a run of its own;
runs are merged when they grow many, small ones first. The history is tokenized and sorted once, and a manifest in the
folder of the index lets another session go on with it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from memlode.llm.neardup import distance
from memlode.llm.sets import POSTING, Order, Similarity, classes, features, meet, postings, verify, word_order
from memlode.session import cut, delete, shared_dir

_LANES = [f"fp{i}" for i in range(4)]
SETS = "key binary, k long, words array<long>, fp0 long, fp1 long, fp2 long, fp3 long"
#: Pairs of a window that are compared at a time.
STEP = 2_000_000
#: Rows of a page of a run's files; a page is the least that a lookup reads.
PAGE_ROWS = 1_000
#: Keys of a batch that are handed to the scan at most; a batch of more keys is joined with the ranges it touches.
MOST_LOOKUPS = 200
#: Edges that one task decides at most.
EDGES = 1_000_000


@dataclass(frozen=True)
class Run:
    """A table of postings or sets: its folder under the index and its number of rows."""

    path: str
    rows: int


def windows(w: np.ndarray, n: np.ndarray, fp: list[np.ndarray], old: np.ndarray, sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a new record and one in its window: under the same key, of a size a similar set may have, with a near fingerprint.

    Rows are sorted by (w, n). Of two new ones each pair comes once.
    """
    starts = np.append(True, w[1:] != w[:-1])
    group = np.cumsum(starts) - 1
    span = int(n.max()) + 2
    at = group * span + n
    new = np.flatnonzero(~old)
    least, most = -(-n[new] * sim.num // sim.den), n[new] * sim.den // sim.num
    lo = np.searchsorted(at, group[new] * span + least, "left")
    hi = np.searchsorted(at, group[new] * span + np.minimum(most, span - 1), "right")
    size = hi - lo
    ends = np.cumsum(size)
    left, right, i = [], [], 0
    while i < len(new):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, "right")))
        part = size[i:j]
        a = np.repeat(new[i:j], part)
        b = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part) + np.repeat(lo[i:j], part)
        keep = np.flatnonzero(old[b] | (a < b))
        a, b = a[keep], b[keep]
        near = distance(fp, a, b) <= sim.radius(n[a] + n[b])
        left.append(a[near])
        right.append(b[near])
        i = j
    none = np.zeros(0, dtype="i8")
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


class HistoryIndex:
    """The persisted key ranges in a folder all executors share."""

    def __init__(self, spark: SparkSession, similarity: float | str = 0.8, path: str | None = None, frequent: int = 65_536, hot: int = 4096, most_runs: int = 8, sets_per_range: int = 50_000):
        self.spark, self.sim, self.similarity = spark, Similarity.of(similarity), str(similarity)
        self.path = path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
        self.frequent, self.hot, self.most_runs, self.sets_per_range = frequent, hot, most_runs, sets_per_range
        self.order = Order(*(np.zeros(0, dtype="i8") for _ in range(3)))
        self.runs: list[Run] = []
        self.set_runs: list[Run] = []
        self.ranges, self.version = 8, 0

    # What is kept -----------------------------------------------------------------------------------------------

    @staticmethod
    def open(spark: SparkSession, path: str) -> "HistoryIndex":
        """The index that another session left in a folder, as of its last manifest."""
        rows = spark.read.text(f"{path}/manifests/*").collect()  # a row an ingestion
        last = max((json.loads(r["value"]) for r in rows), key=lambda m: m["version"])
        out = HistoryIndex(spark, last["similarity"], path, **last["settings"])
        out.version, out.ranges = last["version"], last["ranges"]
        out.runs, out.set_runs = ([Run(*r) for r in last[name]] for name in ("runs", "set_runs"))
        kept = spark.read.parquet(f"{path}/order").toArrow()  # at most `frequent` rows
        out.order = Order(*(kept.column(c).to_numpy() for c in ("word", "rank", "sets")))
        return out

    def _commit(self) -> None:
        """Writes the next manifest; what a failed write leaves behind is never named by one."""
        self.version += 1
        state = {
            "version": self.version, "similarity": self.similarity, "ranges": self.ranges,
            "settings": {"frequent": self.frequent, "hot": self.hot, "most_runs": self.most_runs, "sets_per_range": self.sets_per_range},
            "runs": [[r.path, r.rows] for r in self.runs], "set_runs": [[r.path, r.rows] for r in self.set_runs],
        }
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/manifests/{self.version:08d}")

    def drop(self) -> None:
        """Deletes the index."""
        delete(self.spark, self.path)

    def _write(self, rows: DataFrame, kind: str, range_of: str, *order: str) -> Run:
        """rows as a run: a folder for each range, its file sorted by order."""
        name = f"{kind}-{uuid.uuid4().hex}"
        ranged = rows.withColumn("r", F.pmod(F.col(range_of), F.lit(self.ranges)).cast("int"))
        ranged = ranged.repartition(min(self.ranges, 4096), "r").sortWithinPartitions("r", *order)
        written = Observation()
        ranged.observe(written, F.count(F.lit(1)).alias("n")).write.option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("r").parquet(f"{self.path}/{name}")
        return Run(name, written.get["n"])

    def _read(self, runs: list[Run], columns: str) -> DataFrame:
        """All rows of runs."""
        parts = [self.spark.read.schema(columns + ", r int").parquet(f"{self.path}/{r.path}") for r in runs if r.rows]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], columns + ", r int")

    def _near(self, runs: list[Run], columns: str, by: str, wanted: DataFrame) -> DataFrame:
        """The rows of runs whose key `by` is among those of wanted.

        Only ranges that wanted touches are read, and of their sorted pages, if there are few keys, only those that may hold one.
        The history is not shuffled: it is filtered where it is read.
        """
        keys = wanted.select(by).distinct()
        few = [r[0] for r in keys.limit(MOST_LOOKUPS + 1).collect()]
        rows = self._read(runs, columns)
        if len(few) <= MOST_LOOKUPS:
            self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(MOST_LOOKUPS))  # else pages are not skipped by their keys
            touched = sorted({k % self.ranges for k in few})
            return rows.where(F.col("r").isin(touched) & F.col(by).isin(few)).drop("r") if few else rows.limit(0).drop("r")
        touched = sorted(r[0] for r in keys.select(F.pmod(F.col(by), F.lit(self.ranges)).cast("int")).distinct().collect())  # at most the ranges
        return rows.where(F.col("r").isin(touched)).join(keys, by, "left_semi").drop("r")

    def build(self, history: DataFrame, text: str = "content") -> "HistoryIndex":
        """The first run, of all texts of history. It also fixes the order of words, which stays valid for all later batches."""
        found = cut(classes(features(history.select(F.col(text).alias("_text")), (), "_text")))
        self.ranges = max(8, -(-found.count() // self.sets_per_range))
        self.order = word_order(found, self.frequent)
        words = self.spark.createDataFrame(list(zip(*(x.tolist() for x in (self.order.words, self.order.ranks, self.order.counts)))), "word long, rank long, sets long")
        words.coalesce(1).write.parquet(f"{self.path}/order")
        self._keep(found, postings(found, self.order, self.sim, self.hot, copies=True))
        self._commit()
        return self

    def _keep(self, sets: DataFrame, posted: DataFrame) -> None:
        self.set_runs.append(self._write(sets.select("key", "k", "words", *_LANES), "sets", "k", "k"))
        self.runs.append(self._write(posted.withColumn("m", F.col("m").bitwiseOR(F.lit(1).cast("long"))), "run", "w", "w", "m"))

    def compact(self) -> None:
        """Merges the youngest runs, as many as are not much larger than what is merged already, into one; then the sets alike.

        So a large run is rewritten only once the younger ones have grown to half of it: every row is merged a
        logarithmic number of times.
        """

        def merged(runs: list[Run], kind: str, columns: str, range_of: str, *order: str) -> list[Run]:
            keep, rows, part = list(runs), 0, []
            while keep and (len(part) < 2 or keep[-1].rows <= 2 * rows):
                part.append(keep.pop())
                rows += part[-1].rows
            return [*keep, self._write(self._read(part, columns).drop("r"), kind, range_of, *order)] if len(part) > 1 else runs

        old = {r.path for r in (*self.runs, *self.set_runs)}
        self.runs = merged(self.runs, "run", POSTING, "w", "w", "m")
        self.set_runs = merged(self.set_runs, "sets", SETS, "k", "k")
        self._commit()
        for path in old - {r.path for r in (*self.runs, *self.set_runs)}:
            delete(self.spark, f"{self.path}/{path}")

    # What a batch meets -----------------------------------------------------------------------------------------

    def _sets(self, wanted: DataFrame) -> DataFrame:
        return self._near(self.set_runs, SETS, "k", wanted).withColumn("old", F.lit(True))

    def ingest(self, batches: DataFrame, *, order_by: tuple[str, ...] = ("batch_no", "seq_no", "id"), text: str = "content") -> DataFrame:
        """Every record of one or more pending batches with accepted (boolean); what is accepted joins the index.

        Returns the columns of order_by and accepted. A record is refused if its word set equals or is similar to one of the
        history or of an earlier record, in order_by, that was accepted; pending batches taken at once or one after the other
        give the same. Records that are null or without words resemble nothing and are accepted, but not indexed. A row
        repeated in all of order_by counts once; an empty batch gives an empty table.
        """
        names, order_by = order_by, tuple(f"_o{i}" for i in range(len(order_by)))
        records = batches.select(*(F.col(c).alias(o) for c, o in zip(names, order_by)), F.col(text).alias("_text")).dropDuplicates([*order_by])
        feats = cut(features(records.withColumn("at", F.struct(*order_by)).select("at", "_text"), ("at",), "_text"))
        # one row a word set, at its first place; pos keeps the order in one number
        first = feats.groupBy("key").agg(F.min("at").alias("at"), *(F.first(c).alias(c) for c in ("k", "words", *_LANES)))
        new = cut(first.sort("at").withColumn("pos", F.monotonically_increasing_id())).withColumn("old", F.lit(False))
        posted = postings(new, self.order, self.sim, self.hot, copies=True)
        if self.runs:
            posted = cut(posted)
            posted = posted.unionByName(self._near(self.runs, POSTING, "w", posted))
        lookup = lambda ks: new.unionByName(self._sets(ks.where("old")), allowMissingColumns=True)
        sim = self.sim
        met = cut(meet(posted, lookup, self.order, sim, self.hot, lambda w, n, fp, old: windows(w, n, fp, old, sim)))
        known = self._sets(met.where("old").select(F.col("kb").alias("k"))).select("k", "key", "words", "old")
        similar = cut(verify(met, new.select("k", "key", "words", "old").unionByName(known), self.sim))
        seen = similar.where("old").select(F.col("key_a").alias("key")).distinct()
        fresh = cut(new.join(seen, "key", "left_anti"))
        at = fresh.select("key", "pos")
        ends = similar.where("not old").join(at.withColumnsRenamed({"key": "key_a", "pos": "a"}), "key_a").join(at.withColumnsRenamed({"key": "key_b", "pos": "b"}), "key_b")
        edges = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        taken = cut(fresh.join(refused(edges), "pos", "left_anti"))
        if not taken.isEmpty():
            self._keep(taken, postings(taken, self.order, self.sim, self.hot, copies=True))
            self._commit()
            if len(self.runs) > self.most_runs:
                self.compact()
        accepted = taken.select(F.col("at").alias("_at"), F.lit(True).alias("_yes"))
        worded = feats.select(F.col("at").alias("_at"), F.lit(True).alias("_indexed"))
        rows = records.select(F.struct(*order_by).alias("_at"))
        marked = rows.join(worded, "_at", "left").join(accepted, "_at", "left")
        return marked.select(*(F.col(f"_at.{o}").alias(c) for c, o in zip(names, order_by)), (F.coalesce("_yes", F.lit(False)) | F.col("_indexed").isNull()).alias("accepted"))


def decide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The refused ends of edges sorted by b: a later end is refused if an earlier end of it is not."""
    gone: set[int] = set()
    for x, y in zip(a.tolist(), b.tolist()):
        if x not in gone:
            gone.add(y)
    return np.fromiter(sorted(gone), dtype="i8", count=len(gone))


def refused(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(pos) of the later ends that an accepted earlier end refuses, decided in order.

    edges (a, b): b resembles the earlier a. Whether an end is refused follows from the edges up to it, so the edges
    with the smallest b, at most `most`, are decided by one task; what it accepted then refuses later ends and what it
    refused drops out, for the next `most` edges. The rounds follow from the number of edges, not from the length of chains.
    """
    edges = cut(edges.distinct())
    out = None
    while True:
        n = edges.count()
        head = edges
        if n > most:
            bound = edges.agg(F.approx_percentile("b", F.lit(most / n), F.lit(1_000_000)).alias("q")).first()["q"]
            head = edges.where(F.col("b") <= bound)
        gone = cut(_one_task(head))
        out = gone if out is None else out.unionByName(gone)
        if head is edges:
            return out.distinct()
        rest = edges.where(F.col("b") > bound).join(gone.withColumnRenamed("pos", "a"), "a", "left_anti")
        hit = cut(rest.where(F.col("a") <= bound).select(F.col("b").alias("pos")).distinct())
        out = out.unionByName(hit)
        rest = rest.where(F.col("a") > bound)
        for end in "ab":
            rest = rest.join(hit.withColumnRenamed("pos", end), end, "left_anti")
        edges = cut(rest)


def _one_task(edges: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).sort_by("b")
            yield pa.RecordBatch.from_arrays([pa.array(decide(t.column("a").to_numpy(), t.column("b").to_numpy()))], names=["pos"])

    return edges.coalesce(1).mapInArrow(run, "pos long")
