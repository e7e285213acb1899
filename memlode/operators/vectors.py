"""Exact nearest vectors of a set of queries, in blocks of bounded size that no driver loop builds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.operators.kept import Kept
from memlode.session import partitions


class Best:
    """The k highest scores of each query so far, ties by id; memory is 16 bytes for k rows a query however many rows go by.

    A product in single precision finds the rows that may be among them, and their scores are then computed in double
    precision, one by one, so that equal vectors have equal scores wherever they lie.
    """

    def __init__(self, ids: list, q: np.ndarray, k: int | None, floor: float, inclusive: bool = False):
        self.ids, self.q, self.k, self.floor, self.inclusive = ids, q, k, floor, inclusive
        self.single, self.kept = q.astype("f4"), Kept(len(ids), k)
        self.error = 2.4e-7 * (q.shape[1] + 8)  # twice what single precision may be off by
        self.own: dict = {}
        for i, x in enumerate(ids):
            self.own.setdefault(x, []).append(i)

    def add(self, ids: list, x: np.ndarray) -> None:
        step = max(256, min(4096, 8_000_000 // max(1, len(self.q))))  # bounds the matrix of scores
        for at in range(0, len(ids), step):
            part, own = x[at : at + step], ids[at : at + step]
            s = self.single @ part.T.astype("f4")
            same = [(i, j) for j, other in enumerate(own) for i in self.own.get(other, ())]
            if same:
                s[tuple(np.array(same).T)] = -np.inf
            least = np.maximum(self.kept.bound, self.floor) - self.error
            met = s >= least[:, None]
            if same:
                met[tuple(np.array(same).T)] = False
            if self.k is not None and s.shape[1] > self.k and np.count_nonzero(met) > self.k * len(s) // 2:
                met &= s >= (np.partition(s, -self.k, axis=1)[:, -self.k] - np.float32(self.error))[:, None]  # all that may reach the k-th score go on
            i, j = np.nonzero(met)
            score = np.concatenate([(self.q[i[n : n + 65_536]] * part[j[n : n + 65_536]]).sum(1) for n in range(0, len(i), 65_536)] or [np.zeros(0)])
            good = score >= self.floor if self.inclusive else score > self.floor
            self.kept.add(i[good], j[good] + self.kept.documents(own), score[good])
            self.kept.settle()

    def tables(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The hits so far; without k they are given once."""
        row, other, score = self.kept.hits()
        for n in range(0, len(row), 65_536):
            here = slice(n, n + 65_536)
            yield pa.RecordBatch.from_arrays([pa.array([self.ids[i] for i in row[here]], kind), pa.array([self.kept.ids[i] for i in other[here]], kind), pa.array(score[here])], names=["qid", "id", "score"])
        if self.k is None:
            self.kept = Kept(len(self.ids), None)


def units(batch: pa.RecordBatch, dims: int) -> tuple[list, np.ndarray]:
    """Ids and unit vectors of the rows whose vector is finite and not all zero."""
    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dims)
    with np.errstate(all="ignore"):
        n = np.sqrt((x * x).sum(1))
    good = np.flatnonzero(np.isfinite(n) & (n > 0))
    ids = batch.column("id").to_pylist()
    return [ids[i] for i in good], x[good] / n[good, None]


def scores(rows: DataFrame, queries: DataFrame, *, id_col: str, vector: str, dims: int, k: int | None, floor: float, inclusive: bool, block: int) -> DataFrame:
    """(qid, id, score): of each query the k best rows of each task, or, without k, all of them above the floor."""
    # vectors in single precision travel as such
    vectors = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dims))
    asked, data = vectors(queries), vectors(rows)
    kind = asked.schema["id"].dataType.simpleString()
    out = f"qid {kind}, id {kind}, score double"
    n = asked.count()
    if n <= block:  # at most `block` vectors reach the driver and travel with the tasks; the rows are not shuffled
        table = asked.toArrow().combine_chunks()
        ids, q = units(table.to_batches()[0], dims) if table.num_rows else ([], np.zeros((0, dims)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, of = Best(ids, q, k, floor, inclusive), None
            for batch in batches:
                if batch.num_rows and len(ids):
                    of = batch.schema.field("id").type
                    best.add(*units(batch, dims))
                    if k is None:
                        yield from best.tables(of)
            if of is not None:
                yield from best.tables(of)

        # every task sends up to k rows a query: no more tasks than cores
        return (data if k is None else data.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))).mapInArrow(run, out)
    # every block of queries meets every stripe of rows in a cell: queries first, then the rows as a stream
    blocks, stripes = -(-n // block), partitions(data)
    if k is not None:  # two cells a core, for the same reason
        stripes = min(stripes, max(1, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), every(stripes).alias("s"), F.lit(0).alias("role"))
    r = data.select("id", "v", every(blocks).alias("b"), F.pmod(F.xxhash64("id"), F.lit(stripes)).cast("int").alias("s"), F.lit(1).alias("role"))
    cells = q.unionByName(r).select("id", "v", (F.col("b") * stripes + F.col("s")).cast("int").alias("cell"), "role")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, held, of = None, None, [], None
        for batch in batches:
            cell, role = batch.column("cell").to_numpy(), batch.column("role").to_numpy()
            edges = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (role[1:] != role[:-1]))) if len(cell) else []
            for lo, hi in zip(edges, [*edges[1:], len(cell)]):
                part, of = batch.slice(lo, hi - lo), batch.schema.field("id").type
                if cell[lo] != now:
                    if best is not None:
                        yield from best.tables(of)
                    now, best, held = cell[lo], None, []
                if role[lo] == 0:
                    held.append(units(part, dims))
                elif held:
                    if best is None:
                        best = Best([x for h in held for x in h[0]], np.concatenate([h[1] for h in held]), k, floor, inclusive)
                    best.add(*units(part, dims))
                    if k is None:
                        yield from best.tables(of)
        if best is not None:
            yield from best.tables(of)

    return cells.repartitionById(blocks * stripes, F.col("cell")).sortWithinPartitions("cell", "role").mapInArrow(meet, out)


def top_k(rows: DataFrame, queries: DataFrame, *, id_col: str, vector: str, dims: int, k: int, floor: float | None = None, block: int = 16_384) -> DataFrame:
    """(qid, id, score, rank): of each query (id, vector) the k rows of the highest cosine, ties by id; itself excluded.

    Every task keeps its own best k of each query, so that the shuffle carries k rows a query and task. Up to `block` queries
    travel with the tasks; more are cut into blocks, and every block meets every stripe of rows once. Vectors that are null, of another
    length, not finite or all zero take no part. Rows whose cosine is not above floor are left out.
    """
    found = scores(rows, queries, id_col=id_col, vector=vector, dims=dims, k=k, floor=-np.inf if floor is None else floor, inclusive=False, block=block)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def above(rows: DataFrame, queries: DataFrame, *, id_col: str, vector: str, dims: int, threshold: float, block: int = 16_384) -> DataFrame:
    """(qid, id, score): all rows of a cosine of at least threshold with each query, itself excluded: a theta join in blocks."""
    return scores(rows, queries, id_col=id_col, vector=vector, dims=dims, k=None, floor=threshold, inclusive=True, block=block)
