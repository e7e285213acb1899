"""The most similar vectors of every vector: vantage-point trees per shard.

The upper levels of a vantage-point tree, fitted on a bounded sample, cut the unit sphere into shards. Every vector
lives in one shard and asks in all shards that its ball may reach. Each shard has a vantage-point tree of its own.
At every node the triangle inequality rules out a side whose points are all farther from the vector than its
radius; `relax` divides the margin that this needs. At 1 the search is exact; larger factors look at fewer shards
and leaves and may miss neighbours. Inside a shard, where looking costs no shuffle, half the factor is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.session import cut, partitions

#: Slack for the rounding of 32-bit distances, so that factor 1 is exact.
EPS = 2e-3


def gap(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors x from one unit vector v."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ v)))


@dataclass
class Node:
    """A leaf holds places of points, an inner node a vantage point and the median distance from it."""

    leaf: int = -1
    points: np.ndarray | None = None
    vantage: np.ndarray | None = None
    mu: float = 0.0
    near: "Node | None" = None
    far: "Node | None" = None


def plant(x: np.ndarray, leaves: int | None = None, leaf_rows: int = 256) -> tuple[Node, int]:
    """A tree over x with about `leaves` leaves, or leaves of at most leaf_rows points; and the number of leaves.

    Of a few points at even places that with the widest spread of distances becomes the vantage point. Points that
    no vantage point tells apart stay in one leaf.
    """
    count = 0

    def grow(at: np.ndarray, share: int) -> Node:
        nonlocal count
        if not (share <= 1 if leaves else len(at) <= leaf_rows) and len(at) > 1:
            tries = x[at[:: max(1, len(at) // 12)][:12]]
            probe = x[at[:: max(1, len(at) // 256)]]
            spread = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (tries @ probe.T))).std(axis=1)
            v = tries[int(spread.argmax())]
            d = gap(v, x[at])
            mu = float(np.median(d))
            near = d <= mu
            if not near.all():
                return Node(vantage=v, mu=mu, near=grow(at[near], (share + 1) // 2), far=grow(at[~near], share // 2))
        count += 1
        return Node(leaf=count - 1, points=at)

    root = grow(np.arange(len(x)), leaves or 0)
    return root, count


def route(root: Node, x: np.ndarray, margin: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, places of x): those that live there, or with margins those whose ball may reach it."""
    stack = [(root, np.arange(len(x)))]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if node.vantage is None:
            yield node.leaf, at
            continue
        d = gap(node.vantage, x[at])
        m = 0.0 if margin is None else margin[at]
        near, far = d <= node.mu + m, (d > node.mu if margin is None else d > node.mu - m)
        stack += [(node.near, at[near]), (node.far, at[far])]


class Tree:
    """A vantage-point tree over the points of a cell, to be asked in batches."""

    def __init__(self, x: np.ndarray, leaf_rows: int = 256):
        self.x = x
        self.root, _ = plant(x, leaf_rows=leaf_rows)
        self.leaves: dict[int, Node] = {}
        self.inside = np.zeros(len(x), dtype="i4")
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.vantage is None:
                self.leaves[node.leaf] = node
                self.inside[node.points] = np.arange(len(node.points))
            else:
                todo += [node.near, node.far]
        self.leaf_of = np.zeros(len(x), dtype="i8")
        for leaf, node in self.leaves.items():
            self.leaf_of[node.points] = leaf

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, relax: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, cosine) of the k most similar points of each query with at least its floor.

        own is the place of the query itself among the points, or -1. The first descent, to the leaf a query belongs to,
        narrows its radius; the second visits what the narrowed ball reaches.
        """
        best = np.full((len(q), k), -2.0, dtype="f4")
        place = np.full((len(q), k), -1, dtype="i8")
        bound = floor.astype("f4").copy()
        visited = np.full(len(q), -1, dtype="i8")

        def look(node: Node, at: np.ndarray) -> None:
            for part in np.array_split(at, max(1, -(-len(at) * len(node.points) // 4_000_000))):
                s = q[part] @ self.x[node.points].T
                mine = np.flatnonzero((own[part] >= 0) & (self.leaf_of[own[part]] == node.leaf))
                s[mine, self.inside[own[part[mine]]]] = -2.0
                hit = np.flatnonzero(s.max(axis=1) >= bound[part])
                if not len(hit):
                    continue
                rows = part[hit]
                every = np.concatenate([best[rows], s[hit]], axis=1)
                where = np.concatenate([place[rows], np.broadcast_to(node.points, (len(rows), len(node.points)))], axis=1)
                top = np.argpartition(-every, k - 1, axis=1)[:, :k]
                best[rows], place[rows] = np.take_along_axis(every, top, 1), np.take_along_axis(where, top, 1)
                bound[rows] = np.maximum(bound[rows], best[rows].min(axis=1))

        for leaf, at in route(self.root, q, None):
            look(self.leaves[leaf], at)
            visited[at] = leaf
        margin = (np.sqrt(np.maximum(0.0, 2.0 - 2.0 * bound)) + EPS) / relax
        for leaf, at in route(self.root, q, margin):
            rest = at[visited[at] != leaf]
            if len(rest):
                look(self.leaves[leaf], rest)
        i, j = np.nonzero((place >= 0) & (best >= floor[:, None]))
        return i, place[i, j], best[i, j]


@dataclass(frozen=True)
class Grid:
    """How the shards are cut: points[leaf] blocks of points and asks[leaf] blocks of queries, the first cell of each leaf, the task of each cell.

    Every block of points meets every block of queries of its shard in a cell of its own, so that a task holds about shard_rows
    points, whatever the shard, and however many ask in it.
    """

    points: np.ndarray
    asks: np.ndarray
    first: np.ndarray
    task: np.ndarray
    tasks: int

    @staticmethod
    def of(lives: np.ndarray, asks: np.ndarray, shard_rows: int, least: int) -> "Grid":
        """lives and asks: how many are expected of each leaf."""
        p, a = (np.maximum(1, np.ceil(n / m)).astype("i8") for n, m in ((lives, shard_rows), (asks, 4 * shard_rows)))
        first = np.concatenate([[0], np.cumsum(p * a)])
        rows = np.repeat(lives / p + asks / a, p * a)
        tasks = int(min(len(rows), max(least, np.ceil(rows.sum() / (16 * shard_rows)))))
        # leaves beside one another share most of what asks in them: a task takes neighbours, and a vector goes to it once
        middle = np.cumsum(rows) - rows / 2
        task = np.minimum(tasks - 1, middle / max(1e-9, rows.sum()) * tasks).astype("i4")
        return Grid(p, a, first[:-1], task, tasks)


def unit_vectors(rows: DataFrame, id_col: str, vector: str, dims: int) -> DataFrame:
    """(id, key, v): usable vectors as unit vectors of 32-bit floats; key is a digest of v.

    Usable are vectors of exactly dims finite components that are not all zero; others, and null ids, give no row.
    """
    col = F.col(vector)
    usable = rows.select(F.col(id_col).alias("id"), col.cast("array<double>").alias("_v")).where(
        F.col("id").isNotNull() & (F.size("_v") == dims) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0)
    )
    id_type = usable.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            v = (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype("<f4")
            raw = pa.Array.from_buffers(pa.binary(4 * dims), len(v), [None, pa.py_buffer(v.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), raw], names=["id", "v"])

    out = usable.mapInArrow(run, f"id {id_type}, v binary")
    return out.select("id", F.unhex(F.md5("v")).alias("key"), "v")


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(whole.to_pylist()), dtype="<f4").reshape(-1, dims)


def neighbours(points: DataFrame, asking: DataFrame, *, k: int, dims: int, min_similarity: float | None, relax: float, shard_rows: int, fit_rows: int) -> DataFrame:
    """(q, p, similarity): of every key of asking the k most similar other keys of points. Both are (key, v), keys unique."""
    total = points.count()
    asked = total if asking is points else asking.count()
    rate = min(1.0, fit_rows / max(1, total))
    sample = points.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int(rate * (1 << 40)) + 1).select("v").limit(2 * fit_rows)
    fitted = matrix(sample.toArrow().column("v"), dims) if total else np.zeros((0, dims), dtype="f4")
    wanted = max(1, min(-(-total // shard_rows), len(fitted) // 16))
    root, leaves = plant(fitted, leaves=wanted)
    node_stack = [root]
    while node_stack:  # the tasks need no sample
        node = node_stack.pop()
        node.points = None
        node_stack += [n for n in (node.near, node.far) if n is not None]
    reach = fitted[:20_000] if min_similarity is None else None

    def floors(x: np.ndarray) -> np.ndarray:
        """Below which no neighbour of a query can lie."""
        floor = np.full(len(x), -2.0 if min_similarity is None else min_similarity, dtype="f4")
        if reach is not None and len(reach) > k + 1 and len(x):  # the k-th of a sample is never nearer than the k-th of all
            for part in np.array_split(np.arange(len(x)), -(-len(x) // 256)):
                floor[part] = np.partition(x[part] @ reach.T, -(k + 1), axis=1)[:, -(k + 1)] - np.float32(1e-5)
        return floor

    def margins(floor: np.ndarray) -> np.ndarray:
        return (np.sqrt(np.maximum(0.0, 2.0 - 2.0 * floor)) + EPS) / relax

    # what the sample does foretells how full the shards become; a wrong guess makes a task larger, not the result wrong
    few = fitted[:4096]
    lives, asks = np.zeros(leaves), np.zeros(leaves)
    for counts, margin, of in ((lives, None, total), (asks, margins(floors(few)), asked)):
        for leaf, at in route(root, few, margin):
            counts[leaf] += len(at) * of / max(1, len(few))
    grid = Grid.of(lives, asks, shard_rows, min(partitions(points), points.sparkSession.sparkContext.defaultParallelism))

    def send(live: bool, ask: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column("v"), dims)
                own = np.array([int.from_bytes(key.as_py()[:6], "little") for key in batch.column("key")], dtype="i8")
                home = np.full(len(x), -1, dtype="i8")
                for leaf, at in route(root, x, None):
                    home[at] = leaf
                floor = floors(x) if ask else np.zeros(len(x), dtype="f4")
                block_p, block_a = own % grid.points[home], own // 4096
                out = []  # (place, cell, lives, asks)
                if live:
                    for i in range(int(grid.asks[home].max())):
                        at = np.flatnonzero(grid.asks[home] > i)
                        mine = (block_a[at] % grid.asks[home[at]] == i) & ask
                        out.append((at, grid.first[home[at]] + block_p[at] * grid.asks[home[at]] + i, np.ones(len(at), dtype="?"), mine))
                for leaf, at in route(root, x, margins(floor)) if ask else ():
                    for j in range(int(grid.points[leaf])):
                        to = at[~(live & (home[at] == leaf) & (block_p[at] == j))]  # there it is sent already, for both roles
                        out.append((to, grid.first[leaf] + j * grid.asks[leaf] + block_a[to] % grid.asks[leaf], np.zeros(len(to), dtype="?"), np.ones(len(to), dtype="?")))
                at, cell, is_live, is_ask = (np.concatenate(c) for c in zip(*out))
                code = 4 * cell + 2 * is_live + is_ask
                order = np.lexsort((code, grid.task[cell], at))
                at, code, task = at[order], code[order], grid.task[cell[order]]
                first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (task[1:] != task[:-1]))) if len(at) else np.zeros(0, dtype="i8")
                to = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype("i4")), pa.array(code.astype("i8")))
                got = batch.select(["key", "v"]).take(pa.array(at[first]))
                yield pa.RecordBatch.from_arrays([pa.array(task[first]), to, pa.array(floor[at[first]]), *got.columns], names=["task", "to", "floor", "key", "v"])

        return run

    schema = "task int, to array<bigint>, floor float, key binary, v binary"  # to: 4 * cell + 2 * lives + asks
    if asking is points:
        sent = points.mapInArrow(send(True, True), schema)
    else:
        sent = points.mapInArrow(send(True, False), schema).unionByName(asking.mapInArrow(send(False, True), schema))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, at = None, None, {}
        held: list[pa.RecordBatch] = []  # points of the cell
        waiting: list[pa.RecordBatch] = []  # queries

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal tree, at, waiting, held
            if held and tree is None:
                t = pa.Table.from_batches(held)
                at = {key: i for i, key in enumerate(t.column("key").to_pylist())}
                tree = Tree(matrix(t.column("v"), dims)), list(at)
                held = []
            if tree and waiting:
                a = pa.Table.from_batches(waiting)
                mine = a.column("key").to_pylist()
                own = np.array([at.get(key, -1) for key in mine], dtype="i8")
                i, j, s = tree[0].search(matrix(a.column("v"), dims), own, k, a.column("floor").to_numpy(), max(1.0, relax / 2))
                yield pa.RecordBatch.from_arrays([pa.array([mine[x] for x in i], pa.binary()), pa.array([tree[1][x] for x in j], pa.binary()), pa.array(s)], names=["q", "p", "similarity"])
            waiting = []

        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else []
            for lo, hi in zip(edges, [*edges[1:], len(cell)]):
                if cell[lo] != now:
                    yield from answer()
                    now, tree, at, held = cell[lo], None, {}, []
                part = batch.slice(lo, hi - lo)
                points_of = part.filter(part.column("lives"))
                if points_of.num_rows:  # they come before those that only ask
                    held.append(points_of)
                waiting.append(part.filter(part.column("asks")))
                if tree is None and points_of.num_rows == part.num_rows:
                    continue
                if sum(b.num_rows for b in waiting) >= 4 * shard_rows:
                    yield from answer()
        yield from answer()

    arrived = sent.repartitionById(grid.tasks, F.col("task")).select(F.explode("to").alias("code"), "floor", "key", "v")
    cell, bit = F.shiftright("code", 2).cast("int"), lambda b: F.col("code").bitwiseAND(F.lit(b)) != 0
    placed = arrived.select(cell.alias("cell"), bit(2).alias("lives"), bit(1).alias("asks"), "floor", "key", "v").sortWithinPartitions("cell", F.desc("lives"))
    found = placed.mapInArrow(cells, "q binary, p binary, similarity float")
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "p")))
    return ranked.where(F.col("_r") <= k).drop("_r")


def knn(rows: DataFrame, *, id_col: str = "id", vector: str = "embedding", dims: int = 64, k: int = 5, min_similarity: float | None = None, asking: DataFrame | None = None, relax: float = 8.0, shard_rows: int = 16_384, fit_rows: int = 65_536) -> DataFrame:
    """(id, neighbour, similarity, rank): the k rows of the most similar vectors of every row (or of the ids of asking).

    With min_similarity, of those at least as similar. Cosine is the similarity; equals are ranked by id. Vectors that
    are null, of another length, not finite or all zero take no part; a repeated row counts once; an empty table
    gives an empty one. Equal vectors are searched once and share what is found: of a class of copies only the k + 1 smallest
    ids can be neighbours, so a hot vector is never gathered in one task.
    """
    found = cut(unit_vectors(rows, id_col, vector, dims))
    members = found.select("key", "id").distinct()
    points = cut(found.groupBy("key").agg(F.first("v").alias("v")))
    asks = members if asking is None else members.join(asking.select(F.col(asking.columns[0]).alias("id")).distinct(), "id", "left_semi")
    asked = points if asking is None else points.join(asks.select("key").distinct(), "key", "left_semi")
    near = neighbours(points, asked, k=k, dims=dims, min_similarity=min_similarity, relax=relax, shard_rows=shard_rows, fit_rows=fit_rows)
    first = members.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("_r") <= k + 1).select("key", F.col("id").alias("other"))
    copied = first.groupBy("key").count().where("count > 1").select("key")
    own = first.join(copied, "key", "left_semi").select("key", "other", F.lit(1.0).cast("float").alias("s"))
    others = near.join(first.withColumnRenamed("key", "p"), "p").select(F.col("q").alias("key"), "other", F.col("similarity").alias("s"))
    lists = own.unionByName(others).groupBy("key").agg(F.collect_list(F.struct((-F.col("s")).alias("d"), "other")).alias("l"))
    ranked = asks.join(lists, "key").select("id", F.slice(F.filter(F.array_sort("l"), lambda x: x.other != F.col("id")), 1, k).alias("l"))
    flat = ranked.select("id", F.posexplode("l").alias("rank", "n"))
    return flat.select("id", F.col("n.other").alias("neighbour"), (-F.col("n.d")).alias("similarity"), (F.col("rank") + 1).alias("rank"))
