"""Filling fixed-capacity containers: bounded-space online best-fit.

Items come in order; each goes into the open container whose free space it fills best. At most `open_bins`
are open: when no open one fits, the fullest closes. The open ones are found through a bitset with a bit for every amount of
free space that some open container has, so that the best fit is the lowest bit at or above the size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlode.llm.tokens import VOCABULARY, token_sizes
from memlode.session import cut


class BestFit:
    """Assigns sizes to containers numbered from 0; free is what the open ones have left."""

    def __init__(self, capacity: int, open_bins: int = 64):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.by_free, self.count, self.open = 0, {}, 0, 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_ = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        return bin_

    def add(self, size: int) -> int:
        if not 0 <= size <= self.capacity:
            raise ValueError("an item must fit into an empty container")
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            free, bin_ = self.capacity, self.count
            self.count += 1
            self.open += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(bin_)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return bin_

    def still_open(self) -> dict[int, int]:
        """Container and used space of those that would take more."""
        return {b: self.capacity - free for free, bins in self.by_free.items() for b in bins}


def pack_sizes(items: DataFrame, capacity: int, *, open_bins: int = 64, items_per_task: int = 20_000) -> DataFrame:
    """items (item, part, size), sizes up to capacity, with their container.

    Items are dealt to tasks by the hash of their name and packed there in order of (item, part). What is still open when a
    task ends is packed again, as whole containers, until one task holds all of it; so only open_bins in all stay
    badly filled, however many the tasks.
    """
    total = items.count()
    tasks = max(1, -(-total // items_per_task))
    name = items.schema["item"].dataType.simpleString()

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([("item", "ascending"), ("part", "ascending")])
        fit = BestFit(capacity, open_bins)
        bins = [fit.add(s) for s in t.column("size").to_pylist()]
        last = fit.still_open()
        task = t.column("task")[0].as_py()
        return pa.table({"item": t.column("item"), "part": t.column("part"), "size": t.column("size"), "container": pa.array([f"{task:x}-{b:x}" for b in bins]), "used": pa.array([last.get(b) for b in bins], pa.int64())})

    def dealt(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("task", F.pmod(F.xxhash64("item"), F.lit(n)))

    filled = f"item {name}, part int, size long, container string, used long"
    packed = cut(dealt(items.select("item", "part", F.col("size").cast("long")), tasks).groupBy("task").applyInArrow(fill, filled))
    # only the containers still open go on to the next level, and one small table says where they ended
    still = lambda df: df.where("used is not null").groupBy("container").agg(F.first("used").alias("size"))
    left = still(packed)
    moved = left.select("container", F.col("container").alias("to"))
    level = 0
    while tasks > 1:
        level += 1
        # a fraction of the tasks, with at least the open containers of two in each
        tasks = -(-tasks * open_bins // max(items_per_task, 2 * open_bins))
        again = dealt(left.select(F.col("container").alias("item"), F.lit(0).alias("part"), "size"), tasks).groupBy("task").applyInArrow(fill, filled.replace(f"item {name}", "item string"))
        again = cut(again.select("item", F.concat(F.lit(f"m{level}-"), "container").alias("container"), "used"))
        moved = cut(moved.join(again.select(F.col("item").alias("to"), F.col("container").alias("_next")), "to", "left").select("container", F.coalesce("_next", "to").alias("to")))
        left = still(again)
    if level:
        packed = packed.join(moved, "container", "left").withColumn("container", F.coalesce("to", "container"))
    return packed.select("item", "part", "size", "container")


def pack_texts(rows: DataFrame, *, id_col: str = "doc_id", text: str = "text", capacity: int = 4096, open_bins: int = 64, vocabulary: str = VOCABULARY, items_per_task: int = 20_000) -> DataFrame:
    """(container, id, piece_no, start_token, n_tokens): every text in a container of `capacity` tokens.

    A text is whole (piece 0 from token 0) unless it alone exceeds the capacity; then it gives full pieces and a rest, each an item of
    its own. Null and empty texts have 0 tokens and lie in any container; ids must be unique, since the pieces of one text
    are told apart by their number; an empty table gives an empty one. Extra columns are ignored.
    """
    sizes = token_sizes(rows, (id_col,), text, vocabulary).select(F.col(id_col).alias("item"), "n_tokens")
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity) - 1).cast("int")
    pieces = sizes.select("item", F.explode(F.sequence(F.lit(0), last)).alias("part"), "n_tokens")
    pieces = cut(pieces.select("item", "part", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).alias("size")))
    packed = pack_sizes(pieces, capacity, open_bins=open_bins, items_per_task=items_per_task)
    return packed.select("container", F.col("item").alias(id_col), F.col("part").alias("piece_no"), (F.col("part").cast("long") * capacity).alias("start_token"), F.col("size").alias("n_tokens"))
