"""Word sets as compact keys, fingerprints and prefix words, shared by the operators on similar texts.

A text is the set of its words, each a 64-bit hash. Its fingerprint is an odd sketch: every word flips one of
256 bits, so the Hamming distance of two fingerprints never exceeds the number of words in only one of the two
texts. A bound on the distance therefore loses no pair.

For a similarity of at least t two texts share one of their first n - ceil(t n) + 1 words in any common order of
all words. The order puts rare words first: those outside a bounded table of the most frequent words by their hash, then
the table's by their frequency. Any order gives all pairs; a good one gives short lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlode.functions.words import word_hashes
from memlode.session import cut, partitions

LANES = 4
FEATURES = "key binary, k long, n int, words array<long>, fp0 long, fp1 long, fp2 long, fp3 long"


@dataclass(frozen=True)
class Similarity:
    """The threshold t = num / den and the integer bounds that follow from it."""

    num: int
    den: int

    @staticmethod
    def of(value: float | str) -> "Similarity":
        f = Fraction(str(value))
        if not 0 < f <= 1:
            raise ValueError("the similarity must lie in (0, 1]")
        return Similarity(f.numerator, f.denominator)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many first words of a set of n can't all be missing from a similar set."""
        return n - (self.num * n + self.den - 1) // self.den + 1

    def radius(self, both: np.ndarray) -> np.ndarray:
        """The most words in only one of two similar sets with so many words together."""
        part = self.num + self.den
        return both - 2 * ((self.num * both + part - 1) // part)

    def sizes_fit(self, small: np.ndarray, large: np.ndarray) -> np.ndarray:
        return self.num * large <= self.den * small

    def holds(self, both: Column, a: Column, b: Column) -> Column:
        """Whether two sets of a and b words with so many in common are similar."""
        return (both > 0) & (both * F.lit(self.den) >= (a + b - both) * F.lit(self.num))


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A well mixed 64-bit value of each value."""
    z = x.astype("u8") + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of lists without nulls."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)


def sketch(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Two commutative 64-bit sums and the odd sketch of each set; no set may be empty."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    one = np.add.reduceat(mixed(values, 0x9E3779B97F4A7C15), starts)
    two = np.add.reduceat(mixed(values, 0x5851F42D4C957F2D), starts)
    bits = mixed(values, 0x14057B7EF767814F)
    place, lane = np.uint64(1) << (bits & np.uint64(63)), (bits >> np.uint64(6)) & np.uint64(LANES - 1)
    lanes = [np.bitwise_xor.reduceat(np.where(lane == np.uint64(i), place, np.uint64(0)), starts) for i in range(LANES)]
    return one, two, lanes


def features(rows: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    """keep and the features of each text; texts that are null or have no word give no row.

    key (128 bits) stands for the word set, k is half of it; words holds the hashes.
    """
    prepared = rows.select(*keep, word_hashes(text).alias("_w")).where(F.size("_w") > 0)
    kept = [f for f in prepared.schema if f.name != "_w"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("_w")
            one, two, lanes = sketch(*flat(column))
            raw = np.stack([one, two], axis=1).astype("<u8").tobytes()
            key = pa.Array.from_buffers(pa.binary(16), len(one), [None, pa.py_buffer(raw)]).cast(pa.binary())
            n = pa.array(flat(column)[1].astype("i4"))
            cols = [*(batch.column(f.name) for f in kept), key, pa.array(one.view("i8")), n, column, *(pa.array(x.view("i8")) for x in lanes)]
            yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in kept), "key", "k", "n", "words", "fp0", "fp1", "fp2", "fp3"])

    return prepared.mapInArrow(run, schema)


def classes(feats: DataFrame) -> DataFrame:
    """One row a word set; copies collapse before the shuffle, so that a hot text is one row a task."""
    return feats.groupBy("key").agg(*(F.first(c).alias(c) for c in ("k", "n", "words", "fp0", "fp1", "fp2", "fp3")))


@dataclass(frozen=True)
class Order:
    """The most frequent words, sorted by hash, their ranks from 1 (rarest of them) and in how many sets each is."""

    words: np.ndarray = field(repr=False)
    ranks: np.ndarray = field(repr=False)
    counts: np.ndarray = field(repr=False)


def word_order(feats: DataFrame, frequent: int = 65_536) -> Order:
    """The order of words from their counts in all sets. Only `frequent` rows, 16 bytes each, reach the driver and the tasks."""
    counts = feats.select(F.explode("words").alias("w")).groupBy("w").count().where("count > 1")
    top = counts.orderBy(F.desc("count"), "w").limit(frequent).toPandas()
    w, c = top["w"].to_numpy("i8"), top["count"].to_numpy("i8")
    ranks = np.arange(len(w), 0, -1, dtype="i8")
    by_hash = np.argsort(w)
    return Order(w[by_hash], ranks[by_hash], c[by_hash])


def ranked(values: np.ndarray, lengths: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """The words of each set in the common order, and in how many sets each is (0 outside the table)."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    if len(order.words):
        at = np.minimum(np.searchsorted(order.words, values), len(order.words) - 1)
        known = order.words[at] == values
        rank, count = np.where(known, order.ranks[at], 0), np.where(known, order.counts[at], 0)
    else:
        rank = count = np.zeros(len(values), dtype="i8")
    by = np.lexsort((values, rank, doc))
    return values[by], count[by]


def longer_keys(words: np.ndarray, starts: np.ndarray, n: np.ndarray, row: np.ndarray, key: np.ndarray, place: np.ndarray, depth: np.ndarray, sim: Similarity) -> tuple[np.ndarray, ...]:
    """(row, key, place, depth) of the keys of one word more that stand in for each given key of depth words, the last at place.

    Similar sets that have more than depth words in common share that many among the first prefix + depth words, so
    they share a longer key. Those with no more than depth in common are so small that the key itself, marked as
    ended, holds few sets. So a list of many sets breaks into shorter ones without losing a pair.
    """
    rows, keys, places, depths = [], [], [], []
    limit = np.minimum(n[row], sim.prefix(n[row]) + depth)
    first, step = np.arange(len(key)), 1
    while len(first):
        first = first[place[first] + step < limit[first]]
        q = place[first] + step
        rows.append(row[first])
        keys.append(mixed(key[first] ^ mixed(words[starts[row[first]] + q], 77).view("i8"), 78).view("i8"))
        places.append(q)
        depths.append(depth[first] + 1)
        step += 1
    ended = np.flatnonzero(sim.num * n[row].astype("i8") <= sim.den * depth.astype("i8"))
    rows.append(row[ended])
    keys.append(mixed(key[ended], 79).view("i8"))
    places.append(n[row[ended]])
    depths.append(depth[ended] + 1)
    return tuple(np.concatenate(x) for x in (rows, keys, places, depths))


def first_keys(values: np.ndarray, lengths: np.ndarray, order: Order, sim: Similarity, hot: int, copies: bool) -> tuple[np.ndarray, ...]:
    """(row, key, place, depth) of the prefix words of each set; words known to be in more than hot sets give keys of two words.

    Without copies, sets of one word give no key where nothing else can be similar to them.
    """
    words, count = ranked(values, lengths, order)
    n = lengths.astype("i8")
    starts = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - starts[row]
    inside = place < sim.prefix(n)[row]
    if not copies and 2 * sim.num > sim.den:
        inside &= n[row] > 1
    plain, often = np.flatnonzero(inside & (count <= hot)), np.flatnonzero(inside & (count > hot))
    more = longer_keys(words, starts, n, row[often], words[often], place[often], np.ones(len(often), dtype="i8"), sim)
    one = row[plain], words[plain], place[plain], np.ones(len(plain), dtype="i8")
    return tuple(np.concatenate(x) for x in zip(one, more))


#: A posting: key, half of the set's key, the fingerprint, and m = size of the set, place and depth of the key, whether the set is old.
POSTING = "w long, k long, fp0 long, fp1 long, fp2 long, fp3 long, m long"


def packed(n: np.ndarray, place: np.ndarray, depth: np.ndarray, old: np.ndarray) -> np.ndarray:
    """m of postings: sorting by it sorts by the size of the set."""
    return (n.astype("i8") << 32) | (place.astype("i8") << 4) | (depth.astype("i8") << 1) | old.astype("i8")


def _posted(batch: pa.RecordBatch, n: np.ndarray, row: np.ndarray, key: np.ndarray, place: np.ndarray, depth: np.ndarray, old: np.ndarray) -> pa.RecordBatch:
    names = ["k", "fp0", "fp1", "fp2", "fp3"]
    picked = batch.select(names).take(pa.array(row))
    return pa.RecordBatch.from_arrays([pa.array(key), *picked.columns, pa.array(packed(n[row], place, depth, old))], names=["w", *names, "m"])


def postings(sets: DataFrame, order: Order, sim: Similarity, hot: int = 4096, copies: bool = False) -> DataFrame:
    """A posting for each prefix key of each set; none of them is old."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, lengths = flat(batch.column("words"))
            row, *rest = first_keys(values, lengths, order, sim, hot, copies)
            yield _posted(batch, lengths, row, *rest, np.zeros(len(row), dtype="?"))

    return sets.select("words", "k", "fp0", "fp1", "fp2", "fp3").mapInArrow(run, POSTING)


def longer_postings(deferred: DataFrame, sets: DataFrame, order: Order, sim: Similarity) -> DataFrame:
    """Postings of one word more in place of the deferred ones, whose sets (k, words, old) are looked up."""
    rows = deferred.join(sets.select("k", "old", "words"), ["k", "old"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, lengths = flat(batch.column("words"))
            words, _ = ranked(values, lengths, order)
            n = lengths.astype("i8")
            m, key = batch.column("m").to_numpy(), batch.column("w").to_numpy()
            row, *rest = longer_keys(words, np.cumsum(n) - n, n, np.arange(len(n)), key, (m >> 4) & 0xFFFFFFF, (m >> 1) & 7, sim)
            yield _posted(batch, n, row, *rest, (m & 1)[row])

    return rows.select("words", "k", "w", "m", "fp0", "fp1", "fp2", "fp3").mapInArrow(run, POSTING)


def in_blocks(deferred: DataFrame, hot: int) -> DataFrame:
    """Postings of lists that longer keys do not break, or that few new sets ask: cut into blocks of about hot sets, every two blocks of a list meeting in a list of their own.

    Old sets meet new ones only, so that old blocks are sent as often as there are new ones.
    """
    sizes = deferred.groupBy("w").agg(*((F.ceil(F.count_if(c) / hot)).alias(a) for c, a in ((F.col("old"), "_o"), (~F.col("old"), "_n"))))
    rows = deferred.join(sizes, "w")
    own = F.pmod(F.xxhash64("k"), F.when(F.col("old"), F.col("_o")).otherwise(F.col("_n")))
    count = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    met = F.when(F.col("old"), F.transform(count("_n"), lambda i: F.xxhash64("w", F.lit(1), i, "_b")))
    met = met.otherwise(
        F.concat(
            F.when(F.col("_o") > 0, F.transform(count("_o"), lambda j: F.xxhash64("w", F.lit(1), "_b", j))).otherwise(F.array().cast("array<bigint>")),
            F.transform(count("_n"), lambda j: F.xxhash64("w", F.lit(2), F.least("_b", j), F.greatest("_b", j))),
        )
    )
    rows = rows.where("_n > 0").withColumn("_b", own).withColumn("w", F.explode(met))
    # depth 7: such lists are not put off again
    return rows.select("w", "k", "fp0", "fp1", "fp2", "fp3", F.col("m").bitwiseOR(F.lit(2 * BLOCKS)).alias("m"))


#: Lists whose keys have so many words and are still long are met in blocks.
MOST_WORDS = 3
#: The depth of keys that stand for blocks.
BLOCKS = 7
#: Rows of lists that a task holds at least before it looks at them.
HELD = 65_536

Lists = Callable[[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]


def meet(posted: DataFrame, lookup: Callable[[DataFrame], DataFrame], order: Order, sim: Similarity, hot: int, pairs: Lists) -> DataFrame:
    """(ka, kb, old): pairs of sets that `pairs` finds in the list of some key; kb is old or not, ka is not old.

    A task reads its lists in order. One of too many sets, found by its real length, is put off: the next round gives
    its sets keys of one word more, or, beyond MOST_WORDS words and where at most hot new sets ask a long list of old ones,
    blocks. So a task never holds more than HELD + 16 hot postings, whatever the data. lookup gives the sets (k, old,
    words) of a table of (k, old).
    """
    lanes = [f"fp{i}" for i in range(LANES)]
    schema = "ka long, kb long, old boolean, w long, m long, " + ", ".join(f"{x} long" for x in lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, putting_off, blocks = 0, None, False

        def too_long(new, size, depth):
            return ((new * size > hot * hot) | (size > 16 * hot)) & (depth != BLOCKS)

        def put_off(t: pa.Table, blocks: np.ndarray | bool) -> pa.RecordBatch:
            m = t.column("m").to_numpy()
            none = pa.nulls(len(m), pa.int64())
            cols = [t.column("k"), none, pa.array((m & 1).astype("?")), t.column("w"), pa.array(np.where(blocks, m | (2 * BLOCKS), m)), *(t.column(x) for x in lanes)]
            return pa.table(cols, names=["ka", "kb", "old", "w", "m", *lanes]).combine_chunks().to_batches()[0]

        def look(t: pa.Table) -> Iterator[pa.RecordBatch]:
            w, m = t.column("w").to_numpy(), t.column("m").to_numpy()
            starts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            sizes = np.diff(np.append(starts, len(w)))
            new, depth = np.add.reduceat(1 - (m & 1), starts), ((m >> 1) & 7)[starts]
            long = too_long(new, sizes, depth)
            if long.any():
                late = np.repeat(long, sizes)
                yield put_off(t.filter(pa.array(late)), np.repeat((new <= hot) | (depth >= MOST_WORDS), sizes)[late])
                t = t.filter(pa.array(~late))
                w, m = w[~late], m[~late]
            if not len(w):
                return
            k, fp, old = t.column("k").to_numpy(), [t.column(f"fp{i}").to_numpy().view("u8") for i in range(LANES)], (m & 1).astype("?")
            a, b = pairs(w, m >> 32, fp, old)
            keep = np.flatnonzero(~(old[a] & old[b]))
            a, b = a[keep], b[keep]
            swap = old[a]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            ka, kb, other = k[a], k[b], old[b]
            ka, kb = np.where(other, ka, np.minimum(ka, kb)), np.where(other, kb, np.maximum(k[a], kb))
            found = np.unique(np.stack([ka, kb, other.astype("i8")], axis=1), axis=0)
            none = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2].astype("?")), *[none] * (2 + LANES)], names=["ka", "kb", "old", "w", "m", *lanes])

        for batch in batches:
            if not batch.num_rows:
                continue
            if putting_off is not None:
                w = batch.column("w").to_numpy()
                same = int(np.searchsorted(w, putting_off, "right"))
                if same:
                    yield put_off(pa.Table.from_batches([batch.slice(0, same)]), blocks)
                if same == len(w):
                    continue
                batch, putting_off = batch.slice(same), None
            held.append(batch)
            rows += batch.num_rows
            if rows < HELD:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            w, m = t.column("w").to_numpy(), t.column("m").to_numpy()
            full = int(np.searchsorted(w, w[-1], "left"))  # the last list may go on
            if full:
                yield from look(t.slice(0, full))
                t = t.slice(full)
            new, depth = int((1 - (m[full:] & 1)).sum()), int(m[full] >> 1) & 7
            if too_long(new, len(m) - full, depth):
                blocks = new <= hot or depth >= MOST_WORDS
                yield put_off(t, blocks)
                putting_off, held, rows = w[-1], [], 0
            else:
                held, rows = t.to_batches(), t.num_rows
        if held:
            yield from look(pa.Table.from_batches(held).combine_chunks())

    met, found = [], None
    while True:
        done = cut(posted.repartition(partitions(posted), "w").sortWithinPartitions("w", "m").mapInArrow(run, schema))
        met.append(done.where("kb is not null").select("ka", "kb", "old"))
        late = done.where("kb is null").select(F.col("ka").alias("k"), "old", "w", "m", *lanes)
        if late.isEmpty():
            break
        depth = F.shiftright("m", 1).bitwiseAND(F.lit(7))
        by_words = late.where(depth != BLOCKS)
        posted = longer_postings(by_words, lookup(by_words.select("k", "old").distinct()), order, sim).unionByName(in_blocks(late.where(depth == BLOCKS), hot))
    for part in met:
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def verify(candidates: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """(key_a, key_b, old, similarity) of the candidates (ka, kb, old) whose word sets are similar, by their words.

    sets has (k, key, words, old). Every set is shuffled once. Keys of 64 bits may collide; all sets of a candidate's keys are
    compared, so that a collision costs work and never a wrong or a lost pair. Equal sets count where one is old.
    """
    ends = candidates.select("ka", "kb", F.col("old").alias("_old"), F.explode(F.array_distinct(F.array("ka", "kb"))).alias("k"))
    found = ends.join(sets.select("k", "key", "words", "old"), "k").groupBy("ka", "kb", "_old").agg(F.collect_list(F.struct("k", "key", "words", "old")).alias("s"))
    sides = found.select("_old", F.filter("s", lambda x: (x.k == F.col("ka")) & ~x.old).alias("a"), F.filter("s", lambda x: (x.k == F.col("kb")) & (x.old == F.col("_old"))).alias("b"))
    pairs = sides.select("_old", F.explode("a").alias("a"), "b").select("_old", "a", F.explode("b").alias("b")).where("_old or a.key <> b.key")
    both = F.size(F.array_intersect("a.words", "b.words"))
    sized = pairs.select("a.key", F.col("b.key").alias("other"), F.col("_old").alias("old"), both.alias("o"), F.size("a.words").alias("na"), F.size("b.words").alias("nb")).where(sim.holds(F.col("o"), F.col("na"), F.col("nb")))
    value = F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))
    turn = ~F.col("old") & (F.col("other") < F.col("key"))
    return sized.select(F.when(turn, F.col("other")).otherwise(F.col("key")).alias("key_a"), F.when(turn, F.col("key")).otherwise(F.col("other")).alias("key_b"), "old", value.alias("similarity")).distinct()
