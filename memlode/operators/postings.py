"""The best BM25 hits of many queries at once: blocks of postings meet all queries in the tasks, and only the best leave them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.operators.kept import Kept
from memlode.operators.search import K1, B, best
from memlode.session import cut

#: Documents and words of a block of postings, at most about; entries of queries that a task expands at a time.
BLOCK_DOCS, BLOCK_WORDS, PIECE = 32_768, 8_000_000, 16_384


def slices(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ..., size[i] of them, one slice after the other."""
    return np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())


def index(terms: DataFrame, exact: dict[str, int], prefix: dict[str, int], stemmed: bool) -> DataFrame:
    """A row a block of documents (id, t) in order of id: their ids, lengths and postings of the phrases asked for, by phrase, as packed numbers."""
    kind = terms.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from memlode.functions.porter import stem

        @lru_cache(maxsize=1 << 18)
        def of(word: str) -> tuple[int, ...]:
            term = stem(word) if stemmed else word
            heads = [prefix[term[:n]] for n in range(1, len(term) + 1) if term[:n] in prefix] if prefix else []
            return (exact[term], *heads) if term in exact else tuple(heads)

        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, lists = rows.column("id").combine_chunks(), rows.column("t").combine_chunks()
            plain = ids.to_pylist()
            order = np.array(sorted(range(len(plain)), key=lambda i: (plain[i] is not None, plain[i])), dtype="i8")
            length = np.diff(lists.offsets.to_numpy()).astype("i4")
            place = np.empty(len(order), dtype="i8")
            place[order] = np.arange(len(order))
            coded = lists.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            met = [of(w) for w in coded.dictionary.to_pylist()]
            size = np.array([len(m) for m in met], dtype="i8")
            flat = np.array([p for m in met for p in m], dtype="i8")
            first = np.append(0, np.cumsum(size))[:-1]
            hit = np.flatnonzero(size[code]) if len(code) else np.zeros(0, dtype="i8")
            doc = np.repeat(place, length)[hit]
            phrase = flat[slices(first[code[hit]], size[code[hit]])] if len(hit) else flat[:0]
            pair, tf = np.unique(phrase * len(order) + np.repeat(doc, size[code[hit]]), return_counts=True)
            p, start = np.unique(pair // len(order), return_index=True)
            parts = [length[order], p.astype("i4"), start.astype("i4"), (pair % len(order)).astype("i4"), tf.astype("i4")]
            cols = [pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(ids.type)), pa.array([len(order)]), pa.array([int(length.sum())])]
            return pa.RecordBatch.from_arrays(cols + [pa.array([x.astype(x.dtype.newbyteorder("<")).tobytes()], pa.binary()) for x in parts], names=["ids", "n", "total", "length", "p", "first", "doc", "tf"])

        held, docs, seen = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            docs, seen = docs + batch.num_rows, seen + len(batch.column("t").flatten())
            if docs >= BLOCK_DOCS or seen >= BLOCK_WORDS:
                yield packed(held)
                held, docs, seen = [], 0, 0
        if held:
            yield packed(held)

    return cut(terms.select("id", "t").mapInArrow(run, f"ids array<{kind}>, n long, total long, length binary, p binary, first binary, doc binary, tf binary"))


def unpacked(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_py(), dtype="<i4").astype("i8")


def document_counts(blocks: DataFrame, phrases: int) -> np.ndarray:
    """Of each phrase the number of documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(phrases, dtype="i8")
        for batch in batches:
            for i in range(batch.num_rows):
                p, first = unpacked(batch.column("p")[i]), unpacked(batch.column("first")[i])
                out[p] += np.diff(np.append(first, len(batch.column("doc")[i].as_py()) // 4))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["p", "n"])

    got = blocks.select("p", "first", "doc").mapInArrow(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(phrases, dtype="i8")
    counts[got.column("p").to_numpy()] = got.column("n").to_numpy()
    return counts


def ranking(score: np.ndarray) -> np.ndarray:
    """Scores as they rank: rounded to nine digits."""
    return np.floor(score * 1e9 + 0.5)


def first_of_each(key: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores of each key, rounded to nine digits, ties by tie."""
    order = np.lexsort((tie, -ranking(score), key))
    sorted_ = key[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_, "left") < k]


def best_hits(terms: DataFrame, wanted: DataFrame, k: int, *, stemmed: bool = False, common: int | None = None, most: int = 2_000_000) -> DataFrame:
    """(qid, id, score, rank): of each query the k best of the documents (id, t), ids unique, by BM25 for wanted (qid, phrase, is_prefix); ties by id.

    The same as best() of all scores, but a pair of query and document becomes a row only if it is among the k best of a task. Queries of equal
    phrases are searched once. Phrases in more than `common` documents (a 256th of them by default) are summed once for each
    set of them that queries share. Since every part of a score is positive, the k best of a query are among its documents with a rarer phrase and the k best of its
    common phrases alone; a query that shares its set with no other is summed as a whole. Queries with up to `most` phrases in all travel with the tasks, more go in as many parts. Stemmed, words of t
    become their Porter stems before they meet the phrases.
    """
    spark = terms.sparkSession
    asks = F.array_sort(F.collect_set(F.struct("phrase", "is_prefix")))
    members = cut(wanted.groupBy("qid").agg(asks.alias("asks")).withColumn("key", F.md5(F.to_json("asks"))))
    classes = members.groupBy("key").agg(F.first("asks").alias("asks"))
    parts = max(1, -(-(classes.agg(F.sum(F.size("asks"))).first()[0] or 0) // most))
    out = None
    for part in range(parts):
        some = classes.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part) if parts > 1 else classes
        found = _of_part(spark, terms, some, k, stemmed, common)
        out = found if out is None else out.unionByName(found)
    return best(out.join(members.select("qid", "key"), "key").select("qid", "id", "score"), k).select("qid", "id", "score", "rank")


def _of_part(spark, terms: DataFrame, classes: DataFrame, k: int, stemmed: bool, common: int | None) -> DataFrame:
    """(key, id, score): the k best of each class of queries (key, asks) and some more."""
    asked = classes.select("key", F.col("asks.phrase").alias("phrase"), F.col("asks.is_prefix").alias("is_prefix")).toArrow().combine_chunks()
    number: dict[tuple[str, bool], int] = {}
    sets = [sorted(number.setdefault(a, len(number)) for a in zip(r["phrase"], r["is_prefix"])) for r in asked.select(["phrase", "is_prefix"]).to_pylist()]
    exact, prefix = {w: i for (w, p), i in number.items() if not p}, {w: i for (w, p), i in number.items() if p}
    blocks = index(terms, exact, prefix, stemmed)
    stats = blocks.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n = stats["n"] or 0
    mean = (stats["total"] or 0) / max(1, n) or 1.0
    counts = document_counts(blocks, len(number))
    raw = np.log(np.maximum((n - counts + 0.5) / (counts + 0.5), 1e-300))
    weight = np.where(raw <= 0, 1e-6, raw)
    heavy = counts > (max(64, n // 256) if common is None else common)

    # classes in order of their group, which is a set of common phrases; (class, rare phrase) in order of class
    shared: dict[tuple[int, ...], int] = {}
    group = np.array([shared.setdefault(tuple(p for p in s if heavy[p]), len(shared)) for s in sets], dtype="i8")
    order = np.argsort(group, kind="stable")
    group = group[order]
    rare = [[p for p in sets[i] if not heavy[p] and counts[p]] for i in order]
    entry_class, entry_phrase = np.repeat(np.arange(len(rare)), [len(r) for r in rare]).astype("i8"), np.array([p for r in rare for p in r], dtype="i8")
    edges = [0]  # of pieces of entries: of one group each, ending with a class
    for g in range(len(shared)):
        last = int(np.searchsorted(group[entry_class], g, "right")) if len(entry_class) else 0
        while edges[-1] < last:
            to = min(last, edges[-1] + PIECE)
            edges.append(int(np.searchsorted(entry_class, entry_class[to - 1], "right")))
    pieces: list[list[tuple[int, int]]] = [[] for _ in shared]
    for lo, hi in zip(edges, edges[1:]):
        pieces[int(group[entry_class[lo]])].append((lo, hi))
    groups = [np.array(s, dtype="i8") for s in shared]
    lone, kind = len(sets), terms.schema["id"].dataType.simpleString()  # keys from `lone` on are groups

    classes_of = np.bincount(group, minlength=len(groups))
    alone = np.where(classes_of == 1, np.searchsorted(group, np.arange(len(groups))), -1)  # the class of a group of only one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, of = Kept(lone + len(groups), k, ranking), None
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.column("ids")[row]
                of = own.type.value_type
                length, p, first, doc, tf = (unpacked(batch.column(c)[row]) for c in ("length", "p", "first", "doc", "tf"))
                size = np.diff(np.append(first, len(doc)))
                part = np.repeat(weight[p], size) * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean)))
                slot = np.full(len(weight), -1, dtype="i8")
                slot[p] = np.arange(len(p))
                base = kept.documents(own.as_py())
                wide: dict[int, np.ndarray] = {}  # phrases in many of these documents, a number for each document
                for s in slot[np.flatnonzero(heavy)]:
                    if s >= 0 and size[s] > len(length) // 8:
                        wide[s] = np.zeros(len(length))
                        wide[s][doc[first[s] : first[s] + size[s]]] = part[first[s] : first[s] + size[s]]
                for g, set_ in enumerate(groups):
                    total = np.zeros(len(length))
                    for s in slot[set_]:
                        if s in wide:
                            total += wide[s]
                        elif s >= 0:
                            total[doc[first[s] : first[s] + size[s]]] += part[first[s] : first[s] + size[s]]
                    name = lone + g
                    if alone[g] >= 0:  # its hits are those of its only class, rarer phrases included
                        name = alone[g]
                        for lo, hi in pieces[g]:
                            s = slot[entry_phrase[lo:hi]]
                            s = s[s >= 0]
                            at = slices(first[s], size[s])
                            total += np.bincount(doc[at], part[at], len(length))
                    some = np.flatnonzero(total)
                    value = ranking(total[some])
                    good = value >= kept.bound[name]
                    some, value = some[good], value[good]
                    if len(some) > k:
                        some = some[value >= np.partition(value, -k)[-k]]
                        some = some[first_of_each(np.zeros(len(some)), total[some], some, k)]
                    kept.add(np.full(len(some), name), base + some, total[some])
                    for lo, hi in pieces[g] if alone[g] < 0 else ():
                        s = slot[entry_phrase[lo:hi]]
                        here = np.flatnonzero(s >= 0)
                        if not len(here):
                            continue
                        s = s[here]
                        at = slices(first[s], size[s])
                        pair = np.repeat(entry_class[lo:hi][here], size[s]) * len(length) + doc[at]
                        by = np.argsort(pair, kind="stable")
                        pair = pair[by]
                        starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                        pair, sums = pair[starts], np.add.reduceat(part[at][by], starts)
                        key, who = pair // len(length), pair % len(length)
                        sums = sums + total[who]
                        good = ranking(sums) >= kept.bound[key]
                        key, who, sums = key[good], who[good], sums[good]
                        keep = first_of_each(key, sums, who, k)
                        kept.add(key[keep], base + who[keep], sums[keep])
                kept.settle()
        key, doc, score = kept.hits()
        for lo in range(0, len(key), 65_536):
            here = slice(lo, lo + 65_536)
            yield pa.RecordBatch.from_arrays([pa.array(key[here]), pa.array([kept.ids[i] for i in doc[here]], of), pa.array(score[here])], names=["c", "id", "score"])

    # few tasks, each with many blocks: every task sends up to k rows a key
    hits = blocks.coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(run, f"c int, id {kind}, score double")
    by_score = Window.partitionBy("c").orderBy(F.desc(F.round("score", 9)), "id")
    kept = cut(hits.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") <= k).drop("_r"))
    links = spark.createDataFrame(pa.table({"c": pa.array(np.arange(lone, dtype="i4")), "g": pa.array((lone + group).astype("i4")), "key": asked.column("key").take(pa.array(order)).cast(pa.string())}))
    apart = kept.join(links.select("c", "key"), "c").select("key", "id", "score")
    together = kept.withColumnRenamed("c", "g").join(links.select("g", "key"), "g").select("key", "id", "score")
    return apart.unionByName(together).groupBy("key", "id").agg(F.max("score").alias("score"))
