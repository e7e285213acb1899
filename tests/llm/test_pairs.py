"""Near-duplicates and batches against brute force."""

import random
import re

import numpy as np
import pytest

from memlode.llm import history, neardup, sets

WORDS = [f"w{i}" for i in range(400)]


def words(text):
    return frozenset(re.findall(r"[^\W_]+", (text or "").lower()))


def similar(a, b, t=0.7):
    return bool(a | b) and len(a & b) >= t * len(a | b) - 1e-9


def texts(n, seed, hot=0):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, weights=[1 / (i + 1) for i in range(400)], k=rng.randint(1, 40))) for _ in range(n // 2)]
    out = list(base)
    while len(out) < n:
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rng.shuffle(w)
        out.append(" ".join(w))
    return out + ["Hot text, repeated everywhere."] * hot


def brute(rows):
    live = [(i, words(t)) for i, t in dict(rows).items()]
    return {tuple(sorted((a, b))) for k, (a, x) in enumerate(live) for b, y in live[:k] if x and y and similar(x, y)}


@pytest.fixture(scope="module")
def rows():
    found = [(f"id{k:04d}", t) for k, t in enumerate(texts(300, 3, hot=40))]
    return found + [("null", None), ("empty", ""), ("marks", "!!! ..."), ("long", "long " * 50_000 + "tail"), found[5]]


def test_id_pairs_match_brute_force(spark, rows):
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "id string, content string, key string")
    got = [tuple(r) for r in neardup.id_pairs(df, similarity="0.7").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


@pytest.mark.parametrize("hot,frequent", [(2, 1), (40, 64)])
def test_hot_words_lose_no_pair(spark, rows, hot, frequent):
    df = spark.createDataFrame(rows, "id string, content string")
    members, found = neardup.prepare(df, "id", "content")
    key = lambda d: {(bytes(r.key_a), bytes(r.key_b)) for r in d.collect()}
    # lists are split at their real length: with and without a table of frequent words, down to lists of a few sets
    assert key(neardup.links(found, "0.7", frequent=frequent, hot=hot)) == key(neardup.links(found, "0.7"))


def test_words_beyond_the_table_and_templates(spark):
    rng = random.Random(9)
    fill = lambda k: " ".join(f"r{rng.randrange(10**9)}" for _ in range(k))
    shared = [(f"a{k:03d}", f"one two three four five {fill(6)}") for k in range(150)]
    lines = [(f"b{k:03d}", f"error at line number {k} of the same long file with many words in it") for k in range(150)]
    tiny = [("c0", "x"), *((f"c{k}", f"x y{k}") for k in range(1, 60))]
    for similarity, rows in (("0.8", shared + lines), ("0.5", tiny)):
        df = spark.createDataFrame(rows, "id string, content string")
        members, found = neardup.prepare(df, "id", "content")
        ids = {bytes(r.key): r.id for r in members.collect()}
        got = {tuple(sorted((ids[bytes(r.key_a)], ids[bytes(r.key_b)]))) for r in neardup.links(found, similarity, frequent=1, hot=20).collect()}
        sets_ = {i: words(t) for i, t in rows}
        assert got == {(a, b) for a in sets_ for b in sets_ if a < b and similar(sets_[a], sets_[b], float(similarity))}
        assert len(got) in (150 * 149 // 2, 59)


def test_hot_class_is_spread(spark):
    rows = [(f"k{k:04d}", "the very same text") for k in range(300)] + [(f"m{k}", "the very same text again") for k in range(5)]
    got = neardup.id_pairs(spark.createDataFrame(rows, "id string, content string"), similarity="0.7", block=64).collect()
    assert len({tuple(r) for r in got}) == len(got) == 305 * 304 // 2


def test_groups(spark, rows):
    df = spark.createDataFrame(rows, "id string, content string")
    out = {r.id: r for r in neardup.near_duplicates(df, similarity="0.7").collect()}
    assert "null" not in out and "empty" not in out and "marks" not in out
    pairs = brute(rows)
    assert all(out[a].group == out[b].group for a, b in pairs)
    parent = {i: i for i in out}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    assert len({r.group for r in out.values()}) == len({root(i) for i in out})
    hot = [r for i, r in out.items() if i >= "id0300" and i.startswith("id")]
    assert len({r["class"] for r in hot}) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, content string")
    assert neardup.id_pairs(df).count() == 0
    assert neardup.near_duplicates(df).count() == 0


def test_vantage_point_tree_is_exact():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 3000, (40, 50))
    docs = [np.unique(np.where(rng.random(50) < 0.1, rng.integers(0, 3000, 50), base[k % 40])) for k in range(600)]
    lengths = np.array([len(x) for x in docs])
    _, _, lanes = sets.sketch(np.concatenate(docs).astype("i8") * 7919, lengths)
    sim = sets.Similarity.of(0.8)
    shard = neardup.Shard(lanes, lengths, sim, leaf=16, block=32)
    got = {tuple(sorted((int(i), int(j)))) for a, b in shard.pairs(np.arange(600)) for i, j in zip(a, b)}
    truth = {(i, j) for i in range(600) for j in range(i + 1, 600) if similar(set(docs[i]), set(docs[j]), 0.8)}
    assert truth and truth <= got
    assert shard.compared < 600 * 599 / 2


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    docs = [np.unique(rng.integers(0, 500, rng.integers(1, 200))) for _ in range(60)]
    _, _, lanes = sets.sketch(np.concatenate(docs).astype("i8"), np.array([len(x) for x in docs]))
    for i in range(60):
        d = neardup.distance(lanes, np.array([i]), np.arange(60))
        assert all(d[j] <= len(set(docs[i]) ^ set(docs[j])) for j in range(60))


def greedy(old, records):
    kept, out = [words(t) for t in old if words(t)], {}
    for r in sorted(set(records), key=lambda r: r[:3]):
        s = words(r[3])
        out[r[2]] = not any(similar(s, k) for k in kept)
        if s and out[r[2]]:
            kept.append(s)
    return out


@pytest.fixture(scope="module")
def batches():
    old = texts(200, 3)
    fresh = texts(240, 3)[60:] + texts(120, 8, hot=15)
    rng = random.Random(1)
    rng.shuffle(fresh)
    records = [(1 + k // 60, k % 60, f"r{k}", t) for k, t in enumerate(fresh)]
    return old + [None, ""], records + [(9, 0, "null", None), (9, 1, "empty", ""), records[0]]


def test_batches_match_the_sequential_rule(spark, batches):
    old, records = batches
    schema = "batch_no int, seq_no int, id string, content string"
    index = history.HistoryIndex(spark, "0.7").build(spark.createDataFrame([(t,) for t in old], "content string"))
    got = {r.id: r.accepted for r in index.ingest(spark.createDataFrame(records, schema)).collect()}
    assert got == greedy(old, records)


def test_batch_by_batch_and_compaction_give_the_same(spark, batches):
    old, records = batches
    schema = "batch_no int, seq_no int, id string, content string"
    index = history.HistoryIndex(spark, "0.7", most_runs=2, hot=60, frequent=64).build(spark.createDataFrame([(t,) for t in old], "content string"))
    got = {}
    for n in sorted({r[0] for r in records}):
        part = [r for r in records if r[0] == n]
        index = history.HistoryIndex.open(spark, index.path)  # as another session would
        got |= {r.id: r.accepted for r in index.ingest(spark.createDataFrame(part, schema)).collect()}
    assert len(index.runs) <= 3 and len(index.set_runs) <= 3 and index.version > 6
    assert got == greedy(old, records)
    assert index.ingest(spark.createDataFrame([], schema)).count() == 0
    index.drop()
    with pytest.raises(Exception):
        history.HistoryIndex.open(spark, index.path)


def test_small_batches_read_little(spark):
    rng = random.Random(4)
    old = [(" ".join(f"q{rng.randrange(10**6)}" for _ in range(12)),) for _ in range(30_000)]
    index = history.HistoryIndex(spark, "0.7", sets_per_range=1000).build(spark.createDataFrame(old, "content string").repartition(8))
    batch = spark.createDataFrame([(1, 1, "a", old[7][0]), (1, 2, "b", "something new altogether")], "batch_no int, seq_no int, id string, content string")
    posted = history.postings(history.features(batch, ("id",), "content"), index.order, index.sim, index.hot, copies=True)
    near = index._near(index.runs, history.POSTING, "w", posted)
    assert 0 < near.count() < 20
    plan = near._jdf.queryExecution().executedPlan()
    near._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    read = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    assert read < 0.2 * index.runs[0].rows
    assert {r.id: r.accepted for r in index.ingest(batch).collect()} == {"a": False, "b": True}
    index.drop()


def test_empty_history(spark):
    index = history.HistoryIndex(spark, "0.7").build(spark.createDataFrame([], "content string"))
    got = index.ingest(spark.createDataFrame([(1, 1, "a", "one two"), (1, 2, "b", "two one")], "batch_no int, seq_no int, id string, content string"))
    assert {r.id: r.accepted for r in got.collect()} == {"a": True, "b": False}


def test_long_chains_are_decided_in_order(spark):
    rng = random.Random(2)
    for edges in ([(k, k + 1) for k in range(1200)], [tuple(sorted(rng.sample(range(150), 2))) for _ in range(400)]):
        gone = set()
        for a, b in sorted(set(edges), key=lambda e: e[1]):
            if a not in gone:
                gone.add(b)
        for most in (10**6, 350):
            assert sorted(r.pos for r in history.refused(spark.createDataFrame(edges, "a long, b long"), most).collect()) == sorted(gone)


def test_empty_history_with_a_word_in_all(spark):
    rng = random.Random(6)
    records = [(1, k, f"r{k}", "all of these share eight words here " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(2 + k % 5))) for k in range(400)]
    index = history.HistoryIndex(spark, "0.7", hot=30).build(spark.createDataFrame([], "content string"))
    got = index.ingest(spark.createDataFrame(records, "batch_no int, seq_no int, id string, content string"))
    assert {r.id: r.accepted for r in got.collect()} == greedy([], records)
