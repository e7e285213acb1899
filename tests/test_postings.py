"""The best hits of many queries, against brute force, and what the registered searches move."""

import datetime as dt

import numpy as np
import pytest

from memlode.functions.porter import stem
from memlode.operators import search
from memlode.operators.kept import Kept
from memlode.operators.postings import best_hits
from memlode.plans import catalog


def brute(docs, asked, k, of=lambda w: w):
    """{(qid, rank): (id, score)}"""
    terms = {i: [of(w) for w in t] for i, t in docs}
    n, mean = len(terms), sum(len(t) for t in terms.values()) / len(terms)
    meets = lambda t, p, is_prefix: sum(w.startswith(p) if is_prefix else w == p for w in t)
    having = {a: sum(meets(t, *a) > 0 for t in terms.values()) for a in {(p, x) for _, p, x in asked}}
    out = {}
    for q in {a[0] for a in asked}:
        scores = []
        for i, t in terms.items():
            s = 0.0
            for p, x in sorted({(p, x) for r, p, x in asked if r == q}):
                if tf := meets(t, p, x):
                    raw = np.log((n - having[p, x] + 0.5) / (having[p, x] + 0.5))
                    s += max(raw, 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
            if s:
                scores.append((-round(s, 9), i, s))
        out |= {(q, r + 1): (i, pytest.approx(s)) for r, (_, i, s) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("common,most", [(None, 1000), (0, 1000), (12, 1000), (12, 9)])
def test_best_hits_equal_brute_force(spark, common, most):
    rng = np.random.default_rng(5)
    vocabulary = ["note", "notes", "noted", "deploy", "deployed", "caching", "cache", "été", "x"] + [f"w{i}" for i in range(40)]
    docs = [(f"{(i * 37) % 120:03d}", [vocabulary[min(int(rng.exponential(8)), 48)] for _ in range(int(rng.integers(0, 12)))]) for i in range(120)]
    docs += [("copy1", docs[3][1]), ("copy2", docs[3][1]), ("empty", [])]
    asked = [(q, vocabulary[int(rng.integers(0, 49))], bool(rng.integers(0, 2))) for q in range(25) for _ in range(4)] + [(25, "note", False), (26, "note", False), (27, "absent", True)]
    df = spark.createDataFrame(docs, "id string, t array<string>").repartition(5)
    wanted = spark.createDataFrame(asked, "qid int, phrase string, is_prefix boolean").distinct()
    for stemmed, of in ((False, lambda w: w), (True, stem)):
        terms_asked = sorted({(q, of(p), x) for q, p, x in asked})
        w = spark.createDataFrame(terms_asked, "qid int, phrase string, is_prefix boolean") if stemmed else wanted
        got = {(r.qid, r.rank): (r.id, r.score) for r in best_hits(df, w, 4, stemmed=stemmed, common=common, most=most).collect()}
        assert got == brute(docs, terms_asked, 4, of)
    assert best_hits(df.limit(0), wanted, 4).count() == 0
    assert best_hits(df, wanted.limit(0), 4).count() == 0


def shuffled_rows(spark, run):
    store = spark.sparkContext._jsc.sc().statusStore()
    none, jvm = spark.sparkContext._jvm.java.util.ArrayList(), spark.sparkContext._gateway
    stages = lambda: store.stageList(none, False, False, jvm.new_array(jvm.jvm.double, 0), none)
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    out = run().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    after = stages()
    return out, sum(s.shuffleWriteRecords() for s in (after.apply(i) for i in range(after.size())) if s.stageId() not in before)


def store_of_notes(spark, folder, memories=1500, sessions=400):
    now = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(f"{i:032x}", None, f"debug timeout of part{i % 300} in area{i % 7}", "[]", [float((i * j) % 11 + 1) for j in range(64)], now, now, None) for i in range(memories)]
    spark.createDataFrame(rows, "id string, project_id string, content string, keywords string, embedding array<float>, created_at timestamp, updated_at timestamp, deleted_at timestamp").write.parquet(f"{folder}/memories.parquet")
    spark.createDataFrame([(f"s{i}", f"Debug part{i % 300} timeout") for i in range(sessions)], "id string, title string").write.parquet(f"{folder}/sessions.parquet")
    spark.createDataFrame([("p", "Area part3")], "id string, name string").write.parquet(f"{folder}/projects.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["bm25_multi_query", "bm25_stemmed", "bm25_prefix", "multi_query_first_hits"])
def test_a_pair_of_query_and_document_is_no_row(spark, tmp_path, name):
    folder = store_of_notes(spark, tmp_path)
    out, moved = shuffled_rows(spark, lambda: catalog.queries()[name](spark, folder))
    assert out and moved < 60_000  # 400 titles times 1,500 memories that hold "debug" are 600,000


@pytest.mark.parametrize("name", ["hybrid_scores", "hybrid_search"])
def test_hybrid_legs_move_only_their_best(spark, tmp_path, name):
    folder = store_of_notes(spark, tmp_path, memories=6000)
    out, moved = shuffled_rows(spark, lambda: catalog.queries()[name](spark, folder))
    assert out and moved < 200_000  # 60 memories times 6,000 that hold "debug" are 360,000


def test_a_query_of_its_own_common_words_sends_its_best_once(spark):
    """Not the best by its common words and, beside them, the best with a rarer word."""
    docs = [(i, [f"c{j}" for j in range(12) if (i >> j) % 2] + [f"r{i % 66}"]) for i in range(4096)]
    pairs = [(a, b) for a in range(12) for b in range(a)]
    asked = [(q, w, False) for q, (a, b) in enumerate(pairs) for w in (f"c{a}", f"c{b}", f"r{q}")]
    df, wanted = spark.createDataFrame(docs, "id int, t array<string>").repartition(4), spark.createDataFrame(asked, "qid int, phrase string, is_prefix boolean")
    out, moved = shuffled_rows(spark, lambda: best_hits(df, wanted, 20, common=100))
    assert {(r.qid, r.rank): (r.id, r.score) for r in out if r.qid < 3} == brute(docs, [a for a in asked if a[0] < 3], 20)
    assert moved - len(docs) < 9_000


def test_kept_holds_only_the_best_and_the_documents_they_name():
    rng = np.random.default_rng(2)
    kept, every = Kept(9, 3, held=50), []
    for block in range(40):
        ids = [f"{(block * 30 + i) * 7919 % 10_007:05d}" for i in range(30)]
        base = kept.documents(ids)
        key, doc, score = rng.integers(0, 9, 60), rng.integers(0, 30, 60), rng.integers(0, 50, 60) / 10
        pairs = np.unique(key * 30 + doc, return_index=True)[1]
        key, doc, score = key[pairs], doc[pairs], score[pairs]
        every += [(k, -s, ids[d]) for k, s, d in zip(key.tolist(), score.tolist(), doc.tolist())]
        good = score >= kept.bound[key]
        kept.add(key[good], base + doc[good], score[good])
        kept.settle()
        assert len(kept.ids) <= 27 + 50 + 30
    key, doc, score = kept.hits()
    assert sorted((k, -s, kept.ids[d]) for k, s, d in zip(key.tolist(), score.tolist(), doc.tolist())) == sorted(x for k in range(9) for x in sorted(e for e in every if e[0] == k)[:3])
