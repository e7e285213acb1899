"""Vectors, packing, mixing, personal data and spam."""

import math
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from memlode.llm import knn, mixing, packing, pii, spam


# Vectors


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(120, 16))
    x = np.concatenate([centres[k % 120] + rng.normal(size=16) * 0.15 for k in range(1200)]).reshape(-1, 16)
    rows = [(f"p{k:04d}", [float(np.float32(v)) for v in x[k]]) for k in range(1200)]
    rows += [(f"copy{k:03d}", rows[0][1]) for k in range(30)]
    return rows + [("null", None), ("short", [1.0]), ("zero", [0.0] * 16), ("nan", [math.nan] * 16), ("inf", [math.inf] + [0.0] * 15), rows[3]]


def truth(points, k, floor=-2.0):
    good = {i: np.array(v) for i, v in points if v is not None and len(v) == 16 and np.isfinite(v).all() and any(v)}
    ids = sorted(good)
    x = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    s = x @ x.T
    np.fill_diagonal(s, -3)
    out = {}
    for a, i in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda b: (-round(s[a, b], 6), ids[b]))[:k]
        out[i] = [(ids[b], s[a, b]) for b in order if s[a, b] >= floor]
    return out


def test_factor_one_is_exact(spark, points):
    df = spark.createDataFrame([(a, b, "x") for a, b in points], "id string, embedding array<float>, key string")
    got = {}
    for r in knn.knn(df, dims=16, relax=1.0, shard_rows=150).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r)
    want = truth(points, 5)
    assert set(got) == set(want)
    for i, near in want.items():
        assert [round(r.similarity, 4) for r in got[i]] == pytest.approx([s for _, s in near], abs=2e-4)


@pytest.mark.parametrize("shard_rows,fit_rows", [(150, 64)])
def test_shards_beyond_the_sample_are_cut_into_blocks(spark, points, shard_rows, fit_rows):
    """A sample too small for as many shards as there should be: points and queries are cut into blocks, and factor 1 stays exact."""
    df = spark.createDataFrame(points, "id string, embedding array<float>")
    got = {}
    for r in knn.knn(df, dims=16, relax=1.0, shard_rows=shard_rows, fit_rows=fit_rows, min_similarity=0.8).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(round(r.similarity, 3))
    want = {i: [round(float(s), 3) for _, s in near] for i, near in truth(points, 5, 0.8).items() if near}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=2e-3) for i in want)


def test_the_grid_is_even():
    grid = knn.Grid.of(np.array([100.0, 5000.0, 0.0]), np.array([900.0, 90_000.0, 10.0]), 1000, 4)
    assert grid.points.tolist() == [1, 5, 1] and grid.asks.tolist() == [1, 23, 1] and len(grid.task) == 117
    load = np.bincount(grid.task, weights=np.repeat([1000, 1000 + 90_000 / 23, 10], [1, 115, 1]))
    assert load.max() < 1.3 * load.mean() and grid.tasks == len(load)


def test_a_task_takes_leaves_beside_one_another():
    grid = knn.Grid.of(np.tile([900.0, 100.0, 500.0], 8), np.tile([2000.0, 300.0, 700.0], 8), 1000, 6)
    assert grid.tasks == 6 and (np.diff(grid.task) >= 0).all()  # so that a vector that asks in neighbours is sent once


def test_relaxed_recall(spark, points):
    df = spark.createDataFrame(points, "id string, embedding array<float>")
    got = {(r.id, r.neighbour) for r in knn.knn(df, dims=16, min_similarity=0.9, relax=8.0, shard_rows=150).collect()}
    want = {(i, j) for i, near in truth(points, 5, 0.9).items() for j, _ in near if not i.startswith("copy") and not j.startswith("copy")}
    assert len(want & got) >= 0.95 * len(want)


def test_asking_and_empty(spark, points):
    df = spark.createDataFrame(points, "id string, embedding array<float>")
    few = knn.knn(df, dims=16, asking=spark.createDataFrame([("p0007",), ("null",)], "id string"), relax=1.0)
    assert {r.id for r in few.collect()} == {"p0007"} and few.count() == 5
    assert knn.knn(df.limit(0), dims=16).count() == 0


# Packing


def test_best_fit_takes_the_best_and_closes_the_fullest():
    fit = packing.BestFit(10, open_bins=2)
    assert [fit.add(s) for s in (6, 5, 4, 5)] == [0, 1, 0, 1]
    fit = packing.BestFit(10, open_bins=2)
    assert [fit.add(s) for s in (9, 6, 8, 4, 1)] == [0, 1, 2, 1, 2]  # 0 closed as the fullest
    with pytest.raises(ValueError):
        fit.add(11)


@pytest.mark.parametrize("per_task", [50, 100_000])
def test_packing_is_whole_and_tight(spark, per_task):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["memory", "store", "ünïcode", "x1"]) for _ in range(rng.choice([1, 20, 60, 90, 400])))) for k in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "a " * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, container int")
    out = packing.pack_texts(df, capacity=256, open_bins=8, items_per_task=per_task).collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    per, whole = {}, {}
    for r in out:
        per[r.container] = per.get(r.container, 0) + r.n_tokens
        whole.setdefault(r.doc_id, []).append(r)
    assert max(per.values()) <= 256
    assert sum(per.values()) / (256 * len(per)) > 0.9
    from memlode.llm.tokens import VOCABULARY, encoding

    for key, text in rows:
        n = len(encoding(VOCABULARY).encode_ordinary(text or ""))
        pieces = sorted(whole[key], key=lambda r: r.piece_no)
        assert sum(r.n_tokens for r in pieces) == n
        assert len(pieces) == max(1, -(-n // 256))
    assert packing.pack_texts(df.limit(0)).count() == 0


# Mixing


def test_mix_reaches_its_shares(spark):
    rng = random.Random(2)
    rows = [(k, src, "word " * rng.randint(5, 40)) for k, src in enumerate(["big"] * 900 + ["mid"] * 300 + ["tiny"] * 20 + ["other"] * 5)]
    rows += [(5000, "big", None), (5001, None, "x"), (5002, "tiny", "")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, source string, text string, uses int")
    targets = spark.createDataFrame([("big", 2.0, 1), ("mid", 1.0, 2), ("tiny", 1.0, 4), ("gone", 1.0, 3), ("none", 0.0, 1)], "source string, target_weight double, max_repeats int")
    mix = mixing.mix_sources(docs, targets, reach=1.0, rows_per_window=100)
    report = {r.source: r for r in mix.report.collect()}
    assert report["gone"].tokens == 0 and report["none"].tokens == 0
    for s, share in (("big", 0.5), ("mid", 0.25), ("tiny", 0.25)):
        assert report[s].reached_share == pytest.approx(share, abs=0.03)
    used = mix.documents.collect()
    most = {"big": 1, "mid": 2, "tiny": 4}
    assert all(r.uses <= most[r.source] for r in used) and len({r.doc_id for r in used}) == len(used)
    again = mixing.mix_sources(docs, targets, reach=1.0, rows_per_window=7).documents.collect()
    assert {(r.doc_id, r.uses) for r in again} == {(r.doc_id, r.uses) for r in used}
    assert mixing.mix_sources(docs, targets.limit(0)).report.count() == 0
    assert mixing.mix_sources(docs.limit(0), targets).documents.count() == 0


def test_capped_sources_fall_short_and_say_so(spark):
    docs = spark.createDataFrame([(k, "a" if k < 5 else "b", "word " * 20) for k in range(200)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 2), ("b", 1.0, 1)], "source string, target_weight double, max_repeats int")
    report = {r.source: r for r in mixing.mix_sources(docs, targets, total_tokens=4000).report.collect()}
    assert report["a"].most_uses == 2 and report["a"].reached_share < 0.2 < report["b"].reached_share


def test_scarce_sources_do_not_shrink_the_mix(spark):
    docs = spark.createDataFrame([(k, "a" if k < 2 else "b" if k < 100 else "c", "word " * 20) for k in range(200)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 3), ("b", 2.0, 1), ("c", 1.0, 0)], "source string, target_weight double, max_repeats int")
    whole = {r.source: r for r in mixing.mix_sources(docs, targets, reach=1.0).report.collect()}
    assert whole["a"].most_uses == 3 and 0 < whole["b"].documents < 98 and whole["c"].documents == 0
    part = {r.source: r for r in mixing.mix_sources(docs, targets).report.collect()}
    assert part["a"].most_uses == 3 and part["a"].reached_share < part["a"].wanted_share and part["b"].documents == 98


def test_heavier_documents_come_more_often(spark):
    rows = spark.range(20_000).withColumn("w", F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0))
    picked = rows.orderBy(mixing.exponential(3, "id") / F.col("w")).limit(2000).where("w = 4").count()
    assert picked > 1400


# Personal data

GIVEN = ["Nadia", "Piotr", "Mark", "Will"]
CASES = [
    ("Ask Nadia Vorelquist before {x}.", {"name"}), ("Reviewed with Piotr Halden-Brook on 2025-02-03.", {"name"}), ("As Dr. Orvald said in ABC-1234, it is slow.", {"name"}),
    ("Send it to nadia.v@mail.corp.example please.", {"email"}), ("reply-to p_x (at) host (dot) org, subject 7", {"email"}), ("contact r.d at mail dot corp dot net", {"email"}),
    ("Call +44 20 7946 0099 if it hangs.", {"phone"}), ("Pager for x: (212) 555 0147.", {"phone"}), ("mask SSN 912-34-5678 before export", {"id_number"}), ("user row: passport XA1234567;", {"id_number"}),
    ("Ship the box to 12 Bramley Street, Apt 4, Oldtown.", {"address"}), ("Enviar para Rua das Flores, 227, Porto.", {"address"}), ("parcel: P.O. Box 77, Newton 99011", {"address"}),
    ("Clone git@forge.example:team/repo.git now.", set()), ("pip install tool@0a1b2c3d breaks things", set()), ("ticket 40-254-49189 was merged", set()), ("Build 912-04-592292 was green.", set()),
    ("epoch 177754763184 is the cut", set()), ("The Vornak Gateway shares lib/a/b.py with the gateway.", set()), ("Pinned core@2.70.1 and other@81.0.3.", set()), ("we should mark the gateway and will see", set()),
]


@pytest.fixture(scope="module")
def corpus():
    out = []
    for k in range(60):
        out += [t.replace("{x}", f"step {k}") + (f" Note {k}." if k % 2 else "") for t, _ in CASES]
    return out


def test_kinds_and_placeholders(spark, corpus):
    rows = [(k, t) for k, t in enumerate([t.replace("{x}", "it") for t, _ in CASES])] + [(900, None), (901, ""), (902, "x " * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, content string, kinds string")
    given = spark.createDataFrame([(g,) for g in GIVEN], "given_name string")
    model = pii.fit(spark.createDataFrame([(c,) for c in corpus], "content string"), given)
    out = {r.id: r for r in pii.redact(df, model).collect()}
    for k, (text, kinds) in enumerate(CASES):
        assert set(out[k].kinds) == kinds, (text, out[k].redacted)
    assert out[0].redacted == "Ask [NAME] before it."
    assert out[900].redacted is None and out[901].redacted == "" and out[902].redacted == rows[-1][1]
    assert pii.redact(df.limit(0), model).count() == 0
    empty = pii.fit(df.limit(0), given.limit(0))
    assert pii.redact(df, empty).count() == len(rows)


def test_insurance_numbers_are_found(corpus):
    forms = ["NINO QQ {:02d} 57 90 A", "QQ {:02d}6246 A", "QQ{:02d}8984C", "NI no. QQ-{:02d}-85-14-D"]
    rows = [f"The form logged {f.format(k)} in clear, see GU-7770{k} and build {k}1234." for k in range(10, 20) for f in forms]
    model = pii.train(corpus + rows, GIVEN)
    for text, marks in zip(rows, model.label(rows)):
        assert [(text[a:b].removeprefix("NINO "), pii.LABELS[k]) for a, b, k in marks] == [(regex.search(r"QQ[\d -]+[A-D]", text)[0], "id_number")]
    # short numbers are candidates beside an id word only
    assert [s.end - s.start for s in pii.spans("dni AB 123456 and passport 123456, then we ran step 123456", frozenset())] == [9, 6]


def test_repeated_tokens_agree():
    found = [[pii.Span(0, 3, pii.NAME, [], None, ["vorel"]), pii.Span(9, 12, pii.NAME, [], None, ["vorel"])]]
    scores = np.array([[0.0, 0, 0, 0, 0, 3.0], [0.4, 0, 0, 0, 0, 0.0]])
    pair = np.zeros((4, 6, 6))
    pair[pii.EQUAL] = np.eye(6) * 2
    for skip, want in ((True, [5, 5]), (False, [5, 0])):
        assert pii.propagate(scores, pii.nodes(found, skip), pair)[0].argmax(axis=1).tolist() == want


def test_messages_on_a_tree_are_exact():
    rng = np.random.default_rng(1)
    scores, pair = rng.normal(size=(3, 6)), np.tile(rng.normal(size=(6, 6)), (4, 1, 1))
    net = pii.Nodes(np.arange(3), ["a", "b", "c"], np.array([0, 1]), np.array([1, 2]), np.array([0, 2]))
    joint = scores[0][:, None, None] + scores[1][None, :, None] + scores[2][None, None, :] + pair[0][:, :, None] + pair[2][None, :, :]
    p = np.exp(joint) / np.exp(joint).sum()
    belief, both = pii.propagate(scores, net, pair, 40)
    belief = np.exp(belief) / np.exp(belief).sum(axis=1, keepdims=True)
    assert np.allclose(belief, [p.sum(axis=(1, 2)), p.sum(axis=(0, 2)), p.sum(axis=(0, 1))], atol=1e-6)
    assert np.allclose(both[0], p.sum(axis=2), atol=1e-6)


def test_skip_edges_carry_names_to_far_mentions(corpus):
    """Without the skip edges lone mentions stay readable; with them they follow the full name, in one document only."""
    rng = random.Random(8)
    family = ["".join(rng.choice(["vor", "hal", "quin", "mel", "tar", "bosk"]) for _ in range(3)).capitalize() for _ in range(60)]
    notes = [f"{rng.choice(['Nadia', 'Piotr', 'Dr.'])} {n} wrote the plan for step {k}. It was read twice, and later {n} was slow, and {n} signed it." for k, n in enumerate(family)]
    other = [f"The {v} {w} took step {k}, and later {v} was slow, and {v} signed it." for k, (v, w) in enumerate([(v, w) for v in ("Vornak", "Tulmar", "Osprey") for w in ("Gateway", "Cache", "Store")] * 16)]
    model = pii.train(corpus + notes + other + ["a gateway, a cache and a store are slow"] * 9, GIVEN)
    equal = model.pair[pii.EQUAL]
    assert equal[pii.NAME, pii.NAME] + equal[pii.NONE, pii.NONE] - 2 * equal[pii.NONE, pii.NAME] > 0.5
    fresh = ["Dr. Zelmandra asked for it, as Ms. Zelmandra had. " + "Nothing else was said about the plan. " * 30 + "The Osprey Store was slow. In the end Zelmandra signed.", "Nothing was said. The Osprey Store was slow. In the end Zelmandra signed."]
    count = lambda m: [sum(k == pii.NAME for _, _, k in marks) for marks in m.label(fresh)]
    assert count(model) == [3, 0]
    model.skip = False
    assert count(model) == [2, 0]


# Spam

PROSE = "We moved the cache into the store so that it is no longer read twice by the worker. The team asked for a short note on what was done and why it had to be done."


def test_spam_and_its_likes(spark):
    rng = random.Random(1)
    normal = [(k, PROSE + f" This is note {k} of the series, and it has {rng.randint(1, 99)} rows.", "en") for k in range(120)]
    stuffed = "buy cheap vector search deal " * 40
    links = "\n".join(f"https://www.site{k}.example/page{k}" for k in range(40))
    tags = ", ".join(rng.choice(["cheapDeal", "buyNow", "bestPrice", "freeTool"]) for _ in range(60))
    goods = "\n".join(f"Widget Z{k} | SKU {10000 + k} | $19.99 | best deal" for k in range(30))
    log = "\n".join(f"2025-01-{k % 28 + 1:02d}T10:00:00 INFO worker: job_{k}=a{k}f took={k * 7}ms" for k in range(60))
    code = "\n".join(f"    value_{k} = call_{k}(item[{k}], other_{k})" for k in range(40))
    explained = "\n".join(f"- [page{k}](https://docs.example/page{k}) - It is the page that tells you how to set up the store and when not to." for k in range(20))
    odd = [(900, stuffed, "en"), (901, links, None), (902, tags, "EN-us"), (903, goods, "xx"), (910, log, "en"), (911, code, "en"), (912, explained, "en"), (920, None, "en"), (921, "  ", "en"), (922, PROSE * 4000, "en")]
    df = spark.createDataFrame([(*r, "clash") for r in normal + odd + normal[:1]], "doc_id long, text string, lang string, words string")
    out = spam.spam_scores(df).collect()
    assert {r.doc_id for r in out if r.spam} == {900, 901, 902, 903}
    assert len(out) == len(normal) + len(odd) - 2 + 1
    assert spam.spam_scores(df.limit(0)).count() == 0


def test_distance_and_direction_both_decide(spark):
    """Without the distance, or without the direction, other texts come out: neither is an ornament."""
    rng = random.Random(3)
    clean = [(k, PROSE + f" This is note {k} of the series, and it has {rng.randint(1, 99)} rows. " + (f"See https://a{k}.example/b for it." if k % 3 == 0 else ""), "en") for k in range(150)]
    links = (900, "\n".join(f"https://www.site{k}.example/page{k}" for k in range(40)), "en")
    glossary = (901, "\n".join(rng.choice("red blue green amber violet teal".split()) + f" q{k} w{rng.randint(1, 9999)}" for k in range(60)), "en")
    got = {r.doc_id: r for r in spam.spam_scores(spark.createDataFrame([*clean, links, glossary], "doc_id long, text string, lang string")).collect()}
    assert {i for i, r in got.items() if r.spam} == {900}
    far, along = {i for i, r in got.items() if r.distance**2 > spam.CHI2_6}, {i for i, r in got.items() if r.direction > 0.5}
    assert 901 in far - along and {0, 3, 6} <= along - far and 900 in far & along


def test_long_tags_are_no_text():
    tag = '<div data-x="' + "word " * 200 + '">'
    assert spam.measure(f"alpha beta {tag} gamma", "en")[1] == 3


def test_long_pieces_are_no_sentences_by_two_words():
    def directed(text):
        return sum(spam.measure(text, "fr")[2][:4])

    links = [f"https://go.site{k}.example/a/page{k}" for k in range(40)]
    one_line = " ".join(f"{u} hébergement pas cher #tag{k} pour" for k, u in enumerate(links))
    broken = "<br>".join(f'{{"t":"serveur pas cher d\'{k}","u":"{u}"}}' for k, u in enumerate(links))
    stuffed = "server for the best memory and search " * 30
    assert min(map(directed, (one_line, broken, stuffed))) > 0.8
    assert spam.measure("alpha<br>beta<li>gamma</li>", "en")[2] == spam.measure("alpha\nbeta\ngamma", "en")[2]
    explained = f"Voir {links[0]} et {links[1]} pour la description du stockage, qui est dans le dossier de la page et ne change pas avec une version plus récente."
    assert max(map(directed, (explained, PROSE * 40))) == 0


def test_spam_that_is_much_of_a_language(spark):
    rng = random.Random(5)
    normal = [(k, PROSE + f" This is note {k} of the series, and it has {rng.randint(1, 99)} rows.", "en") for k in range(200)]
    lists = [(1000 + k, "\n".join([f"https://www.site{k}.example/page{j}" for j in range(rng.randint(8, 30))] + ["more to see"] * rng.randint(0, 3)), "en") for k in range(100)]
    copies = [(2000 + k, lists[0][1], "en") for k in range(300)]
    df = spark.createDataFrame(normal + lists + copies, "doc_id long, text string, lang string")
    for part, want in ((df.where("doc_id < 2000"), 100), (df, 400)):
        found = {r.doc_id for r in spam.spam_scores(part).where("spam").collect()}
        assert found == {r.doc_id for r in part.where("doc_id >= 1000").collect()} and len(found) == want
