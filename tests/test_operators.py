"""Core operators on small fixtures and on odd input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from memlode.functions import vectors as V
from memlode.functions.tokenizer import load
from memlode.operators import content, curation, entities, hybrid, knowledge, search, sessions, store
from memlode.operators.graph import connected_components
from memlode.operators.vectors import top_k
from memlode.sources import importers
from memlode.streaming import streams

UTC = dt.timezone.utc


def when(hour, day=1):
    return dt.datetime(2025, 1, day, hour, tzinfo=UTC)


def test_components(spark):
    rng = [(f"n{k}", f"n{k + 1}") for k in range(30)] + [("a", "b"), ("b", "a"), ("c", "c"), (None, "x"), ("hub", "a")] + [("hub", f"leaf{k}") for k in range(40)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(rng, "a string, b string")).collect()}
    assert len({out[f"n{k}"] for k in range(31)}) == 1
    assert out["a"] == out["b"] == out["hub"] == out["leaf7"] != out["n0"]
    assert "c" not in out and "x" not in out
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_change_log(spark):
    log = [("a", 0, "put", "1"), ("a", 1, "delete", None), ("a", 2, "put", "2"), ("b", 0, "put", "1"), ("b", 1, "delete", None), ("c", 0, "put", "1"), ("c", 5, "purge", None)]
    df = spark.createDataFrame(log, "id string, seq long, op string, content string")
    assert {(r.id, r.content) for r in store.live_after(df).collect()} == {("a", "2")}
    assert {r.id for r in store.latest(df).collect()} == {"a", "b"}
    assert store.live_after(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        store.in_scope()


def test_projects(spark):
    p = spark.createDataFrame([("1", "My App", "/home/u/my-app"), ("2", "Other", "/home/u/my-app/sub"), ("3", None, None)], "id string, name string, path string")
    specs = spark.createDataFrame([("my app",), ("MY_APP",), ("/home/u/my-app",), ("1",), ("nope",)], "spec string")
    out = {r.spec: r.project_id for r in store.resolve_projects(specs, p).collect()}
    assert out == {"my app": "1", "MY_APP": "1", "/home/u/my-app": "1", "1": "1", "nope": None}
    paths = spark.createDataFrame([("/home/u/my-app/sub/x",), ("/home/u/my-app2",), ("/home/u/my-app",)], "path string")
    assert {r.path: r.project_id for r in store.detect_project(paths, p).collect()} == {"/home/u/my-app/sub/x": "2", "/home/u/my-app2": None, "/home/u/my-app": "1"}


def test_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0], [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), (3, [1.0, 1.0, 0.0], [1.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0]), (5, [1.0], [1.0, 0.0, 0.0]), (6, None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, a array<float>, b array<float>")
    out = [r.c for r in df.orderBy("id").select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert out[:2] == [1.0, 0.0] and out[2] == pytest.approx(0.707, abs=0.01) and out[3:] == [0.0, 0.0, None]
    q = df.where("id = 3").select(V.dequantize(V.quantize(F.col("a"))).alias("d"), V.normalize(F.col("a")).alias("n")).first()
    assert q.d == pytest.approx([1, 1, 0]) and q.n == pytest.approx([0.7071, 0.7071, 0], abs=1e-4)
    flat = spark.createDataFrame([([2.0, 2.0],)], "a array<float>").select(V.quantize(F.col("a")).alias("q")).first().q
    assert flat.scale == 0 and flat.data == [0, 0]
    pool = spark.createDataFrame([([[1.0, 3.0], [3.0, 5.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<float>>, m array<int>").select(V.mean_pool(F.col("v"), F.col("m")).alias("p")).first().p
    assert pool == [2.0, 4.0]
    near = top_k(df.select("id", F.col("b").alias("v")), df.where("id = 3").select("id", F.col("a").alias("v")), id_col="id", vector="v", dims=3, k=2)
    assert [(r.id, round(r.score, 3)) for r in near.orderBy("rank").collect()] == [(1, 0.707), (2, 0.707)]
    assert top_k(df.select("id", F.col("b").alias("v")), df.limit(0).select("id", F.col("a").alias("v")), id_col="id", vector="v", dims=3, k=2).count() == 0


def test_fusion_and_boosts(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "qid int, id string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 9)], "qid int, id string, rank int")
    out = {r.id: round(r.score, 3) for r in hybrid.fuse([(v, 0.7), (b, 0.3)]).collect()}
    assert out == {"a": 0.7, "b": 0.65}
    rows = spark.createDataFrame([("p", 30), (None, 0), ("", 60), ("x", -5)], "project string, days int")
    got = rows.select(hybrid.project_boost(F.lit(1.0), F.col("project"), F.lit("p")).alias("b"), hybrid.decay(F.lit(1.0), F.expr("timestamp '2025-03-01' - make_dt_interval(days)"), F.expr("timestamp '2025-03-01'")).alias("d")).collect()
    assert [r.b for r in got] == [1.3, 1.1, 1.1, 1.0]
    assert [round(r.d, 3) for r in got] == [0.5, 1.0, 0.25, 1.0]


def test_diversity(spark):
    rows = [(1, "a", 1.0, "red green blue"), (1, "b", 0.99, "red green blue"), (1, "c", 0.6, "other words here"), (2, "z", 1.0, None)]
    out = hybrid.diversify(spark.createDataFrame(rows, "qid int, id string, score double, content string"), 2).collect()
    assert [(r.qid, r.id) for r in sorted(out, key=lambda r: (r.qid, r["rank"]))] == [(1, "a"), (1, "c"), (2, "z")]


def test_substrings_proximity_snippets(spark):
    rows = [("c1", "docker build command failed with exit code 1"), ("c2", "docker " + "x " * 60 + "build"), ("c3", "Go documentation"), ("c4", None), ("c5", "")]
    chunks = spark.createDataFrame(rows, "id string, content string")
    asked = spark.createDataFrame([(1, "docker build"), (2, "Go documentation"), (3, "go"), (4, "")], "qid int, query string")
    hits = search.substring_search(chunks, asked)
    assert {(r.qid, r.id) for r in hits.collect()} == {(1, "c1"), (1, "c2"), (2, "c3")}
    ranked = search.rerank(hits.join(asked, "qid").join(chunks, "id"), 5).where("qid = 1").orderBy("rank").collect()
    assert [r.id for r in ranked] == ["c1", "c2"] and ranked[0].boost > 1
    assert search.min_span(search.term_positions("hello world", ["hello", "world"])) == 7
    assert search.min_span({"a": [], "b": [1]}) == 0
    cut = search.snippet("word " * 200 + "needle " + "word " * 200, ["needle"])
    assert "needle" in cut and cut.startswith("...") and cut.endswith("...") and len(cut) < 400


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "deploy deploys the app"), (2, "nothing here"), (3, None), (4, "")], "id int, text string")
    asked = spark.createDataFrame([("q", "deploy!"), ("r", "the"), ("s", None)], "qid string, text string")
    out = search.bm25(docs, search.phrases(asked, "qid", "text"), id_col="id", text="text").collect()
    assert [(r.qid, r.id) for r in out] == [("q", 1)] and out[0].score > 0


def test_entities_and_topics(spark):
    known = spark.createDataFrame([("alpha-one",), ("são",)], "entity string")
    asked = spark.createDataFrame([(1, "Is Alpha-One in São or alpha-one?"), (2, ""), (3, None)], "qid int, text string")
    assert {(r.qid, r.entity) for r in entities.detect(asked, known).collect()} == {(1, "Alpha-One"), (1, "São"), (1, "alpha-one")}
    steps = spark.createDataFrame([("s", 1, ["a"], [1.0, 0.0]), ("s", 2, ["a", "b"], [1.0, 0.0]), ("s", 3, ["c"], [1.0, 0.1]), ("s", 4, ["d"], [0.0, 1.0]), ("s", 5, None, None)], "k string, n int, entities array<string>, v array<float>")
    assert [r.changed for r in entities.topic_changes(steps, "k", ["n"], vector="v").orderBy("n").collect()] == [False, False, False, True, True]


def test_markdown_chunks():
    found = content.markdown_chunks("# Title 1\nintro\n\n## Section A\ntext\n\n# Title 2\nend")
    assert [c[0] for c in found] == ["Title 1", "Title 1 > Section A", "Title 2"]
    found = content.markdown_chunks("# T\n```go\n# not a heading\nfunc main() {}\n```")
    assert len(found) == 1 and found[0][1] and "```go" in found[0][2]
    assert content.markdown_chunks("") == []
    parts = content.split_paragraphs("é" * 5000, 4096)
    assert "".join(parts) == "é" * 5000 and all(len(p.encode()) <= 4096 for p in parts)
    assert content.pack_lines("a\nb\n" + "c" * 20, 5) == ["a\nb", "c" * 20]


def test_sections_and_eviction(spark):
    text = "# A\n" + "x" * 4000 + "\n## B\nshort"
    out = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(content.heading_sections(F.col("t")).alias("s")).collect()
    assert [len(s) for s in out[0].s] == [2000, 2000, 205, 10] and out[1].s == []
    rows = [("a", when(1), 1, "x" * 50), ("b", when(2), 0, "x" * 50), ("c", when(3), 0, "x" * 50), ("d", when(4, 5), 24, "x" * 50), ("e", when(5), -1, None)]
    chunks = spark.createDataFrame(rows, "id string, indexed_at timestamp, ttl_hours int, content string")
    gone = {r.id: r.reason for r in content.evict(chunks, 100, F.lit("2025-01-05 12:00:00").cast("timestamp")).collect()}
    assert gone == {"a": "expired", "b": "size"}


def test_pages(spark):
    html = "<html><head><style>x</style></head><body><h1>T</h1><p>a <b>b</b> <a href='u'>c</a></p><ul><li>x</li><li>y</li></ul><pre>k = 1</pre></body></html>"
    assert content.html_to_markdown(html) == "# T\n\na **b** [c](u)\n\n- x\n- y\n\n```\nk = 1\n```"
    rows = spark.createDataFrame([(html, "text/html"), ('{"a":1}', "application/json"), ("plain", "text/plain"), ("x", "image/png"), (None, "text/html")], "b string, t string")
    out = [r.f for r in rows.select(content.fetched_text(F.col("b"), F.col("t")).alias("f")).collect()]
    assert out[0].startswith("# T") and '"a"' in out[1] and out[2:] == ["plain", None, None]


def test_triples(spark):
    rows = [(1, "Auth service uses Redis for session caching", when(1), "p"), (2, "O servidor depende de Postgres agora", when(2), "p"), (3, "too short", when(3), None), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id int, t string, at timestamp, p string")
    found = knowledge.extract(df, id_col="id", text="t", time="at", project="p")
    assert {(r.id, r.subject, r.predicate, r.object) for r in found.collect()} == {(1, "Auth service", "uses", "Redis"), (2, "O servidor", "depends_on", "Postgres")}
    assert {r.alias for r in knowledge.entities(found).collect()} == {"auth service", "redis", "o servidor", "postgres"}
    facts = spark.createDataFrame([(1, 0, "A", "uses", "X", when(1)), (2, 0, "a", "uses", "Y", when(5)), (3, 0, "A", "is_a", "Z", when(2))], "id int, n int, subject string, predicate string, object string, valid_from timestamp")
    valid = knowledge.with_validity(facts, ("uses",))
    at = lambda h: {r.object for r in knowledge.as_of(valid, F.lit(f"2025-01-01 {h:02d}:00:00").cast("timestamp")).collect()}
    assert at(3) == {"X", "Z"} and at(6) == {"Y", "Z"}
    assert {r.object for r in knowledge.one_hop(valid, spark.createDataFrame([("A",), ("nope",)], "name string")).collect()} == {"Y", "Z"}


def test_curation(spark):
    rows = [("a", when(3), "x"), ("b", when(1), "x"), ("c", when(2), "x"), ("d", when(1), "y")]
    df = spark.createDataFrame(rows, "id string, created_at timestamp, h string")
    assert {(r.memory_id, r.related_memory_id) for r in curation.exact_duplicates(df, F.col("h")).collect()} == {("a", "b"), ("c", "b")}
    pairs = spark.createDataFrame([("a", "b", 0.72, "enable the cache", "disable the cache"), ("c", "d", 0.72, "it is on", "it is never on"), ("e", "f", 0.72, "same", "same"), ("g", "h", 0.99, "yes", "not")], "id string, other string, similarity double, content string, other_content string")
    assert {(r.id, r.reason) for r in curation.contradictions(pairs).collect()} == {("a", "antonyms"), ("c", "negation")}
    actions = spark.createDataFrame([("a", "dedup", 1.0), ("b", "dedup", 0.8), ("c", "dedup", 0.5), ("d", "contradiction", 0.6)], "memory_id string, action_type string, confidence double")
    status = lambda p: {r.memory_id: r.status for r in curation.consolidate(actions, p).collect()}
    assert status(curation.PRESETS["moderate"]) == {"a": "applied", "b": "applied", "c": "skipped", "d": "flagged"}
    assert status(curation.Preset(0.75, 1))["b"] == "skipped"
    assert set(status(curation.PRESETS["conservative"]).values()) == {"skipped", "flagged"}
    presets = curation.PRESETS
    assert presets["conservative"].threshold > presets["moderate"].threshold > presets["aggressive"].threshold


def test_sessions(spark):
    rows = [("stale", when(1), when(1), None, 1), ("fresh", when(1), when(3), None, None), ("ended", when(1), None, when(2), 2)]
    df = spark.createDataFrame(rows, "id string, created_at timestamp, last_activity_at timestamp, ended_at timestamp, message_count int")
    at = F.lit("2025-01-01 03:15:00").cast("timestamp")
    out = {r.id: r.ended_at for r in sessions.end_stale(df, at, 60).collect()}
    assert out["stale"] is not None and out["fresh"] is None and out["ended"].hour == 2
    s = sessions.stats(df).first()
    assert (s.total, s.active) == (3, 2)
    events = spark.createDataFrame([("fresh", when(4)), ("fresh", when(5)), ("none", when(5))], "session_id string, created_at timestamp")
    counted = {r.id: r.message_count for r in sessions.record_activity(df, events).collect()}
    assert counted == {"stale": 1, "fresh": 2, "ended": 2}
    runs = sessions.sessionize(spark.createDataFrame([("k", when(1)), ("k", when(2)), (None, when(1)), ("k", None)], "k string, t timestamp"), "k", "t")
    assert runs.count() == 2


def test_transcripts(spark, tmp_path):
    folder = tmp_path / "-home-u-app"
    (folder / "subagents").mkdir(parents=True)
    (folder / "a.jsonl").write_text(
        '{"type":"user","sessionId":"s","cwd":"/x","message":{"role":"user","content":"please split the parser"}}\n'
        '{"type":"assistant","sessionId":"s","message":{"role":"assistant","content":[{"type":"text","text":"The parser is now split."},{"type":"tool_use","name":"Read","input":"{}"}]}}\n'
        '{"type":"assistant","message":{"role":"assistant","content":"Let me look at it first"}}\n'
        '{"type":"attachment"}\nnot json\n{"type":"summary","summary":"Work on the parser was done"}\n'
    )
    (folder / "subagents" / "b.jsonl").write_text('{"type":"user","message":{"role":"user","content":"a task for the helper"}}\n')
    out = {(r.role, r.text, r.is_subagent) for r in importers.read_transcripts(spark, str(tmp_path)).collect()}
    assert out == {("user", "please split the parser", False), ("assistant", "The parser is now split.", False), ("summary", "Work on the parser was done", False), ("user", "a task for the helper", True)}


def test_notes_rules_settings(spark, tmp_path):
    (tmp_path / "n.md").write_text("---\ntype: decision\n---\nWe keep it.")
    (tmp_path / "m.md").write_text("weekly report of the team")
    (tmp_path / "r.mdc").write_text("---\ndescription: How to name\nglobs: *.py\n---\nUse plain names.")
    (tmp_path / "bad.mdc").write_text("---\ndescription: never closed")
    notes = {(r.category, r.content) for r in importers.read_notes(spark, str(tmp_path)).collect()}
    assert notes == {("decision", "We keep it."), ("summary", "weekly report of the team")}
    rules = [r.content for r in importers.read_rules(spark, str(tmp_path)).collect()]
    assert len(rules) == 1 and rules[0].startswith("# r\n\nHow to name\n\nUse plain names.\n\n<!-- metadata: ")
    rows = spark.createDataFrame([('{"b":1,"a":{"x":true}}',), ("{}",), ("broken",), (None,)], "s string")
    assert [r.f for r in rows.select(importers.format_settings(F.col("s")).alias("f")).collect()] == ['- **a**: {"x":true}\n- **b**: 1', "", "", ""]


def test_chat_tables(spark):
    make = spark.createDataFrame
    s = make([("s1", "p1", ""), ("s2", None, "/d"), ("s3", None, None)], "id string, project_id string, directory string")
    m = make([("m1", "s1"), ("m2", "s2"), ("m3", "s3")], "id string, session_id string")
    p = make([("2", "m1", "text", "two"), ("1", "m1", "text", " one "), ("3", "m1", "step-start", "no"), ("4", "m2", "text", "  "), ("5", "m3", "text", "x")], "id string, message_id string, type string, text string")
    pr = make([("p1", "Name", "/w"), ("p2", "", ""), ("p3", None, "/only")], "id string, name string, worktree string")
    assert [(r.message_id, r.directory, r.text) for r in importers.chat_messages(s, m, p, pr).collect()] == [("m1", "/w", "one\ntwo")]
    assert {r.content for r in importers.chat_projects(pr).collect()} == {"Project: Name (worktree: /w)", "Project:  (worktree: /only)"}
    todos = make([("s2", 1, "do it"), ("s2", 2, " "), ("zz", 3, "other")], "session_id string, position int, content string")
    assert {(r.content, r.directory) for r in importers.chat_todos(todos, s).collect()} == {("do it", "/d"), ("other", None)}


def test_ingest_and_ledgers(spark):
    rows = spark.createDataFrame([("p", "  token=abcdefghijklmnopqrstuvwx  ", when(1)), ("p", "token=abcdefghijklmnopqrstuvwx", when(2)), ("q", " ", when(1)), (None, None, None)], "p string, content string, at timestamp")
    out = importers.ingest(rows, source="cli", project="p", created=F.col("at")).collect()
    assert len(out) == 1 and out[0].content == "token=[REDACTED]" and out[0].created_at.hour == 1 and len(out[0].id) == 32
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    old = spark.createDataFrame([("a", "1"), ("b", "9")], "path string, sha256 string")
    assert {r.path for r in importers.changed_files(files, old).collect()} == {"b", "c"}
    sources = spark.createDataFrame([("x", when(5)), ("y", when(1)), ("z", when(1))], "source string, modified_at timestamp")
    ledger = spark.createDataFrame([("x", "done", when(1), when(2)), ("y", "done", when(1), when(2))], "source string, status string, started_at timestamp, finished_at timestamp")
    assert {r.source for r in importers.due_imports(sources, ledger).collect()} == {"x", "z"}


def test_tokenizers():
    piece = load({"model": {"type": "WordPiece", "vocab": {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "play": 4, "##ing": 5, "!": 6}, "unk_token": "[UNK]"}, "normalizer": {"type": "BertNormalizer", "lowercase": True}, "pre_tokenizer": {"type": "BertPreTokenizer"}}, 8)
    assert piece.window("Plàying xx!") == ([2, 4, 5, 1, 6, 3, 0, 0], [1] * 6 + [0] * 2, [0] * 8)
    pair = load({"model": {"type": "BPE", "vocab": {"l": 0, "o": 1, "w": 2, "lo": 3, "low": 4}, "merges": ["l o", "lo w"]}})
    assert pair.encode("low lo") == [4, 3]
    greedy = load({"model": {"type": "Unigram", "vocab": [["<unk>", 0], ["▁a", -1], ["▁", -2], ["b", -3]], "unk_id": 0}, "pre_tokenizer": {"type": "Metaspace"}})
    assert greedy.encode("ab b") == [1, 3, 2, 3]
    assert piece.window("")[0] == [2, 3, 0, 0, 0, 0, 0, 0]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("h1", when(1)), ("h1", when(2)), ("h2", when(3))], "h string, t timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "x.parquet"))
    stream = streams.source(spark, str(tmp_path / "x.parquet"))
    assert {r.h for r in streams.run(streams.deduplicated(stream, ["h"], "t")).collect()} == {"h1", "h2"}
    assert streams.run(stream, each=lambda df, n: df.where("h = 'h2'")).count() == 1


def test_context_budget(spark):
    rows = spark.createDataFrame([("p", 0, 1, "x" * 90), ("p", 1, 1, "x" * 20), ("p", 2, 1, "x" * 5), ("q", 1, 1, "x")], "k string, layer int, position int, text string")
    assert {(r.k, r.layer) for r in sessions.compose_context(rows, "k", 100).collect()} == {("p", 0), ("q", 1)}


def test_bins_empty_layers(spark):
    assert sessions.compose_context(spark.createDataFrame([], "k string, layer int, position int, text string"), "k").count() == 0
