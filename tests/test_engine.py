"""The engine's verbs, the schemas, the embedder and context on demand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from memlode.engine import Engine
from memlode.functions.embed import HashingEmbedder, backfill, from_cache
from memlode.operators import context
from memlode.sources import schema


@pytest.fixture(scope="module")
def at(spark):
    return F.lit("2025-01-01").cast("timestamp")


def test_verbs(spark, tmp_path, at):
    engine = Engine(spark, f"file://{tmp_path}/store")
    assert engine.list().count() == 0
    rows = spark.createDataFrame([("p", "We decided to use Redis for the session cache"), ("p", "The parser was split in two"), ("q", "Weekly report of the team"), ("q", " ")], "p string, content string")
    engine.save(rows, at, project="p")
    engine.save(rows.limit(1), at, project="p")
    assert engine.memories().count() == 3
    assert {(r.category, r.n) for r in engine.stats().where("category is not null").collect()} == {("decision", 1), ("fact", 1), ("summary", 1)}
    asked = spark.createDataFrame([(1, "redis cache", "p"), (2, "split parser", None)], "qid int, text string, project string")
    best = {r.qid: r.id for r in engine.search(asked, at, 2).where("rank = 1").collect()}
    texts = {r.id: r.content for r in engine.memories().collect()}
    assert "Redis" in texts[best["1"]] and "parser" in texts[best["2"]]
    assert [r.object for r in engine.facts().collect()] == ["Redis"]
    engine.update(spark.createDataFrame([(best["2"], "The parser uses Antlr in production", None), ("nobody", "x", None)], "id string, content string, category string"), at)
    assert {r.object for r in engine.facts().collect()} == {"Redis", "Antlr"}
    assert engine.forget(spark.createDataFrame([(best["1"],)], "id string")) == 1
    assert engine.forget_scope(category="summary") == 1 and engine.memories().count() == 1
    with pytest.raises(ValueError):
        engine.forget_scope()
    assert engine.curate().count() == 0


def test_index(spark, tmp_path, at):
    engine = Engine(spark, f"file://{tmp_path}/store")
    docs = spark.createDataFrame([(1, "# Build\nRun the zebra compilation first.\n# Docs\nRead the guide."), (2, ""), (3, None)], "id int, text string")
    engine.index(docs, at, "test-doc")
    engine.index(docs, at, "again")
    assert engine.chunks().count() == 2
    hit = engine.search_chunks(spark.createDataFrame([(1, "zebra compilation")], "qid int, query string")).first()
    assert "zebra" in hit.snippet
    assert engine.search_chunks(spark.createDataFrame([(1, "zebra")], "qid int, query string"), source="other").count() == 0


def test_schemas(spark):
    old = spark.createDataFrame([("a", "12", "x")], "id string, access_count string, extra string")
    row = schema.conform(old, "memories").first()
    assert row.id == "a" and row.access_count == 12 and row.content is None and "extra" not in row.asDict()
    ledger = spark.createDataFrame([("001",)], "name string")
    assert schema.pending(ledger, ["001", "002", "003"]) == ["002", "003"]
    assert all(len(schema.schema(t)) for t in schema.TABLES)


def test_embedder_and_cache(spark):
    e = HashingEmbedder(16)
    rows = spark.createDataFrame([(1, "one two"), (2, "two ONE"), (3, ""), (4, None)], "id int, t string")
    out = {r.id: r.embedding for r in e.embed(rows, "id", "t").collect()}
    assert out[1] == out[2] and sum(x * x for x in out[1]) == pytest.approx(1, abs=1e-5) and set(out[3]) == {0.0} and 4 not in out
    when = dt.datetime(2025, 1, 1)
    cache = spark.createDataFrame([("one two", e.model, [9.0], when), ("two ONE", "other", [8.0], when)], "t string, model string, embedding array<float>, created_at timestamp").withColumn("text_hash", F.sha2("t", 256))
    assert {r.id: r.embedding for r in from_cache(rows, cache, "id", "t", e.model).collect()} == {1: [9.0], 2: None, 3: None, 4: None}
    filled = {r.id: r.embedding for r in backfill(rows, cache, e, "id", "t").collect()}
    assert filled[1] == [9.0] and filled[2] == out[2] and set(filled) == {1, 2, 3}


def test_context(spark):
    words = spark.createDataFrame([("search",), ("cache",), ("é",)], "word string")
    asked = spark.createDataFrame([("serch",), ("cachee",), ("cachf",), ("cache",), ("store",), ("",), ("e",)], "word string")
    assert {(r.word, r.correction) for r in context.corrections(asked, words).collect()} == {("serch", "search"), ("cachee", "cache"), ("cachf", "cache"), ("", "é"), ("e", "é")}
    ranked = spark.createDataFrame([(1, "a", 1, "x"), (1, "b", 2, "x"), (1, "c", 3, "y")], "qid int, id string, rank int, category string")
    assert [r.id for r in context.balanced(ranked, 2).orderBy("place").collect()] == ["a", "c"]
    rows = spark.createDataFrame([("aé",), ("abc",), ("",), (None,)], "t string")
    assert [r.c for r in rows.select(context.limit_bytes(F.col("t"), 2).alias("c")).collect()] == ["a", "ab", "", None]


def test_sessions_events_and_facts(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"))
    at = lambda t: F.lit(t).cast("timestamp")
    asked = spark.createDataFrame([("cli", "x1", "p")], "source string, source_session_id string, project_id string")
    first = engine.start_session(asked, at("2025-01-01 10:00:00")).first()
    again = engine.start_session(asked, at("2025-01-01 10:05:00")).first()
    assert not first.resumed and again.resumed and again.id == first.id
    engine.end_session(spark.createDataFrame([(first.id,), ("unknown",)], "id string"), at("2025-01-01 11:00:00"))
    assert [str(r.ended_at) for r in engine.sessions().collect()] == ["2025-01-01 11:00:00"]
    assert not engine.start_session(asked, at("2025-01-02 10:00:00")).first().resumed
    engine.record_events(spark.createDataFrame([("e1", first.id), ("e2", first.id)], "id string, session_id string"))
    engine.delete_events(spark.createDataFrame([("e1",)], "id string"))
    assert [(r.id, r.priority) for r in engine.events().collect()] == [("e2", 3)]
    facts = spark.createDataFrame([("Auth service", "uses", "Redis"), ("auth service", "uses", "redis"), ("Auth service", "uses", "Valkey")], "subject string, predicate string, object string")
    engine.add_facts(facts, at("2025-01-01"))
    engine.add_facts(facts, at("2025-02-01"))
    assert engine.facts(("uses",)).count() == 2


def test_curation_finds_near_duplicates_and_keeps_its_runs(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "c"))
    texts = ["the cache should always be enabled for the worker queue", "the cache should always be disabled for the worker queue", "release notes are written on every friday evening", "release notes are written on every friday evening now"]
    for k, t in enumerate(texts):
        engine.save(spark.createDataFrame([(t,)], "content string"), F.lit(f"2025-01-0{k + 1}").cast("timestamp"))
    ids = {r.content: r.id for r in engine.memories().collect()}
    got = {(r.memory_id, r.action_type, r.status) for r in engine.curate("moderate", apply=True).collect()}
    assert (ids[texts[3]], "dedup", "applied") in got
    assert ids[texts[3]] not in {r.id for r in engine.memories().collect()}
    assert spark.read.parquet(f"{engine.root}/dream_runs").first().proposed == len(got)


def test_chunks_are_deleted_and_evicted(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "k"))
    for k in range(3):
        engine.index(spark.createDataFrame([(k, f"text number {k} " + "x" * 40)], "id long, text string"), F.lit(f"2025-01-0{k + 1}").cast("timestamp"), "web")
    assert engine.evict(100, F.lit("2025-01-03 12:00:00").cast("timestamp")) >= 1
    assert 1 <= engine.chunks().count() <= 2
    engine.delete_chunks(engine.chunks().select("id"))
    assert engine.chunks().count() == 0


def test_chat_database_rules_and_ledger(spark, tmp_path):
    import sqlite3
    from datetime import datetime

    from memlode.sources import importers as I

    with sqlite3.connect(tmp_path / "chat.db") as db:
        db.executescript("""
            CREATE TABLE project(id, name, worktree); CREATE TABLE session(id, project_id, directory); CREATE TABLE message(id, session_id, data); CREATE TABLE part(id, message_id, data);
            INSERT INTO project VALUES ('p', 'one', '/w/one'); INSERT INTO session VALUES ('s', 'p', ''); INSERT INTO message VALUES ('m', 's', '{}');
            INSERT INTO part VALUES ('1', 'm', '{"type":"text","text":"hello"}'), ('2', 'm', '{"type":"step-start"}'), ('3', 'm', '{"type":"text","text":"again"}');""")
    rows = I.read_chat_database(spark, str(tmp_path / "chat.db")).collect()
    assert [(r.directory, r.text) for r in rows] == [("/w/one", "hello\nagain")]
    assert I.read_sqlite(spark, str(tmp_path / "chat.db"), "todo", "session_id string, content string").count() == 0
    (tmp_path / "rules.json").write_text('{"rules": ["use tabs", {"content": "name things"}, " "]}')
    assert sorted(r.content for r in I.read_rules_json(spark, str(tmp_path)).collect()) == ["name things", "use tabs"]

    ledger = spark.createDataFrame([("a", "done", datetime(2025, 1, 1), datetime(2025, 1, 2))], "source string, status string, started_at timestamp, finished_at timestamp")
    fail = lambda: 1 / 0
    sources = [I.Source("b", lambda: None, fail), I.Source("a", lambda: datetime(2025, 1, 1), lambda: rows), I.Source("c", lambda: None, lambda: rows)]
    out = I.run_imports(sources, ledger, lambda name, got: len(got), lambda: datetime(2025, 3, 1))
    assert [(r["source"], r["status"], r["memories_imported"]) for r in out] == [("b", "failed", 0), ("c", "done", 1)]
