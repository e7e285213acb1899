"""Queries of sessions, events, imports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlode.functions.text import ACCENTED, LOW_PREFIXES, NOISE, PLAIN, format_time, normalize_accents, rfc3339
from memlode.functions.tokenizer import load, tokenize
from memlode.functions.embed import HashingEmbedder, from_cache
from memlode.functions.words import words
from memlode.operators import context as C
from memlode.operators import sessions as S
from memlode.operators import store
from memlode.plans.catalog import register
from memlode.sources import importers as I
from memlode.sources.tables import table
from memlode.streaming import streams

SESSIONS, EVENTS = "(SELECT DISTINCT ON (id) * FROM sessions)", "(SELECT DISTINCT ON (id) * FROM session_events)"
AS_OF = "TIMESTAMPTZ '2026-01-01 00:00:00+00'"


def sessions(spark, d):
    return store.once(table(spark, d, "sessions"))


def session_events(spark, d, *columns):
    rows = table(spark, d, "session_events")
    return store.once(rows.select("id", *columns) if columns else rows)


@register("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
      g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
    SELECT user_id, min(ts) AS started, max(ts) AS last_activity, count(*) AS message_count FROM g GROUP BY user_id, g""")
def sessionize(spark, d):
    return S.sessionize(table(spark, d, "events"), "user_id", "ts")


@register(f"SELECT count(*) AS total, count(*) FILTER (ended_at IS NULL) AS active FROM {SESSIONS}")
def session_stats(spark, d):
    return S.stats(sessions(spark, d))


@register(f"SELECT id, CASE WHEN ended_at IS NULL AND coalesce(last_activity_at, created_at) < {AS_OF} - INTERVAL 30 MINUTE THEN {AS_OF} ELSE ended_at END AS ended_at FROM {SESSIONS}")
def stale_sessions(spark, d):
    return S.end_stale(sessions(spark, d), F.lit("2026-01-01").cast("timestamp")).select("id", "ended_at")


@register(f"""SELECT s.id, coalesce(s.message_count, 0) + coalesce(e.n, 0) AS message_count, greatest(s.last_activity_at, e.t) AS last_activity_at FROM {SESSIONS} s
      LEFT JOIN (SELECT session_id, count(*) AS n, max(created_at) AS t FROM {EVENTS} GROUP BY session_id) e ON e.session_id = s.id""")
def record_activity(spark, d):
    return S.record_activity(sessions(spark, d), session_events(spark, d, "session_id", "created_at")).select("id", "message_count", "last_activity_at")


@register(f"SELECT id, source, source_session_id, started FROM (SELECT id, source, source_session_id, created_at AS started, row_number() OVER (PARTITION BY source_session_id ORDER BY created_at DESC, id) AS r FROM {SESSIONS} WHERE ended_at IS NULL) WHERE r = 1")
def active_sessions(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("source_session_id").orderBy(F.desc("created_at"), "id")
    rows = S.active(sessions(spark, d)).withColumn("r", F.row_number().over(w)).where("r = 1")
    return rows.select("id", "source", "source_session_id", F.col("created_at").alias("started"))


@register(f"SELECT id, project_id, rank::INTEGER AS rank FROM (SELECT id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS rank FROM {EVENTS} WHERE priority <= 2) WHERE rank <= 20")
def events_recent(spark, d):
    return S.latest_events(session_events(spark, d, "project_id", "priority", "created_at"), "project_id", 20, 2).select("id", "project_id", "rank")


@register(f"""WITH s AS (SELECT project_id, max_by(summary, struct_pack(a := created_at, b := id)) AS snapshot FROM {EVENTS} WHERE event_type = 'precompact_snapshot' GROUP BY project_id),
      t AS (SELECT project_id, list(summary ORDER BY rank) AS summaries FROM (SELECT project_id, summary, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS rank FROM {EVENTS} WHERE priority <= 2) WHERE rank <= 20 GROUP BY project_id)
    SELECT coalesce(s.project_id, t.project_id) AS project_id, snapshot, summaries FROM s FULL OUTER JOIN t ON s.project_id = t.project_id""")
def resume_context(spark, d):
    return S.resume_context(session_events(spark, d, "project_id", "event_type", "priority", "summary", "created_at"))


LAYERS = "(SELECT project_id, CASE category WHEN 'preference' THEN 0 WHEN 'decision' THEN 1 ELSE 2 END AS layer, id AS position, content AS text FROM (SELECT DISTINCT ON (id) * FROM memories WHERE deleted_at IS NULL) WHERE project_id IS NOT NULL)"


@register(f"SELECT project_id, layer, position, used::BIGINT AS used FROM (SELECT *, sum(strlen(text)) OVER (PARTITION BY project_id ORDER BY layer, position ROWS UNBOUNDED PRECEDING) AS used FROM {LAYERS}) WHERE layer = 0 OR used <= 3600")
def layered_context(spark, d):
    rows = store.once(store.live(table(spark, d, "memories").select("id", "project_id", "category", "content", "deleted_at"))).where("project_id is not null")
    layer = F.when(F.col("category") == "preference", 0).when(F.col("category") == "decision", 1).otherwise(2)
    return S.compose_context(rows.select("project_id", layer.alias("layer"), F.col("id").alias("position"), F.col("content").alias("text")), "project_id").drop("text")


@register(f"SELECT session_id, string_agg(trim(summary, ' '), chr(10) ORDER BY id) AS text FROM {EVENTS} WHERE length(trim(summary, ' ')) > 0 AND session_id IN (SELECT id FROM sessions WHERE nullif(directory, '') IS NOT NULL OR project_id IN (SELECT id FROM projects WHERE nullif(path, '') IS NOT NULL)) GROUP BY session_id")
def role_text_join(spark, d):
    """Sessions as messages, their events as the parts."""
    rows = sessions(spark, d).select("id", "project_id", "directory")
    parts = session_events(spark, d, "session_id", "summary").select("id", F.col("session_id").alias("message_id"), F.lit("text").alias("type"), F.col("summary").alias("text"))
    messages = rows.select("id", F.col("id").alias("session_id"))
    return I.chat_messages(rows, messages, parts, table(spark, d, "projects").select("id", F.col("path").alias("worktree"))).select("session_id", "text")


@register(f"""SELECT id, role, session_id, trim(summary, ' ') AS text FROM (SELECT id, CASE WHEN priority <= 2 THEN 'user' ELSE 'assistant' END AS role, session_id, summary FROM {EVENTS})
    WHERE coalesce(strlen(trim(summary, ' ')) >= 12, false) AND NOT starts_with(lower(trim(summary, ' ')), 'tool:') AND NOT contains(lower(summary), '"tool_use"')
      AND NOT (role = 'assistant' AND strlen(trim(summary, ' ')) < 240 AND ({' OR '.join("starts_with(lower(trim(summary, ' ')), '" + p.replace("'", "''") + "')" for p in LOW_PREFIXES)}))
      AND NOT ({' OR '.join(f"contains(lower(summary), '{p}')" for p in NOISE)})""")
def transcript_messages(spark, d):
    """Events written as transcript lines, with text in blocks or plain, and read back."""
    rows = session_events(spark, d, "session_id", "summary", "priority")
    role = F.when(F.col("priority") <= 2, "user").otherwise("assistant")
    block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("summary").alias("text"))))
    content = F.when(F.col("priority") == 1, block).otherwise(F.col("summary"))
    line = F.to_json(F.struct(role.alias("type"), F.struct(role.alias("role"), content.alias("content")).alias("message"), F.col("session_id").alias("sessionId")))
    return I.parse_transcript(rows.select("id", line.alias("value"))).select("id", "role", "session_id", "text")


@register()
def ingest_documents(spark, d):
    """All documents redacted, categorized, hashed and deduplicated for the store."""
    return I.ingest(table(spark, d, "documents"), source="indexer", text="text", project="project_id", created=F.col("collected_at")).select("id", "project_id", "category", "content_hash", "created_at")


@register("SELECT path, sha FROM (SELECT DISTINCT id AS path, sha256(content) AS sha FROM incoming_memories) WHERE NOT EXISTS (SELECT 1 FROM memories m WHERE m.id = path AND sha256(m.content) = sha)")
def file_delta(spark, d):
    """Incoming records as files whose hash differs from the memory under the same id."""
    now = table(spark, d, "incoming_memories").select(F.col("id").alias("path"), F.sha2("content", 256).alias("sha256")).distinct()
    old = store.once(table(spark, d, "memories").select("id", "content")).select(F.col("id").alias("path"), F.sha2("content", 256).alias("sha256"))
    return I.changed_files(now, old).select("path", F.col("sha256").alias("sha"))


@register("SELECT DISTINCT content_hash FROM (SELECT sha256(content) AS content_hash FROM incoming_memories WHERE content IS NOT NULL)")
def stream_dedupe(spark, d):
    stream = streams.source(spark, f"{d}/incoming_memories.parquet").where("content is not null").withColumn("content_hash", F.sha2("content", 256))
    return streams.run(streams.deduplicated(stream.select("content_hash", "arrived_at"), ["content_hash"], "arrived_at", "90 days")).select("content_hash")


@register("SELECT event_type, date_trunc('day', ts) AS started, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    stream = streams.source(spark, f"{d}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return streams.run_latest(streams.tumbling(stream, "event_type", "ts"), ["event_type", "started"])


@register("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
      g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
    SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM g GROUP BY user_id, g""")
def stream_session_window(spark, d):
    """All session windows, open ones too: the complete result of the stream. In append mode windows come once the watermark has passed them."""
    stream = streams.source(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.run_latest(streams.windows(stream, "user_id", "ts"), ["user_id", "started"], "complete")


@register()
def token_windows(spark, d):
    """Ids, mask and types of the first 126 tokens of every document, by the word-level vocabulary of its own words."""
    vocabulary = load({"model": {"type": "WordPiece", "vocab": {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz0123456789", *("##" + c for c in "abcdefghijklmnopqrstuvwxyz0123456789")])}, "unk_token": "[UNK]"}, "normalizer": {"type": "BertNormalizer", "lowercase": True, "strip_accents": True}, "pre_tokenizer": {"type": "BertPreTokenizer"}})
    return table(spark, d, "documents").select("doc_id", tokenize(vocabulary, F.col("text")).alias("t")).select("doc_id", "t.*")


@register(f"SELECT id, strftime(created_at, '%Y-%m-%d %H:%M') AS shown, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM {SESSIONS}")
def session_times(spark, d):
    """When sessions were created, as lists and as exchange formats show it."""
    return sessions(spark, d).select("id", format_time(F.col("created_at")).alias("shown"), rfc3339(F.col("created_at")).alias("stamp"))


@register(f"""WITH n AS (SELECT source, source_session_id, max_by(id, struct_pack(a := created_at, b := id)) AS id FROM {SESSIONS} WHERE ended_at IS NULL GROUP BY ALL)
    SELECT DISTINCT s.source, s.source_session_id, n.id IS NOT NULL AS resumed, n.id AS open_id FROM {SESSIONS} s LEFT JOIN n ON n.source = s.source AND n.source_session_id = s.source_session_id WHERE s.source IS NOT NULL AND s.source_session_id IS NOT NULL""")
def session_resume(spark, d):
    """Every session asked for again: the open one of its source, or a new one."""
    rows = sessions(spark, d)
    asked = rows.where("source is not null and source_session_id is not null").select("source", "source_session_id", F.lit(None).cast("string").alias("project_id"))
    out = S.start_or_resume(rows, asked, F.lit("2026-01-01").cast("timestamp"))
    return out.select("source", "source_session_id", "resumed", F.when(F.col("resumed"), F.col("id")).alias("open_id"))


LIVE = "(SELECT DISTINCT ON (id) * FROM memories WHERE deleted_at IS NULL)"


@register(f"SELECT project_id, category, list(id ORDER BY r) AS ids FROM (SELECT project_id, category, id, row_number() OVER (PARTITION BY project_id, category ORDER BY updated_at DESC NULLS LAST, id) AS r FROM {LIVE} WHERE project_id IS NOT NULL) WHERE r <= 3 GROUP BY ALL")
def essential_summary(spark, d):
    rows = store.once(store.live(table(spark, d, "memories").select("id", "project_id", "category", "updated_at", "deleted_at")))
    return C.essential_summary(rows)


@register(f"""WITH r AS (SELECT project_id AS qid, id, category, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS rank FROM {LIVE} WHERE project_id IS NOT NULL),
      t AS (SELECT *, row_number() OVER (PARTITION BY qid, category ORDER BY rank, id) AS turn FROM r)
    SELECT qid, id, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY turn, rank, id) AS place FROM t) WHERE place <= 10""")
def balanced_categories(spark, d):
    from pyspark.sql.window import Window

    rows = store.once(store.live(table(spark, d, "memories").select("id", "project_id", "category", "created_at", "deleted_at"))).where("project_id is not null")
    ranked = rows.select(F.col("project_id").alias("qid"), "id", "category", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), "id")).alias("rank"))
    return C.balanced(ranked, 10).select("qid", "id", "place")


WORDS_OF = f"SELECT DISTINCT unnest(regexp_extract_all(translate(lower({{}}), '{ACCENTED}', '{PLAIN}'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')) AS word FROM {{}}"


@register(f"""WITH v AS ({WORDS_OF.format('name', 'projects')}), q AS ({WORDS_OF.format('title', 'sessions')})
    SELECT q.word, v.word AS correction FROM q JOIN v ON levenshtein(q.word, v.word) <= 1 WHERE q.word NOT IN (SELECT word FROM v)""")
def fuzzy_corrections(spark, d):
    """Words of session titles, without accents, that are one edit from a word of a project name."""
    plain = lambda c: F.explode(words(normalize_accents(F.lower(c)))).alias("word")
    return C.corrections(table(spark, d, "sessions").select(plain("title")), table(spark, d, "projects").select(plain("name")))


@register(f"""SELECT id, format('{{}}. [{{}}] {{}} (score={{:.3f}})', rank, category, left(trim(replace(content, chr(10), ' '), ' '), 120) || CASE WHEN length(trim(replace(content, chr(10), ' '), ' ')) > 120 THEN '...' ELSE '' END, 1.0 / (3 * rank)) AS line
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, id) AS rank FROM {LIVE})""")
def result_lines(spark, d):
    from pyspark.sql.window import Window

    rows = store.once(store.live(table(spark, d, "memories").select("id", "source", "category", "content", "created_at", "deleted_at")))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("created_at"), "id")))
    return rows.select("id", C.result_line(F.col("rank"), F.col("category"), F.col("content"), F.lit(1.0) / (3 * F.col("rank"))).alias("line"))


@register("""WITH c AS (SELECT sha256(content) AS h, max(len(embedding)) AS n FROM memories WHERE embedding IS NOT NULL AND content IS NOT NULL GROUP BY 1)
    SELECT DISTINCT i.batch_no, i.seq_no, c.n IS NOT NULL AS hit FROM incoming_memories i LEFT JOIN c ON c.h = sha256(i.content)""")
def embedding_cache_hits(spark, d):
    rows = table(spark, d, "incoming_memories").select(F.struct("batch_no", "seq_no").alias("key"), "content").distinct()
    cache = table(spark, d, "memories").where("embedding is not null and content is not null").select(F.sha2("content", 256).alias("text_hash"), F.lit("given").alias("model"), "embedding", "created_at")
    return from_cache(rows, cache, "key", "content", "given").select("id.batch_no", "id.seq_no", F.col("embedding").isNotNull().alias("hit"))


@register()
def embed_documents(spark, d):
    return HashingEmbedder(64).embed(table(spark, d, "documents"), "doc_id", "text")


@register("SELECT source, count(*) AS found, count(*) FILTER (known) AS skipped, count(*) FILTER (NOT known) AS imported FROM (SELECT DISTINCT i.batch_no, i.seq_no, i.id, i.source, EXISTS (SELECT 1 FROM memories m WHERE sha256(m.content) = sha256(i.content)) AS known FROM incoming_memories i) GROUP BY source")
def import_totals(spark, d):
    known = table(spark, d, "memories").select(F.sha2("content", 256).alias("h")).distinct().withColumn("known", F.lit(True))
    rows = table(spark, d, "incoming_memories").select("batch_no", "seq_no", "id", "source", F.sha2("content", 256).alias("h")).distinct().join(known, "h", "left")
    return rows.groupBy("source").agg(F.count("*").alias("found"), F.count_if(F.col("known").isNotNull()).alias("skipped"), F.count_if(F.col("known").isNull()).alias("imported"))
