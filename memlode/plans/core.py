"""Queries of the store, its aggregates and the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions import text as T
from memlode.operators import store
from memlode.plans.catalog import register
from memlode.sources.tables import table

MEM = "(SELECT DISTINCT ON (id) * FROM memories)"
LIVE = "(SELECT DISTINCT ON (id) * FROM memories WHERE deleted_at IS NULL)"
STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)


def memories(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = table(spark, d, "memories")
    return store.once(rows.select(*columns) if columns else rows)


def live(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = store.live(table(spark, d, "memories"))
    return store.once(rows.select("id", *columns) if columns else rows)


@register(f"SELECT category, count(*) AS n FROM {LIVE} GROUP BY category")
def stats_by_category(spark, d):
    return live(spark, d, "category").groupBy("category").agg(F.count("*").alias("n"))


@register(f"SELECT project_id, count(*) AS n FROM {LIVE} WHERE project_id IS NOT NULL GROUP BY project_id")
def stats_by_project(spark, d):
    return live(spark, d, "project_id").where("project_id is not null").groupBy("project_id").agg(F.count("*").alias("n"))


@register(f"SELECT category, project_id, grouping(category, project_id) AS g, count(*) AS n FROM {LIVE} GROUP BY GROUPING SETS ((), (category), (project_id))")
def stats_rollup(spark, d):
    rows = live(spark, d, "category", "project_id")
    return rows.groupingSets([[], ["category"], ["project_id"]], "category", "project_id").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))


@register("SELECT coalesce(sum(length(content)), 0)::BIGINT AS characters, coalesce(sum(strlen(content)), 0)::BIGINT AS bytes FROM (SELECT DISTINCT ON (id) * FROM content_chunks)")
def content_size_total(spark, d):
    rows = store.once(table(spark, d, "content_chunks").select("id", "content"))
    return rows.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("characters"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))


@register(f"SELECT count(*) AS total, count(*) FILTER (embedding IS NULL OR len(embedding) = 0) AS no_embedding, count(*) FILTER (content_hash IS NULL OR content_hash = '') AS no_hash FROM {LIVE}")
def missing_counts(spark, d):
    rows = live(spark, d, "embedding", "content_hash")
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("embedding").isNull() | (F.size("embedding") == 0)).alias("no_embedding"), F.count_if(F.col("content_hash").isNull() | (F.col("content_hash") == "")).alias("no_hash"))


@register(f"SELECT id, category, created_at FROM {LIVE} ORDER BY created_at DESC, id LIMIT 50")
def list_recent(spark, d):
    return store.page(live(spark, d, "category", "created_at"), 50)


@register(f"SELECT id, category, source, created_at FROM {LIVE} WHERE category = 'decision' ORDER BY created_at DESC, id LIMIT 20 OFFSET 10")
def list_filtered_offset(spark, d):
    return store.page(live(spark, d, "category", "source", "created_at").where("category = 'decision'"), 20, 10)


@register(f"SELECT id, created_at FROM {LIVE} WHERE embedding IS NULL OR len(embedding) = 0 ORDER BY created_at, id LIMIT 100")
def embedding_backlog(spark, d):
    return store.page(store.without_embedding(live(spark, d, "created_at", "embedding")).select("id", "created_at"), 100, newest_first=False)


@register(f"SELECT id, category, content FROM {LIVE} WHERE id = (SELECT min(id) FROM memories)")
def point_lookup(spark, d):
    rows = live(spark, d, "category", "content")
    wanted = table(spark, d, "memories").agg(F.min("id").alias("id"))
    return rows.join(F.broadcast(wanted), "id").select("id", "category", "content")  # one row


@register("SELECT source, max_by(id, struct_pack(a := created_at, b := id)) AS id, max(created_at) AS created_at FROM (SELECT DISTINCT ON (id) * FROM sessions) GROUP BY source")
def latest_per_source(spark, d):
    rows = store.once(table(spark, d, "sessions").select("id", "source", "created_at"))
    return rows.groupBy("source").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max("created_at").alias("created_at"))


def change_log(spark: SparkSession, d: str) -> DataFrame:
    """Memories as puts, their deletions, and incoming records as later puts."""
    rows = memories(spark, d, "id", "project_id", "category", "content", "deleted_at")
    puts = rows.select("id", F.lit(0).cast("long").alias("seq"), F.lit("put").alias("op"), "project_id", "category", "content")
    gone = rows.where("deleted_at is not null").select("id", F.lit(1).cast("long").alias("seq"), F.lit("delete").alias("op"), "project_id", "category", "content")
    late = table(spark, d, "incoming_memories").select("id", (F.col("batch_no") * 1_000_000 + F.col("seq_no") + 2).cast("long").alias("seq"), F.lit("put").alias("op"), "project_id", "category", "content").distinct()
    return puts.unionByName(gone).unionByName(late)


LOG = f"""(SELECT id, 0::BIGINT AS seq, 'put' AS op, project_id, category, content FROM {MEM}
    UNION ALL SELECT id, 1, 'delete', project_id, category, content FROM {MEM} WHERE deleted_at IS NOT NULL
    UNION ALL SELECT DISTINCT id, batch_no::BIGINT * 1000000 + seq_no + 2, 'put', project_id, category, content FROM incoming_memories)"""


@register(f"SELECT id, seq, op, project_id, category FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, op DESC) AS r FROM {LOG}) WHERE r = 1 AND op <> 'delete'")
def live_after_changes(spark, d):
    return store.live_after(change_log(spark, d)).select("id", "seq", "op", "project_id", "category")


@register(f"SELECT project_id, category, count(*) AS affected FROM {LIVE} WHERE source = 'mcp' GROUP BY project_id, category")
def scoped_delete_counts(spark, d):
    return live(spark, d, "project_id", "category", "source").where(store.in_scope(source="mcp")).groupBy("project_id", "category").agg(F.count("*").alias("affected"))


@register(
    f"""WITH k AS (SELECT coalesce(nullif(content_hash, ''), sha256(content)) AS h, project_id AS p, min(id) AS existing_id FROM memories WHERE deleted_at IS NULL GROUP BY ALL)
    SELECT i.batch_no, i.seq_no, i.id, k.existing_id FROM (SELECT DISTINCT * FROM incoming_memories) i
    LEFT JOIN k ON k.h = coalesce(nullif(i.content_hash, ''), sha256(i.content)) AND k.p IS NOT DISTINCT FROM i.project_id"""
)
def hash_upsert_match(spark, d):
    incoming = table(spark, d, "incoming_memories").distinct()
    return store.match_by_hash(incoming, table(spark, d, "memories").select("id", "project_id", "content", "content_hash", "deleted_at")).select("batch_no", "seq_no", "id", "existing_id")


@register(f"SELECT id, coalesce(nullif(content_hash, ''), sha256(content)) AS content_hash, content_hash IS NOT DISTINCT FROM sha256(content) AS fresh FROM {MEM}")
def hash_backfill(spark, d):
    h = T.content_hash(F.col("content"))
    return memories(spark, d, "id", "content", "content_hash").select("id", store.effective_hash(F.col("content_hash"), F.col("content")).alias("content_hash"), F.col("content_hash").eqNullSafe(h).alias("fresh"))


@register(f"SELECT id, CASE WHEN json_valid(keywords) AND json_type(keywords) = 'ARRAY' THEN json_array_length(keywords)::INTEGER END AS n FROM {MEM}")
def keywords_decoded(spark, d):
    decoded = F.from_json("keywords", "array<string>")
    return memories(spark, d, "id", "keywords").select("id", F.when(decoded.isNotNull(), F.size(decoded)).alias("n"))


@register("""SELECT p.spec, (SELECT first(id ORDER BY r, id) FROM (
        SELECT q.id, CASE WHEN q.id = p.spec THEN 0 WHEN q.name = p.spec THEN 1 WHEN q.path = p.spec THEN 2 WHEN split_part(q.path, '/', -1) = p.spec THEN 3
          WHEN regexp_replace(lower(trim(q.name)), '[.\\-_ ]', '', 'g') = regexp_replace(lower(trim(p.spec)), '[.\\-_ ]', '', 'g') THEN 4
          WHEN regexp_replace(lower(trim(split_part(q.path, '/', -1))), '[.\\-_ ]', '', 'g') = regexp_replace(lower(trim(p.spec)), '[.\\-_ ]', '', 'g') THEN 4 END AS r
        FROM projects q) WHERE r IS NOT NULL) AS project_id
    FROM (SELECT DISTINCT upper(name) AS spec FROM projects UNION SELECT DISTINCT split_part(path, '/', -1) FROM projects UNION SELECT id FROM projects) p""")
def resolve_project(spark, d):
    p = table(spark, d, "projects")
    specs = p.select(F.upper("name").alias("spec")).unionAll(p.select(F.element_at(F.split("path", "/"), -1))).unionAll(p.select("id"))
    return store.resolve_projects(specs.where("spec is not null"), p)


@register("""SELECT s.directory AS path, (SELECT max_by(p.id, struct_pack(a := length(p.path), b := p.id)) FROM projects p WHERE s.directory = p.path OR starts_with(s.directory, p.path || '/')) AS project_id
    FROM (SELECT DISTINCT directory FROM sessions WHERE directory IS NOT NULL) s""")
def detect_project(spark, d):
    return store.detect_project(table(spark, d, "sessions").select(F.col("directory").alias("path")).where("path is not null"), table(spark, d, "projects"))


@register(f"""SELECT id, list_filter(list_transform(CASE WHEN regexp_replace(content, '^\\s+|\\s+$', '', 'g') = '' THEN [] ELSE regexp_split_to_array(regexp_replace(lower(content), '^\\s+|\\s+$', '', 'g'), '\\s+') END,
      lambda w: trim(w, '{T._EDGE_TRIM.replace("'", "''")}')), lambda w: strlen(w) >= 2 AND w NOT IN ({STOPS}) AND NOT regexp_full_match(w, '\\p{{Nd}}+') AND NOT regexp_full_match(w, '[\\p{{P}}\\p{{S}}]+')) AS keywords FROM {MEM}""")
def extract_keywords(spark, d):
    return memories(spark, d, "id", "content").select("id", T.keywords(F.col("content")).alias("keywords"))


@register(f"SELECT id, md5(translate(content, '{T.ACCENTED}', '{T.PLAIN}')) AS plain FROM {MEM}")
def normalize_accents(spark, d):
    return memories(spark, d, "id", "content").select("id", F.md5(T.normalize_accents(F.col("content"))).alias("plain"))


def _redaction_sql(column: str) -> str:
    for pattern, replacement, fold in T.SECRETS:
        column = "regexp_replace({}, '{}', '{}', '{}')".format(column, pattern.replace("'", "''"), replacement.replace("$", "\\"), "gi" if fold else "g")
    return column


@register(f"SELECT id, md5({_redaction_sql('content')}) AS redacted FROM (SELECT DISTINCT ON (id) id, content FROM content_chunks)")
def redact_secrets(spark, d):
    rows = store.once(table(spark, d, "content_chunks").select("id", "content"))
    return rows.select("id", F.md5(T.redact_secrets(F.col("content"))).alias("redacted"))


def _category_sql(column: str) -> str:
    cases = " ".join("WHEN regexp_matches({}, '(?i){}') THEN '{}'".format(column, p.replace("<", "\\b").replace(">", "\\b"), c) for p, c in T.CATEGORIES)
    return f"CASE {cases} ELSE 'fact' END"


@register(f"SELECT id, {_category_sql('content')} AS category FROM {MEM}")
def categorize(spark, d):
    return memories(spark, d, "id", "content").select("id", T.categorize(F.col("content")).alias("category"))


@register(f"""SELECT doc_id, md5(regexp_replace(lower(text), '\\p{{Mn}}', '', 'g')) AS entity, left(trim(replace(text, chr(10), ' '), ' '), 80) || CASE WHEN length(trim(replace(text, chr(10), ' '), ' ')) > 80 THEN '...' ELSE '' END AS line,
      len(regexp_extract_all(text, '[\\p{{P}}\\p{{S}}]|[^\\s\\p{{P}}\\p{{S}}]+')) AS tokens FROM documents""")
def text_scalars(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_entity(t)).alias("entity"), T.truncate_display(t, 80).alias("line"), F.size(T.split_on_punctuation(t)).cast("long").alias("tokens"))


def _useful_sql(t: str, assistant: str) -> str:
    low = f"lower(trim({t}, ' '))"
    q = lambda x: "'" + x.replace("'", "''") + "'"
    noise = " OR ".join(f"contains({low}, {q(x)})" for x in (*T.NOISE, '"tool_use"'))
    idle = " OR ".join(f"starts_with({low}, {q(x)})" for x in T.LOW_PREFIXES)
    return f"coalesce(strlen(trim({t}, ' ')) >= 12 AND NOT (starts_with({low}, 'tool:') OR {noise}) AND NOT ({assistant} AND ({idle}) AND strlen(trim({t}, ' ')) < 240), false)"


@register(f"SELECT doc_id, {_useful_sql('text', 'true')} AS useful FROM documents")
def usefulness_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_useful(F.col("text"), F.lit(True)).alias("useful"))


def _contains_sql(column: str, words) -> str:
    return "(" + " OR ".join("contains(lower({}), '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


@register(f"""SELECT id, {_contains_sql('content', T.DANGEROUS)} OR ({_contains_sql('content', T.PIPED)} AND contains(content, '|') AND {_contains_sql('content', ('sh', 'bash'))}) AS dangerous,
      {_contains_sql('content', T.MEMORY_WORDS)} AS mentions FROM (SELECT DISTINCT ON (id) * FROM content_chunks)""")
def command_predicates(spark, d):
    rows = store.once(table(spark, d, "content_chunks").select("id", "content"))
    return rows.select("id", T.is_dangerous(F.col("content")).alias("dangerous"), T.mentions_memory(F.col("content")).alias("mentions"))


@register("""SELECT id, path, CASE WHEN starts_with(dashed, '-') AND len(string_split(substr(dashed, 2), '-')) >= 2 THEN '/' || replace(substr(dashed, 2), '-', '/') ELSE '' END AS restored
    FROM (SELECT id, path, replace(path, '/', '-') AS dashed FROM projects)""")
def dir_to_path(spark, d):
    return table(spark, d, "projects").select("id", "path", T.dir_to_path(F.replace("path", F.lit("/"), F.lit("-"))).alias("restored"))


@register("""SELECT id, source, label, count(*) OVER (PARTITION BY source) AS in_source FROM (SELECT DISTINCT ON (id) * FROM content_chunks) WHERE contains(lower(source), 'o') AND content_type = 'code'""")
def chunk_filters(spark, d):
    rows = store.once(table(spark, d, "content_chunks").select("id", "source", "label", "content_type"))
    rows = rows.where(F.lower("source").contains("o") & (F.col("content_type") == "code"))
    return rows.select("id", "source", "label", F.count("*").over(Window.partitionBy("source")).alias("in_source"))


@register(f"""SELECT id, json_extract_string(m, '$.source') AS source, try_cast(json_extract_string(m, '$.quality_score') AS DOUBLE) AS quality_score FROM (SELECT id, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM {MEM})""")
def metadata_projection(spark, d):
    m = F.try_parse_json(F.col("metadata"))
    return memories(spark, d, "id", "metadata").select("id", F.try_variant_get(m, "$.source", "string").alias("source"), F.try_variant_get(m, "$.quality_score", "double").alias("quality_score"))
