"""Queries of the knowledge graph and of curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlode.operators import curation, knowledge, store
from memlode.operators.vectors import above, top_k
from memlode.plans.catalog import register
from memlode.plans.core import LIVE, live
from memlode.plans.retrieval import HEX, USABLE, hundredth
from memlode.sources.tables import table

FUNCTIONAL = ("uses", "depends_on")


def _triples_sql(most: int | None = 5) -> str:
    zips = ", ".join(
        f"list_transform(list_zip(regexp_extract_all(content, '(?i){knowledge.pattern(v)}', 1), regexp_extract_all(content, '(?i){knowledge.pattern(v)}', 2)), lambda x: struct_pack(subject := trim(x[1], ' '), predicate := '{p}', object := trim(x[2], ' '), confidence := {c}::DOUBLE))"
        for p, c, v in knowledge.PATTERNS
    )
    found = f"list_filter(flatten([{zips}]), lambda t: t.subject <> '' AND t.object <> '')"
    cut = f"({found})[1:{most}]" if most else found
    return f"""SELECT id, n - 1 AS n, t.subject AS subject, t.predicate AS predicate, t.object AS object, t.confidence AS confidence, project_id, created_at AS valid_from FROM (
      SELECT id, project_id, created_at, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS n FROM (SELECT *, {cut} AS l FROM {LIVE} WHERE strlen(content) >= 20))"""


def found(spark, d):
    return knowledge.extract(live(spark, d, "content", "created_at", "project_id"), id_col="id", text="content", time="created_at", project="project_id")


@register(f"SELECT id, n, subject, predicate, object, confidence FROM ({_triples_sql()})")
def kg_extract(spark, d):
    return found(spark, d).select("id", "n", "subject", "predicate", "object", "confidence")


@register(f"SELECT left(sha256(alias), 32) AS entity_id, name, alias FROM (SELECT lower(name) AS alias, min(name) AS name FROM (SELECT subject AS name FROM ({_triples_sql()}) UNION ALL SELECT object FROM ({_triples_sql()})) GROUP BY 1)")
def kg_entities(spark, d):
    return knowledge.entities(found(spark, d))


VALID = f"SELECT *, CASE WHEN predicate IN {FUNCTIONAL} THEN lead(valid_from) OVER (PARTITION BY lower(subject), predicate ORDER BY valid_from, id, n) END AS valid_to FROM ({_triples_sql()})"


@register(f"SELECT id, n, subject, predicate, object, valid_from, valid_to FROM ({VALID})")
def kg_functional_validity(spark, d):
    return knowledge.with_validity(found(spark, d), FUNCTIONAL).select("id", "n", "subject", "predicate", "object", "valid_from", "valid_to")


@register(f"SELECT id, n, subject, predicate, object FROM ({VALID}) WHERE valid_from <= TIMESTAMPTZ '2025-07-01 00:00:00+00' AND (valid_to IS NULL OR valid_to > TIMESTAMPTZ '2025-07-01 00:00:00+00')")
def kg_asof(spark, d):
    facts = knowledge.with_validity(found(spark, d), FUNCTIONAL)
    return knowledge.as_of(facts, F.lit("2025-07-01").cast("timestamp")).select("id", "n", "subject", "predicate", "object")


@register(f"""SELECT DISTINCT e.name, v.id, v.n, v.subject, v.predicate, v.object FROM ({VALID}) v
      JOIN (SELECT DISTINCT upper(subject) AS name FROM ({_triples_sql()})) e ON lower(e.name) IN (lower(v.subject), lower(v.object)) WHERE v.valid_to IS NULL""")
def kg_query_alias(spark, d):
    """All facts of every subject, asked for by another spelling."""
    facts = knowledge.with_validity(found(spark, d), FUNCTIONAL)
    asked = found(spark, d).select(F.upper("subject").alias("name")).distinct()
    return knowledge.one_hop(facts, asked).select("name", "id", "n", "subject", "predicate", "object")


@register(f"""WITH t AS ({_triples_sql()}), e AS (SELECT lower(name) AS alias, min(name) AS name FROM (SELECT subject AS name FROM t UNION ALL SELECT object FROM t) GROUP BY 1)
    SELECT t.id, t.n, s.name AS subject, t.predicate, o.name AS object FROM t JOIN e s ON s.alias = lower(t.subject) JOIN e o ON o.alias = lower(t.object)""")
def kg_star_join(spark, d):
    """Triples in normal form joined with their subjects, predicates and objects."""
    return knowledge.joined(*knowledge.star(found(spark, d))).select("id", "n", "subject", "predicate", "object")


DUPES = f"""SELECT id AS memory_id, o AS related_memory_id FROM (SELECT id, first_value(id) OVER (PARTITION BY sha256(content) ORDER BY created_at, id) AS o FROM {LIVE}) WHERE id <> o"""


def duplicates(spark, d):
    return curation.exact_duplicates(live(spark, d, "created_at", "content"), F.sha2("content", 256))


@register(DUPES)
def dream_exact_dupes(spark, d):
    return duplicates(spark, d)


@register(f"""WITH a AS (SELECT memory_id, 'dedup' AS action_type, 1.0 AS confidence FROM ({DUPES})), k AS (SELECT DISTINCT memory_id FROM a ORDER BY memory_id LIMIT 50)
    SELECT memory_id, action_type, confidence, CASE WHEN memory_id IN (SELECT memory_id FROM k) THEN 'applied' ELSE 'skipped' END AS status FROM a""")
def dream_consolidate_cap(spark, d):
    actions = duplicates(spark, d).select("memory_id", F.lit("dedup").alias("action_type"), F.lit(1.0).alias("confidence"))
    return curation.consolidate(actions, curation.PRESETS["moderate"])




def usable(spark, d):
    rows = live(spark, d, "content", "embedding").where(F.size("embedding") == 64)
    return rows.where(F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))


@register(f"""SELECT qid, id, round(s, 9) AS similarity FROM (SELECT q.id AS qid, m.id, list_cosine_similarity(q.v, m.v) AS s, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, m.v) DESC, m.id) AS r
      FROM (SELECT * FROM ({USABLE}) WHERE {HEX}) q JOIN ({USABLE}) m ON q.id <> m.id) WHERE r <= 10 AND s > 0.5""")
def dream_near_candidates(spark, d):
    """The 10 nearest memories of each whose id is divisible by 100, from a cosine of 0.5."""
    rows = usable(spark, d)
    near = top_k(rows, rows.where(hundredth()), id_col="id", vector="embedding", dims=64, k=10, floor=0.5)
    return near.select("qid", "id", F.round("score", 9).alias("similarity"))


def _contains_any(a: str, b: str) -> tuple[str, str]:
    q = lambda w: "'" + w.replace("'", "''") + "'"
    no = " OR ".join(f"contains({a}, {q(w)}) <> contains({b}, {q(w)})" for w in curation.NEGATIONS)
    anti = " OR ".join(f"(contains({a}, {q(p)}) AND contains({b}, {q(r)})) OR (contains({a}, {q(r)}) AND contains({b}, {q(p)}))" for p, r in curation.OPPOSITES)
    return no, anti


_NO, _ANTI = _contains_any("lower(q.content)", "lower(m.content)")


@register(f"""SELECT q.id, m.id AS other, round(list_cosine_similarity(q.v, m.v), 9) AS similarity, 0.6::DOUBLE AS confidence, CASE WHEN {_ANTI} THEN 'antonyms' ELSE 'negation' END AS reason
    FROM (SELECT * FROM ({USABLE}) WHERE {HEX}) q JOIN ({USABLE}) m ON q.id <> m.id WHERE list_cosine_similarity(q.v, m.v) >= 0.7 AND list_cosine_similarity(q.v, m.v) < 0.995 AND (({_NO}) OR ({_ANTI}))""")
def dream_contradictions(spark, d):
    """All memories that contradict one whose id is divisible by 100, alike from 0.7 up to 0.995."""
    rows = usable(spark, d)
    alike = above(rows, rows.where(hundredth()), id_col="id", vector="embedding", dims=64, threshold=0.7)
    texts = rows.select("id", "content")
    pairs = alike.select(F.col("qid").alias("id"), F.col("id").alias("other"), F.col("score").alias("similarity")).join(texts, "id").join(texts.select(F.col("id").alias("other"), F.col("content").alias("other_content")), "other")
    return curation.contradictions(pairs, 0.995).select("id", "other", F.round("similarity", 9).alias("similarity"), "confidence", "reason")


@register(f"""SELECT q.id AS qid, m.id, round(list_cosine_similarity(q.v, m.v), 9) AS similarity FROM (SELECT * FROM ({USABLE}) WHERE {HEX}) q JOIN ({USABLE}) m ON q.id <> m.id WHERE list_cosine_similarity(q.v, m.v) >= 0.75""")
def vector_theta_join(spark, d):
    """All memories of a cosine of 0.75 or more with one whose id is divisible by 100."""
    rows = usable(spark, d)
    return above(rows, rows.where(hundredth()), id_col="id", vector="embedding", dims=64, threshold=0.75).select("qid", "id", F.round("score", 9).alias("similarity"))
