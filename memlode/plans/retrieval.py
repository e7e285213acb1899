"""Queries of full-text, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlode.functions import vectors as V
from memlode.functions.words import word_set, words
from memlode.operators import entities as E
from memlode.operators import hybrid, postings, search, store
from memlode.operators.vectors import top_k
from memlode.plans.catalog import register
from memlode.plans.core import LIVE, MEM, STOPS, live
from memlode.session import cut
from memlode.functions import text as T
from memlode.sources.tables import table

#: What bm25_search looks for.
QUESTION = "deploy planned after rollback broke the migration"
#: What substring and phrase searches look for.
SUBSTRINGS = ((1, "rolled back"), (2, "thumb for own"), (3, "checks the the"), (4, "go"))
AS_OF = "TIMESTAMP '2026-01-01 00:00:00'"

TERMS = "SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents WHERE text IS NOT NULL"


def bm25_sql(wanted: str, terms: str = TERMS) -> str:
    """wanted is SQL for (qid, phrase, is_prefix); the result is (qid, id, score)."""
    return f"""WITH d AS ({terms}), s AS (SELECT count(*)::DOUBLE AS total, avg(len(t)) AS mean FROM d),
      p AS (SELECT id, len(t) AS d, unnest(t) AS term FROM d), w AS ({wanted}), a AS (SELECT DISTINCT phrase, is_prefix FROM w),
      tf AS (SELECT phrase, is_prefix, id, d, count(*) AS tf FROM p JOIN a ON CASE WHEN is_prefix THEN starts_with(term, phrase) ELSE term = phrase END GROUP BY ALL),
      n AS (SELECT phrase, is_prefix, count(*) AS n FROM tf GROUP BY ALL),
      parts AS (SELECT phrase, is_prefix, id, CASE WHEN ln((total - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - n + 0.5) / (n + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / mean)) AS s FROM tf JOIN n USING (phrase, is_prefix), s)
    SELECT qid, id, sum(s) AS score FROM parts JOIN w USING (phrase, is_prefix) GROUP BY qid, id"""


def phrases_sql(source: str, prefixes: bool = True) -> str:
    """source is SQL for (qid, text)."""
    trim = T._EDGE_TRIM.replace("'", "''")
    base = f"""SELECT DISTINCT qid, unnest(regexp_extract_all(k, '[\\p{{L}}\\p{{N}}]+')) AS phrase FROM (
      SELECT qid, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda w: trim(w, '{trim}')),
        lambda w: strlen(w) >= 2 AND w NOT IN ({STOPS}) AND NOT regexp_full_match(w, '\\p{{Nd}}+') AND NOT regexp_full_match(w, '[\\p{{P}}\\p{{S}}]+'))) AS k FROM ({source}))"""
    return f"SELECT qid, phrase, false AS is_prefix FROM ({base})" + (f" UNION ALL SELECT qid, phrase, true FROM ({base}) WHERE strlen(phrase) >= 3" if prefixes else "")


def _best_sql(scored: str, k: int) -> str:
    return f"SELECT qid, id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM ({scored})) WHERE rank <= {k}"


@register(_best_sql(bm25_sql(phrases_sql(f"SELECT 1 AS qid, '{QUESTION}' AS text")), 20))
def bm25_search(spark, d):
    asked = spark.createDataFrame([(1, QUESTION)], "qid int, text string")
    return search.best(search.bm25(table(spark, d, "documents"), search.phrases(asked, "qid", "text"), id_col="doc_id", text="text"), 20)


MEMORY_TERMS = f"SELECT id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS t FROM {LIVE} WHERE content IS NOT NULL"
TITLES = "SELECT id AS qid, title AS text FROM (SELECT DISTINCT ON (id) * FROM sessions) WHERE title IS NOT NULL"


def titles(spark, d):
    return store.once(table(spark, d, "sessions").select("id", "title")).where("title is not null").select(F.col("id").alias("qid"), F.col("title").alias("text"))


def title_search(spark, d, prefixes=True):
    """The best 5 live memories for the titles of all sessions as queries."""
    rows = search.word_lists(live(spark, d, "content"), id_col="id", text="content")
    return postings.best_hits(rows, search.phrases(titles(spark, d), "qid", "text", prefixes), 5)


@register(_best_sql(bm25_sql(phrases_sql(TITLES, False), MEMORY_TERMS), 5))
def bm25_multi_query(spark, d):
    return title_search(spark, d, False)


@register(_best_sql(bm25_sql(phrases_sql(TITLES), MEMORY_TERMS), 5))
def bm25_prefix(spark, d):
    return title_search(spark, d)


@register(f"SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY qid, rank) AS r FROM ({_best_sql(bm25_sql(phrases_sql(TITLES, False), MEMORY_TERMS), 5)})) WHERE r = 1")
def multi_query_first_hits(spark, d):
    return search.first_hits(title_search(spark, d, False))


@register(f"""WITH d AS ({TERMS}) SELECT id AS doc_id, len(list_filter(range(0, greatest(len(t) - 1, 0)), lambda i: t[i + 1] = 'so' AND t[i + 2] = 'it')) AS phrases,
      len(list_filter(range(0, len(t)), lambda i: t[i + 1] = 'broke' AND (list_contains(t[greatest(i - 3, 1):i], 'migration') OR list_contains(t[greatest(i - 4, 1):i + 6], 'migration')))) > 0 AS near
    FROM d""")
def phrase_near_search(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", words(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size(search.phrase_positions(F.col("t"), ["so", "it"])).cast("long").alias("phrases"), search.near(F.col("t"), "broke", "migration", 4).alias("near"))


#: What advanced_search looks for: a phrase, two near words and words with synonyms.
ADVANCED = '"checks the" migration NEAR/4 broke deploy café'


def _advanced_sql(d: str = TERMS.replace("lower(text)", f"translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}')")) -> str:
    plan = search.expand_query(ADVANCED)
    wanted = " UNION ".join(f"SELECT 1 AS qid, '{s['word']}' AS phrase, {str(s['kind'] == 'prefix').lower()} AS is_prefix" for s in plan if s["kind"] in ("term", "prefix"))
    return f"""SELECT id AS doc_id, round(sum(score), 9) AS score FROM (SELECT id, score FROM ({bm25_sql(wanted, d)}) UNION ALL
      SELECT id, 1.0 FROM ({d}) WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'checks' AND t[i + 1] = 'the')) > 0 UNION ALL
      SELECT id, 1.0 FROM ({d}) WHERE len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'migration' AND (list_contains(t[greatest(i - 5, 1):i - 1], 'broke') OR list_contains(t[i + 1:i + 5], 'broke')))) > 0) GROUP BY id"""


@register(_advanced_sql())
def advanced_search(spark, d):
    """A query of phrases, near words and synonyms, run over all documents."""
    found = search.run_plan(table(spark, d, "documents"), search.expand_query(ADVANCED), id_col="doc_id", text="text")
    return found.select(F.col("id").alias("doc_id"), F.round("score", 9).alias("score"))


@register()
def bm25_stemmed(spark, d):
    """The titles of all sessions over live memories and their keywords, by Porter stems without accents; scores from 0 to 1."""
    rows = live(spark, d, "content", "keywords")
    terms = search.word_lists(rows, id_col="id", text="content", keywords_col="keywords", plain=True).where(F.size("t") > 0)
    wanted = search.stemmed_phrases(search.phrases(titles(spark, d), "qid", "text", False))
    return postings.best_hits(terms, wanted, 5, stemmed=True).withColumn("score", search.normalized(F.col("score")))


def substring_queries(spark):
    return spark.createDataFrame(list(SUBSTRINGS), "qid int, query string")


@register(_best_sql(f"""WITH q(qid, query) AS (VALUES {", ".join(f"({a}, '{b}')" for a, b in SUBSTRINGS)}), a AS (SELECT DISTINCT qid, unnest(string_split(lower(query), ' ')) AS term FROM q),
      t AS (SELECT * FROM a WHERE length(term) >= 3), need AS (SELECT qid, count(*) AS needed FROM t GROUP BY qid),
      c AS (SELECT id, lower(content) AS c, greatest(length(content) - 2, 0) AS d FROM (SELECT DISTINCT ON (id) * FROM content_chunks) WHERE content IS NOT NULL), s AS (SELECT count(*)::DOUBLE AS total, avg(d) AS mean FROM c),
      tf AS (SELECT term, id, d, len(list_filter(range(1, length(c) + 1), lambda i: substr(c, i, length(term)) = term)) AS tf FROM c, (SELECT DISTINCT term FROM t) WHERE contains(c, term)),
      n AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
      parts AS (SELECT term, id, CASE WHEN ln((total - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - n + 0.5) / (n + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / mean)) AS s FROM tf JOIN n USING (term), s)
    SELECT qid, id, sum(s) AS score FROM parts JOIN t USING (term) JOIN need USING (qid) GROUP BY qid, id, needed HAVING count(*) = needed""", 20))
def trigram_search(spark, d):
    chunks = store.once(table(spark, d, "content_chunks").select("id", "content"))
    return search.best(search.substring_search(chunks, substring_queries(spark)), 20)


@register()
def proximity_snippets(spark, d):
    chunks = store.once(table(spark, d, "content_chunks").select("id", "content"))
    asked = substring_queries(spark)
    hits = search.best(search.substring_search(chunks, asked), 40).drop("rank").join(asked, "qid").join(chunks, "id")
    return search.rerank(hits, 20)


@register()
def stemmed_words(spark, d):
    return table(spark, d, "documents").select("doc_id", search.stem_words(F.col("text")).alias("stems"))


# Vectors -----------------------------------------------------------------------------------------------------------


@register("""SELECT qid, id, score, rank::INTEGER AS rank FROM (SELECT q.vec_id AS qid, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
    FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")
def vector_topk(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 100 = 0"), id_col="vec_id", vector="embedding", dims=64, k=10)


HEX = "list_reduce(list_transform(string_split(lower(id), ''), lambda c: greatest(strpos('0123456789abcdef', c) - 1, 0)), lambda a, x: (a * 16 + x) % 100, 0) = 0"
USABLE = f"SELECT id, content, embedding::DOUBLE[] AS v FROM {LIVE} WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"

QUANT = "CASE WHEN hi > lo THEN (round((x - lo) * 255 / (hi - lo)))::SMALLINT ELSE 0::SMALLINT END"


@register(f"""SELECT vec_id, list_transform(v, lambda x: {QUANT}) AS data, (hi - lo) / 255 AS scale, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(embedding::DOUBLE[]) AS hi, list_min(embedding::DOUBLE[]) AS lo FROM embeddings)""")
def quantize(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", V.quantize(F.col("embedding")).alias("q"), V.norm(F.col("embedding")).alias("norm"))
    return rows.select("vec_id", F.col("q.data").alias("data"), F.col("q.scale").alias("scale"), "norm")


@register(f"""SELECT vec_id, round(list_cosine_similarity(list_transform(v, lambda x: ({QUANT}) * (hi - lo) / 255 + lo), v), 6) AS fidelity
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(embedding::DOUBLE[]) AS hi, list_min(embedding::DOUBLE[]) AS lo FROM embeddings)""")
def quantize_roundtrip(spark, d):
    q = V.quantize(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding"), q.alias("q")).select("vec_id", F.round(V.quantized_cosine(F.col("q"), F.col("embedding")), 6).alias("fidelity"))


@register(f"""SELECT id, len(embedding) AS dims, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm FROM {LIVE} WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x)))""")
def vector_norms(spark, d):
    rows = live(spark, d, "embedding").where((F.size("embedding") > 0) & ~F.exists("embedding", lambda x: F.isnan(x)))
    return rows.select("id", F.size("embedding").cast("long").alias("dims"), F.round(V.norm(F.col("embedding")), 5).alias("norm"))


# Fusion --------------------------------------------------------------------------------------------------------------

LEGS = """WITH v AS (SELECT project_id AS qid, id, row_number() OVER (PARTITION BY project_id ORDER BY access_count DESC, id) AS rank FROM L WHERE project_id IS NOT NULL),
      b AS (SELECT project_id AS qid, id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS rank FROM L WHERE project_id IS NOT NULL),
      f AS (SELECT qid, id, sum(s) AS score FROM (SELECT qid, id, 0.7 / rank AS s FROM v UNION ALL SELECT qid, id, 0.3 / rank FROM b) GROUP BY qid, id HAVING sum(s) >= 0.05)""".replace(" L ", f" {LIVE} ")


def _legs(spark, d):
    from pyspark.sql.window import Window

    rows = live(spark, d, "project_id", "access_count", "created_at").where("project_id is not null").withColumn("qid", F.col("project_id"))
    rank = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "id"))
    return rows.select("qid", "id", rank("access_count").alias("rank")), rows.select("qid", "id", rank("created_at").alias("rank"))


@register(f"{LEGS} SELECT qid, id, round(score, 9) AS score FROM f")
def rank_fusion(spark, d):
    v, b = _legs(spark, d)
    return hybrid.fuse([(v, 0.7), (b, 0.3)]).withColumn("score", F.round("score", 9))


@register(f"""SELECT id, round(exp(-ln(2) / 30 * greatest(0, coalesce((epoch_us({AS_OF}) - epoch_us(created_at)) / 86400e6, 0))), 9) AS decayed,
      CASE WHEN project_id IS NULL OR project_id = '' THEN 1.1 WHEN project_id = (SELECT min(id) FROM projects) THEN 1.3 ELSE 1.0 END AS boosted FROM {LIVE}""")
def decay_and_boost(spark, d):
    first = table(spark, d, "projects").agg(F.min("id")).first()[0]
    rows = live(spark, d, "project_id", "created_at")
    as_of = F.expr(AS_OF)
    return rows.select("id", F.round(hybrid.decay(F.lit(1.0), F.col("created_at"), as_of), 9).alias("decayed"), hybrid.project_boost(F.lit(1.0), F.col("project_id"), F.lit(first)).alias("boosted"))


def hundredth(column: str = "id"):
    """Whether an id of hexadecimal digits, read as a number, is divisible by 100: by its last two decimal digits, digit by digit."""
    digits = F.split(F.lower(column), "")
    return F.aggregate(digits, F.lit(0), lambda a, c: (a * 16 + F.greatest(F.instr(F.lit("0123456789abcdef"), c) - 1, F.lit(0))) % 100) == 0


@register(f"""WITH v AS ({USABLE}), q AS (SELECT * FROM {LIVE} WHERE {HEX}),
      vec AS (SELECT * FROM (SELECT q.id AS qid, m.id, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, m.v) DESC, m.id) AS rank
        FROM (SELECT * FROM v WHERE {HEX}) q JOIN v m ON q.id <> m.id WHERE list_cosine_similarity(q.v, m.v) > 0.01) WHERE rank <= 80),
      txt AS ({_best_sql(bm25_sql(phrases_sql("SELECT id AS qid, content AS text FROM q", False), MEMORY_TERMS), 80)}),
      f AS (SELECT qid, id, sum(s) AS s FROM (SELECT qid, id, 0.7 / rank AS s FROM vec UNION ALL SELECT qid, id, 0.3 / rank FROM txt) GROUP BY qid, id HAVING sum(s) >= 0.05)
    SELECT f.qid, f.id, round(f.s * exp(-ln(2) / 30 * greatest(0, coalesce((epoch_us({AS_OF}) - epoch_us(m.created_at)) / 86400e6, 0)))
      * CASE WHEN q.project_id IS NULL OR q.project_id = '' THEN 1.0 WHEN m.project_id IS NULL OR m.project_id = '' THEN 1.1 WHEN m.project_id = q.project_id THEN 1.3 ELSE 1.0 END, 9) AS score
    FROM f JOIN {LIVE} m ON m.id = f.id JOIN q ON q.id = f.qid""")
def hybrid_scores(spark, d):
    """Every live memory whose id is divisible by 100 as a query over all live memories: the fused scores before diversification."""
    legs, rows, queries = _hybrid(spark, d)
    return hybrid.scored(*legs, rows, queries, as_of=F.expr(AS_OF), entity_boost=1.0).select("qid", "id", F.round("score", 9).alias("score"))


def _hybrid(spark, d):
    rows = cut(live(spark, d, "project_id", "created_at", "content", "embedding"))
    asked = rows.where(hundredth())
    by_vector = cut(top_k(rows, asked, id_col="id", vector="embedding", dims=64, k=80, floor=0.01))
    by_text = postings.best_hits(search.word_lists(rows, id_col="id", text="content"), search.phrases(asked, "id", "content", False), 80)
    known = E.detect(asked.select(F.col("id").alias("qid"), F.col("content").alias("text")), _snapshot(spark, d)).groupBy("qid").agg(F.collect_list("entity").alias("entities"))
    queries = asked.select(F.col("id").alias("qid"), F.col("project_id").alias("project")).join(known, "qid", "left")
    return (by_text, by_vector), rows, queries


@register()
def hybrid_search(spark, d):
    """The same queries, boosted by the entities of the snapshot and diversified: 10 memories each."""
    legs, rows, queries = _hybrid(spark, d)
    return hybrid.hybrid_search(*legs, rows, queries, as_of=F.expr(AS_OF), k=10)


@register()
def mmr_diversify(spark, d):
    """The most diverse 10 of the 100 most used memories of each project."""
    v, _ = _legs(spark, d)
    scored = v.where("rank <= 100").join(live(spark, d, "content"), "id").select("qid", "id", (1.0 / F.col("rank")).alias("score"), "content")
    return hybrid.diversify(scored, 10)


# Entities and topics ---------------------------------------------------------------------------------------------------

_ENT = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}_-]{{2,}}')"
SNAPSHOT = f"""SELECT DISTINCT entity FROM (SELECT regexp_replace(lower(e), '\\p{{Mn}}', '', 'g') AS entity FROM (
      SELECT unnest({_ENT.format('name')}) AS e FROM projects
      UNION ALL SELECT unnest(CASE WHEN json_valid(keywords) AND json_type(keywords) = 'ARRAY' THEN keywords::JSON::VARCHAR[] END) FROM {MEM}
      UNION ALL SELECT unnest({_ENT.format('content')}) FROM (SELECT content FROM {MEM} ORDER BY updated_at DESC NULLS LAST, id LIMIT 500))) WHERE length(entity) > 0 AND entity NOT IN ({STOPS})"""


def _snapshot(spark, d):
    rows = store.once(table(spark, d, "memories").select("id", "keywords", "content", "updated_at"))
    return E.snapshot(table(spark, d, "projects"), rows)


@register(SNAPSHOT)
def entity_snapshot(spark, d):
    return _snapshot(spark, d)


@register(f"""WITH s AS ({SNAPSHOT}), q AS ({TITLES}), t AS (SELECT qid, unnest(({_ENT.format('text')})[1:40]) AS raw FROM q)
    SELECT DISTINCT qid, raw AS entity FROM t WHERE regexp_replace(lower(raw), '\\p{{Mn}}', '', 'g') IN (SELECT entity FROM s)""")
def entity_detect(spark, d):
    return E.detect(titles(spark, d), _snapshot(spark, d))


@register(f"""WITH e AS (SELECT session_id, id, created_at, list_distinct({_ENT.format('summary')}) AS now FROM (SELECT DISTINCT ON (id) * FROM session_events)),
      l AS (SELECT *, lag(now) OVER w AS before, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id))
    SELECT session_id, id, n > 1 AND NOT (len(list_distinct(list_concat(coalesce(now, []), coalesce(before, [])))) = 0 OR len(list_intersect(coalesce(now, []), coalesce(before, [])))::DOUBLE / len(list_distinct(list_concat(coalesce(now, []), coalesce(before, [])))) >= 0.3) AS changed FROM l""")
def topic_change(spark, d):
    rows = store.once(table(spark, d, "session_events").select("id", "session_id", "created_at", "summary"))
    rows = rows.withColumn("entities", F.array_distinct(E.entity_tokens(F.col("summary"))))
    return E.topic_changes(rows, "session_id", ["created_at", "id"]).select("session_id", "id", "changed")


@register("""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS s, source FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
      p AS (SELECT *, lag(s) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM w)
    SELECT doc_id, round(CASE WHEN len(list_distinct(list_concat(s, b))) = 0 THEN 1.0 ELSE len(list_intersect(s, b))::DOUBLE / len(list_distinct(list_concat(s, b))) END, 9) AS likeness FROM p WHERE b IS NOT NULL""")
def jaccard_neighbours(spark, d):
    from pyspark.sql.window import Window

    from memlode.functions.words import jaccard

    rows = table(spark, d, "documents").where("text is not null and source is not null").select("doc_id", "source", word_set(F.col("text")).alias("s"))
    rows = rows.withColumn("b", F.lag("s").over(Window.partitionBy("source").orderBy("doc_id"))).where("b is not null")
    return rows.select("doc_id", F.round(jaccard(F.col("s"), F.col("b")), 9).alias("likeness"))
