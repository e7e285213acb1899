"""Queries of the content index."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlode.operators import content, store
from memlode.plans.catalog import register
from memlode.sources.tables import table

CHUNKS = "(SELECT DISTINCT ON (id) * FROM content_chunks)"
AS_OF = "TIMESTAMPTZ '2026-01-01 00:00:00+00'"


def chunks(spark, d, *columns):
    return store.once(table(spark, d, "content_chunks").select("id", *columns))


SECTIONS = """SELECT doc_id AS id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS chunk_no, piece AS content FROM (
      SELECT doc_id, a, b, substr(s, (b * 1900 + 1)::BIGINT, 2000) AS piece FROM (
        SELECT doc_id, a, s, unnest(range(0, CASE WHEN length(s) <= 2000 THEN 1 ELSE ceil((length(s) - 100) / 1900)::BIGINT END)) AS b FROM (
          SELECT doc_id, unnest(s) AS s, unnest(range(0, len(s))) AS a FROM (
            SELECT doc_id, list_filter(string_split(regexp_replace(text, '(?m)^(#{1,6}\\s)', chr(1) || '\\1', 'g'), chr(1)), lambda x: length(x) > 0) AS s FROM documents WHERE text IS NOT NULL))))"""


def sections(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select(F.col("doc_id").alias("id"), F.posexplode(content.heading_sections(F.col("text"))).alias("chunk_no", "content"))


@register(f"SELECT id, chunk_no, md5(content) AS content FROM ({SECTIONS})")
def chunk_heading(spark, d):
    return sections(spark, d).withColumn("content", F.md5("content"))


@register(f"""SELECT id, chunk_no, h AS content_hash FROM (SELECT id, chunk_no, sha256(content) AS h, row_number() OVER (PARTITION BY sha256(content) ORDER BY id, chunk_no) AS r FROM ({SECTIONS}))
    WHERE r = 1 AND h NOT IN (SELECT sha256(content) FROM content_chunks WHERE content IS NOT NULL)""")
def chunk_dedupe(spark, d):
    return content.new_chunks(sections(spark, d), table(spark, d, "content_chunks").select("content")).select("id", "chunk_no", "content_hash")


@register()
def chunk_markdown(spark, d):
    return content.chunk(table(spark, d, "documents"), id_col="doc_id", text="text")


@register()
def chunk_raw_lines(spark, d):
    return content.chunk(table(spark, d, "documents"), id_col="doc_id", text="text", how="raw")


@register("""SELECT doc_id, len(l) AS lines, md5(array_to_string(CASE WHEN len(l) > 100 THEN l[len(l) - 99:] ELSE l END, chr(10))) AS tail FROM (
      SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) > 0) AS l FROM documents WHERE text IS NOT NULL)""")
def jsonl_tail(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    return rows.select("doc_id", F.size(lines).cast("long").alias("lines"), F.md5(F.array_join(content.jsonl_tail(F.col("text")), "\n")).alias("tail"))


@register(f"SELECT id, ttl_hours > 0 AND indexed_at + to_hours(ttl_hours) <= {AS_OF} AS expired FROM {CHUNKS}")
def ttl_expired(spark, d):
    return chunks(spark, d, "indexed_at", "ttl_hours").select("id", content.expired(F.col("indexed_at"), F.col("ttl_hours"), F.lit("2026-01-01").cast("timestamp")).alias("expired"))


@register(f"""WITH c AS (SELECT id, indexed_at, coalesce(length(content), 0) AS size, ttl_hours > 0 AND indexed_at + to_hours(ttl_hours) <= {AS_OF} AS old FROM {CHUNKS}),
      k AS (SELECT *, coalesce(sum(size) OVER (ORDER BY indexed_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM c WHERE NOT old)
    SELECT id, 'expired' AS reason FROM c WHERE old UNION ALL SELECT id, 'size' FROM k WHERE before < total - 100000""")
def evict_size_cap(spark, d):
    return content.evict(chunks(spark, d, "indexed_at", "ttl_hours", "content"), 100_000, F.lit("2026-01-01").cast("timestamp"))


@register()
def page_markdown(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", content.fetched_text(F.col("text"), F.lit("text/html")).alias("markdown"))
