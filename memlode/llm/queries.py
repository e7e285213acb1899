"""The pN_ queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlode.llm import history, knn, mixing, neardup, packing, pii, spam, split
from memlode.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every oversized chunk; a redelivered chunk counts once."""
    chunks = table(spark, sf_dir, "content_chunks").dropDuplicates(["id"])
    return split.split_oversized(chunks, table(spark, sf_dir, "split_limits"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the splitter had to cut."""
    pieces = split.split_oversized(table(spark, sf_dir, "content_chunks"), table(spark, sf_dir, "split_limits"))
    return pieces.where(F.col("n_pieces") > 1).select("id").distinct()


def live_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "memories").where(F.col("deleted_at").isNull())


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of live memories of similarity 0.7 or more."""
    return neardup.id_pairs(live_memories(spark, sf_dir), similarity="0.7")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every live memory with its class, its number of links and its group."""
    return neardup.near_duplicates(live_memories(spark, sf_dir), similarity="0.7")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of live memories of cosine 0.9 or more, one among the 5 most similar of the other."""
    near = knn.knn(live_memories(spark, sf_dir), k=5, min_similarity=0.9)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar live memories of those whose id, read as a hexadecimal number, is divisible by 100."""
    live = live_memories(spark, sf_dir)
    # 16^n mod 100 is 76 for n = 5, 10, ...; the last 15 digits are a whole number below 2^60
    low = F.conv(F.right("id", F.lit(15)), 16, 10).cast("long")
    high = F.left("id", F.length("id") - 15)
    middle, top = F.conv(F.right(high, F.lit(15)), 16, 10).cast("long"), F.conv(F.left(high, F.greatest(F.length(high) - 15, F.lit(0))), 16, 10).cast("long")
    value = low % 100 + 76 * (F.coalesce(middle, F.lit(0)) % 100) + 76 * (F.coalesce(top, F.lit(0)) % 100)
    asking = live.where(value % 100 == 0).select("id")
    return knn.knn(live, k=5, asking=asking, relax=2.0)


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every memory with typed placeholders for personal data, and the kinds found."""
    memories = table(spark, sf_dir, "memories")
    return pii.redact(memories, pii.fit(memories, table(spark, sf_dir, "given_names")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of personal data of each memory, once."""
    return p4_redacted(spark, sf_dir).select("id", F.explode("kinds").alias("kind")).distinct()


#: Batches that p5 ingests at a time, in order of arrival; the index is opened anew for each round, as by another session.
BATCHES_A_ROUND = 6


def p5_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every incoming record, accepted or refused: rounds of batches against all memories and what was accepted before."""
    path = history.HistoryIndex(spark, "0.7", most_runs=2).build(table(spark, sf_dir, "memories")).path
    incoming = table(spark, sf_dir, "incoming_memories")
    last = incoming.agg(F.max("batch_no")).first()[0] or 0
    out = incoming.select("batch_no", "seq_no", "id", F.lit(True).alias("accepted")).where("batch_no is null")
    for low in range(0, last, BATCHES_A_ROUND):
        index = history.HistoryIndex.open(spark, path)
        out = out.unionByName(index.ingest(incoming.where((F.col("batch_no") > low) & (F.col("batch_no") <= low + BATCHES_A_ROUND))))
    history.HistoryIndex(spark, "0.7", path).drop()  # the decisions do not read it
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming records whose content is in memories or was accepted from an earlier record."""
    return p5_decisions(spark, sf_dir).where(~F.col("accepted")).select("id").distinct()


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of one beyond 4,096 tokens, with its container."""
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers with what they hold and the room that is left."""
    packed = p6_pack(spark, sf_dir).groupBy("container").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    return packed.withColumn("room", 4096 - F.col("tokens"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the largest mix in which sources of half the wanted weight fill their budgets; the others give all they may."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), reach=0.5).documents


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted and the reached share of each source in that mix."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), reach=0.5).report


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measures, its robust distance and whether it is spam."""
    return spam.spam_scores(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-stuffed pages, link lists and tag lists."""
    return p8_scores(spark, sf_dir).where("spam").select("doc_id")


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p4_found": p4_found, "p4_redacted": p4_redacted, "p5_found": p5_found, "p5_decisions": p5_decisions, "p6_pack": p6_pack, "p6_containers": p6_containers, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_scores": p8_scores}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            SELECT DISTINCT c.id FROM content_chunks c JOIN split_limits l ON l.content_type = c.content_type
            WHERE strlen(c.content) > l.max_bytes
        """,
        "p2_found": """
            WITH m AS (SELECT DISTINCT ON (id) id, content FROM memories WHERE deleted_at IS NULL),
            w AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'))) AS w FROM m),
            n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
            o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS o FROM w a JOIN w b ON a.w = b.w AND a.id < b.id GROUP BY ALL)
            SELECT id_a, id_b FROM o JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 10 * o >= 7 * (x.n + y.n - o)
        """,
        "p3_found": """
            WITH m AS (SELECT DISTINCT ON (id) id, embedding::DOUBLE[] AS v FROM memories WHERE deleted_at IS NULL AND len(embedding) = 64),
            u AS (SELECT * FROM m WHERE NOT list_bool_or(list_transform(v, lambda x: isnan(x) OR isinf(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0))),
            s AS (SELECT a.id AS q, b.id AS p, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.id <> b.id),
            r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 6) DESC, p) AS r FROM s WHERE s >= 0.9)
            SELECT DISTINCT least(q, p) AS id_a, greatest(q, p) AS id_b FROM r WHERE r <= 5
        """,
    }
