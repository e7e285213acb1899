"""Full-text search: analyzers, BM25 over words and substrings, query expansion, proximity and snippets."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions.text import ACCENTED, PLAIN, STOP_WORDS, fields, keywords
from memlode.functions.words import words

K1, B = 1.2, 0.75

# Words and what is searched beside them.
SYNONYMS = {
    "auth": "authentication authenticate autorizacao",
    "api": "endpoint rest",
    "deploy": "deployment release implantacao publicar",
    "test": "testing spec testar verificacion",
    "config": "configuration setting configuracion parametre ajuste",
    "database": "db sqlite postgres datos donnees",
    "error": "exception failure bug falha excepcion fallo defaut",
    "function": "method procedure handler funcao",
    "performance": "speed latency throughput",
    "refactor": "rewrite restructure",
    "component": "widget module part",
    "debug": "troubleshoot diagnose",
    "server": "backend service servidor servicio serveur",
    "client": "frontend app cliente aplicacion application",
    "security": "auth authorization seguranca",
    "cache": "memoize store",
    "dependency": "import library package",
    "framework": "library toolkit sdk",
    "migration": "upgrade migracao",
    "repository": "repo store repositorio armazenamento",
    "autenticar": "autenticacao login auth",
    "implantar": "implantacao publicar deploy",
    "teste": "testar spec verificacao",
    "configurar": "configuracao ajuste config",
    "banco": "database db sqlite",
    "erro": "exception falha bug",
    "funcao": "metodo procedimento handler",
    "seguranca": "auth autorizacao",
    "prueba": "test verificacion",
    "serveur": "backend service",
    "erreur": "exception defaut",
    "base": "database db datos donnees",
}
_FOLD = str.maketrans(ACCENTED, PLAIN)


def idf(total: Column, having: Column) -> Column:
    """ln((N - n + 0.5) / (n + 0.5)), at least 1e-6."""
    raw = F.log((total - having + 0.5) / (having + 0.5))
    return F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)


def saturation(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def phrases(queries: DataFrame, qid: str, text: str, prefixes: bool = True, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(qid, phrase, is_prefix): the keywords of each query cut into words, each exact and, from three bytes on, as a prefix too."""
    found = queries.select(F.col(qid).alias("qid"), F.explode(keywords(F.col(text), stop_words)).alias("k"))
    found = found.select("qid", F.explode(words(F.col("k"))).alias("phrase")).distinct()
    exact = found.withColumn("is_prefix", F.lit(False))
    return exact.unionByName(found.where(F.octet_length("phrase") >= 3).withColumn("is_prefix", F.lit(True))) if prefixes else exact


def folded(words_: Column) -> Column:
    """Words without accents."""
    return F.transform(words_, lambda w: F.translate(w, ACCENTED, PLAIN))


def stems(vocabulary: DataFrame) -> DataFrame:
    """(word, term): the Porter stem of each word."""
    from memlode.functions.porter import stem

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(term=[stem(w) for w in batch["word"]])

    return vocabulary.mapInPandas(run, "word string, term string")


def word_lists(docs: DataFrame, *, id_col: str, text: str, keywords_col: str | None = None, plain: bool = False) -> DataFrame:
    """(id, t): the words of each document and, with keywords_col, a JSON array, of its keywords; null texts give none. Plain words have no accents."""
    t = words(F.col(text))
    if keywords_col:
        t = F.concat(t, F.coalesce(F.flatten(F.transform(F.from_json(keywords_col, "array<string>"), words)), F.array().cast("array<string>")))
    return docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), (folded(t) if plain else t).alias("t"))


def term_counts(docs: DataFrame, *, id_col: str, text: str, keywords_col: str | None = None, stemmed: bool = False) -> DataFrame:
    """(id, d, term, tf): the postings of each document with its length; null texts give none.

    With keywords_col, a JSON array, its words are indexed too. Stemmed, accents are folded and words become their
    Porter stems, each word of the vocabulary once.
    """
    terms = word_lists(docs, id_col=id_col, text=text, keywords_col=keywords_col, plain=stemmed)
    counted = terms.select("id", F.size("t").alias("d"), F.explode("t").alias("term")).groupBy("id", "d", "term").agg(F.count("*").alias("tf"))
    if not stemmed:
        return counted
    known = stems(counted.select(F.col("term").alias("word")).distinct())
    return counted.withColumnRenamed("term", "word").join(known, "word").groupBy("id", "d", "term").agg(F.sum("tf").alias("tf"))


def stemmed_phrases(wanted: DataFrame) -> DataFrame:
    """wanted (qid, phrase, is_prefix) in the terms of a stemmed index."""
    plain = wanted.select("qid", F.translate("phrase", ACCENTED, PLAIN).alias("word"), "is_prefix")
    return plain.join(stems(plain.select("word").distinct()), "word").select("qid", F.col("term").alias("phrase"), "is_prefix").distinct()


def score_postings(posted: DataFrame, wanted: DataFrame, n: int, mean: float) -> DataFrame:
    """(qid, id, score) by BM25 of postings (id, d, term, tf) for wanted (qid, phrase, is_prefix); n documents of a mean length.

    A phrase meets its postings by an equi-join on the term, a prefix by one on its first three characters. A prefix is one
    phrase: its frequency sums over all words it starts.
    """
    total, mean = F.lit(float(n)), F.lit(float(mean or 1.0))
    asked = wanted.select("phrase", "is_prefix").distinct()
    exact = posted.join(asked.where(~F.col("is_prefix")).withColumn("term", F.col("phrase")), "term").select("phrase", "is_prefix", "id", "d", "tf")
    heads = asked.where("is_prefix").withColumn("head", F.left("phrase", F.lit(3)))
    started = posted.withColumn("head", F.left("term", F.lit(3))).join(heads, "head").where(F.col("term").startswith(F.col("phrase")))
    started = started.groupBy("phrase", "is_prefix", "id", "d").agg(F.sum("tf").alias("tf"))
    tf = exact.unionByName(started)
    having = tf.groupBy("phrase", "is_prefix").agg(F.count("*").alias("n"))
    parts = tf.join(having, ["phrase", "is_prefix"]).select("phrase", "is_prefix", "id", (idf(total, F.col("n")) * saturation(F.col("tf"), F.col("d"), mean)).alias("s"))
    return parts.join(wanted, ["phrase", "is_prefix"]).groupBy("qid", "id").agg(F.sum("s").alias("score"))


def bm25(docs: DataFrame, wanted: DataFrame, *, id_col: str, text: str) -> DataFrame:
    """(qid, id, score) of every document that some phrase of the query matches; null texts count as empty documents do not.

    Only the terms that can match are counted: before the count, words meet the wanted ones by the equi-joins of score_postings.
    """
    terms = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), words(F.col(text)).alias("t"))
    lengths = terms.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean")).first()
    posted = terms.select("id", F.size("t").alias("d"), F.explode("t").alias("term")).withColumn("head", F.left("term", F.lit(3)))
    asked = wanted.select("phrase", "is_prefix", F.left("phrase", F.lit(3)).alias("head")).distinct()
    heads = asked.where("is_prefix").select("head").distinct()
    rest = asked.where(~F.col("is_prefix")).join(heads, "head", "left_anti").select(F.col("phrase").alias("term")).distinct()
    few = posted.join(heads, "head", "left_semi").unionByName(posted.join(rest, "term", "left_semi"))
    return score_postings(few.groupBy("id", "d", "term").agg(F.count("*").alias("tf")), wanted, lengths["n"], lengths["mean"])


def normalized(score: Column) -> Column:
    """A BM25 score as a number from 0 to 1 that grows with it: s / (1 + s)."""
    return F.greatest(score, F.lit(0.0)) / (1.0 + F.greatest(score, F.lit(0.0)))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query with their rank, ties by id."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")))
    return ranked.where(F.col("rank") <= k)


def stem_words(text: Column) -> Column:
    """Words without accents and with Porter stems."""
    from memlode.functions.porter import stem

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            plain = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
            return [stem(w) for w in re.findall(r"[^\W_]+", plain)]

        return texts.map(one, na_action="ignore")

    return run(text)


def phrase_positions(terms: Column, phrase: list[str]) -> Column:
    """The places from 0 where the words of a phrase follow one another."""
    spots = F.sequence(F.lit(0), F.greatest(F.size(terms) - len(phrase), F.lit(0)))
    here = lambda i: [F.get(terms, i + j) == w for j, w in enumerate(phrase)]

    def all_(i):
        out = F.lit(True)
        for c in here(i):
            out = out & F.coalesce(c, F.lit(False))
        return out

    return F.filter(spots, all_)


def near(terms: Column, a: str, b: str, most: int) -> Column:
    """Whether a and b are at most `most` words apart."""
    pa, pb = phrase_positions(terms, [a]), phrase_positions(terms, [b])
    return F.exists(pa, lambda i: F.exists(pb, lambda j: (F.abs(i - j) >= 1) & (F.abs(i - j) <= most + 1)))


def expand_query(query: str) -> list[dict]:
    """The plan of an advanced query: quoted phrases and a NEAR/n b stay; other words give exact, prefix and synonyms."""
    plan, seen = [], set()

    def add(**step):
        key = tuple(sorted((k, tuple(v) if isinstance(v, list) else v) for k, v in step.items()))
        if key not in seen:
            seen.add(key)
            plan.append(step)

    rest = query
    for m in re.finditer(r'"([^"]+)"', query):
        add(kind="phrase", words=m[1].translate(_FOLD).lower().split())
        rest = rest.replace(m[0], " ")
    for m in re.finditer(r"(\S+)\s+NEAR/(\d+)\s+(\S+)", rest):
        add(kind="near", words=[m[1].lower(), m[3].lower()], distance=int(m[2]))
        rest = rest.replace(m[0], " ")
    for word in rest.lower().split():
        word = word.strip(".,;:!?()[]{}\"'").translate(_FOLD)
        if len(word.encode()) < 2 or word in STOP_WORDS or word.isdigit():
            continue
        add(kind="term", word=word)
        if len(word.encode()) >= 3:
            add(kind="prefix", word=word)
        for other in SYNONYMS.get(word, "").split():
            add(kind="term", word=other)
    return plan


def run_plan(docs: DataFrame, plan: list[dict], *, id_col: str, text: str) -> DataFrame:
    """(id, score): documents that some step of an expanded query matches, by the BM25 of its words, prefixes and synonyms plus one for each phrase or pair of near words."""
    wanted = [(s["word"], s["kind"] == "prefix") for s in plan if s["kind"] in ("term", "prefix")]
    asked = docs.sparkSession.createDataFrame([(1, *w) for w in dict.fromkeys(wanted)], "qid int, phrase string, is_prefix boolean")
    folded_docs = docs.select(F.col(id_col).alias("id"), F.translate(F.lower(text), ACCENTED, PLAIN).alias("_c"))
    by_words = bm25(folded_docs, asked, id_col="id", text="_c").select("id", "score")
    whole = [s for s in plan if s["kind"] in ("phrase", "near")]
    if not whole:
        return by_words
    # the words of a text are a column of their own, used by one projection: a filter would have them computed anew for every place
    held = folded_docs.where("_c is not null").select("id", words(F.col("_c")).alias("t"))
    met = [F.size(phrase_positions(F.col("t"), s["words"])) > 0 if s["kind"] == "phrase" else near(F.col("t"), *s["words"], s["distance"]) for s in whole]
    extra = held.select("id", reduce(Column.__add__, [F.when(m, 1.0).otherwise(0.0) for m in met]).alias("score"))
    return by_words.unionByName(extra).groupBy("id").agg(F.sum("score").alias("score")).where("score > 0")


def substring_search(chunks: DataFrame, queries: DataFrame, *, id_col: str = "id", text: str = "content") -> DataFrame:
    """(qid, id, score): chunks that hold every term of a query as a substring in lower case, by BM25.

    queries is (qid, query). Terms are its white-space runs of at least three characters; a query without one finds nothing. The
    frequency of a term counts overlapping places, the length of a chunk is its trigrams. The terms of all queries together
    become one pattern a term; the query table is small by nature and joins as (term) with the chunks that hold it.
    """
    asked = queries.select("qid", F.explode(F.array_distinct(fields(F.lower("query")))).alias("term")).where(F.length("term") >= 3)
    needed = asked.groupBy("qid").agg(F.count("*").alias("needed"))
    body = chunks.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text).alias("c")).withColumn("d", F.greatest(F.length("c") - 2, F.lit(0)))
    stats = body.agg(F.count("*").alias("n"), F.avg("d").alias("mean")).first()
    total, mean = F.lit(float(stats["n"])), F.lit(float(stats["mean"] or 1.0))
    terms = [r["term"] for r in asked.select("term").distinct().orderBy("term").limit(10_001).collect()]
    if len(terms) > 10_000:
        raise ValueError("more than 10,000 terms in one search; pass the queries in parts")
    counts = F.array(*(F.struct(F.lit(t).alias("term"), F.regexp_count("c", F.lit("(?=" + re.sub(r"([^\w\s])", r"\\\1", t) + ")")).alias("tf")) for t in terms)) if terms else F.array().cast("array<struct<term:string,tf:int>>")
    tf = body.select("id", "d", F.explode(F.filter(counts, lambda x: x.tf > 0)).alias("h")).select("id", "d", "h.term", "h.tf")
    having = tf.groupBy("term").agg(F.count("*").alias("n"))
    parts = tf.join(having, "term").select("term", "id", (idf(total, F.col("n")) * saturation(F.col("tf"), F.col("d"), mean)).alias("s"))
    hits = parts.join(asked, "term").groupBy("qid", "id").agg(F.sum("s").alias("score"), F.count("*").alias("met"))
    return hits.join(needed, "qid").where("met = needed").select("qid", "id", "score")


def term_positions(content: str, terms: list[str]) -> dict[str, list[int]]:
    """All overlapping places of each term."""
    low = content.lower()
    return {t: [m.start() for m in re.finditer(f"(?={re.escape(t)})", low)] for t in terms}


def min_span(positions: dict[str, list[int]]) -> int:
    """Characters of the shortest stretch with a place of every term; 0 if some term has none."""
    if not positions or any(not p for p in positions.values()):
        return 0
    events = sorted((p, t) for t, ps in positions.items() for p in ps)
    best_, last = 0, {}
    for p, t in events:
        last[t] = p
        if len(last) == len(positions):
            span = p - min(last.values()) + 1
            best_ = span if not best_ else min(best_, span)
    return best_


def proximity_boost(span: int) -> float:
    """1.5 for adjacent terms, falling by 0.02 a character to 1."""
    return max(1.0, 1.5 - 0.02 * (span - 1)) if span > 0 else 1.0


def snippet(content: str, terms: list[str], most: int = 300) -> str:
    """The whole text if short, else about `most` characters around the densest cluster of terms, at word edges."""
    if len(content) <= most:
        return content
    half = most // 2
    places = sorted(p for ps in term_positions(content, terms).values() for p in ps)
    around = [bisect_right(places, p + half) - bisect_left(places, p - half) for p in places]
    centre = places[around.index(max(around))] if places else half
    start = max(0, min(centre - half, len(content) - most))
    end = min(len(content), start + most)
    while start > 0 and not content[start - 1].isspace() and centre - start < most:
        start -= 1
    while end < len(content) and not content[end].isspace() and end - centre < most:
        end += 1
    return ("..." if start else "") + content[start:end].strip() + ("..." if end < len(content) else "")


def rerank(hits: DataFrame, k: int, most: int = 300) -> DataFrame:
    """hits (qid, id, score, query, content) with boost and snippet, the best k of each query by boosted score, ties by id."""
    extra = hits.select("qid", "id", "score", "query", "content")
    schema = "qid {}, id {}, score double, boost double, adjusted double, snippet string".format(extra.schema["qid"].dataType.simpleString(), extra.schema["id"].dataType.simpleString())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            boosts, snippets = [], []
            for query, content in zip(batch["query"], batch["content"]):
                terms = list(dict.fromkeys(query.lower().split()))
                boosts.append(proximity_boost(min_span(term_positions(content, terms))) if len(terms) > 1 else 1.0)
                snippets.append(snippet(content, terms, most))
            out = batch[["qid", "id", "score"]].assign(boost=boosts, snippet=snippets)
            out["adjusted"] = out["score"] * out["boost"]
            yield out[["qid", "id", "score", "boost", "adjusted", "snippet"]]

    boosted = extra.mapInPandas(run, schema)
    return boosted.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("adjusted", 9)), "id"))).where(F.col("rank") <= k)


def first_hits(hits: DataFrame) -> DataFrame:
    """Of a document found by several queries of one request the hit of the first query, then of the best rank."""
    order = Window.partitionBy("id").orderBy("qid", "rank")
    return hits.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
