"""Keyword-stuffed and link-list pages: robust Mahalanobis outliers in spam-directed directions.

Every text is measured by the densities of bare links, of product data or tags, of repeated phrases and of loose fragments
among its words, by its lack of function words and by the entropy of its words. Per language, the centre and the scatter of all
texts, copies once, are estimated robustly (medians, then concentration steps over the nearest half). A text is spam if its
robust distance is beyond the quantile and its deviation lies in a spam direction: in the metric of the scatter its angle to
what links, product data and repeats alone contribute to it is under 60 degrees. No measure has a threshold of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlode.session import cut

MEASURES = ("links", "goods", "repeats", "fragments", "lack", "order")
#: The measures that span the spam directions.
SPAM_DIRECTED = MEASURES[:3]
#: The resolution of the measures, added to their scatter; most texts have no link at all.
FLOOR = 0.05
#: The quantile of chi-squared with six degrees of freedom that one normal text in 10^12 exceeds, so that collections of
#: any size that is met have hardly a false outlier (fixed value).
CHI2_6 = 68.1
#: By which the scatter of the nearest half of a normal population in six dimensions is too small: 0.5 / P(chi-squared of eight
#: degrees < median of chi-squared of six) (fixed value).
HALF_CONSISTENCY = 1.785

WORD = re.compile(r"[^\W_]+")
URL = re.compile(r"""(?:https?://|www\.)[^\s<>"')\]|,;]+|(?<![\w@/.-])(?:[a-z0-9-]+\.)+[a-z]{2,12}/[^\s<>"')\]|,;]*""", re.I)
PRICE = re.compile(r"(?:[$€£¥]|R\$|US\$)\s?\d|\d[\d.,]*\s?(?:€|£|EUR\b|USD\b|BRL\b)|\b(?:SKU|EAN|GTIN|art\.|ref\.?|réf\.?)\s?[#:]?\s?[A-Z]{0,3}-?\d", re.I)
HASHTAG = re.compile(r"(?<!\w)#\w*[^\W\d]")
#: What makes a token technical: a sign of code or paths, or the form of a call, a date, a hash or a duration.
SIGNS = frozenset("_/\\{}=[]<>\"`$│├└")
TECHNICAL = re.compile(r"::|\w\(|^\d{4}-\d\d-\d\d|^[0-9a-f]{7,8}$|^\d+(?:\.\d+)?m?s$")
#: The share of function words a sentence has at least; about 0.3 is usual.
SENTENCE_SHARE = 0.12
#: One of these is in every price or article number; looking for them is quicker than the pattern.
PRICE_SIGNS = ("$", "€", "£", "¥", "sku", "ean", "gtin", "art.", "ref", "réf", "eur", "usd", "brl")
ANCHOR = re.compile(r"""<a\s[^>]*href\s*=\s*["']?([^"'>\s]+)[^>]*>""", re.I)
ELEMENT = re.compile(r"</?[a-z][^<>]*>", re.I)
#: Tags that end a line of the page.
BREAK = re.compile(r"</?(?:br|li|p|tr|ul|ol|div|table|h[1-6])\b[^<>]*>", re.I)
LINES = re.compile(r"[\n\r  ]+")
SEGMENTS = re.compile(r"[|;•·]+|\s\*\s|\s-\s|\s//\s|(?<=[.!?:])\s+")

#: Function words by language (fixed values: the most common grammatical words, as in any grammar).
FUNCTION_WORDS = {
    "en": "the a an and or of to in is it for that this with on as by be was are not from at its so if when we you but has have only every than no any which own one can will into before after unless until who what there their our must should while because been do does he she they them both then also".split(),
    "pt": "o a os as da de do das dos e em um uma não na no nas nos com ou ao aos que para por se mais seu sua ele ela já isso este esta depois antes quando como foi ser está quem só até".split(),
    "es": "el la los las un una de y en que es con su sus al del lo por para se no pero muy como más esto esta este después antes cuando ya hasta le les fue si".split(),
    "fr": "le la les de des du et est dans pour que qui ne pas sur au aux il elle on ce se une un ses son sa mais ou où par avec plus cette après avant quand être si".split(),
}
ALL_FUNCTION_WORDS = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws)


def technical_token(token: str) -> bool:
    # the forms begin with a digit or a hexadecimal letter or hold a bracket or a colon
    return not SIGNS.isdisjoint(token) or ((token[0] in "0123456789abcdef" or "(" in token or ":" in token) and TECHNICAL.search(token) is not None)


def priced(text: str) -> bool:
    low = text.lower()
    return any(sign in low for sign in PRICE_SIGNS) and PRICE.search(text) is not None


def is_sentence(body: list[str], links: int) -> bool:
    """Whether a piece is one: enough of its words are function words, it is no list of links and doesn't repeat itself."""
    n = len(body)
    if n < 6 or len(ALL_FUNCTION_WORDS.intersection(body)) < 2 or sum(w in ALL_FUNCTION_WORDS for w in body) < SENTENCE_SHARE * n:
        return False
    if links > 1 and n < 8 * links:
        return False
    pairs = Counter(zip(body, body[1:])) if n >= 24 else {}
    return sum(c for c in pairs.values() if c >= 3) <= 0.5 * n


def language(counts: Counter, declared: str | None) -> str:
    """The language whose function words are most frequent, if clearly ahead of the declared one's; else that one or 'und'."""
    said = (declared or "").strip().lower()[:2]
    hits = {code: sum(counts[w] for w in ws) for code, ws in FUNCTION_WORDS.items()}
    best = max(hits, key=hits.get)
    if hits[best] >= 4 and hits[best] > 1.3 * hits.get(said, 0):
        return best
    return said if said in FUNCTION_WORDS else "und"


def measure(text: str, declared: str | None = None) -> tuple[str, int, tuple[float, ...]]:
    """Language, number of words and MEASURES of a text, over all of it."""
    text = ELEMENT.sub(" ", BREAK.sub("\n", ANCHOR.sub(r" \1 ", text))) if "<" in text else text
    total = technical = 0
    parts, pairs, bags, words = [], Counter(), Counter(), Counter()
    for line in LINES.split(text):
        tokens = line.split()
        if not tokens:
            continue
        linked = ("/" in line or "www." in line.lower()) and URL.search(line) is not None
        if not linked and not priced(line):
            odd = sum(map(technical_token, tokens))
            if odd >= 0.25 * len(tokens):
                inside = WORD.findall(line.lower())
                if odd >= 0.5 * len(tokens) or len(ALL_FUNCTION_WORDS.intersection(inside)) < 2:
                    total += len(inside)
                    technical += len(inside)
                    continue
        for piece in SEGMENTS.split(line):
            body = WORD.findall(piece.lower())
            all_ = len(body)
            if not all_:
                continue
            total += all_
            n_links = 0
            if linked:
                rest, n_links = URL.subn(" ", piece)
                body = WORD.findall(rest.lower())
            grammar = len(ALL_FUNCTION_WORDS.intersection(body))
            words.update(body)
            if is_sentence(body, n_links):  # of which only a price counts
                if priced(piece):
                    parts.append((piece, all_, body, grammar, False, True))
                continue
            parts.append((piece, all_, body, grammar, n_links > 0 and len(body) <= 24 * n_links, False))
            pairs.update([(a, b) if a < b else (b, a) for a, b in zip(body, body[1:])])
            bags[tuple(sorted(body))] += 1
    # how often a pair of words comes by chance grows with the text: twice and the hundredth part of its different words
    often = 2 + len(words) // 100
    links = goods = repeats = fragments = 0
    for piece, all_, body, grammar, linked, sentence in parts:
        if linked:
            links += all_
        elif sentence or priced(piece) or ("#" in piece and HASHTAG.search(piece)):
            goods += all_
        else:
            items = piece.split(",")
            if len(items) >= 5 and sum(len(WORD.findall(x)) <= 3 for x in items) >= 0.8 * len(items):
                goods += all_
            elif len(body) <= 8 and bags[tuple(sorted(body))] >= min(often, 3):
                repeats += all_
            else:
                hit = [False] * len(body)
                for i, (a, b) in enumerate(zip(body, body[1:])):
                    if pairs[(a, b) if a < b else (b, a)] >= often:
                        hit[i] = hit[i + 1] = True
                repeats += sum(hit)
                if len(body) <= 6 and grammar == 0:
                    fragments += all_ - sum(hit)
    n = sum(words.values())
    grammar = sum(words[w] for w in ALL_FUNCTION_WORDS)
    entropy = -sum(c / n * math.log2(c / n) for c in words.values()) / math.log2(n) if n > 1 else 1.0
    t = max(1, total)
    # texts of machines lack function words without being spam: their words count as if they had the usual share
    lack = 1 - (grammar + 0.3 * technical) / t if total else 0.7
    return language(words, declared), total, (links / t, goods / t, repeats / t, fragments / t, lack, 1 - entropy)


def measures(rows: DataFrame, id_col: str, text: str, lang: str) -> DataFrame:
    """(id, language, words, MEASURES, _copy) of the texts that have a word; copies have the same _copy."""
    picked = rows.select(F.col(id_col).alias("id"), F.col(text).alias("_t"), F.col(lang).alias("_l"), F.xxhash64(text).alias("_c")).where(F.col("_t").isNotNull())
    schema = f"id {picked.schema['id'].dataType.simpleString()}, language string, words long, _copy long, " + ", ".join(f"{m} double" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measure(t, said) for t, said in zip(batch.column("_t").to_pylist(), batch.column("_l").to_pylist())]
            values = np.array([g[2] for g in got], dtype="f8").reshape(-1, len(MEASURES))
            cols = [batch.column("id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), batch.column("_c"), *(pa.array(values[:, i]) for i in range(len(MEASURES)))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "language", "words", "_copy", *MEASURES])

    return picked.mapInArrow(run, schema).where("words > 0")


Fit = dict[str, tuple[np.ndarray, np.ndarray]]


def product(fit: Fit, left: bool, right: bool) -> Column:
    """The inner product, in the metric of its language's scatter, of a row's deviation with itself; left and right take only its
    spam-directed part: the positive deviations of SPAM_DIRECTED."""
    out = F.lit(None).cast("double")
    for code, (mean, inverse) in fit.items():
        whole = [F.col(m) - F.lit(float(mean[i])) for i, m in enumerate(MEASURES)]
        part = [F.greatest(d, F.lit(0.0)) if m in SPAM_DIRECTED else None for m, d in zip(MEASURES, whole)]
        a, b = (part if x else whole for x in (left, right))
        terms = [a[i] * b[j] * F.lit(float(inverse[i, j])) for i in range(len(MEASURES)) for j in range(len(MEASURES)) if a[i] is not None and b[j] is not None]
        out = F.when(F.col("language") == code, reduce(Column.__add__, terms)).otherwise(out)
    return out


def squared_distance(fit: Fit) -> Column:
    """The squared Mahalanobis distance of a row from its language's fit, as an expression."""
    return product(fit, False, False)


def direction(fit: Fit) -> Column:
    """The cosine of the angle between a row's deviation and its spam-directed part; 0 where there is no such part."""
    size = product(fit, True, True) * product(fit, False, False)
    return F.when(size > 0, product(fit, True, False) / F.sqrt(F.when(size > 0, size))).otherwise(0.0)


def robust_fit(measured: DataFrame, steps: int = 3) -> Fit:
    """Centre and inverse scatter of each language (there are at most five), from all rows.

    It starts from medians; each concentration step takes mean and scatter of the half of the rows nearest to the last fit: up to
    half of a language's distinct texts may be spam of any form, without drawing the fit to them. Only
    sums reach the driver: one row of 28 numbers a language and step. Texts of unknown language are few and mostly
    odd, no population of their own; they are held against all known languages together.
    """
    d = len(MEASURES)
    medians = measured.groupBy("language").agg(*(F.percentile_approx(m, 0.5, 10_000).alias(m) for m in MEASURES))
    fit = {r["language"]: (np.array([r[m] for m in MEASURES]), np.eye(d) / 0.1**2) for r in medians.collect()}
    found: dict[str, tuple[int, np.ndarray, np.ndarray]] = {}
    for _ in range(steps):
        near = measured.withColumn("_d", squared_distance(fit))
        bounds = {r["language"]: r["q"] for r in near.groupBy("language").agg(F.percentile_approx("_d", 0.5, 10_000).alias("q")).collect()}
        limit = F.lit(0.0)
        for code, q in bounds.items():
            limit = F.when(F.col("language") == code, float(q)).otherwise(limit)
        sums = [F.sum(m).alias(f"s{i}") for i, m in enumerate(MEASURES)]
        squares = [F.sum(F.col(MEASURES[i]) * F.col(MEASURES[j])).alias(f"q{i}_{j}") for i in range(d) for j in range(i, d)]
        for r in near.where(F.col("_d") <= limit).groupBy("language").agg(F.count("*").alias("n"), *sums, *squares).collect():
            mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
            scatter = np.zeros((d, d))
            for i in range(d):
                for j in range(i, d):
                    scatter[i, j] = scatter[j, i] = r[f"q{i}_{j}"] / r["n"] - mean[i] * mean[j]
            found[r["language"]] = (r["n"], mean, scatter)
        fit = {code: (mean, widened(scatter)) for code, (_, mean, scatter) in found.items()}
    known = [v for code, v in found.items() if code != "und"]
    if known and "und" in fit:
        n = sum(v[0] for v in known)
        mean = sum(v[0] * v[1] for v in known) / n
        scatter = sum(v[0] * (v[2] + np.outer(v[1] - mean, v[1] - mean)) for v in known) / n
        fit["und"] = (mean, widened(scatter))
    return fit


def widened(scatter: np.ndarray) -> np.ndarray:
    """The inverse of a trimmed scatter, which is too small; the floor keeps measures that hardly vary from deciding alone."""
    return np.linalg.inv(scatter * HALF_CONSISTENCY + np.eye(len(scatter)) * FLOOR**2)


def spam_scores(rows: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = CHI2_6, least_cosine: float = 0.5) -> DataFrame:
    """(id, language, words, MEASURES, distance, direction, spam) of every text with a word.

    Null, blank and wordless texts are no spam and give no row; a null, odd or wrong language is guessed from
    the function words, else texts are measured against those of unknown language. Repeated rows give repeated rows;
    an empty table gives an empty one. All texts are measured whole; three passes over six numbers a text give the fit.
    """
    measured = cut(measures(rows, id_col, text, lang))
    fit = robust_fit(cut(measured.select("language", "_copy", *MEASURES).dropDuplicates(["language", "_copy"])))
    scored = measured.withColumn("distance", F.sqrt(squared_distance(fit)) if fit else F.lit(0.0)).withColumn("direction", direction(fit) if fit else F.lit(0.0))
    spam = (F.col("distance") * F.col("distance") > quantile) & (F.col("direction") > least_cosine)
    return scored.drop("_copy").withColumn("spam", spam).withColumnRenamed("id", id_col)
