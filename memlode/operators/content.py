"""The content index: chunkers, deduplication by hash, expiry and eviction."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions.text import content_hash

MOST_BYTES = 4096


def heading_sections(text: Column, size: int = 2000, overlap: int = 100) -> Column:
    """Sections cut before # headings; those over `size` characters slide on by size - overlap. Empty ones are left out."""
    sections = F.filter(F.split(text, r"(?md)(?=^#{1,6}\s)"), lambda s: F.length(s) > 0)
    step = size - overlap

    def slide(s):
        count = F.when(F.length(s) <= size, F.lit(1)).otherwise(F.ceil((F.length(s) - overlap) / F.lit(step)).cast("int"))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(s, i * step + 1, F.lit(size)))

    return F.flatten(F.transform(sections, slide))


def jsonl_tail(text: Column, most: int = 100) -> Column:
    """The last `most` lines that are not blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    return F.when(F.size(lines) > most, F.slice(lines, -most, most)).otherwise(lines)


def pack_lines(text: str, most: int = MOST_BYTES) -> list[str]:
    """Whole lines packed up to `most` bytes; a longer line is a piece of its own."""
    out, held, size = [], [], 0
    for line in text.split("\n"):
        n = len(line.encode()) + 1
        if held and size + n - 1 > most:
            out.append("\n".join(held))
            held, size = [], 0
        held.append(line)
        size += n
    if held:
        out.append("\n".join(held))
    return [x for x in out if x.strip()]


def split_paragraphs(text: str, most: int = MOST_BYTES) -> list[str]:
    """Paragraphs packed up to `most` bytes; a longer one is cut at its last newline, else space, else between characters."""
    out, held = [], ""
    for part in re.split(r"\n\s*\n", text):
        joined = f"{held}\n\n{part}" if held else part
        if len(joined.encode()) <= most:
            held = joined
            continue
        if held:
            out.append(held)
        while len(part.encode()) > most:
            head = part.encode()[:most].decode(errors="ignore")
            at = max(head.rfind("\n"), 0) or max(head.rfind(" "), 0) or len(head)
            out.append(part[:at].rstrip())
            part = part[at:].lstrip()
        held = part
    if held.strip():
        out.append(held)
    return [x for x in out if x.strip()]


def markdown_chunks(text: str, most: int = MOST_BYTES) -> list[tuple[str, bool, str]]:
    """(breadcrumb, has_code, content): sections between headings and rules; sections with a code fence stay whole."""
    trail: list[tuple[int, str]] = []
    chunks: list[tuple[str, bool, str]] = []
    lines: list[str] = []
    fence, code = "", False

    def close():
        nonlocal lines, code
        body = "\n".join(lines).strip()
        crumb = " > ".join(t for _, t in trail)
        if body:
            chunks.extend((crumb, code, x) for x in ([body] if code else split_paragraphs(body, most)))
        lines, code = [], False

    for line in text.split("\n"):
        mark = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
        if fence:
            lines.append(line)
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(mark[1][0]):
                fence = ""
            continue
        if mark:
            fence, code = mark[1], True
            lines.append(line)
            continue
        heading = re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if heading:
            close()
            level = len(heading[1])
            trail = [x for x in trail if x[0] < level] + [(level, heading[2])]
            lines.append(line)
        elif re.match(r"\s{0,3}([-*_])(?:\s*\1){2,}\s*$", line):
            close()
        else:
            lines.append(line)
    close()
    return chunks


def chunk(rows: DataFrame, *, id_col: str, text: str, how: str = "markdown", most: int = MOST_BYTES) -> DataFrame:
    """(id, chunk_no, label, has_code, content) by the Markdown or the raw line chunker; null and blank texts give no chunk."""
    picked = rows.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    schema = f"id {picked.schema['id'].dataType.simpleString()}, chunk_no int, label string, has_code boolean, content string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, value in zip(batch["id"], batch["text"]):
                found = markdown_chunks(value, most) if how == "markdown" else [("", True, x) for x in pack_lines(value, most)]
                out += [(key, i, *c) for i, c in enumerate(found)]
            yield pd.DataFrame(out, columns=["id", "chunk_no", "label", "has_code", "content"])

    return picked.mapInPandas(run, schema)


def new_chunks(chunks: DataFrame, indexed: DataFrame, text: str = "content") -> DataFrame:
    """chunks whose content is neither indexed nor repeated among them (the row first by id and chunk_no stays)."""
    hashed = chunks.withColumn("content_hash", content_hash(F.col(text)))
    known = indexed.select(content_hash(F.col(text)).alias("content_hash")).distinct()
    first = hashed.groupBy("content_hash").agg(F.min(F.struct("id", "chunk_no")).alias("f"))
    fresh = first.join(known, "content_hash", "left_anti")
    return hashed.join(fresh, "content_hash").where((F.col("id") == F.col("f.id")) & (F.col("chunk_no") == F.col("f.chunk_no"))).drop("f")


def expired(indexed_at: Column, ttl_hours: Column, as_of: Column) -> Column:
    """Whether a row has outlived its hours; 0 and fewer never expire."""
    return F.coalesce((ttl_hours > 0) & (indexed_at + F.make_dt_interval(F.lit(0), ttl_hours) <= as_of), F.lit(False))


def running_sum(rows: DataFrame, value: str, order: str, tie: str, out: str) -> DataFrame:
    """rows with the sum of value over all rows before each, in order of a timestamp and a tie-breaker.

    Days are summed first and the sums of days added up, so that no window holds more than a day.
    """
    dated = rows.withColumn("_day", F.to_date(order))
    days = dated.groupBy("_day").agg(F.sum(value).alias("_s"))
    before = days.select(F.col("_day").alias("_d"), (F.sum("_s").over(Window.orderBy(F.asc_nulls_first("_day"))) - F.col("_s")).alias("_before"))  # a row a day
    inner = F.sum(value).over(Window.partitionBy("_day").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1))
    return dated.withColumn("_in", F.coalesce(inner, F.lit(0))).join(before, F.col("_day").eqNullSafe(F.col("_d"))).withColumn(out, F.col("_before") + F.col("_in")).drop("_day", "_d", "_before", "_in")


def evict(chunks: DataFrame, most: int, as_of: Column) -> DataFrame:
    """(id, reason): chunks to delete: expired ones, then the oldest until the rest has at most `most` characters."""
    marked = chunks.select("id", "indexed_at", F.coalesce(F.length("content"), F.lit(0)).alias("size"), expired(F.col("indexed_at"), F.col("ttl_hours"), as_of).alias("old"))
    gone = marked.where("old").select("id", F.lit("expired").alias("reason"))
    kept = marked.where("not old")
    surplus = (kept.agg(F.sum("size")).first()[0] or 0) - most
    over = running_sum(kept, "size", "indexed_at", "id", "before").where(F.col("before") < surplus)
    return gone.unionByName(over.select("id", F.lit("size").alias("reason")))


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.href: str | None = None
        self.pre = False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head", "template"):
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table", "blockquote"):
            self.out.append("\n\n")
        elif tag in ("br", "tr"):
            self.out.append("\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.href = dict(attrs).get("href")
            self.out.append("[" if self.href else "")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head", "template"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.out.append(f"]({self.href})" if self.href else "")
            self.href = None
        elif tag in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote"):
            self.out.append("\n\n")
        elif tag in ("td", "th"):
            self.out.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"[ \t]+", " ", data))


def html_to_markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def markdown_of_html(html: Column) -> Column:
    """Markdown of HTML; null for null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(html_to_markdown, na_action="ignore")

    return run(html)


def fetched_text(body: Column, content_type: Column) -> Column:
    """A fetched body as text: HTML as Markdown, JSON indented, plain text as it is; null for other types."""
    kind = F.lower(content_type)
    pretty = F.coalesce(F.to_json(F.try_parse_json(body), {"pretty": "true"}), body)
    return F.when(kind.contains("html"), markdown_of_html(body)).when(kind.contains("json"), pretty).when(kind.startswith("text/"), body)
