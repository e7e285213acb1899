"""Import of transcripts, notes, rules, settings and chat tables as rows for the memory store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlode.functions.text import categorize, content_hash, front_matter, front_matter_category, front_matter_map, is_useful, redact_secrets

_BLOCK = "struct<type:string,text:string,name:string,input:string>"
_LINE = f"struct<type:string,message:struct<role:string,content:string>,cwd:string,sessionId:string,summary:string,timestamp:string>"


def blocks(content: Column) -> Column:
    """Polymorphic content, a string or a list of blocks, as a list of blocks."""
    listed = F.from_json(content, f"array<{_BLOCK}>")
    plain = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("input")))
    return F.when(F.ltrim(content).startswith("[") & listed.isNotNull(), listed).otherwise(plain)


def block_texts(content: Column) -> Column:
    """The texts of the text blocks."""
    return F.transform(F.filter(blocks(content), lambda b: (b.type == "text") & (F.length(F.trim(b.text)) > 0)), lambda b: b.text)


def block_text(content: Column) -> Column:
    """The texts joined by newlines."""
    return F.array_join(block_texts(content), "\n")


def tool_calls(content: Column) -> Column:
    """The tool blocks that name a tool."""
    return F.filter(blocks(content), lambda b: (b.type == "tool_use") & (F.coalesce(b.name, F.lit("")) != ""))


def parse_transcript(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows (role, session_id, cwd, text) of the useful user, assistant and summary lines; broken and other lines are dropped."""
    parsed = lines.withColumn("_j", F.from_json(line, _LINE)).where(F.col("_j.type").isin("user", "assistant", "summary"))
    text = F.when(F.col("_j.type") == "summary", F.coalesce("_j.summary", block_text(F.col("_j.message.content")))).otherwise(block_text(F.col("_j.message.content")))
    rows = parsed.select("*", F.col("_j.type").alias("role"), F.col("_j.sessionId").alias("session_id"), F.col("_j.cwd").alias("cwd"), F.trim(text).alias("text")).drop("_j", line)
    return rows.where(is_useful(F.col("text"), F.col("role") == "assistant"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Every *.jsonl file under path, with its file and whether it is a sub-agent's."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_transcript(lines).withColumn("is_subagent", F.col("file").contains("/subagents/"))


def read_notes(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(file, category, content): Markdown notes with the category of their front matter, else of their text."""
    docs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    front = front_matter(F.col("value"))
    body = F.trim(F.regexp_replace("value", r"^---\n[\s\S]*?\n---\n?", ""))
    named = front_matter_category(front)
    return docs.select("file", F.when(named != "", named).otherwise(categorize(body)).alias("category"), body.alias("content")).where("content <> ''")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(file, content): rule files with name, description, body and front matter; those that never close it are skipped."""
    docs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mdc").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    docs = docs.where(~F.col("value").startswith("---") | F.col("value").rlike(r"^---\n[\s\S]*?\n---"))
    meta = front_matter_map(front_matter(F.col("value")))
    name = F.regexp_extract("file", r"([^/]+)\.mdc$", 1)
    body = F.trim(F.regexp_replace("value", r"^---\n[\s\S]*?\n---\n?", ""))
    parts = F.array(F.concat(F.lit("# "), name), F.try_element_at(meta, F.lit("description")), body, F.concat(F.lit("<!-- metadata: "), F.to_json(meta), F.lit(" -->")))
    return docs.select("file", F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n\n").alias("content"))


def format_settings(settings: Column) -> Column:
    """A JSON object as sorted bullets; '' for anything else or an empty one."""
    entries = F.array_sort(F.map_entries(F.from_json(settings, "map<string,string>")))
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- **"), e.key, F.lit("**: "), F.coalesce(e.value, F.lit("null")))), "\n"), F.lit(""))


def chat_messages(sessions: DataFrame, messages: DataFrame, parts: DataFrame, projects: DataFrame) -> DataFrame:
    """(session_id, message_id, directory, text): text parts of each message joined in order of their id.

    sessions (id, project_id, directory), messages (id, session_id), parts (id, message_id, type, text), projects (id,
    worktree). Sessions without a directory take their project's; with neither they are skipped, as are empty messages.
    """
    place = sessions.join(projects.select(F.col("id").alias("project_id"), "worktree"), "project_id", "left")
    place = place.select(F.col("id").alias("session_id"), F.coalesce(F.nullif("directory", F.lit("")), F.nullif("worktree", F.lit(""))).alias("directory")).where("directory is not null")
    texts = parts.where((F.col("type") == "text") & (F.length(F.trim("text")) > 0)).groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.trim("text").alias("t")))), lambda x: x.t), "\n").alias("text"))
    return messages.select(F.col("id").alias("message_id"), "session_id").join(place, "session_id").join(texts, "message_id").select("session_id", "message_id", "directory", "text")


def chat_projects(projects: DataFrame) -> DataFrame:
    """(id, content): a line on each project that has a name or a worktree."""
    name, tree = F.nullif("name", F.lit("")), F.nullif("worktree", F.lit(""))
    return projects.where(name.isNotNull() | tree.isNotNull()).select("id", F.concat(F.lit("Project: "), F.coalesce(name, F.lit("")), F.lit(" (worktree: "), F.coalesce(tree, F.lit("")), F.lit(")")).alias("content"))


def chat_todos(todos: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, position, directory, category, content): todos that are not blank, as plans."""
    kept = todos.where(F.length(F.trim("content")) > 0)
    return kept.join(sessions.select(F.col("id").alias("session_id"), "directory"), "session_id", "left").select("session_id", "position", "directory", F.lit("plan").alias("category"), F.trim("content").alias("content"))


def ingest(rows: DataFrame, *, source: str, text: str = "content", project: str | None = None, created: Column) -> DataFrame:
    """Rows for the store: trimmed, redacted, categorized, hashed, with an id that follows from project and content.

    Blank texts give no row; a category that is given stays. One row a project and content.
    """
    clean = redact_secrets(F.trim(F.regexp_replace(F.regexp_replace(F.col(text), r"^\s+", ""), r"\s+$", "")))
    out = rows.where(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0).withColumn("_c", clean)
    given = F.nullif(F.col("category"), F.lit("")) if "category" in rows.columns else F.lit(None).cast("string")
    where = F.col(project) if project else F.lit(None).cast("string")
    out = out.select(where.alias("project_id"), F.coalesce(given, categorize(F.col("_c"))).alias("category"), F.col("_c").alias("content"), F.lit(source).alias("source"), created.alias("created_at"))
    out = out.withColumn("content_hash", content_hash(F.col("content")))
    out = out.groupBy("project_id", "content_hash").agg(*(F.min_by(c, F.struct("created_at", "category")).alias(c) for c in ("category", "content", "source")), F.min("created_at").alias("created_at"))
    # after the aggregate, so that no filter repeats the redaction
    out = out.where("content <> ''")
    return out.withColumn("id", F.left(F.sha2(F.concat_ws("\u0001", F.coalesce("project_id", F.lit("")), "content_hash"), 256), F.lit(32)))


def read_sqlite(spark: SparkSession, path: str, name: str, columns: str) -> DataFrame:
    """A table of a SQLite database, such as a chat tool's, on a path that every node sees; a table it lacks is empty.

    One task reads it as a stream of batches: such a database is a single file of one machine.
    """
    names = [f.name for f in StructType.fromDDL(columns)]

    def run(batches):
        import sqlite3

        import pandas as pd

        for _ in batches:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                if not db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (name,)).fetchone():
                    return
                cursor = db.execute(f'SELECT {", ".join(chr(34) + n + chr(34) for n in names)} FROM "{name}"')
                while rows := cursor.fetchmany(10_000):
                    yield pd.DataFrame(rows, columns=names)

    return spark.range(1).coalesce(1).mapInPandas(run, columns)


def read_chat_database(spark: SparkSession, path: str) -> DataFrame:
    """chat_messages of a chat tool's SQLite database, whose messages and parts are JSON."""
    get = lambda t, c: read_sqlite(spark, path, t, c)
    parts = get("part", "id string, message_id string, data string").select("id", "message_id", F.get_json_object("data", "$.type").alias("type"), F.get_json_object("data", "$.text").alias("text"))
    return chat_messages(get("session", "id string, project_id string, directory string"), get("message", "id string, session_id string"), parts, get("project", "id string, worktree string"))


def read_rules_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, content): the rules of JSON files, each an object with rules, a list of strings or of objects with a content."""
    docs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rules = F.from_json(F.get_json_object("value", "$.rules"), "array<string>")
    one = docs.select("file", F.explode(rules).alias("r"))
    return one.select("file", F.trim(F.coalesce(F.get_json_object("r", "$.content"), F.col("r"))).alias("content")).where("content <> ''")


@dataclass(frozen=True)
class Source:
    """A named source: when it was last changed, and how it is read as rows with a content."""

    name: str
    modified_at: Callable[[], datetime | None]
    read: Callable[[], DataFrame]


def run_imports(sources: list[Source], ledger: DataFrame, save: Callable[[str, DataFrame], int], now: Callable[[], datetime]) -> list[dict]:
    """Imports the sources that are due, in order of their names, and gives the rows to append to the ledger.

    A source that fails does not stop the others: its row has the status failed and the error, so that it is due again.
    """
    last = {r["source"]: r for r in ledger.groupBy("source").agg(F.max_by(F.struct("status", "finished_at"), "started_at").alias("l")).select("source", "l.*").collect()}  # a row a source
    out = []
    for source in sorted(sources, key=lambda s: s.name):
        before, changed = last.get(source.name), source.modified_at()
        if before and before["status"] == "done" and before["finished_at"] and not (changed and changed > before["finished_at"]):
            continue
        row = {"source": source.name, "started_at": now(), "status": "done", "memories_imported": 0, "error": None}
        try:
            row["memories_imported"] = save(source.name, source.read())
        except Exception as failed:  # reported in the ledger
            row |= {"status": "failed", "error": str(failed)[:1000]}
        out.append(row | {"finished_at": now()})
    return out


def changed_files(found: DataFrame, indexed: DataFrame) -> DataFrame:
    """found (path, sha256) whose hash is new or differs from the indexed one."""
    old = indexed.select("path", F.col("sha256").alias("_old"))
    return found.join(old, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("_old"))).drop("_old")


def due_imports(sources: DataFrame, ledger: DataFrame) -> DataFrame:
    """sources (source, modified_at) whose last import is missing, not done, or older than the source."""
    last = ledger.groupBy("source").agg(F.max_by(F.struct("status", "finished_at"), "started_at").alias("l"))
    return sources.join(last, "source", "left").where(F.col("l").isNull() | (F.col("l.status") != "done") | (F.col("modified_at") > F.col("l.finished_at")) | F.col("l.finished_at").isNull()).drop("l")
