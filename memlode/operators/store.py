"""The memory store: an append-only change log with views of the latest and the live rows.

A change is (id, seq, op, columns); op is put, update, delete or purge. The latest change of an id wins, ties of seq by
op. Views read the log once; what writes only appends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions.text import content_hash, normalize_project_spec


def once(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows without the redelivered ones: one row a key. Null keys are one key."""
    return rows.dropDuplicates(list(keys or ("id",)))


def live(rows: DataFrame) -> DataFrame:
    """Rows not deleted."""
    return rows.where(F.col("deleted_at").isNull())


def latest(log: DataFrame, key: str = "id", *order: str) -> DataFrame:
    """The last change of each key; keys whose last change is a purge are gone."""
    names = order or ("seq", "op")
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in names))
    return log.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r").where("op <> 'purge'")


def live_after(log: DataFrame) -> DataFrame:
    """The live rows after all changes: those whose last change is no delete; a later put brings a row back."""
    return latest(log).where("op <> 'delete'")


def effective_hash(given: Column, text: Column) -> Column:
    """The hash as given, or that of the text where none is."""
    return F.coalesce(F.nullif(given, F.lit("")), content_hash(text))


def match_by_hash(incoming: DataFrame, memories: DataFrame) -> DataFrame:
    """incoming with existing_id: the smallest id of a live row with the same content hash in the same project (null equals null)."""
    known = live(memories).select(effective_hash(F.col("content_hash"), F.col("content")).alias("_h"), F.col("project_id").alias("_p"), F.col("id").alias("_id"))
    known = known.groupBy("_h", "_p").agg(F.min("_id").alias("existing_id"))
    rows = incoming.withColumn("_hash", effective_hash(F.col("content_hash"), F.col("content")))
    on = (F.col("_hash") == F.col("_h")) & F.col("project_id").eqNullSafe(F.col("_p"))
    return rows.join(known, on, "left").drop("_h", "_p", "_hash")


def in_scope(project: str | None = None, category: str | None = None, source: str | None = None) -> Column:
    """The condition of a scope; at least one part must be given."""
    parts = [(F.col(c) == v) for c, v in (("project_id", project), ("category", category), ("source", source)) if v]
    if not parts:
        raise ValueError("a scope needs a project, a category or a source")
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def page(rows: DataFrame, limit: int, offset: int = 0, *, newest_first: bool = True) -> DataFrame:
    """A page of rows by creation, ties by id."""
    order = (F.desc("created_at"), "id") if newest_first else ("created_at", "id")
    return rows.orderBy(*order).offset(offset).limit(limit)


def without_embedding(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("embedding").isNull() | (F.size("embedding") == 0))


def resolve_projects(specs: DataFrame, projects: DataFrame) -> DataFrame:
    """(spec, project_id): the project that each spec names, null if none.

    By id, name, path or last part of the path in this order; else by name or last part in lower case without . - _ and
    spaces. Of equals the smallest id.
    """
    base = F.element_at(F.split("path", "/"), -1)
    keys = F.array(
        F.struct(F.col("id").alias("k"), F.lit(0).alias("rank")), F.struct(F.col("name").alias("k"), F.lit(1).alias("rank")), F.struct(F.col("path").alias("k"), F.lit(2).alias("rank")), F.struct(base.alias("k"), F.lit(3).alias("rank"))
    )
    exact = projects.select("id", F.explode(keys).alias("e")).select("id", "e.k", "e.rank")
    loose = projects.select("id", F.explode(F.array("name", base)).alias("k")).select("id", normalize_project_spec(F.col("k")).alias("k"), F.lit(4).alias("rank"))
    asked = specs.select("spec").distinct()
    tries = asked.select("spec", F.col("spec").alias("k"), F.lit(False).alias("loose")).unionByName(asked.select("spec", normalize_project_spec(F.col("spec")).alias("k"), F.lit(True).alias("loose")))
    hits = tries.join(exact.unionByName(loose), "k").where(F.col("loose") == (F.col("rank") == 4))
    best = hits.groupBy("spec").agg(F.min(F.struct("rank", "id")).alias("b")).select("spec", F.col("b.id").alias("project_id"))
    return asked.join(best, "spec", "left")


def detect_project(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, project_id): the project whose path is the longest leading part of a path, by whole components; null if none.

    Every leading part of a path becomes a key of an equi-join, so no range join is needed.
    """
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = paths.select("path").distinct()
    rows = asked.select("path", F.explode(heads).alias("head"))
    hits = rows.join(projects.select(F.col("path").alias("head"), "id"), "head")
    best = hits.groupBy("path").agg(F.max(F.struct(F.length("head").alias("n"), "id")).alias("b")).select("path", F.col("b.id").alias("project_id"))
    return asked.join(best, "path", "left")
