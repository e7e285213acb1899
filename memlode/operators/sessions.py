"""Sessions and events: sessionizing, activity, staleness, context to resume with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessionize(events: DataFrame, key: str, time: str, gap: str = "30 minutes") -> DataFrame:
    """(key, started, last_activity, message_count): runs of events with no gap of `gap` or more. Null times and keys give none."""
    grouped = events.where(F.col(time).isNotNull() & F.col(key).isNotNull()).groupBy(key, F.session_window(time, gap).alias("w"))
    return grouped.agg(F.min(time).alias("started"), F.max(time).alias("last_activity"), F.count("*").alias("message_count")).drop("w")


def start_or_resume(sessions: DataFrame, asked: DataFrame, at: Column) -> DataFrame:
    """(id, project_id, source, source_session_id, created_at, last_activity_at, resumed): the session of each asked (source, source_session_id, project_id).

    The newest open session of that source and its id is resumed; where there is none a new one gets an id that follows from source, its id and time.
    """
    newest = sessions.where("ended_at is null").groupBy("source", "source_session_id").agg(F.max_by(F.struct("id", "project_id", "created_at"), F.struct("created_at", "id")).alias("_s"))
    rows = asked.select("source", "source_session_id", F.col("project_id").alias("_p")).distinct().join(newest, ["source", "source_session_id"], "left")
    fresh = F.left(F.sha2(F.concat_ws("\u0001", "source", "source_session_id", at.cast("string")), 256), F.lit(32))
    return rows.select(F.coalesce("_s.id", fresh).alias("id"), F.coalesce("_s.project_id", "_p").alias("project_id"), "source", "source_session_id", F.coalesce("_s.created_at", at).alias("created_at"), at.alias("last_activity_at"), F.col("_s").isNotNull().alias("resumed"))


def end(sessions: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """sessions with ended_at set where they are among ids (id) and still open."""
    asked = ids.select("id", F.lit(True).alias("_e")).distinct()
    return sessions.join(asked, "id", "left").withColumn("ended_at", F.when(F.col("_e") & F.col("ended_at").isNull(), at).otherwise(F.col("ended_at"))).drop("_e")


def active(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("ended_at").isNull())


def end_stale(sessions: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """sessions with ended_at set to as_of where open ones were idle for longer; without activity their creation counts."""
    idle = F.coalesce("last_activity_at", "created_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return sessions.withColumn("ended_at", F.when(F.col("ended_at").isNull() & idle, as_of).otherwise(F.col("ended_at")))


def stats(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("total"), F.count_if(F.col("ended_at").isNull()).alias("active"))


def record_activity(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """sessions with their events counted in: message_count grows, last_activity_at becomes the latest."""
    seen = events.groupBy("session_id").agg(F.count("*").alias("_n"), F.max("created_at").alias("_t"))
    rows = sessions.join(seen, F.col("id") == F.col("session_id"), "left")
    return rows.withColumns({"message_count": F.coalesce("message_count", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_activity_at": F.greatest("last_activity_at", "_t")}).drop("session_id", "_n", "_t")


def latest_events(events: DataFrame, key: str, k: int = 20, most_priority: int | None = None) -> DataFrame:
    """The newest k events of each key, ties by id; with most_priority only those of at most that priority."""
    rows = events if most_priority is None else events.where(F.col("priority") <= most_priority)
    w = Window.partitionBy(key).orderBy(F.desc("created_at"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def resume_context(events: DataFrame, k: int = 20) -> DataFrame:
    """(project_id, snapshot, summaries): of each project the last snapshot and the newest k important summaries.

    Important is a priority of 2 or less. Events of no project count for none here; callers union them in where wanted.
    """
    shots = events.where("event_type = 'precompact_snapshot'").groupBy("project_id").agg(F.max_by("summary", F.struct("created_at", "id")).alias("snapshot"))
    top = latest_events(events, "project_id", k, 2).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("rank", "summary"))).alias("l"))
    rows = top.select("project_id", F.transform("l", lambda x: x.summary).alias("summaries"))
    return shots.join(rows, "project_id", "full_outer").select("project_id", "snapshot", "summaries")


def compose_context(rows: DataFrame, key: str, budget: int = 3600) -> DataFrame:
    """rows (key, layer, position, text) kept while their bytes fit the budget: layer 0 always, then layers in order."""
    w = Window.partitionBy(key).orderBy("layer", "position").rowsBetween(Window.unboundedPreceding, 0)
    used = rows.withColumn("used", F.sum(F.octet_length("text")).over(w))
    return used.where((F.col("layer") == 0) | (F.col("used") <= budget))
