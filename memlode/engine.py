"""The verbs of the memory tools over tables in a folder: save, search, list, update, forget, stats, index, query."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlode.functions import text as T
from memlode.functions.embed import HashingEmbedder
from memlode.operators import content, curation, hybrid, knowledge, search, store
from memlode.operators import entities as E
from memlode.operators import sessions as S
from memlode.operators.vectors import above, top_k
from memlode.session import cut
from memlode.sources.importers import ingest
from memlode.sources.schema import conform, schema


class Engine:
    """A store under `root`: an append-only log of memory changes and a table of chunks. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, dims: int = 64):
        self.spark, self.root, self.embedder = spark, root.rstrip("/"), HashingEmbedder(dims)

    def _append(self, rows: DataFrame, table: str) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{table}")

    def _read(self, table: str, columns: str) -> DataFrame:
        try:
            return self.spark.read.schema(columns).parquet(f"{self.root}/{table}")
        except Exception as missing:  # no change yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], columns)

    def _log(self) -> DataFrame:
        return self._read("memories_log", "id string, seq long, op string, project_id string, category string, content string, source string, content_hash string, created_at timestamp, updated_at timestamp")

    def _next(self) -> int:
        return (self._log().agg(F.max("seq")).first()[0] or 0) + 1

    def memories(self) -> DataFrame:
        """The live memories."""
        return store.live_after(self._log())

    def save(self, rows: DataFrame, at: Column, source: str = "cli", project: str | None = None) -> None:
        """Adds rows with a content; the same content in the same project is an update of the same memory."""
        ready = ingest(rows, source=source, project=project, created=at)
        self._append(ready.select("id", F.lit(self._next()).cast("long").alias("seq"), F.lit("put").alias("op"), "project_id", "category", "content", "source", "content_hash", "created_at", F.col("created_at").alias("updated_at")), "memories_log")

    def update(self, changes: DataFrame, at: Column) -> None:
        """changes (id, content, category): new content or category of live memories; what is null stays; unknown ids do nothing."""
        new = changes.select("id", T.redact_secrets(F.trim("content")).alias("_c"), F.col("category").alias("_g"))
        rows = self.memories().join(new, "id")
        text = F.coalesce("_c", "content")
        self._append(rows.select("id", F.lit(self._next()).cast("long").alias("seq"), F.lit("put").alias("op"), "project_id", F.coalesce("_g", "category").alias("category"), text.alias("content"), "source", T.content_hash(text).alias("content_hash"), "created_at", at.alias("updated_at")), "memories_log")

    def forget(self, ids: DataFrame, hard: bool = False) -> int:
        """Deletes the memories of ids (id), for good if hard; how many there were."""
        rows = self.memories().join(ids.select("id").distinct(), "id", "left_semi")
        n = rows.count()
        self._append(rows.withColumns({"seq": F.lit(self._next()).cast("long"), "op": F.lit("purge" if hard else "delete")}), "memories_log")
        return n

    def forget_scope(self, **scope: str) -> int:
        """Deletes by project, category and source together; at least one."""
        return self.forget(self.memories().where(store.in_scope(**scope)))

    def list(self, limit: int = 20, offset: int = 0, **scope: str) -> DataFrame:
        rows = self.memories().where(store.in_scope(**scope)) if any(scope.values()) else self.memories()
        return store.page(rows, limit, offset)

    def stats(self) -> DataFrame:
        return self.memories().groupingSets([[], ["category"], ["project_id"]], "category", "project_id").agg(F.count("*").alias("n"))

    def search(self, queries: DataFrame, as_of: Column, k: int = 20) -> DataFrame:
        """queries (qid, text, project): the best k memories of each by words, vectors, age and project, diversified."""
        rows = self.memories()
        vectors = self.embedder.embed(rows, "id", "content")
        asked = self.embedder.embed(queries.withColumn("qid", F.col("qid").cast("string")), "qid", "text")
        by_vector = top_k(vectors, asked, id_col="id", vector="embedding", dims=self.embedder.dims, k=4 * k, floor=0.01)
        by_text = search.best(search.bm25(rows, search.phrases(queries.withColumn("qid", F.col("qid").cast("string")), "qid", "text"), id_col="id", text="content"), 4 * k)
        asked_as = queries.select(F.col("qid").cast("string").alias("qid"), "project", "text")
        known = E.snapshot(rows.select(F.col("project_id").alias("name")), rows.withColumn("keywords", F.lit(None).cast("string")))
        about = asked_as.join(E.detect(asked_as, known).groupBy("qid").agg(F.collect_list("entity").alias("entities")), "qid", "left").drop("text")
        return hybrid.hybrid_search(by_text, by_vector, rows, about, as_of=as_of, k=k)

    def index(self, rows: DataFrame, at: Column, source: str, how: str = "markdown", ttl_hours: int = 336) -> str:
        """Chunks the texts of rows (id, text) and adds those whose content is new; the name of the group."""
        group = uuid.uuid4().hex
        found = content.chunk(rows, id_col="id", text="text", how=how)
        fresh = content.new_chunks(found, self.chunks())
        ready = fresh.select(F.left(F.sha2(F.concat_ws("\u0001", F.lit(group), F.col("id").cast("string"), F.col("chunk_no").cast("string")), 256), F.lit(32)).alias("id"), F.lit(source).alias("source"), F.col("label"), F.col("content"), F.lit("code" if how == "raw" else "prose").alias("content_type"), at.alias("indexed_at"), F.lit(ttl_hours).alias("ttl_hours"))
        self._append(conform(ready, "content_chunks"), "content_chunks")
        return group

    def chunks(self) -> DataFrame:
        """The chunks that no later deletion names."""
        gone = self._read("chunks_deleted", "id string")
        return self._read("content_chunks", schema("content_chunks").toDDL()).join(gone, "id", "left_anti")

    def delete_chunks(self, ids: DataFrame) -> None:
        self._append(ids.select("id").distinct(), "chunks_deleted")

    def evict(self, most: int, as_of: Column) -> int:
        """Deletes expired chunks and the oldest beyond `most` characters; how many there were."""
        gone = cut(content.evict(self.chunks(), most, as_of))
        self.delete_chunks(gone)
        return gone.count()

    # Sessions, events and facts

    def sessions(self) -> DataFrame:
        log = self._read("sessions_log", "id string, seq long, project_id string, source string, source_session_id string, created_at timestamp, last_activity_at timestamp, ended_at timestamp")
        return log.groupBy("id").agg(F.max_by(F.struct("project_id", "source", "source_session_id", "created_at", "last_activity_at", "ended_at"), "seq").alias("s")).select("id", "s.*")

    def _put_sessions(self, rows: DataFrame) -> None:
        seq = (self._read("sessions_log", "seq long").agg(F.max("seq")).first()[0] or 0) + 1
        self._append(cut(rows.withColumn("seq", F.lit(seq).cast("long"))), "sessions_log")

    def start_session(self, asked: DataFrame, at: Column) -> DataFrame:
        """The open session of each asked (source, source_session_id, project_id), or a new one."""
        found = cut(S.start_or_resume(self.sessions(), asked, at))
        self._put_sessions(found.drop("resumed").withColumn("ended_at", F.lit(None).cast("timestamp")))
        return found

    def end_session(self, ids: DataFrame, at: Column) -> None:
        self._put_sessions(S.end(self.sessions(), ids, at).join(ids.select("id").distinct(), "id", "left_semi"))

    def record_events(self, rows: DataFrame) -> None:
        """Appends events; columns that are missing get their defaults."""
        self._append(conform(rows, "session_events"), "session_events")

    def delete_events(self, ids: DataFrame) -> None:
        self._append(ids.select("id").distinct(), "events_deleted")

    def events(self) -> DataFrame:
        return self._read("session_events", schema("session_events").toDDL()).join(self._read("events_deleted", "id string"), "id", "left_anti")

    def add_facts(self, rows: DataFrame, at: Column) -> None:
        """Adds facts (subject, predicate, object) that are not known yet."""
        known = self.added_facts()
        key = F.left(F.sha2(F.concat_ws("\u0001", F.lower("subject"), "predicate", F.lower("object")), 256), F.lit(32))
        new = rows.select(key.alias("id"), F.lit(0).alias("n"), "subject", "predicate", "object", F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("project_id"), at.alias("valid_from"))
        self._append(cut(knowledge.add_facts(known, new).join(known.select("id"), "id", "left_anti")), "kg_facts")

    def added_facts(self) -> DataFrame:
        return self._read("kg_facts", "id string, n int, subject string, predicate string, object string, confidence double, project_id string, valid_from timestamp")

    def search_chunks(self, queries: DataFrame, k: int = 3, source: str | None = None) -> DataFrame:
        """queries (qid, query): the best k chunks of each with their snippets, reranked by how near the terms are."""
        rows = self.chunks() if source is None else self.chunks().where(F.lower("source").contains(source.lower()))
        hits = search.best(search.substring_search(rows, queries), 2 * k).drop("rank")
        return search.rerank(hits.join(queries, "qid").join(rows.select("id", "content"), "id"), k)

    def facts(self, functional: tuple[str, ...] = ()) -> DataFrame:
        """The knowledge graph of the live memories with the validity of each fact."""
        found = knowledge.extract(self.memories(), id_col="id", text="content", time="created_at", project="project_id")
        return knowledge.with_validity(found.unionByName(self.added_facts()), functional)

    def curate(self, preset: str = "moderate", apply: bool = False) -> DataFrame:
        """Exact and near duplicates and contradictions of all memories with their status; applied deletions are made if apply, and the run is kept."""
        rows, limits = self.memories(), curation.PRESETS[preset]
        exact = curation.exact_duplicates(rows, F.col("content_hash")).select("memory_id", "related_memory_id", F.lit("dedup").alias("action_type"), F.lit(1.0).alias("confidence"))
        vectors = self.embedder.embed(rows, "id", "content")
        side = lambda p, c: rows.select(F.col("id").alias(p), F.col("content").alias(f"{c}content"), F.col("created_at").alias(f"{c}created_at"), F.col("content_hash").alias(f"{c}hash"))
        alike = above(vectors, vectors, id_col="id", vector="embedding", dims=self.embedder.dims, threshold=0.7).where("qid < id")
        pairs = cut(alike.select(F.col("qid").alias("id"), F.col("id").alias("other"), F.col("score").alias("similarity")).join(side("id", ""), "id").join(side("other", "other_"), "other").where("hash <> other_hash"))
        near = curation.near_duplicates(pairs, limits.threshold).select("memory_id", "related_memory_id", F.lit("dedup").alias("action_type"), F.col("similarity").alias("confidence"))
        against = curation.contradictions(pairs, limits.threshold).select(F.col("id").alias("memory_id"), F.col("other").alias("related_memory_id"), F.lit("contradiction").alias("action_type"), "confidence")
        done = cut(curation.consolidate(exact.unionByName(near).unionByName(against), limits))
        run = uuid.uuid4().hex
        self._append(curation.report(done, rows.count()).withColumn("run_id", F.lit(run)), "dream_runs")
        self._append(done.withColumn("run_id", F.lit(run)), "dream_actions")
        if apply:
            self.forget(done.where("status = 'applied'").select(F.col("memory_id").alias("id")))
        return done
