"""The tables of the store as schemas, and the migrations that bring older rows up to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Table name to columns.
TABLES = {
    "memories": "id string, project_id string, category string, content string, keywords string, embedding array<float>, source string, source_id string, created_at timestamp, updated_at timestamp, access_count int, last_accessed_at timestamp, metadata string, content_hash string, deleted_at timestamp",
    "embedding_cache": "text_hash string, model string, embedding array<float>, created_at timestamp",
    "projects": "id string, name string, path string, source_tool string, created_at timestamp, updated_at timestamp",
    "essential_stories": "project_id string, story string, source_memories string, generated_at timestamp, bytes int, schema_version int",
    "kg_entities": "id string, name string, project_id string, embedding array<float>, created_at timestamp",
    "kg_entity_aliases": "entity_id string, alias string",
    "kg_predicates": "id string, name string, is_functional boolean, created_at timestamp",
    "kg_triples": "id string, subject_id string, predicate_id string, object_id string, confidence double, project_id string, valid_from timestamp, valid_to timestamp, txn_time timestamp, created_at timestamp",
    "imports": "id string, source string, path string, memories_imported int, entities_imported int, status string, started_at timestamp, finished_at timestamp, error string",
    "sessions": "id string, project_id string, source string, source_session_id string, title string, directory string, created_at timestamp, message_count int, imported_at timestamp, last_activity_at timestamp, ended_at timestamp, source_tool string, metadata string",
    "migrations": "id long, name string, applied_at timestamp",
    "indexed_files": "path string, sha256 string, indexed_at timestamp",
    "dream_runs": "id string, started_at timestamp, finished_at timestamp, config string, memories_analyzed int, actions_proposed int, actions_applied int, status string",
    "dream_actions": "id string, run_id string, memory_id string, related_memory_id string, action_type string, confidence double, reason string, proposed_at timestamp, applied_at timestamp, status string",
    "content_chunks": "id string, session_id string, project_id string, source string, label string, content string, metadata string, content_type string, indexed_at timestamp, ttl_hours int",
    "session_events": "id string, session_id string, project_id string, event_type string, priority int, tool_name string, summary string, metadata string, created_at timestamp",
}
#: What a column is where an older table lacks it or has null.
DEFAULTS = {"access_count": 0, "message_count": 0, "ttl_hours": 336, "priority": 3, "is_functional": False, "confidence": 1.0, "schema_version": 1, "label": "", "content_type": ""}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def conform(rows: DataFrame, table: str) -> DataFrame:
    """rows with exactly the table's columns: missing ones are added, types cast where they can be, defaults filled in."""
    out = []
    for f in schema(table):
        col = rows[f.name].try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(col, F.lit(DEFAULTS[f.name]).cast(f.dataType)) if f.name in DEFAULTS else col).alias(f.name))
    return rows.select(*out)


def pending(applied: DataFrame, names: list[str]) -> list[str]:
    """The migrations of an ordered list that the ledger (name) lacks; the ledger has at most as many rows as there are names."""
    done = {r["name"] for r in applied.where(F.col("name").isin(names)).select("name").distinct().collect()}
    return [n for n in names if n not in done]
