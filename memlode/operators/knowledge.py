"""The knowledge graph: triples from text, entities with aliases, validity in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values: (predicate, confidence, verb phrase), in the order in which candidates are listed.
PATTERNS = (
    ("uses", 0.9, r"(?:uses?|usa)"),
    ("depends_on", 0.85, r"(?:depends?\s+on|depende\s+de)"),
    ("deployed_on", 0.8, r"(?:deployed?\s+on|implantad[oa]\s+em)"),
    ("is_a", 0.9, r"(?:is\s+a|é\s+(?:um|uma))"),
    ("created_by", 0.85, r"(?:created\s+by|criad[oa]\s+por)"),
    ("requires", 0.8, r"(?:requires?|requer)"),
    ("integrates_with", 0.75, r"(?:integrates?\s+with|integra\s+com)"),
)
SUBJECT, OBJECT = r"([A-Za-z][A-Za-z0-9_.\- ]{0,40}?)", r"([A-Za-z]\w[\w.\-]*)"

_FACTS = "array<struct<subject:string,predicate:string,object:string,confidence:double>>"


def pattern(verb: str) -> str:
    return rf"{SUBJECT}\s+{verb}\s+{OBJECT}"


def triples(text: Column, most: int | None = 5) -> Column:
    """Array of (subject, predicate, object, confidence): matches pattern by pattern, the first `most`; texts under 20 bytes give none."""

    def matches(name: str, confidence: float, verb: str) -> Column:
        p = F.lit("(?iu)" + pattern(verb))
        fact = lambda s, o: F.struct(F.trim(s).alias("subject"), F.lit(name).alias("predicate"), F.trim(o).alias("object"), F.lit(confidence).alias("confidence"))
        both = F.zip_with(F.regexp_extract_all(text, p, F.lit(1)), F.regexp_extract_all(text, p, F.lit(2)), fact)
        # the subject makes the whole pattern slow; the verb alone is quick to rule out
        return F.when(text.rlike(rf"(?iu)\s{verb}\s"), both).otherwise(F.array().cast(_FACTS))

    found = F.filter(F.concat(*(matches(*p) for p in PATTERNS)), lambda t: (t.subject != "") & (t.object != ""))
    found = F.slice(found, 1, most) if most else found
    return F.when(F.octet_length(text) >= 20, found).otherwise(F.slice(found, 1, 0))


def extract(rows: DataFrame, *, id_col: str, text: str, time: str, project: str, most: int | None = 5) -> DataFrame:
    """(id, n, subject, predicate, object, confidence, project_id, valid_from)."""
    found = rows.select(F.col(id_col).alias("id"), F.col(project).alias("project_id"), F.col(time).alias("valid_from"), F.posexplode(triples(F.col(text), most)).alias("n", "t"))
    return found.select("id", "n", "t.subject", "t.predicate", "t.object", "t.confidence", "project_id", "valid_from")


def entities(found: DataFrame) -> DataFrame:
    """(entity_id, name, alias): subjects and objects, one entity a lower-case name; its name is the smallest spelling."""
    names = found.select(F.explode(F.array("subject", "object")).alias("name")).groupBy(F.lower("name").alias("alias")).agg(F.min("name").alias("name"))
    return names.select(F.left(F.sha2("alias", 256), F.lit(32)).alias("entity_id"), "name", "alias")


def with_validity(found: DataFrame, functional: tuple[str, ...]) -> DataFrame:
    """found with valid_to: a functional predicate's fact ends when the next of the same subject and predicate begins."""
    w = Window.partitionBy(F.lower("subject"), "predicate").orderBy("valid_from", "id", "n")
    return found.withColumn("valid_to", F.when(F.col("predicate").isin(*functional), F.lead("valid_from").over(w)))


def add_facts(known: DataFrame, new: DataFrame) -> DataFrame:
    """The facts of known and new, new ones added where no current fact says the same of the same subject (in lower case).

    Both are (id, n, subject, predicate, object, confidence, project_id, valid_from); what a functional predicate
    replaces follows from with_validity.
    """
    same = ["_s", "predicate", "_o"]
    keyed = lambda df: df.withColumns({"_s": F.lower("subject"), "_o": F.lower("object")})
    fresh = keyed(new).join(keyed(known).select(*same).distinct(), same, "left_anti").dropDuplicates(same).drop("_s", "_o")
    return known.unionByName(fresh.select(*known.columns))


def star(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, predicates, triples): facts in normal form, ends and predicates by id."""
    named = entities(found)
    predicates = found.select(F.left(F.sha2("predicate", 256), F.lit(32)).alias("predicate_id"), F.col("predicate").alias("name")).distinct()
    key = lambda c: F.left(F.sha2(F.lower(c), 256), F.lit(32))
    triples_ = found.select("id", "n", key("subject").alias("subject_id"), F.left(F.sha2("predicate", 256), F.lit(32)).alias("predicate_id"), key("object").alias("object_id"), "confidence", "project_id", "valid_from")
    return named, predicates, triples_


def joined(named: DataFrame, predicates: DataFrame, triples_: DataFrame) -> DataFrame:
    """Triples with the names of their subject, predicate and object: the star join."""
    e = named.select("entity_id", "name")
    rows = triples_.join(e.withColumnsRenamed({"entity_id": "subject_id", "name": "subject"}), "subject_id").join(e.withColumnsRenamed({"entity_id": "object_id", "name": "object"}), "object_id")
    return rows.join(predicates.withColumnRenamed("name", "predicate"), "predicate_id").select("id", "n", "subject", "predicate", "object", "confidence", "project_id", "valid_from")


def as_of(found: DataFrame, at: Column, known_at: Column | None = None) -> DataFrame:
    """Facts valid at a time; with known_at only those recorded by then (column txn_time)."""
    out = found.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    return out.where(F.col("txn_time") <= known_at) if known_at is not None else out


def one_hop(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(name and the fact): current facts whose subject or object is the name or has it as its alias (lower case).

    asked is (name). Both ends become one key of an equi-join.
    """
    ends = found.where(F.col("valid_to").isNull()).select("*", F.explode(F.array_distinct(F.array(F.lower("subject"), F.lower("object")))).alias("_k"))
    return ends.join(asked.select("name", F.lower("name").alias("_k")).distinct(), "_k").drop("_k")
