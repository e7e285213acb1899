"""Context on demand: summaries of projects, a balanced choice of categories, correction of misspelt words, result lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions.text import truncate_display


def essential_summary(memories: DataFrame, each: int = 3) -> DataFrame:
    """(project_id, category, ids): the `each` last updated memories of each project and category, newest first, ties by id."""
    w = Window.partitionBy("project_id", "category").orderBy(F.desc("updated_at"), "id")
    top = memories.where("project_id is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= each)
    return top.groupBy("project_id", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x.id).alias("ids"))


def balanced(ranked: DataFrame, k: int) -> DataFrame:
    """ranked (qid, id, rank, category): k rows a query, one of each category in turn, each by rank."""
    turn = F.row_number().over(Window.partitionBy("qid", "category").orderBy("rank", "id"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("turn", "rank", "id"))
    return ranked.withColumn("turn", turn).withColumn("place", place).where(F.col("place") <= k)


def deletions(word: Column) -> Column:
    """The word and what is left of it without one of its letters: words of edit distance 1 share one of these."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.left(word, i - 1), F.substr(word, i + 1)))))


def corrections(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, correction): known words one edit away from each asked word that is not known itself.

    Both sides meet on their deletions, an equi-join, before distances are taken.
    """
    known = vocabulary.select(F.col("word").alias("correction")).distinct()
    unknown = asked.select("word").distinct().join(known.withColumnRenamed("correction", "word"), "word", "left_anti")
    a, b = unknown.select("word", F.explode(deletions(F.col("word"))).alias("d")), known.select("correction", F.explode(deletions(F.col("correction"))).alias("d"))
    return a.join(b, "d").select("word", "correction").distinct().where(F.levenshtein("word", "correction") <= 1)


def result_line(rank: Column, category: Column, content: Column, score: Column) -> Column:
    """A result as a line: rank, category, the beginning of the text and the score."""
    return F.format_string("%d. [%s] %s (score=%.3f)", rank, category, truncate_display(content, 120), score)


def limit_bytes(text: Column, most: int) -> Column:
    """At most `most` bytes of a text, cut before a character that does not fit."""
    whole = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "utf-8"), 1, most).cast("string")), "�$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(whole)
