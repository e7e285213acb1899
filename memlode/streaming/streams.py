"""Streams over tables: deduplication, session windows, expiry and ingestion in micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlode.session import shared_dir


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files of a Parquet table, a folder or a single file, with the schema it has now."""
    now = spark.read.parquet(path)
    name = path.rstrip("/").rsplit("/", 1)[1]
    reader = spark.readStream.schema(now.schema)
    if all(f.rstrip("/").endswith("/" + name) for f in now.inputFiles()):  # a file source watches folders
        return reader.option("pathGlobFilter", name).parquet(path.rstrip("/")[: -len(name) - 1])
    return reader.parquet(path)


def run(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """What the stream gives for all there is now. Progress and results lie in the shared folder, so a lost executor or driver costs no row."""
    to = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{to}/progress").outputMode(mode)
    if each is None:
        query = writer.format("parquet").option("path", f"{to}/rows").start()
    else:
        query = writer.foreachBatch(lambda df, n: each(df, n).write.mode("overwrite").parquet(f"{to}/rows/batch={n}")).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{to}/rows")


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str = "10 days") -> DataFrame:
    """The first row of each key; state is kept for as long as rows may be late."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windows(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", delay: str = "10 days") -> DataFrame:
    """(key, started, ended, n): session windows, given once the watermark has passed them."""
    grouped = stream.withWatermark(time, delay).groupBy(F.col(key), F.session_window(time, gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def run_latest(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """The last value that the stream gave for each key: a sink of updates (or of complete results) that replaces by key."""
    to = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def keep(df: DataFrame, n: int) -> None:
        df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{to}/rows/batch={n}")

    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{to}/progress").outputMode(mode)
    writer.foreachBatch(keep).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{to}/rows").drop("batch")
    values = [c for c in rows.columns if c not in keys and c != "_batch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v"))
    return last.select(*keys, "v.*")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], every: str | None = None) -> None:
    """Calls work on every micro-batch, for all there is now, or from now on every `every`: embedding, triples and eviction hang on it."""
    to = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{to}/progress").foreachBatch(work)
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if not every:
        query.awaitTermination()


def text_files(spark: SparkSession, folder: str, glob: str = "*.{md,mdc,jsonl}") -> DataFrame:
    """A stream of the text files of a folder, (file, modified_at, sha256, text): new and renewed files come as they appear."""
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").format("text")
    rows = reader.load(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified_at"), F.col("value").alias("text"))
    return rows.withColumn("sha256", F.sha2("text", 256))


def tumbling(stream: DataFrame, key: str, time: str, width: str = "1 day", delay: str = "10 days") -> DataFrame:
    grouped = stream.withWatermark(time, delay).groupBy(F.col(key), F.window(time, width).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), "n")
