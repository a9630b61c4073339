"""Streams over logs and heartbeats. Sinks write a new file for every append, which a file stream needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reports
from ..sources.schemas import HEARTBEAT, REPORT


def log_stream(spark: SparkSession, folder: str, schema: str = REPORT, glob: str = "*.json*") -> DataFrame:
    """Rows of new log files, with the time of the file and its name."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).json(folder)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("file"))


def latest_stream(rows: DataFrame, order: tuple[str, ...] = ("at", "file")) -> DataFrame:
    """The newest row of each book as a running aggregate (complete or update mode)."""
    rows = reports.keyed(rows)
    rest = [c for c in rows.columns if c not in ("source", "book_id")]
    best = rows.groupBy("source", "book_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select("source", "book_id", "r.*")


def monitor(rows: DataFrame, checkpoint: str, show: Callable[[DataFrame, int], None], once: bool = True, interval: str = "5 seconds") -> StreamingQuery:
    """Keeps the newest row of each book as state and hands the figures by source to `show` whenever
    rows come in. once: what is there now, then it ends."""

    def each(batch: DataFrame, number: int) -> None:
        show(reports.with_total(batch), number)

    out = latest_stream(rows).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=interval)).start()


def heartbeat_stream(spark: SparkSession, folder: str) -> DataFrame:
    return log_stream(spark, f"{folder}/.progress", HEARTBEAT, "*.json")


def active_workers(beats: DataFrame, now: float, ttl: float = 3600.0) -> DataFrame:
    """The newest heartbeat of each book that isn't stale, of a batch or a running aggregate."""
    newest = reports.latest(beats, ["source", "book_id"], ["updated_at"])
    return reports.active(newest, now, ttl)


def state_of_workers(beats: DataFrame, checkpoint: str, show: Callable[[DataFrame, int], None], now: Callable[[], float], ttl: float = 3600.0) -> StreamingQuery:
    """Newest heartbeats as state; each batch shows those that aren't stale at that time."""
    newest = beats.groupBy("source", "book_id").agg(F.max_by(F.struct("slug", "pid", "step", "step_index", "n_steps", "started_at", "updated_at"), "updated_at").alias("r")).select("source", "book_id", "r.*")

    def each(batch: DataFrame, number: int) -> None:
        show(reports.active(batch, now(), ttl), number)

    return newest.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


def step_events(plan, books: DataFrame, at: float) -> DataFrame:
    """(source, book_id, step_index, step, at) of a plan's stages for each book."""
    steps = F.array(*[F.struct(F.lit(i).alias("step_index"), F.lit(n).alias("step")) for i, n in enumerate(plan.names)])
    return books.select("source", "book_id", F.inline(steps)).withColumn("at", F.lit(at))
