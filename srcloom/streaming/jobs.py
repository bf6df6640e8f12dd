"""Job metrics over a stream of job events: first terminal snapshot of each attempt, then running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import new_path
from ..functions.text import js_round
from ..operators.jobs import TERMINAL


def terminal(events: DataFrame) -> DataFrame:
    """One row per job and started attempt with its duration: of its terminal snapshots that with the least event_seq, in whatever order they arrive."""
    done = events.filter(F.col("status").isin(*TERMINAL) & (F.col("attempt") >= 1))
    taken = F.col("finished_at") - F.coalesce("started_at", "created_at")
    first = F.min(F.struct("event_seq", "status", F.greatest(F.lit(0).cast("long"), taken).alias("duration"))).alias("first")
    return done.groupBy("job_id", "attempt").agg(first).select("job_id", "attempt", "first.event_seq", "first.status", "first.duration")


def totals(attempts: DataFrame) -> DataFrame:
    """Totals over the rows of terminal."""
    return attempts.groupBy().agg(F.count("*").alias("finished"), F.max_by("duration", "event_seq").alias("last_ms"), js_round(F.avg("duration")).alias("average_ms"), F.max("duration").alias("max_ms"))


def run_to_end(spark: SparkSession, path: str, adapt, aggregate=totals) -> DataFrame:
    """Streams the Parquet files at a path through adapt and terminal until none is left; the aggregate of its attempts as a static table.

    The state is a row for each attempt, which metrics over all time need; each trigger writes the totals anew.
    """
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).parquet(f"{path[:-1]}*")  # a pattern finds a table that is one file as well as a folder
    out = new_path(spark, "stream")

    def write(batch: DataFrame, epoch: int) -> None:
        aggregate(batch).write.mode("overwrite").parquet(f"{out}/table")

    query = terminal(adapt(source)).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/table")
