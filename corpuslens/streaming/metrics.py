"""Request metrics recorded and summarised as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpuslens.operators.metrics import summary_columns


#: Folders of the metrics table; the number of files a batch writes does not grow with the projects.
PROJECT_BUCKETS = 16


def _project_bucket(project: Column) -> Column:
    return F.pmod(F.xxhash64(project), F.lit(PROJECT_BUCKETS)).cast("int")


def record_requests(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append request rows to the metrics table, in a fixed number of buckets of projects."""
    return (
        requests.withColumn("project_bucket", _project_bucket(F.col("project_id")))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("project_bucket")
        .trigger(availableNow=True)
        .start()
    )


def read_requests(spark: SparkSession, path: str, project_id: str | None = None) -> DataFrame:
    """The recorded requests, or those of one project, of whose bucket alone files are read."""
    stored = spark.read.parquet(path)
    if project_id is not None:
        name = F.lit(project_id)
        stored = stored.where((F.col("project_bucket") == _project_bucket(name)) & (F.col("project_id") == name))
    return stored.drop("project_bucket")


_MEANS = {
    "latency_ms": "avg_latency_ms",
    "retrieval_latency_ms": "avg_retrieval_latency_ms",
    "generation_latency_ms": "avg_generation_latency_ms",
    "citation_count": "avg_citation_count",
}


def keep_chat_summary(requests: DataFrame, path: str, checkpoint: str, window: str = "1 day") -> StreamingQuery:
    """Counts and mean latencies of all requests, however late: each batch writes its sums per
    window and project under its own number, so a replayed batch replaces them.  There is no state."""

    def absorb(batch: DataFrame, batch_id: int) -> None:
        sums = [F.count(F.lit(1)).alias("request_count")]
        for name in _MEANS:
            sums += [F.sum(name).alias(f"sum_{name}"), F.count(name).alias(f"n_{name}")]
        (
            batch.groupBy(F.window("created_at", window).alias("window"), "project_id")
            .agg(*sums)
            .select("window.start", "window.end", "project_id", "request_count", *[f"{k}_{n}" for n in _MEANS for k in ("sum", "n")])
            .withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(path)
        )

    return (
        requests.writeStream.foreachBatch(absorb)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_chat_summary(spark: SparkSession, path: str) -> DataFrame:
    """The kept sums as counts and means per window and project."""
    means = [(F.sum(f"sum_{n}") / F.sum(f"n_{n}")).alias(to) for n, to in _MEANS.items()]
    stored = spark.read.parquet(path)
    return stored.groupBy("start", "end", "project_id").agg(F.sum("request_count").alias("request_count"), *means)


def stream_chat_summary(
    requests: DataFrame, window: str = "1 day", late: str = "1 hour"
) -> DataFrame:
    """Counts and mean latencies of closed windows, each once; rows later than ``late`` are
    dropped.  ``keep_chat_summary`` is the complete form.

    The state holds one row per open window and project."""
    return (
        requests.withWatermark("created_at", late)
        .groupBy(F.window("created_at", window), "project_id")
        .agg(*summary_columns())
        .select("window.start", "window.end", "project_id", *[c for c in _NAMES])
    )


_NAMES = (
    "request_count", "avg_latency_ms", "avg_retrieval_latency_ms", "avg_generation_latency_ms",
    "avg_citation_count",
)
