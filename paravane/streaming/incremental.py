"""Incremental scoring: predictions arrive as files and are scored and merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paravane.plans.evaluate import Evaluator

PREDICTION = "dataset string, model_id string, id string, variant string, y string, raw string, row_idx long"


def score_stream(spark: SparkSession, source: str, target: str, checkpoint: str, evaluator: Evaluator, files_per_trigger: int = 100) -> StreamingQuery:
    """Score raw outputs as they arrive; each batch is one folder of the target, so a retry replaces it."""
    raw = spark.readStream.schema(PREDICTION).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def sink(batch: DataFrame, epoch: int) -> None:
        evaluator.scored(batch).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return raw.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The newest prediction of each (dataset, model_id, variant, id) over all batches."""
    keys = ["dataset", "model_id", "variant", "id"]
    df = spark.read.parquet(target)
    rest = [c for c in df.columns if c not in (*keys, "epoch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("epoch")).alias("p")).select(*keys, "p.*")


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and means per event type and window; works on a stream (with its watermark) and on a table."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = source.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")
