"""Interaction strengths over a stream of events, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.recommend import STRENGTH

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_strengths(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Strongest event and events of each person in each window; state is dropped once the watermark has passed it."""
    kinds = F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv])
    return (
        events.where(F.col("event_type").isin(*STRENGTH)).withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), F.col("user_id").alias("person_id"))
        .agg(F.max(kinds[F.col("event_type")]).alias("strength"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "person_id", "strength", "n")
    )


def run_to_end(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that is there now to ``path`` and stop; a second run goes on from the checkpoint."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
