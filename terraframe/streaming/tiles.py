"""Detections as a stream: newly arrived raw detections, filtered and counted as they come.

Suppression needs all neighbours, so it runs in batch on what each trigger has
gathered; see suppress_each_batch().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terraframe.operators.nms import greedy_nms

BOXES = "id long, xmin double, ymin double, xmax double, ymax double, area double, conf double, arrived timestamp"


def arrivals(spark: SparkSession, folder: str, schema: str = BOXES, files: int = 64) -> DataFrame:
    """Parquet files of detections as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def counts(stream: DataFrame, confidence: float = 0.4, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Number and area of detections at or above a confidence in tumbling windows of arrival."""
    kept = stream.where(F.col("conf") >= confidence).withWatermark("arrived", late)
    return kept.groupBy(F.window("arrived", window)).agg(F.count("*").alias("n"), F.sum("area").alias("alan_m2")).select("window.start", "window.end", "n", "alan_m2")


def suppress_each_batch(stream: DataFrame, out: str, checkpoint: str, threshold: float = 0.5, cell: float = 16.0) -> StreamingQuery:
    """Each trigger's detections after suppression, under ``out``/batch=n; a batch that runs again replaces itself."""

    def settle(batch: DataFrame, n: int) -> None:
        greedy_nms(batch, threshold, cell).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
