"""The same operators on a stream of files.

Only the summaries that a stream can keep are here: counts and means in event-time windows with
a watermark, and stateless derivations such as banding, which apply to a stream unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import bands as B


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """New Parquet files of a folder as a stream with the columns of ``like``."""
    return spark.readStream.schema(like.schema).parquet(path)


def windowed(events: DataFrame, ts: str, keys: Sequence[str], measures: Sequence[Column], window: str, late: str) -> DataFrame:
    """Measures by window and keys; rows later than ``late`` behind the newest are dropped."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(F.window(ts, window).alias("w"), *keys).agg(*measures).withColumn("start", F.col("w.start")).drop("w")


def banded_counts(events: DataFrame, ts: str, value: str, edges: Sequence, labels: Sequence[str], window: str, late: str) -> DataFrame:
    """How many values fall in each band in each window."""
    label, _ = B.band(value, edges, labels)
    return windowed(events.withColumn("band", label), ts, ["band"], [F.count(F.lit(1)).alias("n")], window, late)
