"""Right-closed bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .columns import as_column

# Edges and labels of the known bandings; None is infinity.
PACK_TIME = ([0, 1, 2, 3, 4, 5, 6, 7, None], ["< 1 hour", "1-2 hours", "2-3 hours", "3-4 hours", "4-5 hours", "5-6 hours", "6-7 hours", "> 7 hours"])
OPERATOR_SPEED = ([0, 4, 8, 12, 16, 20, 24], ["0 - 4", "4 - 8", "8 - 12", "12 - 16", "16 - 20", "20 - 24"])
AGE = ([0, 30, 45, 60, 100], ["young", "adult", "middle", "senior"])
BALANCE = ([None, 0, 1000, 10000, None], ["negative", "low", "medium", "high"])
CALL_LENGTH = ([0, 60, 180, 600, None], ["very_short", "short", "medium", "long"])
FORECAST = ["Extreme Underforecast", "Underforecast", "Correct", "Overforecast", "Extreme Overforecast"]


def band(c: Column | str, edges: Sequence, labels: Sequence[str], include_lowest: bool = False) -> tuple[Column, Column]:
    """(label, ordinal) of the band (a, b] that holds the value; outside or null: nulls.

    ``include_lowest`` closes the first band on the left too. None stands for infinity.
    """
    value, label, ordinal = as_column(c), F.lit(None).cast("string"), F.lit(None).cast("int")
    for i in reversed(range(len(labels))):
        low, high = edges[i], edges[i + 1]
        inside = F.lit(True)
        if low is not None:
            inside = inside & ((value >= low) if include_lowest and i == 0 else (value > low))
        if high is not None:
            inside = inside & (value <= high)
        inside = inside & value.isNotNull() & ~F.isnan(value.cast("double"))
        label, ordinal = F.when(inside, labels[i]).otherwise(label), F.when(inside, i).otherwise(ordinal)
    return label, ordinal


def accuracy_band(pct: Column | str, limits: Sequence[float] = (-15, -5, 5, 15), middle: str = "Correct") -> Column:
    labels = [middle if x == "Correct" else x for x in FORECAST]
    return band(pct, [None, *limits, None], labels)[0]


def accuracy_band_or_zero(pct: Column, truth: Column, predicted: Column, limits: Sequence[float] = (-10, -5, 5, 10), near: float = 0.01, far: float = 0.1) -> Column:
    """Bands by percentage; where the truth is 0, by the size of the prediction."""
    zero = (
        F.when(F.abs(predicted) <= near, "Accurate")
        .when(predicted > far, FORECAST[4])
        .when(predicted > near, FORECAST[3])
        .when(predicted < -far, FORECAST[0])
        .when(predicted < -near, FORECAST[1])
    )
    return F.when(truth == 0, zero).otherwise(accuracy_band(pct, limits, "Accurate"))


def band_summary(df: DataFrame, label: str, ordinal: str, member: str, labels: Sequence[str], descending: bool = False) -> DataFrame:
    """Distinct members, share and running share of every band, empty ones included.

    Shares are rounded to two places before they are summed, as long as ``descending`` is not
    set; from the top band down it is the sum that is rounded. One row for each band.
    """
    spark = df.sparkSession
    bands = spark.createDataFrame(list(enumerate(labels)), f"{ordinal} int, {label} string")
    counts = df.where(F.col(ordinal).isNotNull()).groupBy(ordinal).agg(F.countDistinct(member).alias("n_members"))
    full = bands.join(counts, ordinal, "left").withColumn("n_members", F.coalesce("n_members", F.lit(0)))
    everything = Window.partitionBy(F.lit(1))
    running = everything.orderBy(F.desc(ordinal) if descending else ordinal).rowsBetween(Window.unboundedPreceding, 0)
    share = F.try_divide(F.col("n_members") * 100.0, F.sum("n_members").over(everything))
    full = full.withColumn("proportion", F.round(share, 2))
    if descending:
        return full.withColumn("cumulative", F.round(F.try_divide(F.sum("n_members").over(running) * 100.0, F.sum("n_members").over(everything)), 2))
    return full.withColumn("cumulative", F.round(F.sum("proportion").over(running), 2))


def fit_verdict(train_mse: Column, test_mse: Column, train_r2: Column, test_r2: Column) -> Column:
    """overfit where the training error is under 0.7 of the test's, underfit where both R2 are
    under 0.6, else good fit."""
    return F.when(train_mse < test_mse * 0.7, "overfit").when((train_r2 < 0.6) & (test_r2 < 0.6), "underfit").otherwise("good fit")
