"""Melting, day explosion, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def melt_indicators(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """A row for each indicator column that is 1."""
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, list(columns), name, "_value").where("_value = 1").drop("_value")


def explode_days(df: DataFrame, start: str, end: str, out: str, first: str | None = None, last: str | None = None, outer: bool = True) -> DataFrame:
    """A row for each day of the stay, both ends included.

    Stays are clipped to ``first``..``last`` before they explode, as no filter on the made day
    reaches below the explosion. Reversed or missing ends have no day: one null row, or none
    without ``outer``.
    """
    low, high = F.to_date(start), F.to_date(end)
    if first is not None:
        low = F.greatest(low, F.to_date(F.lit(first)))
    if last is not None:
        high = F.least(high, F.to_date(F.lit(last)))
    ends = low.isNotNull() & high.isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()
    days = F.when(ends & (high >= low), F.sequence(low, F.when(high >= low, high).otherwise(low)))
    return df.withColumn(out, (F.explode_outer if outer else F.explode)(days))


def pivot(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, measure, fill: object = 0) -> DataFrame:
    """Values of ``column`` across; naming them saves a pass that would look for them."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(measure).na.fill(fill)


def transpose(df: DataFrame, key: str, names: Sequence[str], out: str = "feature") -> DataFrame:
    """Columns down and the key's values, given as ``names``, across."""
    columns = [c for c in df.columns if c != key]
    long = df.unpivot([key], columns, out, "_value")
    return long.groupBy(out).pivot(key, list(names)).agg(F.first("_value"))


def reindex(df: DataFrame, key: str, values: Sequence, fill: object = 0) -> DataFrame:
    """A row for each given key in their order, filled where the table has none."""
    kind = df.schema[key].dataType.simpleString()
    frame = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"position int, {key} {kind}")
    return frame.join(df, key, "left").na.fill(fill).orderBy("position")
