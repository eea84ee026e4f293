"""Joins that recover, attach and restrict, and unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def left_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], null_safe: bool = False) -> DataFrame:
    """Left join on differently named keys; the right keys go. Null keys match only if asked to."""
    renamed = right.select(*(F.col(c).alias(f"_r_{c}") if c in {b for _, b in pairs} else F.col(c) for c in right.columns))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b)
    return left.join(renamed, reduce(Column.__and__, (same(a, f"_r_{b}") for a, b in pairs)), "left").drop(*(f"_r_{b}" for _, b in pairs))


def recover(df: DataFrame, reference: DataFrame, keys: Sequence[str], attribute: str) -> DataFrame:
    """Missing attributes from a reference by key, in one left join; rows still missing stay null.

    A key that the reference has several times gives a row for each, for missing rows only.
    """
    found = reference.select(*keys, F.col(attribute).alias("_found"))
    have, lack = df.where(F.col(attribute).isNotNull()), df.where(F.col(attribute).isNull())
    filled = lack.join(found, list(keys), "left").withColumn(attribute, F.col("_found")).select(*df.columns)
    return have.unionByName(filled)


def reject_nulls(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without nulls in the columns, one row with the numbers kept and dropped)."""
    some = reduce(Column.__or__, (F.col(c).isNull() for c in columns))
    return df.dropna(subset=list(columns)), df.agg(F.count_if(~some).alias("n_kept"), F.count_if(some).alias("n_dropped"))


def coverage_filter(df: DataFrame, c: str, other: DataFrame, other_c: str, condition: Column | None = None, strict: bool = False) -> DataFrame:
    """Rows inside the other table's days, both ends whole.

    ``strict`` ends at the last day's midnight. Nulls, in the condition too, drop the row.
    """
    ends = other.agg(F.min(F.to_date(other_c)).alias("_low"), F.max(F.to_date(other_c)).alias("_high"))
    last = F.col("_high") if strict else F.date_add("_high", 1)
    inside = (F.col(c) >= F.col("_low")) & ((F.col(c) <= last) if strict else (F.col(c) < last))
    kept = df if condition is None else df.where(condition)
    return kept.crossJoin(F.broadcast(ends)).where(inside).drop("_low", "_high")


def calendar_flag(df: DataFrame, day: str, calendar: DataFrame, calendar_day: str, out: str) -> DataFrame:
    """1 where the day is in the calendar, else 0."""
    days = calendar.select(F.col(calendar_day).alias("_day")).distinct()
    return df.join(days, F.col(day) == F.col("_day"), "left").withColumn(out, F.col("_day").isNotNull().cast("int")).drop("_day")


def in_dimension(df: DataFrame, c: str, dimension: DataFrame, key: str, out: str) -> DataFrame:
    """Whether the value is a key of the dimension; null is not."""
    keys = dimension.select(F.col(key).alias("_key")).distinct()
    return df.join(keys, F.col(c) == F.col("_key"), "left").withColumn(out, F.col("_key").isNotNull()).drop("_key")


def argmax_rows(df: DataFrame, c: str) -> DataFrame:
    """All rows that have the column's greatest value."""
    most = df.agg(F.max(c).alias("_most"))
    return df.join(F.broadcast(most), F.col(c) == F.col("_most")).drop("_most")


def union_fill(frames: Sequence[DataFrame], fill: Mapping[str, object]) -> DataFrame:
    """Rows of all frames; columns that a frame lacks are null, then filled."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).na.fill(dict(fill))


def zip_on_id(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Columns of all frames side by side, by an explicit row id in place of position."""
    return reduce(lambda a, b: a.join(b, key), frames)


def attach(df: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Attributes by id, null where there are none."""
    return df.join(attributes, key, "left")
