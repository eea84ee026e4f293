"""Numbers, running sums and quantiles along an order of any number of rows.

Rows are dealt to ranges of the order and written; each range is numbered by itself and shifted
by what the ranges before it hold, of which there is one row a range. No task sorts all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .checkpoints import ensure, written


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` with the columns that ``groups`` has for its keys; null keys match null."""
    if not keys:
        return df.crossJoin(F.broadcast(groups))
    renamed = groups.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in groups.columns if c not in keys))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    return df.join(renamed, same, how).drop(*(f"_k_{k}" for k in keys))


def ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` in ranges of the order, numbered in ``_part``."""
    ensure(df.sparkSession)
    return df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()


def numbered(df: DataFrame, order: Sequence[Column | str], sums: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_position`` from 0 and the running sum ``_upto_<c>`` of each of ``sums``.

    Without ties in ``order`` the numbers are the same in every run.
    """
    placed = ranges(df, order)
    own = Window.partitionBy("_part").orderBy(*order)
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_s_{c}") for c in sums))
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in ["_n", *(f"_s_{c}" for c in sums)]))
    made = placed.withColumns({"_position": F.row_number().over(own) - 1, **{f"_upto_{c}": F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)) for c in sums}})
    # one row a range
    made = made.join(F.broadcast(starts), "_part")
    made = made.withColumns({"_position": F.col("_position") + F.col("_before_n"), **{f"_upto_{c}": F.col(f"_upto_{c}") + F.col(f"_before_s_{c}") for c in sums}})
    return made.drop("_part", "_before_n", *(f"_before_s_{c}" for c in sums))


def group_numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_position`` from 0 inside each group and the running sums ``_upto_<c>``.

    A group may hold any share of the rows: ranges go over keys and order, so that a large group
    lies in several, and a range's first group is shifted by what earlier ranges hold of it.
    """
    placed = ranges(df, [*keys, *order])
    own = Window.partitionBy("_part", *keys).orderBy(*order)
    made = placed.withColumns({"_position": (F.row_number().over(own) - 1).cast("long"), **{f"_upto_{c}": F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)) for c in sums}})
    held = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_s_{c}") for c in sums))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("_part", *keys, F.sum("_n").over(before).alias("_before_n"), *(F.sum(f"_s_{c}").over(before).alias(f"_before_{c}") for c in sums)).where("_before_n is not null")
    starts = starts.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k_{k}") for k in keys), "_before_n", *(f"_before_{c}" for c in sums))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), F.col("_part") == F.col("_p"))
    # Ranges follow each other: one group at most goes on into a range, one row a range.
    made = made.join(F.broadcast(starts), same, "left")
    made = made.withColumns({"_position": F.col("_position") + F.coalesce("_before_n", F.lit(0)), **{f"_upto_{c}": F.col(f"_upto_{c}") + F.coalesce(F.col(f"_before_{c}"), F.lit(0)) for c in sums}})
    return made.select(*df.columns, "_position", *(f"_upto_{c}" for c in sums))


#: Bins of a histogram pass, and the rows of a range whose values are counted one by one.
BINS, FEW = 1 << 12, 1 << 17


def _scaled(k: int) -> str:
    """What the bins of pass ``k`` are equally wide in; passes on logarithms serve long tails."""
    return "signum({0}) * ln(1 + abs({0}))" if k % 2 else "{0}"


def quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float], by: Sequence[str] = (), few: int = FEW) -> DataFrame:
    """(keys, column_name, q0, q1, ...): exact quantiles by group, interpolated between neighbours.

    Nulls and NaN are left out; a group without values of a column has no row for it. No row is
    sorted or shuffled: a pass counts rows in BINS bins of each range in which a wanted place
    lies, pre-aggregated where they are read, and goes on with the bin that has it, until a
    range has few rows or one value. Only in ranges of ``few`` rows are values counted one by
    one, so that neither a hot group nor a value of most rows meets in one task.
    """
    items = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns))
    rows = df.select(*by, F.inline(items)).where("v is not null and not isnan(v)")
    keys = [*by, "column_name"]
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("q"), F.lit(e).alias("end"), f(F.lit(p) * (F.col("n") - 1)).cast("long").alias("rank")) for i, p in enumerate(points) for e, f in (("low", F.floor), ("high", F.ceil)))))
    state = written(whole.withColumn("w", wanted).select(*keys, F.col("n").alias("whole"), "w.q", "w.end", "w.rank", F.lit(0).cast("long").alias("below"), "n", "low", "high"))
    span, k = [*keys, "low", "high"], 0

    def inside(open_: DataFrame) -> DataFrame:
        return join_groups(rows, open_.select(*span).distinct(), keys, "inner").where("v between low and high")

    while not (large := state.where((F.col("n") > few) & (F.col("low") < F.col("high")))).isEmpty():
        # Halves, so that the width of a range of all doubles is a number.
        f = lambda c, k=k: _scaled(k).format(f"(greatest(-1.7e308D, least(1.7e308D, {c})) / 2)")
        at = F.expr(f"case when v = low then 0 when v = high then {BINS - 1} else coalesce(cast(greatest(0, least({BINS - 1}, floor(try_divide({f('v')} - {f('low')}, {f('high')} - {f('low')}) * {BINS}))) as int), 0) end")
        # BINS rows a range, whatever its number of values.
        bins = inside(large).groupBy(*span, at.alias("bin")).agg(F.count(F.lit(1)).alias("b_n"), F.min("v").alias("b_low"), F.max("v").alias("b_high"))
        upto = Window.partitionBy(*span).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("b_upto", F.sum("b_n").over(upto))
        met = join_groups(state, bins, span)
        hit = (F.col("rank") >= F.col("below") + F.col("b_upto") - F.col("b_n")) & (F.col("rank") < F.col("below") + F.col("b_upto"))
        met = met.where(F.col("bin").isNull() | hit)
        state = written(met.select(*keys, "whole", "q", "end", "rank", (F.col("below") + F.coalesce(F.col("b_upto") - F.col("b_n"), F.lit(0))).alias("below"), F.coalesce("b_n", "n").alias("n"), F.coalesce("b_low", "low").alias("low"), F.coalesce("b_high", "high").alias("high")))
        k += 1
    counts = inside(state.where("low < high")).groupBy(*span, "v").agg(F.count(F.lit(1)).alias("v_n"))
    # At most ``few`` rows a range.
    counts = counts.withColumn("v_upto", F.sum("v_n").over(Window.partitionBy(*span).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    placed = join_groups(state, counts, span)
    hit = (F.col("rank") >= F.col("below") + F.col("v_upto") - F.col("v_n")) & (F.col("rank") < F.col("below") + F.col("v_upto"))
    found = placed.where(F.col("v").isNull() | hit).withColumn("v", F.coalesce("v", "low"))
    ends = found.groupBy(*keys, "whole").agg(*(F.max(F.when((F.col("q") == i) & (F.col("end") == e), F.col("v"))).alias(f"_{e}{i}") for i in range(len(points)) for e in ("low", "high")))
    part = lambda p: F.lit(p) * (F.col("whole") - 1) - F.floor(F.lit(p) * (F.col("whole") - 1))
    made = [F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), F.col(f"_low{i}")).otherwise(F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * part(p)).alias(f"q{i}") for i, p in enumerate(points)]
    return ends.select(*keys, *made)
