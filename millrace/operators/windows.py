"""Window operators inside groups, and running shares over small summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .ordered import group_numbered, join_groups, numbered


#: Rows of a group up to which one task sorts it.
ONE_TASK = 1 << 20


def group_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "place", one_task: int = ONE_TASK) -> DataFrame:
    """1, 2, ... inside each group along ``order``, which should leave no ties.

    Groups are counted first: where one has over ``one_task`` rows, all rows are dealt to ranges
    of keys and order, so that a hot group is spread over tasks; else a window numbers them.
    """
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > one_task).isEmpty():
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return group_numbered(df, keys, order).withColumn(out, (F.col("_position") + 1).cast("int")).select(*(c for c in df.columns if c != out), out)


def top1(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in ``order``, which should leave no ties.

    The filter on the row number lets Spark keep one row a group where rows are read
    (WindowGroupLimit), so that a hot group brings a row a task to the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep-first by an explicit order in place of file order; null keys are a key like any other."""
    return top1(df, keys, order)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys repeat, and rows beyond each key's first."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count_if(F.col("n") > 1).alias("n_repeated_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_extra_rows"))


def repeated_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The occurrences after each key's first."""
    return group_rank(df, keys, order, "_place").where("_place > 1").drop("_place")


def group_minmax(df: DataFrame, c: str, keys: Sequence[str], out: str) -> DataFrame:
    """Scaled to 0..1 inside the group; null where the group has one value."""
    ends = df.groupBy(*keys).agg(F.min(c).alias("_low"), F.max(c).alias("_high"))
    return join_groups(df, ends, keys).withColumn(out, F.try_divide(F.col(c) - F.col("_low"), F.col("_high") - F.col("_low"))).select(*df.columns, out)


def group_share(df: DataFrame, c: str, keys: Sequence[str], out: str) -> DataFrame:
    sums = df.groupBy(*keys).agg(F.sum(c).alias("_sum"))
    return join_groups(df, sums, keys).withColumn(out, F.try_divide(F.col(c), F.col("_sum"))).select(*df.columns, out)


def impute_group_mean(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Nulls become the group's mean. A null key is no group: its rows keep their nulls.

    Means are made by aggregation and joined back, so that no group has to fit in one task.
    """
    means = df.dropna(subset=list(keys)).groupBy(*keys).agg(*(F.avg(c).alias(f"_mean_{c}") for c in columns))
    filled = df.join(means, list(keys), "left").withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_mean_{c}")) for c in columns})
    return filled.select(*df.columns)


def borderline(df: DataFrame, c: str, keys: Sequence[str], k: float, out: str) -> DataFrame:
    """Above the group's mean by more than ``k`` sample deviations; groups of one: false."""
    limits = df.groupBy(*keys).agg((F.avg(c) + k * F.stddev_samp(c)).alias("_limit"))
    return df.join(limits, list(keys)).withColumn(out, F.coalesce(F.col(c) > F.col("_limit"), F.lit(False))).drop("_limit")


def cum_rank_pct(df: DataFrame, c: str, ties: Sequence[str], out: str) -> DataFrame:
    """Running percentage of the 0-based position after sorting; ``ties`` leave none.

    The positions up to p add up to p (p + 1) / 2, so that only the position has to be known.
    """
    p, n = F.col("position").cast("double"), F.col("_n")
    placed = numbered(df, [c, *ties]).withColumnRenamed("_position", "position")
    whole = df.agg(F.count(F.lit(1)).alias("_n"))
    return placed.crossJoin(F.broadcast(whole)).withColumn(out, F.try_divide(p * (p + 1) * 100.0, n * (n - 1))).drop("_n")


def minmax(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Columns scaled to 0..1 over the whole table by one aggregate; a constant column is null."""
    ends = df.agg(*(F.min(c).alias(f"_low_{c}") for c in columns), *(F.max(c).alias(f"_high_{c}") for c in columns))
    scaled = {f"{c}{suffix}": F.try_divide(F.col(c) - F.col(f"_low_{c}"), F.col(f"_high_{c}") - F.col(f"_low_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(ends)).withColumns(scaled).drop(*(f"_{e}_{c}" for e in ("low", "high") for c in columns))


def combined_score(df: DataFrame, plus: str, minus: str, out: str) -> DataFrame:
    """What is wanted less what is not, each scaled over the table."""
    return minmax(df, [plus, minus]).withColumn(out, F.col(f"{plus}_scaled") - F.col(f"{minus}_scaled"))
