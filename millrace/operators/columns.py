"""Derived columns: rules, lookups, flags, ratios, errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain
from operator import add

from pyspark.sql import Column, DataFrame, functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rules(pairs: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Masked overwrites in order: the last rule that holds wins; a null condition does not hold."""
    found = default if isinstance(default, Column) else F.lit(default)
    for condition, value in pairs:
        found = F.when(condition, value).otherwise(found)
    return found


def map_values(c: Column | str, values: Mapping) -> Column:
    """The value each key stands for; keys not listed give null."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))
    return F.try_element_at(table, as_column(c))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; null counts as not holding."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def flags(df: DataFrame, spec: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Boolean columns, each a comparison of a column with a value; null compares false."""
    return df.withColumns({name: F.coalesce(F.col(c) == F.lit(v), F.lit(False)) for name, (c, v) in spec.items()})


def flag_score(*conditions: Column) -> Column:
    return reduce(add, (flag(c) for c in conditions))


def override(c: Column | str, condition: Column, value: object) -> Column:
    return rules([(condition, value)], as_column(c))


def external_score(*columns: Column | str) -> Column:
    """The sum of counts of what lies around; a missing count counts as 0."""
    return reduce(add, (F.coalesce(as_column(c), F.lit(0)) for c in columns))


def no_access(*columns: Column | str) -> Column:
    """1 where nothing lies around, else 0."""
    return flag(external_score(*columns) == 0)


def guarded_ratio(num: Column | str, den: Column | str) -> Column:
    """num / (den + 1): one is added so that a zero count divides."""
    return as_column(num) / (as_column(den) + 1)


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, null where den is zero or null."""
    return F.try_divide(as_column(num).cast("double"), as_column(den).cast("double"))


def rate(num: Column | str, hours: Column | str) -> Column:
    """Units by hours; units without time count as rate 0, neither units nor time as null."""
    num, hours = as_column(num).cast("double"), as_column(hours).cast("double")
    return F.when(hours != 0, num / F.nullif(hours, F.lit(0.0))).when(num != 0, F.lit(0.0))


def weighted_score(weights: Mapping[str, float]) -> Column:
    return reduce(add, (F.col(c) * F.lit(w) for c, w in weights.items()))


def period_parts(c: Column | str, length: int) -> tuple[Column, Column]:
    """1-based position in its period and number of the period of a 1-based counter."""
    zero = as_column(c) - 1
    return F.pmod(zero, F.lit(length)) + 1, F.floor(zero / length) + 1


def error_columns(truth: Column | str, predicted: Column | str, variance: Column | str) -> dict[str, Column]:
    """Absolute, squared and root squared error, and 1 - squared error / variance of the truth."""
    difference = as_column(predicted) - as_column(truth)
    square = F.pow(difference, F.lit(2.0))
    return {"mae": F.abs(difference), "mse": square, "rmse": F.sqrt(square), "r2": 1 - F.try_divide(square, as_column(variance))}


def pct_error(truth: Column | str, predicted: Column | str, signed: int = 1) -> Column:
    """Percentage of the truth; null where it is 0. signed = -1 for truth minus prediction."""
    truth = as_column(truth).cast("double")
    return F.when(truth != 0, (as_column(predicted) - truth) * signed / F.nullif(truth, F.lit(0.0)) * 100)


def whole_days(start: Column | str, end: Column | str) -> Column:
    """Full 24-hour days from start to end, floored: -1 where end is a little earlier."""
    return F.floor(F.timestamp_diff("SECOND", as_column(start), as_column(end)) / 86400)


def fmt_int(c: Column | str) -> Column:
    return F.format_number(as_column(c), 0)


def select_like(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


def cast_all(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Columns cast to the named types; what cannot be cast becomes null."""
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()})


def category_code(df: DataFrame, c: str, out: str, missing: int = -1, levels: DataFrame | None = None) -> DataFrame:
    """Alphabetical codes from 0, null as ``missing``. Only the distinct values are ordered.

    ``levels``, a table with the column ``c`` such as a dimension, says the values there are;
    without it ``df`` is read once more for them.
    """
    from pyspark.sql.window import Window

    codes = (df if levels is None else levels).where(F.col(c).isNotNull()).select(c).distinct()
    codes = codes.withColumn(out, (F.row_number().over(Window.orderBy(c)) - 1).cast("int"))
    return df.join(codes, c, "left").withColumn(out, F.coalesce(out, F.lit(missing)))


def group_number(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """A number from 0 for each combination of keys, in their order; null keys match null."""
    from .ordered import join_groups, numbered as in_order

    numbers = in_order(df.select(*keys).distinct(), keys).select(*keys, F.col("_position").cast("long").alias(out))
    return join_groups(df, numbers, keys, "inner")
