"""Operators on uniformly sampled series: rows (key, x, y)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .columns import as_column


def log_bands(c: Column | str, low: float, high: float, reach: float) -> tuple[Column, Column]:
    """(block, its geometric middle): blocks of equal ratio, none wider than ``reach``.

    Blocks are half-open, the last is closed; values outside low..high give nulls.
    """
    count = max(1, math.ceil(math.log(high / low) / math.log(reach) - 1e-12))
    width, value = math.log(high / low) / count, as_column(c).cast("double")
    inside = (value >= low) & (value <= high)
    block = F.when(inside, F.least(F.lit(count - 1), F.greatest(F.lit(0), F.floor(F.ln(F.when(inside, value) / low) / width))).cast("int"))
    return block, F.exp(F.lit(math.log(low)) + (block + 0.5) * width)


def simpson_weights(key: Sequence[str], x: str) -> Column:
    """Weights in units of the step: Simpson's rule for odd counts; even counts end in a 3/8
    rule over four points, two points are a trapezoid, one point has weight 1."""
    own = Window.partitionBy(*key)
    i, n = F.row_number().over(own.orderBy(x)) - 1, F.count(F.lit(1)).over(own)
    inner = lambda last: F.when((i == 0) | (i == last), 1 / 3).when(i % 2 == 1, 4 / 3).otherwise(2 / 3)
    tail = F.when((i == n - 4) | (i == n - 1), 3 / 8).when(i > n - 4, 9 / 8).otherwise(0.0)
    even = F.when(i < n - 4, inner(n - 4)).when((i == n - 4) & (n > 4), 1 / 3 + 3 / 8).otherwise(tail)
    return F.when(n == 1, 1.0).when(n == 2, 0.5).when(n % 2 == 1, inner(n - 1)).otherwise(even)


def integrate_simpson(df: DataFrame, key: Sequence[str], x: str, y: str) -> DataFrame:
    weighed = df.withColumn("_w", simpson_weights(key, x))
    step = F.coalesce(F.try_divide(F.max(x) - F.min(x), F.count(F.lit(1)) - 1).cast("double"), F.lit(1.0))
    return weighed.groupBy(*key).agg((F.sum(F.col("_w") * F.col(y)) * step).alias("integral"))


def taper(key: Sequence[str], x: str, kind: str, edge: float = 0.1) -> Column:
    """Window factor of each point of its series: hann, hamming, blackman, or flat with cosine edges."""
    own = Window.partitionBy(*key)
    i, n = F.row_number().over(own.orderBy(x)) - 1, F.count(F.lit(1)).over(own)
    t = F.try_divide(i.cast("double"), (n - 1).cast("double"))
    turn = lambda k: F.cos(t * (2 * math.pi * k))
    shapes = {
        "hann": 0.5 - 0.5 * turn(1),
        "hamming": 0.54 - 0.46 * turn(1),
        "blackman": 0.42 - 0.5 * turn(1) + 0.08 * turn(2),
        "flat": F.when(t < edge, 0.5 - 0.5 * F.cos(t / edge * math.pi)).when(t > 1 - edge, 0.5 - 0.5 * F.cos((1 - t) / edge * math.pi)).otherwise(1.0),
    }
    return F.coalesce(shapes[kind], F.lit(1.0))


def regrid(df: DataFrame, key: str, position: str, y: str, fill: float = 0.0) -> DataFrame:
    """Each series on the full grid 0, 1, ... to its last position, gaps filled."""
    grid = df.groupBy(key).agg(F.max(position).alias("_last")).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long"))).alias(position))
    return grid.join(df.select(key, position, y), [key, position], "left").withColumn(y, F.coalesce(y, F.lit(fill)))


def off_grid(df: DataFrame, x: str, step: float) -> DataFrame:
    """The greatest distance of a point from the grid of multiples of ``step``."""
    return df.agg(F.max(F.abs(F.col(x) - F.round(F.col(x) / step) * step)).alias("deviation"))


def relative_to_ref(df: DataFrame, key: str, c: str, order: str, out: str) -> DataFrame:
    """Divided by the value at the group's reference point, its first in ``order``; null where that is 0."""
    references = df.groupBy(key).agg(F.min_by(c, order).alias("_ref"))
    return df.join(references, key).withColumn(out, F.try_divide(F.col(c).cast("double"), F.col("_ref").cast("double"))).drop("_ref")


def ar1_forecast(df: DataFrame, key: str, t: str, y: str, steps: int) -> DataFrame:
    """(key, step, forecast): differences follow dy = a + b * (dy before), fitted by group."""
    own = Window.partitionBy(key).orderBy(t)
    moved = df.withColumn("_dy", F.col(y) - F.lag(y).over(own)).withColumn("_before", F.lag("_dy").over(own))
    fits = moved.groupBy(key).agg(
        F.coalesce(F.regr_slope("_dy", "_before"), F.lit(0.0)).alias("b"),
        F.coalesce(F.regr_intercept("_dy", "_before"), F.avg("_dy"), F.lit(0.0)).alias("a"),
        F.max_by(y, t).cast("double").alias("last"),
        F.coalesce(F.max_by("_dy", t), F.lit(0)).cast("double").alias("dy"),
    )
    start = F.struct(F.lit(0).alias("step"), F.col("dy").alias("dy"), F.col("last").alias("y"))
    following = lambda s, i: F.struct(i.alias("step"), (F.col("a") + F.col("b") * s["dy"]).alias("dy"), (s["y"] + F.col("a") + F.col("b") * s["dy"]).alias("y"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(start), lambda acc, i: F.concat(acc, F.array(following(F.element_at(acc, -1), i))))
    return fits.select(key, F.inline(F.slice(path, 2, steps))).select(key, "step", F.col("y").alias("forecast"))


def _two_slopes(y: str, p: str, q: str) -> list[Column]:
    """Intercept and slopes of ``y`` on ``p`` and ``q`` from one aggregate, by normal equations.

    Where the two do not vary apart from each other, the first alone is used, then none.
    """
    has = F.col(y).isNotNull() & F.col(p).isNotNull() & F.col(q).isNotNull()
    c = {n: F.when(has, F.col(n)) for n in (y, p, q)}
    pp, qq, pq = F.var_pop(c[p]), F.var_pop(c[q]), F.covar_pop(c[p], c[q])
    py, qy = F.covar_pop(c[p], c[y]), F.covar_pop(c[q], c[y])
    whole = pp * qq - pq * pq
    apart = F.coalesce(whole > 1e-12 * pp * qq, F.lit(False))
    slope_p = F.coalesce(F.when(apart, F.try_divide(py * qq - qy * pq, whole)).otherwise(F.try_divide(py, pp)), F.lit(0.0))
    slope_q = F.coalesce(F.when(apart, F.try_divide(qy * pp - py * pq, whole)), F.lit(0.0))
    level = F.coalesce(F.avg(c[y]) - slope_p * F.avg(c[p]) - slope_q * F.avg(c[q]), F.lit(0.0))
    return [level.alias("c0"), slope_p.alias("c1"), slope_q.alias("c2")]


def arima_fit(df: DataFrame, key: str, t: str, y: str) -> DataFrame:
    """(key, level, ar, ma, last, dy, shock): an ARIMA(1, 1, 1) of each series in two regressions.

    First a long autoregression of differences, dy on the two before it, whose residuals stand
    for the shocks; then dy on the difference and the shock before it (Hannan and Rissanen).
    A series too short for either regression has a slope of 0. ``last``, ``dy`` and ``shock`` are
    where a forecast starts from. A series is ordered in one task: it is one row a time.
    """
    own = Window.partitionBy(key).orderBy(t)
    moved = df.select(key, t, F.col(y).cast("double").alias("_y")).withColumn("_d", F.col("_y") - F.lag("_y").over(own))
    moved = moved.withColumns({"_d1": F.lag("_d").over(own), "_d2": F.lag("_d", 2).over(own)})
    long_ar = moved.groupBy(F.col(key).alias("_k")).agg(*_two_slopes("_d", "_d1", "_d2"))
    shocks = moved.join(long_ar, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_e", F.col("_d") - F.col("c0") - F.col("c1") * F.col("_d1") - F.col("c2") * F.col("_d2")).drop("_k", "c0", "c1", "c2")
    shocks = shocks.withColumn("_e1", F.lag("_e").over(own))
    zero = lambda c: F.coalesce(F.max_by(c, t), F.lit(0.0))
    level, ar, ma = _two_slopes("_d", "_d1", "_e1")
    return shocks.groupBy(key).agg(level.alias("level"), ar.alias("ar"), ma.alias("ma"), F.max_by("_y", t).alias("last"), zero("_d").alias("dy"), zero("_e").alias("shock"))


def arima_forecast(fits: DataFrame, key: str, steps: int) -> DataFrame:
    """(key, step, forecast) from arima_fit(): the last shock counts in the first step only."""
    first = F.col("level") + F.col("ar") * F.col("dy") + F.col("ma") * F.col("shock")
    start = F.array(F.struct(F.lit(1).alias("step"), first.alias("dy"), (F.col("last") + first).alias("y")))
    following = lambda s, i: F.struct(i.alias("step"), (F.col("level") + F.col("ar") * s["dy"]).alias("dy"), (s["y"] + F.col("level") + F.col("ar") * s["dy"]).alias("y"))
    path = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(steps)), 2, max(1, steps - 1)), start, lambda acc, i: F.concat(acc, F.array(following(F.element_at(acc, -1), i))))
    return fits.select(key, F.inline(path)).select(key, "step", F.col("y").alias("forecast"))
