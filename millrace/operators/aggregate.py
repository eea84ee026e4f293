"""Summaries: profiles, shares, totals, metrics, histograms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .columns import as_column, ratio
from .ordered import join_groups, numbered, quantiles, ranges

FUNCTIONS = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "nunique": F.countDistinct, "std": F.stddev_samp}


def multi_agg(df: DataFrame, keys: Sequence[str], columns: Sequence[str], functions: Sequence[str]) -> DataFrame:
    """Every function of every column by group as column_function; rows with a null key are left out."""
    made = [FUNCTIONS[f](c).alias(f"{c}_{f}") for c in columns for f in functions]
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*made)


def distinct_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, n_distinct, n): distinct and all non-null values of each column.

    Distinct (group, column, value) rows are made first, partly where the rows are read, and then
    counted: rows are not copied once an aggregate and a hot group or value is spread.
    """
    kinds = {df.schema[c].dataType.simpleString() for c in columns}
    value = lambda c: F.col(c) if len(kinds) == 1 else F.col(c).cast("string")
    cells = df.select(*by, F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), value(c).alias("_v")) for c in columns))))
    once = cells.where("_v is not null").groupBy(*by, "column_name", "_v").agg(F.count(F.lit(1)).alias("_n"))
    found = once.groupBy(*by, "column_name").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("_n").alias("n"))
    # A column without values has 0 of both.
    groups = (df.select(*by).distinct() if by else df.sparkSession.range(1).select()).withColumn("column_name", F.explode(F.array(*map(F.lit, columns))))
    filled = join_groups(groups, found, [*by, "column_name"])
    return filled.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_distinct", "n")})


def approx_distinct(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), error: float = 0.02) -> DataFrame:
    """(by, column_name, n_distinct) from HyperLogLog sketches with a relative standard error of
    ``error``: one pass, a sketch a group and column."""
    row = df.groupBy(*by).agg(*(F.approx_count_distinct(c, error).alias(f"n_distinct_{c}") for c in columns))
    down = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"n_distinct_{c}").alias("n_distinct")) for c in columns))
    return row.select(*by, F.inline(down))


def profile_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Distinct and non-null counts of the columns by group; rows with a null key are left out."""
    cells = distinct_counts(df.dropna(subset=list(keys)), columns, keys)
    made = [F.max(F.when(F.col("column_name") == c, F.col(v))).alias(f"{c}_{n}") for v, n in (("n_distinct", "nunique"), ("n", "count")) for c in columns]
    return cells.groupBy(*keys).agg(*made)


def sum_if(c: Column | str, condition: Column) -> Column:
    """Sum where the condition holds; 0 for a group without such rows."""
    return F.coalesce(F.sum(F.when(condition, as_column(c))), F.lit(0))


def mean_if(condition: Column) -> Column:
    """Share of rows where the condition holds; null counts as not."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def span_hours(c: Column | str) -> Column:
    """Hours from the group's first to its last time."""
    return F.timestamp_diff("SECOND", F.min(as_column(c)), F.max(as_column(c))) / 3600.0


def _columns_down(row: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row for each column of a one-row frame that has name_column columns."""
    items = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{n}_{c}").alias(n) for n in names)) for c in columns))
    return row.select(F.inline(items))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls and rows of each column in one pass; an empty table has 0 of both."""
    columns = columns or df.columns
    row = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns), *(F.count(F.lit(1)).alias(f"n_rows_{c}") for c in columns))
    return _columns_down(row, columns, ["nulls", "n_rows"])


def sentinel_profile(df: DataFrame, columns: Sequence[str], sentinels: Sequence[str]) -> DataFrame:
    """Cells that equal one of the sentinel values, as text, and their percentage."""
    row = df.agg(
        *(F.count_if(F.col(c).cast("string").isin(*sentinels)).alias(f"n_sentinel_{c}") for c in columns),
        *(F.round(ratio(F.count_if(F.col(c).cast("string").isin(*sentinels)) * 100, F.count(F.lit(1))), 2).alias(f"pct_{c}") for c in columns),
    )
    return _columns_down(row, columns, ["n_sentinel", "pct"])


def distinct_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return distinct_counts(df, columns).select("column_name", "n_distinct")


def missing_report(df: DataFrame, c: str, keep: Column) -> DataFrame:
    """Missing values and their rate before and after a filter."""
    kept, lost = F.coalesce(keep, F.lit(False)), F.col(c).isNull()
    row = df.agg(F.count(F.lit(1)).alias("a"), F.count_if(lost).alias("b"), F.count_if(kept).alias("c"), F.count_if(kept & lost).alias("d"))
    items = F.array(
        F.struct(F.lit("before").alias("step"), F.col("a").alias("n_rows"), F.col("b").alias("n_missing"), F.round(ratio(F.col("b") * 100, "a"), 2).alias("pct_missing")),
        F.struct(F.lit("after").alias("step"), F.col("c").alias("n_rows"), F.col("d").alias("n_missing"), F.round(ratio(F.col("d") * 100, "c"), 2).alias("pct_missing")),
    )
    return row.select(F.inline(items))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), c)


def value_share(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Counts of values inside each group and their percentage of the group."""
    counts = df.dropna(subset=[*keys, c]).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", ratio(F.col("n") * 100, F.sum("n").over(Window.partitionBy(*keys))))


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, by group if asked for."""
    made = []
    for c in columns:
        items = {"n": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c)}
        made += [(v if k == "n" else v.cast("double")).alias(f"{k}_{c}") for k, v in items.items()]
    row = df.groupBy(*by).agg(*made)
    down = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{k}_{c}").alias(k) for k in ("n", "mean", "std", "min", "max"))) for c in columns))
    # A column without values has no quantiles.
    points = quantiles(df, columns, (0.25, 0.5, 0.75), by)
    joined = join_groups(row.select(*by, F.inline(down)), points, [*by, "column_name"])
    return joined.select(*by, "column_name", "n", "mean", "std", "min", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max")


def with_total(df: DataFrame, key: str, c: str, label: str = "Total") -> DataFrame:
    """Count of ``c`` by key and a grand total row, with the percentage of the total."""
    rows = df.where(F.col(key).isNotNull()).rollup(key).agg(F.count(c).alias("n"), F.grouping_id().alias("level"))
    total = F.max(F.when(F.col("level") == 1, F.col("n"))).over(Window.partitionBy(F.lit(1)))
    return rows.select(F.when(F.col("level") == 1, label).otherwise(F.col(key).cast("string")).alias(key), "n", F.round(ratio(F.col("n") * 100, total), 2).alias("pct"))


def grouping_levels(df: DataFrame, sets: Sequence[Sequence[str]], measures: Sequence[Column], level: str | None = "level") -> DataFrame:
    """One summary at several key sets in one pass; keys outside a set are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    grouped = df.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys))
    names = F.array_join(F.array_compact(F.array(*(F.when(F.grouping(k) == 0, F.lit(k)) for k in keys))), "+")
    return grouped.agg(*measures, *([names.alias(level)] if level else []))


#: Columns up to which correlations are plain aggregates of one row; columns of a block beyond.
PLAIN, GRAM_BLOCK = 16, 256
#: Rows whose means values are shifted by.
SHIFT_ROWS = 1000


def _gram_parts(left: Sequence[int], right: Sequence[int], shift: np.ndarray):
    """Sums of products of a partition's rows, blocks of columns as rows of bytes.

    For columns a, b over the rows in which both have a value: their number, the sums of a, b,
    a squared, b squared and a b.
    """

    def run(batches):
        held = None
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(batch.num_columns)])
            for at in range(0, len(x), 8192):
                own = x[at : at + 8192] - shift
                has = np.isfinite(own)
                own, has = np.where(has, own, 0.0), has.astype(float)
                a, m, b, o = own[:, left], has[:, left], own[:, right], has[:, right]
                made = np.stack([m.T @ o, a.T @ o, m.T @ b, (a * a).T @ o, m.T @ (b * b), a.T @ b])
                held = made if held is None else held + made
        if held is not None:
            for i in range(0, len(left), GRAM_BLOCK):
                for j in range(0, len(right), GRAM_BLOCK):
                    part = np.ascontiguousarray(held[:, i : i + GRAM_BLOCK, j : j + GRAM_BLOCK])
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["i", "j", "sums"])

    return run


def _gram_corr(columns: Sequence[str], others: Sequence[str], upper: bool):
    """Adds up the blocks of a partition, which lie together, and makes correlations of them."""

    def rows(i, j, held):
        shape = (6, min(GRAM_BLOCK, len(columns) - i), min(GRAM_BLOCK, len(others) - j))
        n, sa, sb, qa, qb, ab = held.reshape(shape)
        with np.errstate(all="ignore"):
            va, vb = qa - sa * sa / n, qb - sb * sb / n
            corr = (ab - sa * sb / n) / np.sqrt(va * vb)
        # What is left of a constant column is rounding.
        good = (n > 1) & (va > 1e-12 * qa) & (vb > 1e-12 * qb) & np.isfinite(corr)
        p, q = np.nonzero(np.add.outer(np.arange(shape[1]) + i, -(np.arange(shape[2]) + j)) < 0) if upper else np.nonzero(np.ones(shape[1:]))
        value = [float(np.clip(corr[x, y], -1, 1)) if good[x, y] else None for x, y in zip(p, q)]
        return pa.RecordBatch.from_arrays([pa.array([columns[i + x] for x in p]), pa.array([others[j + y] for y in q]), pa.array(value, pa.float64())], names=["a", "b", "corr"])

    def run(batches):
        at, held = None, None
        for batch in batches:
            for i, j, sums in zip(*(batch.column(c).to_pylist() for c in range(3))):
                own = np.frombuffer(sums)
                if at == (i, j):
                    held = held + own
                    continue
                if at is not None:
                    yield rows(*at, held)
                at, held = (i, j), own
        if at is not None:
            yield rows(*at, held)

    return run


def gram_corr(df: DataFrame, columns: Sequence[str], others: Sequence[str] | None = None) -> DataFrame:
    """(a, b, corr) of every pair, each once, or of ``columns`` with ``others``; for thousands of columns.

    Each partition of rows is multiplied with itself in Arrow batches and gives one set of blocks of
    GRAM_BLOCK columns a side, which are dealt by block and added up one after the other. A plan
    has two stages however many columns there are; a task holds one set of sums, 48 bytes a
    pair. Values are shifted by the means of SHIFT_ROWS rows, any rows, which keeps digits and
    changes no result. Rows in which one of the two is null, NaN or infinite are left out for
    that pair; a pair that does not vary has null.
    """
    own, upper = list(columns), others is None
    other = own if upper else list(others)
    used = list(dict.fromkeys([*own, *other]))
    kinds = dict(df.dtypes)
    x = df.select(*(f"`{c}`" if kinds[c] == "double" else F.col(f"`{c}`").cast("double").alias(c) for c in used))
    first = x.limit(SHIFT_ROWS).toArrow()
    sample = np.column_stack([c.to_numpy().astype(float) for c in first.columns]) if first.num_rows else np.zeros((0, len(used)))
    has = np.isfinite(sample)
    shift = np.where(has, sample, 0.0).sum(0) / np.maximum(has.sum(0), 1)
    at = {c: i for i, c in enumerate(used)}
    parts = x.mapInArrow(_gram_parts([at[c] for c in own], [at[c] for c in other], shift), "i int, j int, sums binary")
    parts = parts.where("i <= j") if upper else parts
    return parts.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_gram_corr(own, other, upper), "a string, b string, corr double")


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, each pair once; many columns by gram_corr()."""
    if len(columns) > PLAIN:
        return gram_corr(df, columns)
    pairs = list(combinations(columns, 2))
    row = df.agg(*(F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("corr")) for i, (a, b) in enumerate(pairs)))))


def corr_with(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Correlation of each column with the target, strongest first."""
    if len(columns) > PLAIN * PLAIN:
        down = gram_corr(df, columns, [target]).select(F.col("a").alias("feature"), "corr")
    else:
        row = df.agg(*(F.corr(c, target).alias(c) for c in columns))
        down = row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in columns))))
    return down.orderBy(F.desc(F.abs("corr")), "feature")


def top_features(df: DataFrame, target: str, columns: Sequence[str], n: int) -> DataFrame:
    return corr_with(df, target, columns).limit(n)


def histogram(df: DataFrame, c: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins between the column's least and greatest value.

    The last bin is closed; bins without rows have 0. Equal values all fall in bin 0.
    """
    ends = df.agg(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(c).cast("double") - F.col("low"), width)))).cast("int")
    placed = df.where(F.col(c).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", at)
    counts = placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    frame = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.col("low"), width.alias("width"))
    if by:
        frame = df.select(*by).dropna().distinct().crossJoin(F.broadcast(frame))
    full = frame.join(counts, [*by, "bin"], "left")
    return full.select(*by, "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df: DataFrame, c: str, by: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at ``reach`` interquartile ranges and the number of outliers by group."""
    points = quantiles(df, [c], (0.25, 0.5, 0.75), by)
    boxes = points.select(*by, *(F.col(f"q{i}").alias(n) for i, n in enumerate(("q1", "median", "q3"))))
    spread = (F.col("q3") - F.col("q1")) * reach
    inside = F.col(c).between(F.col("q1") - spread, F.col("q3") + spread)
    joined = join_groups(df.where(F.col(c).isNotNull()), boxes, by, "inner")
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(c))).alias("whisker_low"), F.max(F.when(inside, F.col(c))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers")
    )


def regression_metrics(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """R2, RMSE, MAE and MSE; R2 is null where the truth does not vary. Null pairs are left out."""
    y, e = F.col(truth).cast("double"), F.col(truth).cast("double") - F.col(predicted).cast("double")
    pairs = df.dropna(subset=[truth, predicted])
    made = pairs.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("v"), F.count(F.lit(1)).alias("n"))
    return made.select(*by, "mae", "mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide("mse", "v")).alias("r2"), "n")


def model_table(results: Mapping[str, DataFrame]) -> DataFrame:
    """Metric rows of several models under each other, named."""
    from functools import reduce

    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("model"), "*") for name, df in results.items()))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of each (truth, prediction), pairs of known labels that do not occur as 0."""
    pairs = df.dropna(subset=[truth, predicted])
    labels = pairs.select(F.explode(F.array(truth, predicted)).alias("label")).distinct()
    grid = labels.select(F.col("label").alias(truth)).crossJoin(labels.select(F.col("label").alias(predicted)))
    counts = pairs.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, [truth, predicted], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def binary_metrics(df: DataFrame, truth: str, predicted: str, positive: object) -> DataFrame:
    """accuracy, precision, recall and F1 for the positive label; 0 where a denominator is 0."""
    y, p = F.col(truth) == F.lit(positive), F.col(predicted) == F.lit(positive)
    row = df.dropna(subset=[truth, predicted]).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(ratio("tp", F.col("tp") + F.col("fp"))), zero(ratio("tp", F.col("tp") + F.col("fn")))
    row = row.withColumns({"precision": precision, "recall": recall})
    return row.withColumn("f1", zero(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def roc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """A point for each distinct score from the highest: rates of positives and negatives at or above.

    Running sums go over the distinct scores, in ranges of the score.
    """
    steps = df.dropna(subset=[truth, score]).groupBy(score).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum(1 - F.col(truth).cast("long")).alias("q"))
    placed = numbered(steps, [F.desc(score)], ["p", "q"])
    whole = placed.agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    return placed.crossJoin(F.broadcast(whole)).select(score, ratio("_upto_p", "_p").alias("tpr"), ratio("_upto_q", "_q").alias("fpr"))


def auc(points: DataFrame) -> DataFrame:
    """Area under roc() points by trapezoids from (0, 0)."""
    placed = ranges(points.select("fpr", "tpr"), ["fpr", "tpr"])
    # one row a range: the last point, which the next range starts from
    ends = placed.groupBy("_part").agg(F.max(F.struct("fpr", "tpr")).alias("end"))
    ends = ends.select("_part", F.lag("end").over(Window.partitionBy(F.lit(1)).orderBy("_part")).alias("end"))
    own = Window.partitionBy("_part").orderBy("fpr", "tpr")
    before = lambda c: F.coalesce(F.lag(c).over(own), F.col(f"end.{c}"), F.lit(0.0))
    area = placed.join(F.broadcast(ends), "_part").select(((F.col("fpr") - before("fpr")) * (F.col("tpr") + before("tpr")) / 2).alias("a"))
    return area.agg(F.sum("a").alias("auc"))


def range_of(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(column_name, low, high, inside): each column's ends, and whether all values lie within its limits."""
    row = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in limits for n, f in (("low", F.min), ("high", F.max))))
    inside = {f"inside_{c}": F.coalesce((F.col(f"low_{c}") >= low) & (F.col(f"high_{c}") <= high), F.lit(True)) for c, (low, high) in limits.items()}
    return _columns_down(row.withColumns(inside), list(limits), ["low", "high", "inside"])


def mean_loss(df: DataFrame, truth: str, predicted: str, loss: Callable[[Column], Column], by: Sequence[str] = ()) -> DataFrame:
    """The mean by group of a loss that the caller gives as a function of the error's column."""
    error = F.col(truth).cast("double") - F.col(predicted).cast("double")
    return df.dropna(subset=[truth, predicted]).groupBy(*by).agg(F.avg(loss(error)).alias("loss"), F.count(F.lit(1)).alias("n"))


def non_converters(df: DataFrame, user: str, converted: str) -> DataFrame:
    """Distinct users less the sum of the flag."""
    return df.agg((F.countDistinct(user) - F.coalesce(F.sum(F.col(converted).cast("long")), F.lit(0))).alias("n"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by both keys and the first key's total, by which it is ordered."""
    counts = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(a))).orderBy(F.desc("total"), a, b)


def noise_contrast(df: DataFrame, cluster: str, columns: Sequence[str], noise: object = -1) -> DataFrame:
    """Mean of each column in each cluster and in the noise, and their difference."""
    noisy = df.where(F.col(cluster) == F.lit(noise)).agg(*(F.avg(c).alias(f"noise_{c}") for c in columns))
    means = df.where(F.col(cluster) != F.lit(noise)).groupBy(cluster).agg(*(F.avg(c).alias(f"mean_{c}") for c in columns))
    items = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("cluster_mean"), F.col(f"noise_{c}").alias("noise_mean"), (F.col(f"mean_{c}") - F.col(f"noise_{c}")).alias("difference")) for c in columns))
    return means.crossJoin(F.broadcast(noisy)).select(cluster, F.inline(items))


def names_by(df: DataFrame, key: str, c: str) -> DataFrame:
    """The distinct values of each group in order, joined by commas."""
    return df.dropna(subset=[key]).groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(c)), ",").alias("names"))


def leaderboard(results: Mapping[str, DataFrame], score: str, k: str, fixed: int, ties: Sequence[str]) -> DataFrame:
    """Each method's best row overall and with ``fixed`` clusters, stacked.

    gain is a hundred times its score less the best other method's in the same scope; the
    verdict says whether it outperforms. Only positive scores take part.
    """
    from functools import reduce

    rows = []
    for method, df in results.items():
        for scope, part in (("overall", df), (f"k={fixed}", df.where(F.col(k) == fixed))):
            best = part.where(F.col(score) > 0).orderBy(F.desc(score), *ties).limit(1)
            rows.append(best.select(F.lit(method).alias("method"), F.lit(scope).alias("scope"), *ties, k, score))
    stacked = reduce(DataFrame.unionByName, rows)
    others = stacked.select(F.col("method").alias("_m"), F.col("scope").alias("_s"), F.col(score).alias("_other"))
    most = stacked.join(others, (F.col("scope") == F.col("_s")) & (F.col("method") != F.col("_m")), "left").groupBy(*stacked.columns).agg(F.max("_other").alias("_most"))
    made = most.withColumn("gain", (F.col(score) - F.col("_most")) * 100).drop("_most")
    return made.withColumn("verdict", F.when(F.col("gain").isNull(), "alone").when(F.col("gain") > 0, "outperforms").otherwise("does not outperform"))
