"""Splits and folds from hashes of ids: the same rows fall the same way in any run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .ordered import join_groups

GRAIN = 1_000_000


def digest(keys: Sequence[str], seed: int) -> Column:
    """MD5 of keys and seed as text, which any other system computes alike."""
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))


def bucket(keys: Sequence[str], seed: int, n: int = GRAIN) -> Column:
    return F.conv(F.substring(digest(keys, seed), 1, 8), 16, 10).cast("long") % n


def split(df: DataFrame, keys: Sequence[str], test: float, seed: int = 42, out: str = "is_test") -> DataFrame:
    """About ``test`` of the ids to the test side."""
    return df.withColumn(out, bucket(keys, seed) < int(test * GRAIN))


def split_groups(df: DataFrame, keys: Sequence[str], test: float, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Whole groups to one side: the group's keys are hashed."""
    return split(df, keys, test, seed, out)


def split_stratified(df: DataFrame, key: str, by: str, test: float, seed: int = 42, out: str = "is_test") -> DataFrame:
    """``test`` of each stratum, exact to a row: ranks of the ids' hashes inside it.

    A stratum is ranked in 256 pieces by the hash's first digits, shifted by the pieces before.
    """
    pieces = df.withColumn("_hash", digest([key], seed)).withColumn("_piece", F.substring("_hash", 1, 2))
    sizes = pieces.groupBy(by, "_piece").agg(F.count(F.lit(1)).alias("_size"))
    own = Window.partitionBy(by)
    before = own.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(by, "_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.sum("_size").over(own).alias("_rows"))
    place = F.row_number().over(Window.partitionBy(by, "_piece").orderBy("_hash", key)) - 1
    ranked = join_groups(pieces.withColumn("_place", place), sizes, [by, "_piece"])
    share = F.coalesce(F.try_divide(F.col("_place") + F.col("_start"), F.col("_rows") - 1), F.lit(0.0))
    return ranked.withColumn(out, share < test).select(*df.columns, out)


def kfold(df: DataFrame, keys: Sequence[str], k: int, seed: int = 42, out: str = "fold") -> DataFrame:
    return df.withColumn(out, bucket(keys, seed, k).cast("int"))


def shuffle(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    return df.orderBy(digest(keys, seed), *keys)


def random_labels(df: DataFrame, keys: Sequence[str], k: int, seed: int = 42, out: str = "label") -> DataFrame:
    return kfold(df, keys, k, seed, out)
