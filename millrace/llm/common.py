"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names it; where that is unset (tests on one
    machine) a temporary folder is set as the context's checkpoint directory.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set on this cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there,
    so a lost executor costs no recomputation and row order within it no longer matters."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_released(spark: SparkSession):
    """Shuffle files of a query go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bucketed(spark: SparkSession, frames: Iterable[DataFrame], column: str, label: str) -> DataFrame:
    """Like ``materialise``, the frames one after the other in a table with a bucket for each
    shuffle partition, so that later grouping by ``column`` moves nothing. Rows lie by ``column``."""
    n, name = partitions(spark), f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/millrace/{name}"
    with shuffles_released(spark):
        for df in frames:
            dealt = df.repartition(n, column)
            dealt.write.bucketBy(n, column).sortBy(column).mode("append").option("path", path).option("compression", "zstd").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, as their folder is named
    return found


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int) -> DataFrame:
    """``out``: 0, 1, 2, ... within each ``group``, however large a group is.

    Rows of a group are dealt to ``buckets`` by a hash of ``order``, numbered inside
    (group, bucket), and shifted by the sizes of the group's earlier buckets. Those sizes are
    one row for each (group, bucket); the rows themselves are shuffled once.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_inside", F.row_number().over(inside) - 1)
    sizes = dealt.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    starts = starts.select(*(F.col(c).alias(f"_r{c}") for c in [*group, "_bucket"]), "_start")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in [*group, "_bucket"]))
    return (
        numbered.join(starts, same)
        .withColumn(out, (F.col("_inside") + F.col("_start")).cast("long"))
        .drop("_bucket", "_inside", "_start", *(f"_r{c}" for c in [*group, "_bucket"]))
    )


def along(df: DataFrame, group: list[str], order: list[str], label: str, running: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``place`` (0, 1, ... inside the group) and running totals along ``order``, however large a group is.

    ``running`` maps a new column to (column, "sum" or "xor"). Rows are dealt to ranges of
    (group, order) and written; each range counts for itself and a group that goes on from
    earlier ranges is shifted by what they hold of it. Rows of equal order stay in one range, so
    ``order`` should end in a row number where many rows may be equal.
    """
    running = running or {}
    total = {"sum": F.sum, "xor": F.bit_xor}
    joined = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
    placed = materialise(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), label)
    inside = Window.partitionBy("_part", *group).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    made = placed.withColumns({"place": F.row_number().over(inside).cast("long") - 1, **{n: total[f](c).over(upto) for n, (c, f) in running.items()}})
    sums = placed.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_t_place"), *(total[f](c).alias(f"_t_{n}") for n, (c, f) in running.items()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    kinds = {"place": "sum", **{n: f for n, (_, f) in running.items()}}
    starts = sums.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_g_{c}") for c in group), *(total[f](f"_t_{n}").over(before).alias(f"_b_{n}") for n, f in kinds.items()))
    # Ranges follow each other, so that one group at most goes on into a range: one row a range.
    starts = F.broadcast(starts.where("_b_place is not null"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group), F.col("_part") == F.col("_p"))
    shifted = {n: F.when(F.col("_p").isNull(), F.col(n)).otherwise(joined[f](F.col(n), F.col(f"_b_{n}"))) for n, f in kinds.items()}
    return made.join(starts, same, "left").withColumns(shifted).select(*df.columns, *kinds)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
