"""Files in and out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.parts import PART, text_parts


def read_csv(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",", corrupt: str | None = None) -> DataFrame:
    """CSV with a header and a declared schema. What does not fit becomes null; its line is
    kept in the column named by ``corrupt``, which the schema must have."""
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def feature_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, position, feature) rows of a JSON file {"feature_sets": {name: [features]}}."""
    schema = "feature_sets map<string, array<string>>, targets array<string>"
    meta = spark.read.schema(schema).option("multiLine", True).json(path)
    named = meta.select(F.explode("feature_sets").alias("set_name", "features"))
    return named.select("set_name", F.posexplode("features").alias("position", "feature"))


def feature_columns(meta: DataFrame, set_name: str, drop: Sequence[str] = ()) -> list[str]:
    """The names of one set in order; column names, so their number is that of a schema."""
    rows = meta.where((F.col("set_name") == set_name) & ~F.col("feature").isin(*drop, "")).orderBy("position")
    return [r["feature"] for r in rows.collect()]


def materialise(make: Callable[[], DataFrame], spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, made and written first where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_texts(spark: SparkSession, path: str, kind: str = "text", part: int = PART) -> DataFrame:
    """(path, part, content): each file as text; rows of csv and json files as lines of JSON.

    Those come in parts of about ``part`` characters, so that a file of any length is read by
    many tasks; the parts of a file follow each other with a line feed between them.
    """
    if kind == "text":
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.lit(0).cast("long").alias("part"), F.col("value").alias("content"))
    rows = spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.json(path)
    where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]
    lines = rows.select(*where, F.to_json(F.struct(*rows.columns)).alias("line"))
    made = text_parts(lines, ["path"], ["block", "row"], F.char_length("line") + 1, F.col("line"), "\n", part)
    return made.select("path", "part", F.col("text").alias("content"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

