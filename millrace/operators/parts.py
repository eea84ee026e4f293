"""Long texts in order: numbered parts of bounded length, and files that follow each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import group_numbered, join_groups

#: Characters of a part, about: a part ends with the piece that reaches this.
PART = 1 << 20


def text_parts(pieces: DataFrame, keys: Sequence[str], order: Sequence[Column | str], length: Column, piece: Column, sep: str = "", part: int = PART) -> DataFrame:
    """(keys, part, text, n): each key's pieces in ``order``, joined into parts numbered from 0.

    ``piece`` may use ``_position``, the piece's number in its key from 0. A piece belongs to
    the part in which its first character falls, by the running ``length`` of the pieces before
    it, so that a part has about ``part`` characters however long a key's text is; one piece is
    never cut. A key's text is its parts in order, ``sep`` between them. n counts pieces.
    """
    placed = group_numbered(pieces.withColumn("_chars", length.cast("long")), keys, order, ["_chars"])
    start = F.col("_upto__chars") - F.col("_chars")
    rows = placed.select(*keys, F.floor(start / part).cast("long").alias("part"), "_position", piece.alias("_piece"))
    ordered = F.array_sort(F.collect_list(F.struct("_position", "_piece")))
    return rows.groupBy(*keys, "part").agg(F.array_join(F.transform(ordered, lambda x: x["_piece"]), sep).alias("text"), F.count(F.lit(1)).alias("n"))


def write_parts(parts: DataFrame, path: str, order: Sequence[str], text: str = "text") -> None:
    """Text files that follow each other by name as the parts do, a line feed after each part.

    Parts are dealt to ranges of ``order``, one range a file, so that no task holds a text.
    """
    parts.repartitionByRange(*order).sortWithinPartitions(*order).select(text).write.mode("overwrite").text(path)


def render_pages(pages: DataFrame, key: str, url: str, content: str, depth: str, order: Sequence[str], part: int = PART) -> DataFrame:
    """(key, part, text, n): each group's pages under ``--- Page i: url (Depth d) ---`` headers in
    order, in parts by the length of their contents. A null content is empty."""
    body = F.coalesce(F.col(content), F.lit(""))
    block = F.format_string("--- Page %d: %s (Depth %d) ---\n%s\n\n", F.col("_position") + 1, F.col(url), F.col(depth), body)
    return text_parts(pages, [key], order, F.char_length(body), block, part=part)


def render_records(df: DataFrame, key: str, template: str, fields: Sequence[Column], order: Sequence[str], empty: str = "No records", part: int = PART) -> DataFrame:
    """(key, part, text, n): each record by the template, in order, a line each; the first part
    stands under a header with the key's number of records. ``empty`` stands for a key's
    records where none has a text. n counts the key's records."""
    record = F.format_string(template, *fields)
    rows = df.withColumn("_record", record)
    made = text_parts(rows, [key], order, F.char_length("_record") + 1, F.col("_record"), "\n", part)
    counts = made.groupBy(key).agg(F.sum("n").alias("_all"))
    whole = join_groups(made.drop("n"), counts, [key])
    headed = F.when(F.col("part") > 0, F.col("text")).otherwise(F.format_string("RECORDS (%d)\n%s", "_all", F.when(F.col("text") != "", F.col("text")).otherwise(empty)))
    return whole.select(key, "part", headed.alias("text"), F.col("_all").alias("n"))
