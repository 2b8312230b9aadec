"""Occurrences, reusable units, content groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotmill.functions.text import is_blank


def line_occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 160) -> DataFrame:
    """Each non-blank line as an occurrence: key, ord (from 1), source, before, after, sha256.

    before and after are up to `reach` characters of the neighbouring occurrences of the same document.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("ord", "source")).where(~is_blank(F.col("source")))
    w = Window.partitionBy(key).orderBy("ord")
    return lines.select(
        key, (F.col("ord") + 1).alias("ord"), "source",
        F.coalesce(F.right(F.lag("source").over(w), F.lit(reach)), F.lit("")).alias("before"),
        F.coalesce(F.left(F.lead("source").over(w), F.lit(reach)), F.lit("")).alias("after"),
        F.sha2("source", 256).alias("sha256"),
    )


def translation_units(occurrences: DataFrame, keys: list[str], order: Column, unit_prefix: str = "tu-") -> DataFrame:
    """Occurrences that agree in `keys` as one unit: unit_id, keys, occurrence_count, first_seen (smallest order)."""
    made = occurrences.groupBy(*keys).agg(F.count("*").alias("occurrence_count"), F.min(order).alias("first_seen"))
    name = F.concat_ws("\u001f", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys])
    return made.withColumn("unit_id", F.concat(F.lit(unit_prefix), F.left(F.sha2(name, 256), F.lit(16))))


def reuse_key(source: Column, kind: Column, context: Column, tokens: Column, occurrence: Column) -> Column:
    """Key under which grid occurrences share a unit; an unknown context never merges."""
    base = F.to_json(F.array(source, kind, context, F.to_json(tokens)))
    known = F.coalesce((context != "") & (context != "unknown"), F.lit(False))
    return F.when(known, base).otherwise(F.concat(base, F.lit("\u0000"), occurrence))


def content_groups(rows: DataFrame, content: str, key: str, place: str) -> DataFrame:
    """Rows with equal bytes: sha256, locations (count), first and last key, places (distinct count)."""
    return rows.groupBy(F.sha2(content, 256).alias("sha256")).agg(
        F.count("*").alias("locations"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count_distinct(place).alias("places")
    )


def distinct_first(rows: DataFrame, message: str, order: Column) -> DataFrame:
    """Each message once, with where it came first and how often."""
    return rows.groupBy(message).agg(F.min(order).alias("first_seen"), F.count("*").alias("times"))


def interleave(rows: DataFrame, group: list[str], order: str, left: str, right: str) -> DataFrame:
    """Pair rows as two: the left text at 2n - 1 and the right one at 2n of each group."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    sides = F.array(F.struct((n * 2 - 1).alias("row"), F.col(left).alias("value")), F.struct((n * 2).alias("row"), F.col(right).alias("value")))
    return rows.withColumn("_sides", sides).select(*group, F.inline("_sides"))


def text_above(cells: DataFrame, sheet: str, col: str, row: str, text: str) -> DataFrame:
    """Non-blank cells with the last non-blank text above them in their column."""
    w = Window.partitionBy(sheet, col).orderBy(row)
    return cells.where(~is_blank(F.col(text))).withColumn("above", F.lag(text).over(w))
