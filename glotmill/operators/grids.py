"""Grid operators: ranges, gaps, merges, headers, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def cells_in_ranges(cells: DataFrame, ranges: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Cells (sheet, col, row) that lie in any range (sheet, c0, r0, c1, r1).

    A range is spread over the blocks of rows that it touches and meets cells by (sheet, block); the exact
    bounds are checked after that, so it is an equality join with a residual, not a nested loop.
    """
    blocks = F.sequence(F.floor(F.col("r0") / BLOCK), F.floor(F.col("r1") / BLOCK))
    spread = ranges.where("r0 <= r1 AND c0 <= c1").select(F.col(sheet).alias("_s"), "c0", "r0", "c1", "r1", F.explode(blocks).alias("_b"))
    placed = cells.withColumn("_block", F.floor(F.col("row") / BLOCK))
    inside = (F.col(sheet) == F.col("_s")) & (F.col("_block") == F.col("_b")) & F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    return placed.join(spread, inside, "left_semi").drop("_block")


def blank_runs(rows: DataFrame, sheet: str, row: str, blank: str, least: int = 3) -> DataFrame:
    """Runs of at least `least` consecutive blank rows of a sheet: sheet, first_row, last_row, rows."""
    w = Window.partitionBy(sheet).orderBy(row)
    marked = rows.where(F.col(blank)).withColumn("_run", F.col(row) - F.row_number().over(w))
    runs = marked.groupBy(sheet, "_run").agg(F.min(row).alias("first_row"), F.max(row).alias("last_row"), F.count("*").alias("rows"))
    return runs.where(F.col("rows") >= least).drop("_run")


def merged_rows(merges: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Rows that merges of several rows cover, each once."""
    return merges.where("r0 < r1").select(sheet, F.explode(F.sequence("r0", "r1")).alias("row")).distinct()


def merged_width(cells: DataFrame, merges: DataFrame, widths: DataFrame, sheet: str = "sheet") -> DataFrame:
    """The width of each cell: that of its column, or of all columns of the merge that begins at it."""
    ends = merges.select(F.col(sheet), F.col("c0").alias("col"), F.col("r0").alias("row"), "c1")
    spans = cells.join(ends, [sheet, "col", "row"], "left").withColumn("_c", F.explode(F.sequence("col", F.coalesce("c1", "col"))))
    return spans.join(widths.select(sheet, F.col("col").alias("_c"), "width"), [sheet, "_c"], "left").groupBy(sheet, "col", "row").agg(F.sum(F.coalesce("width", F.lit(8.43))).alias("width"))


def header_rows(cells: DataFrame, table: str) -> DataFrame:
    """The first row of each table with more than one non-empty cell."""
    rows = cells.where(F.coalesce(F.col("text") != "", F.lit(False))).groupBy(table, "row").agg(F.count("*").alias("n"))
    return rows.where("n > 1").groupBy(table).agg(F.min("row").alias("header_row"))


def label_pitch(labels: DataFrame, image: str, reach: float = 60, floor: float = 9) -> DataFrame:
    """For each label (id, x0, y0, x1, y1) the distance to its nearest label above or below that overlaps it sideways.

    Labels meet in bands of `reach` pixels, so a label is compared with those in its own and the next bands only.
    """
    band = F.floor(F.col("y0") / reach)
    a = labels.withColumn("_b", F.explode(F.array(band - 1, band, band + 1)))
    b = labels.select(F.col(image), band.alias("_b"), F.col("id").alias("id2"), F.col("x0").alias("x2"), F.col("x1").alias("x3"), F.col("y0").alias("y2"))
    near = a.join(b, [image, "_b"]).where("id <> id2 AND x0 < x3 AND x2 < x1 AND y0 <> y2").withColumn("d", F.abs(F.col("y0") - F.col("y2"))).where(F.col("d") <= reach)
    best = near.groupBy(image, "id").agg(F.min("d").alias("d"))
    return labels.join(best, [image, "id"], "left").withColumn("pitch", F.greatest(F.coalesce("d", F.lit(float(reach))), F.lit(float(floor)))).drop("d")
