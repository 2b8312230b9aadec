"""Greedy batches of pending units under a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_batches(units: DataFrame, job: list[str], order: str, cost: str, budget: int = 24_000) -> DataFrame:
    """units with batch_index (from 1): each job's units in order, cut where the next one would exceed the budget.

    A unit over the budget stands alone. A job is what one worklist holds; its costs (not its texts) are
    folded in one row, so a job should hold at most some 100,000 units.
    """
    if budget < 1:
        raise ValueError("the budget must be positive")

    def step(state: Column, item: Column) -> Column:
        new = (state["size"] > 0) & (state["size"] + item["cost"] > budget)
        batch = F.when(new, state["batch"] + 1).otherwise(state["batch"])
        size = F.when(new, F.lit(0).cast("long")).otherwise(state["size"]) + item["cost"]
        return F.struct(batch.alias("batch"), size.alias("size"), F.concat(state["all"], F.array(F.struct(item["ord"].alias("ord"), batch.alias("batch")))).alias("all"))

    kind = dict(units.dtypes)[order]
    start = F.struct(F.lit(1).alias("batch"), F.lit(0).cast("long").alias("size"), F.array().cast(f"array<struct<ord:{kind},batch:int>>").alias("all"))
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("ord"), F.greatest(F.col(cost).cast("long"), F.lit(1)).alias("cost"))))
    folded = units.groupBy(*job).agg(items.alias("_items")).select(*job, F.inline(F.aggregate("_items", start, step, lambda s: s["all"])))
    return units.join(folded.select(*job, F.col("ord").alias(order), F.col("batch").alias("batch_index")), [*job, order])


def elide_context(units: DataFrame, job: list[str], order: str, batch: str = "batch_index") -> DataFrame:
    """Within a batch, blank `after` that the next unit's source begins with and `before` that the previous one ends with."""
    w = Window.partitionBy(*job, batch).orderBy(order)
    seen_after = F.lead("source").over(w).startswith(F.col("after")) & (F.lead("part").over(w) == F.col("part"))
    seen_before = F.lag("source").over(w).endswith(F.col("before")) & (F.lag("part").over(w) == F.col("part"))
    after, before = (F.when(F.coalesce(c, F.lit(False)), "").otherwise(F.col(n)) for c, n in ((seen_after, "after"), (seen_before, "before")))
    saved = F.length("after") - F.length(after) + F.length("before") - F.length(before)
    return units.withColumns({"_a": after, "_b": before, "saved": saved}).drop("after", "before").withColumnsRenamed({"_a": "after", "_b": "before"})
