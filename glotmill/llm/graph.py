"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import cut

#: Edges up to which one task links them: dealing out so few anew for every step costs more than the steps do.
FEW = 100_000


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all batches' edges (a, b), as components() returns them."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    made = [(x, r) for x in list(up) if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], pa.int64()) for i in (0, 1)], ["node", "root"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b) that isn't its component's smallest node.

    Each step shuffles the edges once by node; a node's minimum is pre-aggregated before the
    shuffle, and neighbours are never gathered into one row. The steps keep the components and
    end, after about log(longest path) rounds, in stars around the smallest node. Self-loops and
    repeated edges do no harm; an empty table gives an empty table. Up to FEW edges between BIGINTs are linked in one task.
    """
    now = cut(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    if set(dict(now.dtypes).values()) == {"bigint"} and now.count() <= FEW:
        return cut(now.coalesce(1).mapInArrow(_linked, "node long, root long"))
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").selectExpr("greatest(b, m) AS a", "least(b, m) AS b")
        now = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
    raise RuntimeError("components did not settle")
