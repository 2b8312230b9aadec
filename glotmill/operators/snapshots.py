"""Snapshot comparison and rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, keys: list[str], value: str, unexpected_only: bool = False) -> DataFrame:
    """Full outer comparison by key: keys and change (added, removed, changed, same). Values compare null-safe."""
    a = before.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ina"))
    b = after.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_inb"))
    kind = F.when(F.col("_ina").isNull(), "added").when(F.col("_inb").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    out = a.join(b, keys, "full_outer").select(*keys, kind.alias("change"))
    return out.where("change <> 'same'") if unexpected_only else out


def bag_difference(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values that left has more often than right, by key: keys, value, missing."""
    a = left.groupBy(*keys, value).agg(F.count("*").alias("n"))
    b = right.groupBy(*keys, value).agg(F.count("*").alias("m"))
    return a.join(b, [*keys, value], "left").withColumn("missing", F.col("n") - F.coalesce("m", F.lit(0))).where("missing > 0").select(*keys, value, "missing")


def check(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """All broken rules: key and rule. A rule is broken where its condition isn't true."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def reasons(checks: list[tuple[Column, str]]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in checks]))


def _targets(own) -> dict:
    targets: dict = {}
    for a, b in zip(own.column("owner").to_pylist(), own.column("target").to_pylist(), strict=True):
        targets.setdefault(a, []).append(b)
    return targets


def _follow(own, starts):
    """(node): what one range's edges reach from starts."""
    import pyarrow as pa

    targets = _targets(own)
    found, open_ = set(), starts.column("node").to_pylist()
    while open_:
        for t in targets.pop(open_.pop(), ()):
            if t not in found:
                found.add(t)
                open_.append(t)
    return pa.table({"node": pa.array(list(found), own.column("target").type)})


def _shorten(own, marks):
    """(owner, target): from each node at which paths enter a range straight to those at which they leave it.

    Strongly connected nodes are found first (Tarjan's way, without recursion); then each component's exits are the union of its
    own and of its successors', as the bits of one integer. A range that would have more such edges than it has now keeps its own.
    """
    import pyarrow as pa

    targets, kind = _targets(own), own.column("target").type
    enter, leave = [], {}
    for node, out in zip(marks.column("node").to_pylist(), marks.column("out").to_pylist(), strict=True):
        if out:
            leave.setdefault(node, len(leave))
        elif node in targets:
            enter.append(node)
    low, order, on, stack, bits, edges = {}, 0, set(), [], {}, []
    for root in enter:
        if root in low:
            continue
        low[root] = order
        work, order = [(root, order, iter(targets[root]))], order + 1
        stack.append(root)
        on.add(root)
        while work:
            v, at, rest = work[-1]
            for t in rest:
                if t not in low:
                    low[t] = order
                    work.append((t, order, iter(targets.get(t, ()))))
                    order += 1
                    stack.append(t)
                    on.add(t)
                    break
                if t in on:
                    low[v] = min(low[v], low[t])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == at:
                    group = []
                    while not group or group[-1] != v:
                        group.append(stack.pop())
                        on.discard(group[-1])
                    have = 0
                    for u in group:
                        for t in targets.get(u, ()):
                            have |= bits.get(t, 0) | (1 << leave[t] if t in leave else 0)
                    for u in group:
                        bits[u] = have
    names, most = list(leave), own.num_rows
    for v in enter:
        have = bits[v]
        if len(edges) + have.bit_count() > most:
            edges, done = [(a, b) for a, bs in targets.items() for b in bs]
            break
        while have:
            last = have & -have
            edges.append((v, names[last.bit_length() - 1]))
            have ^= last
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.table({"owner": pa.array(a, kind), "target": pa.array(b, kind)})


def closure(edges: DataFrame, roots: DataFrame, block: int = 100_000) -> DataFrame:
    """Nodes that roots(owner) reach over edges(owner, target), each once, however deep the graph.

    Edges lie in ranges of about `block`. All ranges are shortened at once: to edges from the nodes at which paths enter one to
    those at which they leave it. The nodes that are reached over these edges are found in the same way, until one range holds
    them; then all ranges are followed once from there. So a path through many ranges takes few rounds. Where shortening doesn't
    leave half the edges at most, a round follows paths inside each range to their ends, and only nodes that are new go on to the
    next round, until there are none. A null owner has no targets; a null target is a node. Intermediate results are checkpointed.
    """
    from glotmill.plans.storage import settled

    kind = edges.schema["target"].dataType.simpleString()
    edges = edges.select(F.col("owner").cast(kind).alias("owner"), "target").dropna(subset=["owner"])
    seen = settled(roots.select(F.col("owner").cast(kind).alias("node")).distinct())
    return seen.union(_reached(edges, seen, kind, block)).distinct()


def _reached(edges: DataFrame, seen: DataFrame, kind: str, block: int) -> DataFrame:
    """Nodes that one edge or more of edges(owner, target) leads to from seen(node)."""
    from glotmill.plans.storage import settled

    count = edges.count()
    parts = count // block + 1
    if parts == 1:
        edges, starts = edges.withColumn("_b", F.lit(0)), seen.select(F.lit(0).alias("part"), "node")
        return settled(edges.groupBy("_b").cogroup(starts.groupBy("part")).applyInArrow(_follow, f"node {kind}"))
    edges = settled(edges.repartitionByRange(parts, "owner", "target").withColumn("_b", F.spark_partition_id()))
    owners = settled(edges.select(F.col("owner").alias("node"), F.col("_b").alias("part")).distinct())

    # A node inside a range's bounds is no other range's owner.
    bounds = edges.groupBy("_b").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"))
    far = edges.join(F.broadcast(bounds), "_b").where("target <= lo OR target >= hi").select("_b", F.col("target").alias("node")).distinct()
    across = settled(far.join(owners, "node").where("part <> _b").select("_b", "part", "node"))
    into = across.select("part", "node").union(owners.join(seen, "node").select("part", "node"))
    marks = into.withColumn("out", F.lit(False)).union(across.select(F.col("_b").alias("part"), "node", F.lit(True).alias("out"))).distinct()
    short = edges.groupBy("_b").cogroup(marks.groupBy("part")).applyInArrow(_shorten, f"owner {kind}, target {kind}")
    short = settled(short)
    if short.count() <= count // 2:
        starts = settled(owners.join(seen.union(_reached(short, seen, kind, block)).distinct(), "node").select("part", "node"))
        return settled(_step(edges, starts, kind))
    first, new = seen, seen
    while not new.isEmpty():
        step = _step(edges, settled(owners.join(new, "node").select("part", "node")), kind)
        known = seen.select(F.col("node").alias("_n"))
        new = settled(step.join(known, step.node.eqNullSafe(known._n), "left_anti"))
        seen = settled(seen.union(new))
    return seen.join(first, "node", "left_anti")


def _step(edges: DataFrame, starts: DataFrame, kind: str) -> DataFrame:
    """What starts(part, node) reach, each inside its own range of edges."""
    touched = edges.join(starts.select(F.col("part").alias("_b")).distinct(), "_b", "left_semi")
    return touched.groupBy("_b").cogroup(starts.groupBy("part")).applyInArrow(_follow, f"node {kind}").distinct()
