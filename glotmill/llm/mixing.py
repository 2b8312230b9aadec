"""Mixing sources to target weights: blocks of words, drawn per shard, permuted per source, joined by index."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glotmill.llm.common import WORD, cut, give_back, take

#: Words of a block.
BLOCK = 256
#: Weights, repeating over the sources in order of their code points.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this.
MOST = 3
#: Slots (blocks) of an output shard.
SHARD = 1 << 16
#: At most so many output shards are drawn for, on the driver.
MAX_SHARDS = 4_096
#: At most so many sources; their sizes come to the driver.
MAX_SOURCES = 100_000
#: Documents of a source are laid end to end in groups of about this many.
GROUP_ROWS = 2_000


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, most: float = MOST) -> list[float]:
    """What each source is to give: shares of the sum of sizes by repeating weights, at most `most` times its size.

    What a capped source can't give is shared by weight among the others, until none is above its cap.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in sorted(open_) if left * w[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n) at the given indices: a four-round Feistel network with cycle walking."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x, walking = index.astype(np.uint64), np.ones(len(index), bool)
    while walking.any():
        y = x[walking]
        left, right = y >> np.uint64(half), y & mask
        for r in range(3, -1, -1) if inverse else range(4):
            if inverse:
                left, right = right ^ (_round(left, key * 4 + r) & mask), left
            else:
                left, right = right, left ^ (_round(right, key * 4 + r) & mask)
        x[walking] = left << np.uint64(half) | right
        walking = x >= n
    return x.astype(np.int64)


class Slots:
    """The slots of each source: how many, what epoch and block each is, how many words the last one takes."""

    def __init__(self, sizes: Sequence[int], takes: Sequence[int], block: int, shard: int, seed: int):
        self.block, self.shard, self.seed = block, shard, seed
        self.sizes = np.array(sizes, np.int64)
        self.blocks = -(-self.sizes // block)
        n, last = [], []
        for s, (size, want) in enumerate(zip(sizes, takes, strict=True)):
            epochs, rest = divmod(want, size) if size else (0, 0)
            count, partial = epochs * int(self.blocks[s]), block
            if rest:
                short = int(permute(np.array([self.blocks[s] - 1]), int(self.blocks[s]), self._key(s, epochs), inverse=True)[0])
                spare = int(self.blocks[s]) * block - size  # words that the short block lacks
                done, partial = divmod(rest if rest <= short * block else rest + spare, block)
                if short * block < rest <= (short + 1) * block - spare:  # it ends within the short block
                    done, partial = short, rest - short * block
                count, partial = (count + done + 1, partial) if partial else (count + done, block)
            n.append(count)
            last.append(partial)
        self.n, self.last = np.array(n, np.int64), np.array(last, np.int64)

    def draws(self) -> pd.DataFrame:
        """The blocks that each shard draws: sid, out_shard, first (number of a source's slot) and count.

        A shard's counts are a multinomial draw by what the sources have left to give, so that in the end each
        source has given what it is to give. There are at most MAX_SHARDS shards; beyond that they are larger.
        """
        rng, given, total, out = np.random.default_rng(self.seed), np.zeros_like(self.n), int(self.n.sum()), []
        shard = max(self.shard, -(-total // MAX_SHARDS))
        for number in range(-(-total // shard)):
            left = self.n - given
            size, drawn = min(shard, int(left.sum())), np.zeros_like(left)
            while size > drawn.sum():
                room = left - drawn
                drawn += np.minimum(room, rng.multinomial(size - int(drawn.sum()), room / room.sum()))
            at = np.flatnonzero(drawn)
            out.append(pd.DataFrame({"sid": at, "out_shard": number, "first": given[at], "count": drawn[at]}))
            given += drawn
        return pd.concat(out) if out else pd.DataFrame({"sid": [], "out_shard": [], "first": [], "count": []}, dtype="int64")

    def _key(self, source: int, epoch: int) -> int:
        return self.seed * 1_000_003 + source * MOST + epoch + 1

    def of(self, source: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
        """epoch, idx (block) and words of the j-th slots of sources."""
        epoch, index, idx = j // self.blocks[source], j % self.blocks[source], np.zeros_like(j)
        for s in np.unique(source):
            at = source == s
            for e in np.unique(epoch[at]):
                here = at & (epoch == e)
                idx[here] = permute(index[here], int(self.blocks[s]), self._key(int(s), int(e)))
        return {"epoch": epoch, "idx": idx, "words": np.where(j == self.n[source] - 1, self.last[source], self.block)}


def _table(rows: Iterable[tuple], **types: pa.DataType) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.table({c: pa.array(x, t) for (c, t), x in zip(types.items(), columns, strict=True)})


class Mix:
    """The mix of docs: `located` (documents laid end to end in each source) and `parts` (what it takes of them).

    Sources are ordered by code point, null last, and weighted by repeating weights; targets() says what each is
    to give. A document's size is its number of words. Null texts have none. Ids break no ties: rows that agree in
    all columns are alike, and which of them a draw takes doesn't matter.

    Each source's documents, in pseudorandom groups and then by key, form a stream that is cut into blocks of `block`
    words. A source whose target is t words gives its whole stream as often as it fits into t, and then the
    blocks that a keyed permutation of their indices puts first, the last one in part, so that it
    gives t words to the word. Each output shard draws how many blocks it takes of each source (Slots.draws); only drawn
    blocks are taken. Slots and pieces of documents join on (source, block), which no source or document makes hot. Only
    source totals come to the driver; a long source is laid out in groups, whose lengths are summed before.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, weights: Sequence[float] = WEIGHTS, seed: int = 1, shard: int = SHARD, mark: Sequence[str] = ()):
        rows = take(docs, *dict.fromkeys((key, text, source, *mark)))
        size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
        self.block = block
        sized = cut(rows.select(F.col(key).alias("k"), F.col(source).alias("src"), size.alias("size"), F.xxhash64(*rows.columns).alias("h")))
        stats = sized.groupBy("src").agg(F.sum("size").alias("w"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(stats) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        stats.sort(key=lambda r: (r["src"] is None, r["src"] or ""))
        sizes = [r["w"] for r in stats]
        self.targets = targets(sizes, weights)
        self.slots = Slots(sizes, [min(MOST * w, round(t)) for w, t in zip(sizes, self.targets, strict=True)], block, shard, seed)
        spark = docs.sparkSession
        # Arrow tables: rows of Python objects would go through further Python workers, which stay in each executor.
        known = [(i, r["src"], r["w"], t, max(1, math.ceil(r["n"] / GROUP_ROWS))) for i, (r, t) in enumerate(zip(stats, self.targets, strict=True))]
        known = spark.createDataFrame(_table(known, sid=pa.int32(), s=pa.string(), source_size=pa.int64(), target=pa.float64(), groups=pa.int32()))
        placed = sized.join(known, F.col("src").cast("string").eqNullSafe(F.col("s"))).drop("s").withColumn("g", F.pmod(F.xxhash64("h", "k"), F.col("groups")))
        lengths = placed.groupBy("sid", "g").agg(F.sum("size").alias("gw"))
        lengths = lengths.withColumn("base", F.coalesce(F.sum("gw").over(Window.partitionBy("sid").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inside = Window.partitionBy("sid", "g").orderBy("k", "h").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        placed = placed.join(lengths.select("sid", "g", "base"), ["sid", "g"]).withColumn("start", F.col("base") + F.col("inside"))
        self.located = cut(placed.select("k", "src", "sid", "size", "h", "source_size", "target", "start"))

        end = F.col("start") + F.col("size")
        pieces = self.located.where("size > 0").select(
            "sid", "start", end.alias("end"), F.explode(F.sequence((F.col("start") / block).cast("long"), ((end - 1) / block).cast("long"))).alias("idx")
        )
        slots = self.slots
        #: What each shard draws of each source.
        self.draws = spark.createDataFrame(_table(slots.draws().itertuples(index=False), sid=pa.int32(), out_shard=pa.int64(), first=pa.int64(), count=pa.int64()))
        drawn = self.draws.select("sid", "out_shard", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)).alias("j"))

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"sid": f["sid"], "out_shard": f["out_shard"]} | slots.of(f["sid"].to_numpy(np.int64), f["j"].to_numpy(np.int64)))

        made = drawn.mapInPandas(place, "sid int, out_shard long, epoch long, idx long, words long")
        first = F.greatest(F.col("idx") * block, "start")
        until = F.least(F.col("idx") * block + F.col("words"), "end")
        #: sid, start (of a document), epoch, out_shard, and the document's words [lo, hi) that a slot takes.
        self.parts = pieces.join(made.hint("merge"), ["sid", "idx"]).where(until > first).select(
            "sid", "start", "epoch", "out_shard", (first - F.col("start")).alias("lo"), (until - F.col("start")).alias("hi")
        )

    def taken(self) -> DataFrame:
        """k, size, source_size, target, taken for each row of docs."""
        sums = self.parts.groupBy("sid", "start").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
        # Documents without words share their start with the next one.
        own = self.located.withColumn("s", F.when(F.col("size") > 0, F.col("start")))
        return own.join(sums.withColumnRenamed("start", "s"), ["sid", "s"], "left").select("k", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **more: object) -> DataFrame:
    """key, size, source_size, target and taken (words the mix takes, repeats counted) for each row of docs. See Mix."""
    return Mix(docs, key, text, source, **more).taken().withColumnRenamed("k", key)


def mix_documents(docs: DataFrame, columns: tuple[str, ...], key: str = "doc_id", text: str = "text", source: str = "source", shard_column: str | None = None, **more: object) -> DataFrame:
    """The mixed documents with the given columns: one row for each shard and round that takes words of a document.

    With `shard_column` the shard's number follows. A row that takes all words gives the text as it is; one that takes
    some gives, in order, the runs of text that hold them, joined by line ends. Documents of which nothing is taken give no row. Rows that
    agree in all columns are alike. See Mix for the rest.
    """
    rows = take(docs, *columns)
    mix = Mix(rows, key, text, source, mark=columns, **more)
    rounds = mix.parts.groupBy("sid", "start", "epoch", "out_shard").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    rounds = rounds.join(mix.located.where("size > 0").select("sid", "start", "h", "size"), ["sid", "start"])
    names = list(dict.fromkeys((key, text, source, *columns)))
    texts = rows.withColumn("_h", F.xxhash64(*names)).dropDuplicates(["_h"])

    @F.pandas_udf("string")
    def chosen(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts_, spans, sizes in parts:
            yield pd.Series([excerpt(t, [(x["lo"], x["hi"]) for x in s], n) for t, s, n in zip(texts_, spans, sizes, strict=True)])
            texts_ = spans = sizes = None
        give_back()

    out = texts.join(rounds, texts["_h"] == rounds["h"])
    return out.withColumn("_new", chosen(F.col(text), "spans", "size")).select(*[F.col("_new").alias(c) if c == text else F.col(c) for c in columns], *([F.col("out_shard").alias(shard_column)] if shard_column else []))


def write_mix(docs: DataFrame, columns: tuple[str, ...], path: str, **more: object) -> None:
    """Write the mixed documents as Parquet, a folder `out_shard=<number>` for each output shard. See mix_documents()."""
    mix_documents(docs, columns, shard_column="out_shard", **more).write.partitionBy("out_shard").parquet(path)


def excerpt(text: str, spans: list[tuple[int, int]], size: int) -> str:
    """The runs of text that hold the words [lo, hi) of each span; touching spans are one run."""
    import re

    runs: list[list[int]] = []
    for lo, hi in spans:
        if runs and runs[-1][1] == lo:
            runs[-1][1] = hi
        else:
            runs.append([lo, hi])
    if runs == [[0, size]]:
        return text
    at = [m.span() for m in re.finditer(WORD, text)]
    return "\n".join(text[at[lo][0] : at[hi - 1][1]] for lo, hi in runs)
