"""Texts whose sets of word shingles have a Jaccard similarity of at least 0.8: prefix filter, exact check, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.llm import simhash
from glotmill.llm.common import Scratch, cut, give_back, take
from glotmill.llm.graph import components
from glotmill.llm.sketches import _MEMO, SHINGLE, shingle_hashes

#: Texts from which frequent shingles are learned, and how many of these are kept. Both only set an order, never a result.
SAMPLE = 5_000
FREQUENT = 100_000
#: Groups of shingles by which two sets' common ones are bounded.
GROUPS = 32
#: Ranges of shingles that are joined one after another, so that the shuffle files of one are there at a time.
PASSES = 4
#: Shingles up to which one pass is enough.
PASS_ROWS = 1 << 22
#: Texts to read again up to which their keys go to every task.
FEW = 1 << 19
#: Texts whose sets a worker holds at a time.
ROWS = 256


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def fingerprint(hashes: np.ndarray) -> int:
    """The signed SimHash of a set of hashes: a bit is set if it is set in more than half of them. It gives candidates, never a result."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit for each set of hashes that agree in their last bits, in as many BIGINTs, a power of two, as give a bit for each hash at least."""
    size = 64 << max(0, (len(hashes) - 1).bit_length() - 6)
    bits = np.zeros(size, np.uint8)
    bits[(hashes >> 5) & (size - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def signatures(rows: DataFrame, frequent: dict[int, int], shingle: int = SHINGLE) -> DataFrame:
    """(key, sid, n, fp, p, c, b) of rows(key BIGINT, text): a hash of the text's set of shingles, its size, its SimHash,
    as many of the set's shingles, frequent ones last, else by hash, as two sets of similarity 0.8 must share one of, and
    how many shingles fall into each of GROUPS groups, a byte each in BIGINTs (all -1 if a byte can't hold one), and bitmap()."""
    known = np.array(sorted(frequent), np.int64)
    times = np.array([frequent[k] for k in known.tolist()], np.int64)

    def signed(t: str | None) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]:
        h = shingle_set(t, shingle)
        sid = int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)
        n, fp, counts = len(h), fingerprint(h), np.bincount(h & (GROUPS - 1), minlength=GROUPS)
        c = counts.astype(np.uint8).view(np.int64) if counts.max() < 255 else np.full(GROUPS // 8, -1)
        b = bitmap(h)
        if len(known) and n:
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            h = h[np.lexsort((h, np.where(known[at] == h, times[at], 0)))]
        return sid, n, fp, h[: n + 1 - -(-4 * n // 5)] if n else h, c, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sid, n, fp, p, c, b = zip(*[signed(t.as_py()) for t in part.column(1)], strict=True)
                ends, cuts = (np.cumsum([0, *map(len, x)]).astype(np.int32) for x in (p, b))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sid, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(p)),
                     pa.ListArray.from_arrays(np.arange(0, len(c) * GROUPS // 8 + 1, GROUPS // 8, dtype=np.int32), np.concatenate(c)),
                     pa.ListArray.from_arrays(cuts, np.concatenate(b))],
                    ["key", "sid", "n", "fp", "p", "c", "b"],
                )
            batch = part = None
        _MEMO.clear()
        give_back()

    return rows.select("key", "text").mapInArrow(run, "key long, sid long, n int, fp long, p array<long>, c array<long>, b array<long>")


def _frequent(rows: DataFrame, shingle: int) -> dict[int, int]:
    """Frequent shingles of a sample of texts, and how often they are. They set an order, never a result."""
    n = rows.count()
    few = rows.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // SAMPLE))) == 0)

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle) for t in texts])

    seen = few.select(F.explode(shingles("text")).alias("key")).groupBy("key").count().where("count > 1")
    return dict(map(tuple, seen.orderBy(F.desc("count"), "key").limit(FREQUENT).collect()))


def similar(shingle: int):
    """A column function: whether two texts' sets have similarity 0.8 at least: 9 times what they share is 4 times both sizes."""

    @F.arrow_udf("boolean")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in parts:
            out = []
            for x, y in zip(a, b, strict=True):
                s, t = shingle_set(x.as_py(), shingle), shingle_set(y.as_py(), shingle)
                out.append(9 * len(np.intersect1d(s, t, assume_unique=True)) >= 4 * (len(s) + len(t)))
            a = b = x = y = None
            yield pa.array(out, pa.bool_())
        _MEMO.clear()
        give_back()

    return run


def _fits() -> Column:
    """Whether sets of n and m shingles with bitmaps x and y can be that similar: a bit that one lacks is a shingle it lacks.

    Sets of such sizes have bitmaps of one size or of twice that, and then the larger is folded.
    """
    word = lambda v, i: f"({v}[{i}] | {v}[({i} + least(size(x), size(y))) % size({v})])"
    lacks = lambda v, w: f"aggregate(sequence(0, least(size(x), size(y)) - 1), 0, (s, i) -> s + bit_count({word(v, 'i')} & ~{word(w, 'i')}))"
    return F.expr(f"9 * least(n, m) >= 4 * (n + m) AND 9 * least(n - {lacks('x', 'y')}, m - {lacks('y', 'x')}) >= 4 * (n + m)")


def _texts(rows: DataFrame, ends: DataFrame) -> Iterator[DataFrame]:
    """(sid, text) of those of rows(key, text) that ends(key, sid) has. Only these are shuffled: few ends go to the rows, of more a range of keys at a time."""
    few = ends.count() <= FEW
    for i in range(1 if few else PASSES):
        mine = ends if few else ends.where(F.pmod("key", F.lit(PASSES)) == i)
        found = rows.join(mine.hint("broadcast"), "key") if few else rows.where(F.pmod("key", F.lit(PASSES)) == i).join(mine, "key")
        yield found.dropDuplicates(["key"]).select("sid", "text")


def _near(pairs: DataFrame, head: DataFrame, rows: DataFrame, shingle: int, scratch: Scratch, name: str) -> DataFrame:
    """Those of pairs(a, b) of sids whose texts are similar.

    Pairs whose bitmaps tell that they aren't go first: unrelated texts share shingles by chance, in pairs that grow faster than the
    texts do, and those must not carry texts. Only the texts of the other pairs are read again.
    """
    maps = head.select("sid", "n", "b")
    pairs = pairs.join(maps.toDF("a", "n", "x"), "a").join(maps.toDF("b", "m", "y"), "b").where(_fits())
    pairs = scratch.keep(pairs.select("a", "b"), f"{name}-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    ends = scratch.keep(ends.join(head.select("sid", "rep"), "sid").select("sid", F.col("rep").alias("key")), f"{name}-ends")
    texts = scratch.keep_all(_texts(rows, ends), f"{name}-texts")
    both = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("_s")), "a").join(texts.select(F.col("sid").alias("b"), F.col("text").alias("_t")), "b")
    out = scratch.keep(both.where(similar(shingle)("_s", "_t")).select("a", "b"), f"{name}-near")
    scratch.free(f"{name}-pairs", f"{name}-ends", f"{name}-texts")
    return out


def _can(n: str, at: str, m: str, to: str) -> Column:
    """Whether sets of n and m shingles whose first common one stands at `at` and `to` can be that similar."""
    return 9 * F.least(F.col(n) - F.col(at), F.col(m) - F.col(to)) >= 4 * (F.col(n) + F.col(m))


def _may(c: str, d: str, n: str, m: str) -> Column:
    """Whether sets of n and m shingles can be that similar: of each group they share as many as the smaller count at most."""
    each = [F.least(*[F.shiftrightunsigned(F.get(x, i // 8), 8 * (i % 8)).bitwiseAND(F.lit(255)) for x in (c, d)]) for i in range(GROUPS)]
    return (F.get(c, 0) == -1) | (F.get(d, 0) == -1) | (9 * reduce(Column.__add__, each) >= 4 * (F.col(n) + F.col(m)))


def link(head: DataFrame, rows: DataFrame, shingle: int, scratch: Scratch, tied: DataFrame | None = None) -> DataFrame:
    """(sid, root) of head(sid, n, fp, p, c, b, rep): root is the smallest sid that links of similarity 0.8 or more, or those of tied(a, b), a > b, reach.

    Candidates are those whose SimHash fingerprints link (simhash.classes), each with its component's smallest one. As 64
    bits can't tell all sets of similarity 0.8, the others follow by the prefix bound: two such sets share one of
    their first n - ceil(0.8 n) + 1 shingles in any common order, and the first that they share leaves room for the
    rest (_can). Sets first meet two others at each such shingle, chosen by a hash so that they differ from shingle to
    shingle, so that groups contract without a list of their pairs; then sets of different groups meet, unless their counts by groups of shingles tell
    inside the join that they can't be similar (_may). All joins by shingles go by ranges of them, each with a table of its own that
    goes with its range, so that neither the shuffle files nor the rows of all are there at once. Ties are links from the start. Every
    other link is verified on the whole sets.
    """
    prints = cut(head.where("n > 0").select("sid", "fp"))
    hashed = prints.join(simhash.classes(prints, key="sid"), "fp").where("component_id <> sid")
    hashed = hashed.select(F.greatest("sid", "component_id").alias("a"), F.least("sid", "component_id").alias("b"))
    counted = head.select("sid", "n", "c")

    heads = head.where("n > 0").select("sid", "n", F.posexplode("p").alias("at", "key"))
    many = head.agg(F.sum(F.size("p"))).first()[0] or 0
    passes = PASSES if many > PASS_ROWS else 1

    def shared(part: DataFrame) -> DataFrame:
        both = part.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi").select("key")
        return part.join(both.hint("merge"), "key")

    def stars(some: DataFrame) -> DataFrame:
        mine = F.struct(F.xxhash64("key", "sid").alias("r"), "sid", "n", "at")
        met = some.join(some.groupBy("key").agg(F.min(mine).alias("lo"), F.max(mine).alias("hi")).hint("merge"), "key")
        star = met.select("sid", "n", "at", F.explode(F.array("lo", "hi")).alias("e")).where((F.col("sid") != F.col("e.sid")) & _can("n", "at", "e.n", "e.at"))
        return star.select(F.greatest("sid", "e.sid").alias("a"), F.least("sid", "e.sid").alias("b")).distinct()

    some = [scratch.keep(shared(heads.where(F.pmod("key", F.lit(passes)) == i)), f"some{i}") for i in range(passes)]
    star = scratch.keep_all(map(stars, some), "stars").union(hashed).distinct()
    if tied is not None:
        star = star.join(tied, ["a", "b"], "left_anti")
    star = star.join(counted.toDF("a", "n", "c"), "a").join(counted.toDF("b", "m", "d"), "b").where(_may("c", "d", "n", "m")).select("a", "b")
    near = _near(star, head, rows, shingle, scratch, "star")
    near = components(near.union(tied) if tied is not None else near)
    scratch.free("stars", "star-near")
    label = F.coalesce("root", "sid").alias("label")

    def mixed(some: DataFrame) -> DataFrame:
        named = some.join(near, some.sid == near.node, "left").select("key", "sid", "n", "at", label)
        sizes = named.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("major"), F.count("*").alias("labels"))
        return named.join(sizes.where("labels > 1").drop("labels").hint("merge"), "key").join(counted.select("sid", "c"), "sid")

    other = (F.col("label1") != F.col("label")) & ((F.col("label") == F.col("major")) | (F.col("label1") < F.col("label")))

    def across(part: DataFrame) -> DataFrame:
        rare = part.where("label <> major").select("key", *[F.col(c).alias(f"{c}1") for c in ("sid", "n", "at", "label", "c")])
        met = rare.join(part.hint("merge"), "key").where(other & _can("n1", "at1", "n", "at") & _may("c1", "c", "n1", "n"))
        return met.select(F.greatest("sid1", "sid").alias("a"), F.least("sid1", "sid").alias("b")).distinct()

    def each() -> Iterator[DataFrame]:
        for i, part in enumerate(some):
            held = scratch.keep(mixed(part), f"held{i}")
            scratch.free(f"some{i}")
            yield across(held)
            scratch.free(f"held{i}")

    pairs = scratch.keep_all(each(), "across")
    more = _near(pairs.distinct(), head, rows, shingle, scratch, "across")
    top = components(more.union(near.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    scratch.free("across", "across-near")
    return head.select("sid").join(top, F.col("sid") == top.node, "left").select("sid", F.coalesce("root", "sid").alias("root"))


def groups(rows: DataFrame, key: str = "key", text: str = "text", shingle: int = SHINGLE, ties: DataFrame | None = None) -> DataFrame:
    """(key, root) for each row of rows(key BIGINT, text): rows with equal root are linked, those of ties(key, other) whatever their texts.
    Texts without words are alike."""
    rows = take(rows, key, text).toDF("key", "text")
    scratch = Scratch(rows.sparkSession)
    made = scratch.keep(signatures(rows, _frequent(rows, shingle), shingle), "made")
    ids = scratch.keep(made.select("key", "sid"), "ids")
    head = scratch.keep(made.groupBy("sid").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("p").alias("p"), F.first("c").alias("c"), F.first("b").alias("b"), F.min("key").alias("rep")), "head")
    scratch.free("made")
    tied = None
    if ties is not None:
        once = ids.distinct()
        ends = ties.distinct().join(once.toDF("key", "a"), "key").join(once.toDF("other", "b"), "other")
        tied = scratch.keep(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "tied")
    out = cut(ids.join(link(head, rows, shingle, scratch, tied), "sid").select(F.col("key").alias(key), "root"))
    scratch.free("ids", "head", "tied")
    return out
