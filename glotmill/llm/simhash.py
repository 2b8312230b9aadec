"""SimHash near-duplicates: choices of fields, one-wildcard variants, equality joins, verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import cut, take
from glotmill.llm.graph import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Keys that a task makes, about: bounds the memory of a task.
TASK_KEYS = 1 << 20
#: Tasks that a large component's fingerprints are dealt over.
SALTS = 32
#: Shingles hashed at a time, which bounds the memory a very long text takes.
BLOCK = 1 << 16


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 if it has no words or is null.

    A-Z are lower-cased, words are runs without white space, shingles count as often as they occur,
    and a text with fewer words than a shingle is one shingle. A bit is set if it is set in more than
    half the shingles' XXH64.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    if len(words) >= shingle:
        begin, end = begin[: len(words) - shingle + 1], end[shingle - 1 :]
    else:
        begin, end = begin[:1], end[-1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begin), BLOCK):
        spans = zip(begin[at : at + BLOCK].tolist(), end[at : at + BLOCK].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(joined[i:j], seed) for i, j in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(begin), bitorder="little").view("<u8")[0])


def fingerprint(text: Column | str, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """simhash() as a signed BIGINT column."""

    @F.arrow_udf("long")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(np.array([simhash(t.as_py(), shingle, seed) for t in part], np.uint64).view(np.int64))

    return run(text)


def _fields(count: int) -> list[int]:
    """64 bits cut into so many fields, as masks."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _masks(fields: int, together: int) -> list[int]:
    """Of 64 bits cut into `fields` fields, the masks of all choices of `together` fields."""
    return [sum(c) for c in combinations(_fields(fields), together)]


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _number(i: int) -> int:
    return _signed((i + 1) * 0x9E3779B97F4A7C15)


def _keys(rows: DataFrame, masks: list[int]) -> DataFrame:
    """rows(fp, ...) once for each mask, with `choice`, its number, and `key`: what the mask leaves of fp, xored with a number of the mask's own.

    Keys of one mask are equal if and only if the masked bits are; those of two masks hardly ever are,
    and links are verified anyway. The masks are one constant, so that the rows are made in compiled code.
    """
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).alias("m"), F.lit(_number(i)).alias("c")) for i, m in enumerate(masks)])
    made = rows.withColumn("_v", F.explode(table))
    return made.select(*rows.columns, F.col("_v.i").alias("choice"), F.col("fp").bitwiseAND(F.col("_v.m")).bitwiseXOR(F.col("_v.c")).alias("key"))


def _variants(fields: int, together: int) -> tuple[list, list]:
    """For each choice of `together` fields, the longer keys by which rows of its bucket are met and by which they look, as (mask, number, flipped bit).

    Rows that agree in one more field have a key of it in common. Those that agree in the choice alone, and in every other
    field but for one bit, look under the keys that the other has in the choice's first other field, one bit flipped.
    """
    each, longer = _fields(fields), list(combinations(range(fields), together + 1))
    met, look = [], []
    for i, c in enumerate(combinations(range(fields), together)):
        more = [(sum(each[f] for f in c) | each[d], longer.index((*c, d)), 0) for d in range(c[-1] + 1, fields)]
        first = min(set(range(fields)) - set(c))
        mask, number = sum(each[f] for f in c) | each[first], len(longer) + i
        met.append([*more, (mask, number, 0)])
        look.append([*more, *((mask, number, 1 << b) for b in range(64) if each[first] >> b & 1)])
    return met, look


def _looked(rows: DataFrame, variants: list) -> DataFrame:
    """rows(choice, fp, ...) once for each variant of their choice, with `key`."""
    table = F.array(*[F.array(*[F.struct(F.lit(_signed(m)).alias("m"), F.lit(_number(i)).alias("c"), F.lit(_signed(x)).alias("x")) for m, i, x in v]) for v in variants])
    made = rows.withColumn("_v", F.explode(F.get(table, F.col("choice"))))
    return made.select(*rows.columns, F.col("fp").bitwiseXOR(F.col("_v.x")).bitwiseAND(F.col("_v.m")).bitwiseXOR(F.col("_v.c")).alias("key"))


def _dealt(rows: DataFrame, n: int, masks: list[int]) -> DataFrame:
    """rows in so many partitions by fp that each makes about TASK_KEYS keys."""
    return rows.repartition(max(1, -(-n * len(masks) // TASK_KEYS)), "fp")


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b joined on key by sorting: Spark thinks rows that keys multiply small, and would broadcast them."""
    return a.join(b.hint("merge"), "key")


def _bucket() -> list[Column]:
    """Of a bucket's members, how many there are and in how many bits they differ at all."""
    return [F.count("*").alias("members"), F.bit_count(F.bit_or("fp").bitwiseXOR(F.bit_and("fp"))).alias("differ")]


def _may_link(max_bits: int) -> Column:
    """False for buckets of two fingerprints that differ in more than max_bits bits, which hold no link."""
    return (F.col("members") > 2) | (F.col("differ") <= max_bits)


def _ends(rows: DataFrame, max_bits: int) -> DataFrame:
    """Of rows(key, fp, label), those whose key has several labels and may link them, with an array `e` of the members of its least and largest label."""
    mine = F.struct("label", "fp")
    ends = rows.groupBy("key").agg(F.min(mine).alias("lo"), F.max(mine).alias("hi"), *_bucket()).where(F.expr("lo.label < hi.label") & _may_link(max_bits))
    return _joined(rows, ends.select("key", F.array("lo", "hi").alias("e")))


def _stars(met: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) between labels that met(fp, label, e) verifies."""
    star = met.select("fp", "label", F.explode("e").alias("e")).where((F.col("label") != F.col("e.label")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("e.fp"))) <= max_bits))
    return star.select(F.greatest("label", "e.label").alias("a"), F.least("label", "e.label").alias("b")).distinct()


def link(prints: DataFrame, max_bits: int = MAX_BITS, fields: int | None = None) -> DataFrame:
    """(fp, root) for every distinct fingerprint of prints(fp): root is its component's smallest one.

    Two fingerprints link if they differ in at most max_bits bits. Exact, in four steps:
    1. Fingerprints meet the smallest and the largest one that agrees with them in two of four 16-bit fields, and the
       verified links are contracted, so that dense groups shrink to one label without a list of their pairs.
    2. Cut into `fields` fields (by default max_bits + 3), linked fingerprints agree in fields - max_bits at least. Those that
       share no such choice of fields with another label have no further link and are done. The others meet members of the
       least and the largest label of each choice, and are contracted likewise.
    3. Only rows of a choice's bucket that still holds several labels go on. Linked ones agree in one more field, or else
       differ in exactly one bit of every field outside the choice. So they share a longer key: the choice with a further
       field, as it is or with one bit flipped (a one-wildcard variant). Only members that don't have the bucket's most
       common label look under flipped keys; the others are met. Keys are joined by equality, the distance is verified.
    4. Components of all steps' links.
    A bucket of two fingerprints that differ in more than max_bits bits is left out at once in each step.
    A choice of three fields has 27 bits, a longer key 36, so that unrelated fingerprints seldom meet. For far more
    fingerprints than 2**27, more fields give longer keys (eight: 32 bits) and more of them (70 for 35).
    """
    prints = cut(take(prints, "fp").dropna().distinct())
    if max_bits < 1:
        return prints.select("fp", F.col("fp").alias("root"))
    n, fields = prints.count(), fields or max_bits + 3
    coarse, masks = _masks(4, 2), _masks(fields, fields - max_bits)
    near = components(_stars(_ends(_keys(_dealt(prints, n, coarse), coarse).withColumn("label", F.col("fp")), max_bits), max_bits))
    named = cut(prints.join(near, prints.fp == near.node, "left").select("fp", F.coalesce("root", "fp").alias("label")))
    some = cut(_ends(_keys(_dealt(named, n, masks), masks), max_bits))
    more = components(_stars(some, max_bits).union(near.select("node", "root")))
    named = some.select("key", "choice", "fp", F.col("label").alias("old")).join(more, F.col("old") == more.node, "left").select("key", "choice", "fp", F.coalesce("root", "old").alias("label"))
    mixed = named.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("major"), F.count("*").alias("labels"))
    held = cut(_joined(named, mixed.where("labels > 1").select("key", "major")).select("choice", "fp", "label", "major"))

    met, look = _variants(fields, fields - max_bits)
    rare = held.where("label <> major").select("choice", "fp", "label")
    rare = _looked(rare, look).select("key", F.col("fp").alias("fp1"), F.col("label").alias("label1"))
    across = (
        _joined(rare, _looked(held.select("choice", "fp", "label"), met)).where((F.col("label1") != F.col("label")) & (F.bit_count(F.col("fp1").bitwiseXOR(F.col("fp"))) <= max_bits))
        .select(F.col("label1").alias("a"), F.col("label").alias("b")).distinct()
    )
    top = components(cut(across).union(more.select("node", "root")))
    return prints.join(top, prints.fp == top.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of docs: key, fp (BIGINT), component_id (the smallest key reachable by links).

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows stay repeated. A null
    key takes part in links; its component_id is null only if no linked row has a key. Extra columns are
    ignored and an empty table gives an empty result. Links run between distinct fingerprints, so exact
    copies, however many, cost nothing beyond their own row; they come back by an equality join that Spark
    splits where one fingerprint is hot.
    """
    rows = cut(take(docs, key, text).select(key, fingerprint(F.col(text), shingle).alias("fp")))
    return rows.join(classes(rows, max_bits, key), "fp", "left").select(key, "fp", "component_id")


def classes(rows: DataFrame, max_bits: int = MAX_BITS, key: str = "doc_id") -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of rows(key, fp): the smallest key that links of max_bits bits reach."""
    ends = rows.groupBy("fp").agg(F.min(key).alias("low"))
    kept = cut(ends.join(link(ends, max_bits), "fp"))
    # A large component's fingerprints are dealt over SALTS tasks, to each of which its smallest key goes.
    first = kept.groupBy("root").agg(F.min("low").alias("least"), F.count("*").alias("n")).where("n > 1")
    first = first.select("root", "least", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    return cut(kept.join(first, ["root", "salt"], "left").select("fp", F.coalesce("least", "low").alias("component_id")))


def fingerprint_hex(fp: Column | str) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
