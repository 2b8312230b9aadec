"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import Scratch, take

#: Lines within one word's edit are near only if the longer one has at least so many words: then 0.8 of it agrees.
LEAST_WORDS = 5
#: Running values are gathered in blocks of this size, which keeps long lines linear.
BLOCK = 512


def _words(line: Column) -> Column:
    """A line's words. Lines whose only white space is the blank, nearly all, are split without a pattern."""
    other = F.lit(False)
    for c in "\t\v\f\r\n":
        other = other | F.contains(line, F.lit(c))
    return F.array_remove(F.when(other, F.split(line, r"[\x20\x09-\x0D]+")).otherwise(F.split(line, " ")), "")


def _running_xor(values: Column) -> Column:
    """For an ARRAY<BIGINT>, the array of xors of all elements up to each one."""

    def scan(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("x"), F.array().cast("array<bigint>").alias("all"))
        step = lambda s, v: F.struct(s["x"].bitwiseXOR(v).alias("x"), F.concat(s["all"], F.array(s["x"].bitwiseXOR(v))).alias("all"))
        return F.aggregate(part, first, step, lambda s: s["all"])

    zero = F.lit(0).cast("long")
    total = lambda part: F.aggregate(part, zero, lambda a, v: a.bitwiseXOR(v))
    block = lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    last = ((F.size(values) - 1) / BLOCK).cast("int")
    long = F.flatten(
        F.transform(F.sequence(F.lit(0), last), lambda b: scan(block(b), total(F.slice(values, F.lit(1), b * BLOCK))))
    )
    return F.when(F.size(values) <= BLOCK, scan(values, zero)).otherwise(long)


def _one_edit(a: Column, b: Column) -> Column:
    """True if two word arrays are at most one insertion, deletion or substitution apart."""
    miss = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    rest = lambda x, k: F.slice(x, k, F.greatest(F.size(x) - k + 1, F.lit(0)))
    n, m = F.size(a), F.size(b)
    return (
        F.when(miss == 0, True)
        .when(n == m, rest(a, miss + 1) == rest(b, miss + 1))
        .when(n == m + 1, rest(a, miss + 1) == rest(b, miss))
        .when(m == n + 1, rest(a, miss) == rest(b, miss + 1))
        .otherwise(False)
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] | None = None) -> DataFrame:
    """Drop every line that an earlier line repeats exactly or within one word's edit.

    Returns one row for each row of docs: the given columns (by default key and text), with text
    reduced to the kept lines, and n_lines and n_kept. A line is what `\\n` ends; it is compared as its
    words (runs without white space, case kept). Lines without words always stay. Order is by key
    (an integer; nulls last), then line number. A line goes if an earlier one has the same words, or,
    where the longer of the two has at least LEAST_WORDS words, if one word inserted, deleted or replaced
    makes them equal; the earlier line counts even if it goes itself.

    Null text stays null with n_lines and n_kept 0; a document whose lines all go has an empty text. Rows
    with equal key and text are one document and get the same result; rows with one key and different
    texts have tied positions, and lines tied for earliest all stay. Extra columns are ignored, an empty
    table gives an empty result.

    Method: distinct lines (by a 128-bit hash, with their earliest position, pre-aggregated) first meet by the
    hash of their first or last half, one of which any pair within one edit shares; only lines that meet
    another go on, and no pair is lost. For these, all variants within the bound are emitted as 64-bit keys:
    the line with each word replaced by a wildcard, with each word deleted, and as it is. Equal keys join to
    the earliest line of the bucket (one row for each variant, never all pairs), the edit distance
    to the line's earliest match is verified on the words, and its occurrences go. Hot lines and keys
    are pre-aggregated and split by Spark's skew join. A line goes only if its 128-bit hash says so; where two lines
    share its first 64 bits, near ones of one of them may be missed.
    """
    columns = columns or (key, text)
    docs = take(docs, *dict.fromkeys((*columns, key, text)))
    whole = docs.withColumn("_row", F.xxhash64(key, text))
    lines = whole.select(F.col(key).alias("doc"), "_row", F.posexplode(F.split(text, "\n")).alias("no", "line"))
    lines = lines.select("doc", "_row", "no", _words(F.col("line")).alias("w")).where(F.size("w") > 0)
    ten = F.lit("10000000000").cast("decimal(11,0)")
    last = F.lit("9" * 19).cast("decimal(19,0)")
    place = (F.coalesce(F.col("doc").cast("decimal(19,0)"), last) * ten + F.col("no")).cast("decimal(32,0)")
    # The halves' hashes are of the words' hashes, so that each word's letters are read three times in all.
    lines = lines.withColumn("v", F.transform("w", lambda x: F.xxhash64(x)))
    h1, h2 = F.xxhash64("v"), F.xxhash64(F.lit(1), "w")
    n = F.size("w")

    def halves(size: Column) -> list[Column]:
        cut = (size / 2).cast("int")
        return [F.xxhash64(F.lit(0), size, F.slice("v", F.lit(1), cut)), F.xxhash64(F.lit(1), size, F.slice("v", n - (size - cut) + 1, size - cut))]

    meets = F.when(n >= LEAST_WORDS, F.array(*halves(n), *halves(n - 1))).when(n == LEAST_WORDS - 1, F.array(*halves(n)))
    scratch = Scratch(docs.sparkSession)
    seen = lines.select("_row", "no", place.alias("place"), h1.alias("h1"), h2.alias("h2"), *[F.get(meets, i).alias(f"m{i}") for i in range(4)])
    seen = scratch.keep(seen, "seen")
    first = seen.groupBy("h1", "h2").agg(
        F.min("place").alias("place"), F.min_by("_row", "place").alias("_row"), F.min_by("no", "place").alias("no"), *[F.max(f"m{i}").alias(f"m{i}") for i in range(4)]
    )
    first = scratch.keep(first, "first")

    # Lines that share a half with another line.
    half = first.select("h1", F.explode(F.array_compact(F.array("m0", "m1", "m2", "m3"))).alias("key"))
    shared = half.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    meeting = half.join(shared, "key", "left_semi").select("h1").distinct()
    chosen = first.select("h1", "h2", "_row", "no", "place").dropDuplicates(["h1"]).join(meeting, "h1", "left_semi")

    # Their words, from the documents that hold them first.
    by_row = chosen.groupBy("_row").agg(F.collect_list(F.struct("no", "h1", "h2", "place")).alias("want"))
    texts = whole.select("_row", text).join(by_row, "_row").select(F.split(text, "\n").alias("all"), F.explode("want").alias("x"))
    # Repeated rows bring a line as often as they are; once is enough.
    near = texts.select("x.h1", "x.h2", "x.place", F.get("all", "x.no").alias("line")).dropDuplicates(["h1"])
    near = scratch.keep(near.select("h1", "h2", "place", _words(F.col("line")).alias("w")), "near")
    at = F.transform("w", lambda w, i: F.xxhash64(w, i))
    before = F.transform("w", lambda w, i: F.xxhash64(w, i - 1))
    stored, near = near, near.withColumns({"at": at, "before": before})
    full = F.aggregate("at", F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v))
    # The xor of a line without its word i differs from that without word i - 1 by words i - 1 and i alone.
    steps = F.transform(
        "at",
        lambda _, i: F.when(i == 0, F.aggregate(F.slice("before", F.lit(2), F.size("before")), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v)))
        .otherwise(F.get("at", i - 1).bitwiseXOR(F.get("before", i))),
    )
    near = near.withColumns({"full": full, "steps": steps}).withColumn("without", _running_xor(F.col("steps")))
    n = F.size("w")
    wild = F.when(n >= LEAST_WORDS, F.transform("at", lambda v, i: F.struct(F.xxhash64(F.lit("s"), n, i, F.col("full").bitwiseXOR(v)).alias("key"), F.lit(0).alias("role"))))
    fewer = F.when(n >= LEAST_WORDS, F.transform(F.array_distinct("without"), lambda v: F.struct(F.xxhash64(F.lit("d"), n - 1, v).alias("key"), F.lit(1).alias("role"))))
    same = F.array(F.struct(F.xxhash64(F.lit("d"), n, "full").alias("key"), F.lit(0).alias("role")))
    empty = F.array().cast("array<struct<key:bigint,role:int>>")
    variants = near.select("h1", F.explode(F.concat(F.coalesce(wild, empty), F.coalesce(fewer, empty), same)).alias("v")).select("h1", "v.key", "v.role")
    equal = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    equal = scratch.keep(variants.join(equal, "key", "left_semi"), "equal")
    variants = equal.join(stored.select("h1", "place"), "h1")

    # In a bucket of "d" keys, lines as they are (one at most) meet those with a word deleted; in one of "s" keys, all meet.
    is_d = F.col("role") == 1
    buckets = variants.groupBy("key").agg(
        F.count("*").alias("n"),
        F.min(F.when(~is_d, F.col("place"))).alias("p0"), F.min_by("h1", F.when(~is_d, F.col("place"))).alias("b0"),
        F.min(F.when(is_d, F.col("place"))).alias("p1"), F.min_by("h1", F.when(is_d, F.col("place"))).alias("b1"), F.max("role").alias("d"),
    ).where("n > 1 AND p0 IS NOT NULL")
    met = variants.join(buckets, "key")
    as_is = (F.col("role") == 0) & (F.col("d") == 1)
    met = met.select("h1", "place", F.when(as_is, F.col("p1")).otherwise(F.col("p0")).alias("p"), F.when(as_is, F.col("b1")).otherwise(F.col("b0")).alias("b"))
    pairs = met.where("p < place").groupBy("h1").agg(F.min_by("b", "p").alias("b"))
    words = stored.select("h1", "h2", "w")
    other = stored.select(F.col("h1").alias("b"), F.col("w").alias("v"))
    gone = pairs.join(words, "h1").join(other, "b").where(_one_edit(F.col("w"), F.col("v"))).select("h1", "h2", F.lit(True).alias("near"))

    # Back to the occurrences, and from their documents' texts.
    decided = first.select("h1", "h2", F.col("place").alias("first_place")).join(gone, ["h1", "h2"], "left")
    drop = seen.select("_row", "no", "place", "h1", "h2").join(decided, ["h1", "h2"]).where(F.col("near") | (F.col("place") > F.col("first_place")))
    lost = scratch.keep(drop.groupBy("_row").agg(F.collect_set("no").alias("lost")), "lost")
    scratch.free("seen", "first", "near", "equal")
    out = whole.join(lost, "_row", "left").withColumn("_all", F.split(text, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.coalesce("lost", F.array().cast("array<int>")))
    out = out.withColumn("_kept", F.when(F.col("_all").isNotNull(), kept))
    new = F.when(F.col("lost").isNull(), F.col(text)).otherwise(F.array_join(F.transform("_kept", lambda i: F.get("_all", i)), "\n"))
    count = lambda c: F.when(F.col("_all").isNull(), 0).otherwise(F.size(c))
    return out.select(*[new.alias(c) if c == text else F.col(c) for c in columns], count("_all").alias("n_lines"), count("_kept").alias("n_kept"))
