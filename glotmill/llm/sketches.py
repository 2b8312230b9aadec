"""Document fingerprints: bottom-k sketches of word-shingle hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import take

SHINGLE = 5
K = 128
#: Words whose hashes a worker keeps at a time.
CACHE = 500_000
#: Documents are dealt into at most so many ranges of keys; a range's first key goes to every task.
MAX_RANGES = 65_536
#: A range is to hold about so many documents.
RANGE_ROWS = 2_000


class _Memo(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        self[word] = h = xxh64_intdigest(word, 1)
        return h


_MEMO = _Memo()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of a text's word shingles (A-Z lower-cased); the whole text is one if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_MEMO) > CACHE:
        _MEMO.clear()
    h = np.fromiter(map(_MEMO.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out + h[i : i + len(out)])
    return out


class Sketch:
    """The k smallest distinct shingle hashes, ascending. Sketches of a text's parts merge to the sketch of their union."""

    __slots__ = ("h", "k")

    def __init__(self, hashes: np.ndarray, k: int = K):
        if len(hashes) > 4 * k:
            # The share of the hash range that holds about 2k of them; repeated hashes may need more of it.
            low = hashes[hashes < np.uint64(int(2 * k / len(hashes) * 2**64))]
            low = np.unique(low)
            if len(low) >= k:
                hashes = low
        self.h, self.k = np.unique(hashes)[:k], k

    def merge(self, other: Sketch) -> Sketch:
        return Sketch(np.concatenate([self.h, other.h]), min(self.k, other.k))

    def distinct(self) -> float:
        """Estimated number of distinct shingles; exact below k."""
        return float(len(self.h)) if len(self.h) < self.k else (self.k - 1) / (float(self.h[-1]) / 2**64)

    def resemblance(self, other: Sketch) -> float:
        """Estimated Jaccard similarity of the shingle sets; 1 for two empty ones."""
        k = min(self.k, other.k)
        union = np.union1d(self.h, other.h)[:k]
        if not len(union):
            return 1.0
        both = np.intersect1d(self.h, other.h, assume_unique=True)
        return float(np.isin(union, both, assume_unique=True).sum()) / len(union)

    def containment(self, other: Sketch) -> float:
        """Estimated share of this text's shingles that the other text has; 1 for an empty one."""
        if not len(self.h):
            return 1.0
        union = self.merge(other).distinct()
        return min(1.0, self.resemblance(other) * union / self.distinct())

    def hex(self) -> str:
        """16 hex digits for each hash, ascending."""
        return self.h.astype(">u8").tobytes().hex()

    @classmethod
    def parse(cls, text: str, k: int = K) -> Sketch:
        return cls(np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64), k)


def merge_all(sketches: Iterable[Sketch], k: int = K) -> Sketch:
    """The sketch of the union of all parts."""
    out = Sketch(np.zeros(0, np.uint64), k)
    for s in sketches:
        out = out.merge(s)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """key, fingerprint (Sketch.hex()) and n_distinct (estimated) for each row of docs; null texts are empty ones."""

    @F.pandas_udf("fingerprint string, n_distinct double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [Sketch(shingle_hashes(t, shingle), k) for t in part]
            yield pd.DataFrame({"fingerprint": [s.hex() for s in made], "n_distinct": [s.distinct() for s in made]})

    rows = take(docs, key, text)
    return rows.select(F.col(key), run(F.col(text)).alias("r")).select(key, "r.*")


def _ranges(rows: DataFrame, key: str) -> np.ndarray:
    """Keys at which ranges of about RANGE_ROWS rows begin, the smallest key first; at most MAX_RANGES."""
    n = rows.where(F.col(key).isNotNull()).count()
    if not n:
        return np.zeros(0, np.int64)
    parts = int(min(MAX_RANGES, max(1, n // RANGE_ROWS)))
    at = F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.0], max(10_000, 10 * parts))
    r = rows.agg(F.min(key), at).first()
    return np.unique(np.array([r[0], *r[1]], np.int64))


def with_next(docs: DataFrame, make, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Run `make` over the documents in ascending key order; it sees each one and its successor.

    make(pairs) gets an iterator of (key, text, next text) of one range of keys and yields batches (pandas).
    The last document's successor is the first one. Rows with equal keys are in order of their texts'
    hash, and null keys follow all others. The whole text is shuffled once: ranges of keys are sorted
    apart, and each range also gets the first rows of the range after it. No task holds more than the
    rows it is at.
    """
    rows = take(docs, key, text)
    starts = _ranges(rows, key)
    last = max(0, len(starts) - 1)

    @F.pandas_udf("array<int>")
    def targets(keys: pd.Series) -> pd.Series:
        null = keys.isna().to_numpy()
        k = keys.fillna(0).to_numpy(np.int64)
        at = np.where(null, last, np.clip(np.searchsorted(starts, k, "right") - 1, 0, last)) if len(starts) else np.zeros(len(k), int)
        # Marked by a negative number: a copy for the end of the range before.
        first = ~null & (starts[at] == k) if len(starts) else np.ones(len(k), bool)
        return pd.Series([[int(b), -1 - (int(b) - 1 if b else last)] if f else [int(b)] for b, f in zip(at, first, strict=True)])

    dealt = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.explode(targets(F.col(key))).alias("to"))
    dealt = dealt.select("k", "t", (F.col("to") < 0).alias("copy"), F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("part"))
    dealt = dealt.repartition("part").sortWithinPartitions("part", "copy", F.col("k").asc_nulls_last(), F.xxhash64("t"))

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        held = None
        for frame in frames:
            for k, t, copy, part in zip(frame["k"].tolist(), frame["t"].tolist(), frame["copy"].tolist(), frame["part"].tolist(), strict=True):
                if held is not None and held[2] == part:
                    yield held[0], held[1], t
                    held = None
                if not copy:
                    held = (k, t, part)
        assert held is None, "a range without the start of the next one"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from make(pairs(frames))

    # Keys travel as text, so that nulls don't turn numbers into floats.
    dealt = dealt.withColumn("k", F.col("k").cast("string"))
    return dealt.select("k", "t", "copy", "part").mapInPandas(run, schema)


def edited(text: str | None, after: str | None) -> str:
    """The text with its last half (code points, rounded down) replaced by the first as many of the next text."""
    text, half = text or "", len(text or "") // 2
    return text[: len(text) - half] + (after or "")[:half]


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint each text and its edited text, and compare it with that and with the next document.

    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (estimated
    resemblance), n_distinct and in_next (estimated containment in the next document), one row for each row
    of docs. Null texts are empty; two texts without words are alike (1.0), one of them is unlike any other (0.0).
    A single document is its own successor. See with_next() for ties and null keys. Extra columns are
    ignored, an empty table gives an empty result.
    """

    def make(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        out, known = [], (None, None)
        for at, t, after in rows:
            t, after = t or "", after or ""
            own = known[1] if known[0] == t else Sketch(shingle_hashes(t, shingle), k)
            following = Sketch(shingle_hashes(after, shingle), k)
            known = (after, following)
            new = edited(t, after)
            changed = Sketch(shingle_hashes(new, shingle), k)
            out.append((at, len(t), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.hex(), changed.hex(), own.resemblance(changed), own.resemblance(following), own.distinct(), own.containment(following)))
            if len(out) == 1000:
                yield pd.DataFrame(out)
                out = []
        if out:
            yield pd.DataFrame(out)

    schema = "k string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, in_next double"
    kind = take(docs, key).dtypes[0][1]
    got = with_next(docs, make, schema, key, text)
    return got.select(F.col("k").cast(kind).alias(key), *[c.split()[0] for c in schema.split(", ")[1:]])
