"""Packing: shortest-pack-first over the length histogram, then joined back to the documents by rank."""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glotmill.llm.common import give_back, shared_dir, take

SIZE = 2048
END = 1
#: A document is cut to fill a sequence only if at least so many ids fit.
LEAST_CUT = 16
#: Documents whose rests are equally long are ranked in so many groups at least and at most, one more for each million.
GROUPS = (64, 4096)
#: Characters of text whose distinct words are encoded together, and whose ids leave the worker together.
BLOCK_CHARS = 2_000_000
TOKENIZER = "word_bpe_49k.json"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: How the tokenizer cuts printable ASCII, in lower case.
#: Words of letters that have one lower case and one normal form, and words of ASCII letters that end in punctuation.
PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+$"
ENDED = r"^[A-Za-z]+[!-/:-@\[-`{-~]+$"
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class WordEncoder:
    """The tokenizer on single words. Its own merges run in a faster engine, in which byte 0 ends a piece, on words
    that no normal form changes: Latin letters, and printable ASCII. Others are left to the tokenizer itself."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, letters = model["vocab"], _byte_letters()
        ranks, ids = {bytes([b]): b for b in range(256)}, [vocabulary.get(c, 0) for c, b in sorted(letters.items(), key=lambda x: x[1])]

        def add(a: str, b: str) -> None:
            raw = b"".join(bytes(map(letters.__getitem__, x.removesuffix("</w>"))) + b"\0" * x.endswith("</w>") for x in (a, b))
            if raw in ranks:
                raise ValueError(f"two merges give {a + b!r}")
            ranks[raw] = len(ids)
            ids.append(vocabulary[a + b])

        for c, b in letters.items():
            if b:
                add(c, "</w>")
        for merge in model["merges"]:
            add(*(merge.split(" ") if isinstance(merge, str) else merge))
        self.ids, self.last = np.array(ids, "<u4"), np.array([x.endswith(b"\0") for x in ranks])
        self.engine = tiktoken.Encoding("pieces", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where each word's begin and how many they are."""
        letters = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        ended = pc.match_substring_regex(words, ENDED).to_numpy(zero_copy_only=False)
        apart = pc.replace_substring_regex(pc.ascii_lower(words.filter(pa.array(ended))), "^([a-z]+)(.+)$", "\\1\0\\2")
        parts = [(letters, pc.utf8_lower(words.filter(pa.array(letters))), 1), (ended, apart, 2)]
        left = np.flatnonzero(~letters & ~ended)
        texts = words.take(pa.array(left)).to_pylist()
        ascii_ = np.array([t.isascii() and t.isprintable() and "<|" not in t and t != "" for t in texts], bool)
        pieces = [ASCII_PIECES.findall(t.lower()) for t, f in zip(texts, ascii_, strict=True) if f]
        parts.append((left[ascii_], pa.array(["\0".join(x) for x in pieces], pa.string()), np.array([len(x) for x in pieces], np.int64)))
        start, n, ids, base = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, "<u4")], 0
        for at, plain, times in parts:
            if len(plain):
                line = pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), "\0")[0].as_py() + "\0"
                found = np.asarray(self.engine.encode_to_numpy(line))
                ends = np.concatenate([[0], np.flatnonzero(self.last[found]) + 1])[np.cumsum(np.full(len(plain), times))]
                n[at], start[at] = np.diff(ends, prepend=0), base + np.concatenate([[0], ends[:-1]])
                ids.append(self.ids[found])
                base += len(found)
        other, texts = left[~ascii_], [t for t, f in zip(texts, ascii_, strict=True) if not f]
        for i in range(0, len(other), 4096):
            at, some = other[i : i + 4096], texts[i : i + 4096]
            # A token belongs to the word that its first character lies in.
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begin = np.cumsum([0, *(len(t) + 1 for t in some[:-1])])
            firsts = np.fromiter((o[0] for o in e.offsets), np.int64, len(e))
            ends = np.searchsorted(np.searchsorted(begin, firsts, "right"), np.arange(1, len(some) + 1), "right")
            n[at], start[at] = np.diff(ends, prepend=0), base + np.concatenate([[0], ends[:-1]])
            ids.append(np.array(e.ids, "<u4"))
            base += len(e)
        return np.concatenate(ids), start, n


_ENCODERS: dict[str, WordEncoder] = {}


def tokenize(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text, equal to encode(text, add_special_tokens=False).

    The tokenizer drops white space and never joins across it, so each distinct word of a block of texts is encoded once.
    """
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    for lo, hi in blocks(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)):
        split = pc.ascii_split_whitespace(texts.slice(lo, hi - lo).fill_null(""))
        words = split.flatten().dictionary_encode()
        ids, start, n = _ENCODERS[path](words.dictionary)
        word = words.indices.to_numpy()
        n, ends = n[word], np.concatenate([[0], np.cumsum(n[word])])
        all_ = ids[np.repeat((start[word] - ends[:-1]).astype(np.int32), n) + np.arange(ends[-1], dtype=np.int32)]
        bounds = split.offsets.to_numpy()
        bounds = ends[bounds - bounds[0]].tolist()
        yield from (all_[x:y] for x, y in zip(bounds, bounds[1:], strict=False))


def blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """[lo, hi) of runs of texts of about BLOCK_CHARS bytes, one text at least."""
    at = size = 0
    for i, n in enumerate(sizes.tolist(), 1):
        size += n
        if size >= BLOCK_CHARS or i == len(sizes):
            yield at, i
            at, size = i, 0


class Plan:
    """How the pieces of each length go into sequences.

    For a length, ranks [low, ...) up to the next row's low go to sequences base, base + 1, ... at `offset`,
    with their first `take` ids; what is left has the rank `then` + (rank - low) among the pieces of
    length - take.
    """

    def __init__(self, counts: dict[int, int], size: int = SIZE, least: int = LEAST_CUT):
        pending: dict[int, int] = defaultdict(int, {k: v for k, v in counts.items() if k > 0 and v > 0})
        left = sum(k * v for k, v in pending.items())
        budget, self.n = -(-left // size), 0
        free: list[list[list[int]]] = [[] for _ in range(size + 1)]
        rows, top = [], 0

        def put(space: int, base: int, n: int) -> None:
            nonlocal top
            if space and n:
                free[space].append([base, n])
                top = max(top, space)

        for length in range(size, 0, -1):
            rank = 0
            while rank < pending[length]:
                while top and not free[top]:
                    top -= 1
                n = pending[length] - rank
                if top < length and self.n < budget:  # a new sequence
                    m = min(n, budget - self.n)
                    put(size, self.n, m)
                    self.n += m
                elif top >= length or top >= least:  # into the emptiest, or cut to fill it
                    base, m = free[top].pop()
                    m, rest, given = min(n, m), m - min(n, m), min(length, top)
                    put(top, base + m, rest)
                    rows.append((length, rank, base, size - top, given, pending[length - given]))
                    if given < length:
                        pending[length - given] += m
                    put(top - given, base, m)
                    rank += m
                    left -= m * given
                else:
                    budget = self.n + -(-left // size)
        table = np.array(rows or [(0, 0, 0, 0, 0, 0)], np.int64)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        self.key = (table[:, 0] << 44) | table[:, 1]
        self.low, self.base, self.offset, self.take, self.then = table[:, 1:].T

    def place(self, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(rows, ids before, sequence, offset, ids taken) for each round of cuts, of pieces by length and rank."""
        at, start = np.flatnonzero(length > 0), np.zeros(len(length), np.int64)
        length, rank = length.copy(), rank.copy()
        while len(at):
            i = np.searchsorted(self.key, (length[at] << 44) | rank[at], "right") - 1
            step = rank[at] - self.low[i]
            yield at, start[at], self.base[i] + step, self.offset[i], self.take[i]
            start[at] += self.take[i]
            length[at] -= self.take[i]
            rank[at] = self.then[i] + step
            at = at[length[at] > 0]


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, size: int = SIZE, end: int = END, with_ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most `size` ids.

    A document's ids are those of the tokenizer, then `end`. Returns a row for each piece: key, start,
    length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the ids (BINARY, little-endian 32
    bits). Pieces of a sequence follow each other without gaps from offset 0. Null and empty texts have the
    id `end` alone; repeated rows are packed each; null keys stay null. Extra columns are ignored, an empty
    table gives an empty result.

    Every run of `size` ids is a sequence of its own. The rests are counted by length; lengths are placed longest first,
    each into the emptiest sequence (shortest pack first), with groups of equally filled sequences handled as
    one count. New sequences are opened until their number suffices for all ids; then a piece that fits
    nowhere is cut to fill the emptiest sequence, and its rest goes back to the histogram.
    That plan has a few thousand rows at any input size and goes to every task. Pieces get
    their rank within a length from a window over small salted groups plus the groups' running counts, so a
    length that a third of all rows have isn't ranked in one task. Texts aren't shuffled; ids are, once,
    and are then kept in the shared folder for the placing.
    """
    path, spark = tokenizer or default_tokenizer(), docs.sparkSession
    rows = take(docs, key, text)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in blocks(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)):
                part = batch.slice(lo, hi - lo)
                ids = pa.array([stored(x, end) for x in tokenize(part.column(1), path)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["k", "ids"])
            batch = part = ids = None
        give_back()

    salts = min(GROUPS[1], max(GROUPS[0], math.ceil(rows.count() / 1_000_000)))
    kind = rows.schema[0].dataType.simpleString()
    made = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(ids_of, f"k {kind}, ids binary").withColumn("h", F.xxhash64("ids"))
    wide = F.when(F.substring("ids", 1, 1) == F.lit(b"2"), 2).otherwise(4)
    made = made.withColumn("n", ((F.octet_length("ids") - 1) / wide).cast("long"))
    # Equal rows differ by their place, so that they don't meet in one group.
    made = made.withColumns({"rest": F.col("n") % size, "salt": F.pmod(F.xxhash64("k", "h", F.monotonically_increasing_id()), F.lit(salts))})
    order = Window.partitionBy("rest", "salt").orderBy("k", "h")
    folder = f"{shared_dir(spark)}/packing-{uuid.uuid4().hex}"
    made.withColumn("row", F.row_number().over(order) - 1).drop("h").write.option("compression", "zstd").parquet(folder)
    made = spark.read.parquet(folder)

    # At most size * GROUPS[1] counts, whatever the input.
    groups = made.groupBy("rest", "salt").agg(F.count("*").alias("c")).toPandas()
    counts = np.zeros((size, salts), np.int64)
    counts[groups["rest"].to_numpy(int), groups["salt"].to_numpy(int)] = groups["c"].to_numpy(int)
    longest = made.agg(F.max("n")).first()[0] or 0
    plan = Plan({k: int(n) for k, n in enumerate(counts.sum(axis=1))}, size)
    return _placed(made, counts, plan, longest // size + 1, size, with_ids).withColumnRenamed("k", key)


def stored(ids: np.ndarray, end: int) -> bytes:
    """The ids and `end` in 16 bits each, if they are that small, or else 32; the first byte says which."""
    ids = np.append(ids, np.uint32(end))
    return b"2" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"4" + ids.astype("<u4").tobytes()


def piece(ids: bytes, start: int, n: int) -> bytes:
    """n ids from `start` on, little-endian 32 bits, of ids stored in 16 or 32 bits."""
    if ids[:1] == b"4":
        return ids[1 + 4 * start : 1 + 4 * (start + n)]
    return np.frombuffer(ids, "<u2", n, 1 + 2 * start).astype("<u4").tobytes()


def _placed(made: DataFrame, counts: np.ndarray, plan: Plan, fulls: int, size: int, with_ids: bool) -> DataFrame:
    before = np.cumsum(counts, axis=1) - counts  # rank of a group's first row within its length
    numbers = np.cumsum(counts.sum(axis=1)) - counts.sum(axis=1)  # number of a length's first document

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame["ids"].tolist()
            total, rest = frame["n"].to_numpy(np.int64), frame["rest"].to_numpy(np.int64)
            rank = before[rest, frame["salt"].to_numpy(np.int64)] + frame["row"].to_numpy(np.int64)
            out = []
            number = numbers[rest] + rank  # a document's own number, by which its full sequences are named
            full = total // size
            at = np.repeat(np.arange(len(total)), full)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
            out.append((at, nth * size, plan.n + number[at] * fulls + nth, np.zeros(len(at), np.int64), np.full(len(at), size)))
            for rows, start, sequence, offset, taken in plan.place(rest, rank):
                out.append((rows, full[rows] * size + start, sequence, offset, taken))
            at, start, sequence, offset, taken = (np.concatenate(x) for x in zip(*out, strict=True))
            places = zip(at.tolist(), start.tolist(), taken.tolist(), strict=True)
            if with_ids:
                cut = [piece(ids[i], a, b) for i, a, b in places]
                more = {"ids_crc32": [zlib.crc32(x) for x in cut], "ids": cut}
            else:
                more = {"ids_crc32": [zlib.crc32(piece(ids[i], a, b)) for i, a, b in places]}
            done = {"k": frame["k"].iloc[at].to_numpy(), "start": start, "length": taken, "doc_tokens": total[at], "sequence_id": sequence, "offset": offset} | more
            yield pd.DataFrame({c: done[c] for c in names})
            frame = ids = cut = done = more = None
        give_back()

    # Keys travel as text, so that nulls don't turn numbers into floats.
    schema = "k string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    rows = made.select(F.col("k").cast("string").alias("k"), "ids", "n", "rest", "salt", "row")
    return rows.mapInPandas(place, schema).withColumn("k", F.col("k").cast(dict(made.dtypes)["k"]))
