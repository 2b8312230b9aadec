"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotmill.llm.common import give_back, take

UND = "und"
#: A text's bytes are labelled in windows of so many, each read with so many more bytes of the text on either side.
WINDOW = 256
CONTEXT = 16
#: The training sample: at most so many documents of each language, and so many short windows of each document.
SAMPLE_DOCS = 200
SAMPLE_WINDOWS = 40
TRAIN_BYTES = 40
#: Bytes of text that are cut into windows together, and numbers that a batch of windows may hold of each kind.
BLOCK_BYTES = 1_000_000
BATCH_CELLS = 4_000_000


@dataclass
class Model:
    """Weights by name, the languages, and the hidden size of each direction."""

    langs: list[str]
    w: dict[str, np.ndarray]
    hidden: int


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): like tanh, but much faster. Its slope is (1 - |value|) squared."""
    return x / (1 + np.abs(x))


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * (_squash(x) + 1)


def _gate_slope(g: np.ndarray) -> np.ndarray:
    return 0.5 * (1 - np.abs(2 * g - 1)) ** 2


def _init(n_langs: int, hidden: int, embed: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {"E": rng.normal(0, 0.3, (257, embed))}
    for d in "fb":
        w[d + "W"] = rng.normal(0, embed**-0.5, (embed, 3 * hidden))
        w[d + "U"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
        w[d + "b"] = np.zeros(3 * hidden)
    w["O"] = rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, n_langs))
    w["o"] = np.zeros(n_langs)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _run(w: dict, d: str, x: np.ndarray, mask: np.ndarray, hidden: int, keep: bool = False):
    """Hidden states of one direction; x: (time, batch, 3 hidden) inputs, mask: (time, batch, 1)."""
    steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
    h = np.zeros((x.shape[1], hidden), np.float32)
    out, tape = np.empty((len(x), x.shape[1], hidden), np.float32), {}
    u = w[d + "U"]
    for t in steps:
        a = h @ u
        zr = _gate(x[t, :, : 2 * hidden] + a[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        n = _squash(x[t, :, 2 * hidden :] + r * a[:, 2 * hidden :])
        new = n + z * (h - n)
        if keep:
            tape[t] = (h, z, r, n, a[:, 2 * hidden :])
        h = np.where(mask[t], new, h)
        out[t] = h
    return out, tape


def _pad(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time, batch) byte ids, 256 where a word has ended, and their mask."""
    n = max(map(len, words))
    ids = np.full((n, len(words)), 256, np.int64)
    for i, word in enumerate(words):
        ids[: len(word), i] = np.frombuffer(word, np.uint8)
    return ids, ids < 256


def _forward(m: Model, words: list[bytes], keep: bool = False):
    ids, mask = _pad(words)
    e = m.w["E"][ids]
    states, tapes = [], {}
    for d in "fb":
        s, tapes[d] = _run(m.w, d, e @ m.w[d + "W"] + m.w[d + "b"], mask[:, :, None], m.hidden, keep)
        states.append(s)
    both = np.concatenate(states, axis=2)
    logits = both @ m.w["O"] + m.w["o"]
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    return ids, mask, e, both, p, tapes


def _backward(m: Model, words: list[bytes], target: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy over all positions, by backpropagation through time."""
    ids, mask, e, both, p, tapes = _forward(m, words, keep=True)
    h = m.hidden
    dl = p.copy()
    dl[:, np.arange(len(words)), target] -= 1
    dl *= mask[:, :, None] / mask.sum()
    g = {k: np.zeros_like(v) for k, v in m.w.items()}
    g["O"] = np.einsum("tbh,tbl->hl", both, dl)
    g["o"] = dl.sum(axis=(0, 1))
    dboth, de = dl @ m.w["O"].T, np.zeros_like(e)
    for k, d in enumerate("fb"):
        carry, u = np.zeros((len(words), h), np.float32), m.w[d + "U"]
        for t in range(len(ids) - 1, -1, -1) if d == "f" else range(len(ids)):
            prev, z, r, n, a_n = tapes[d][t]
            dh = dboth[t, :, k * h : (k + 1) * h] + carry
            live = mask[t][:, None]
            dnew = np.where(live, dh, 0)
            dn = dnew * (1 - z) * (1 - np.abs(n)) ** 2
            dz = dnew * (prev - n) * _gate_slope(z)
            dr = dn * a_n * _gate_slope(r)
            dx, da = np.concatenate([dz, dr, dn], axis=1), np.concatenate([dz, dr, dn * r], axis=1)
            g[d + "W"] += e[t].T @ dx
            g[d + "b"] += dx.sum(axis=0)
            g[d + "U"] += prev.T @ da
            de[t] += dx @ m.w[d + "W"].T
            carry = np.where(live, dnew * z + da @ u.T, dh)
    np.add.at(g["E"], ids, de * mask[:, :, None])
    return g


def train(by_lang: dict[str, list[bytes]], hidden: int = 8, embed: int = 8, steps: int = 250, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Model:
    """Fit a model on byte sequences by language, each language equally often. The same input gives the same model."""
    langs = sorted(k for k, v in by_lang.items() if v)
    rng = np.random.default_rng(seed)
    m = Model(langs, _init(len(langs), hidden, embed, rng), hidden)
    if len(langs) < 2:
        return m
    mean, square = ({k: np.zeros_like(v) for k, v in m.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        target = rng.integers(0, len(langs), batch)
        words = [by_lang[langs[k]][rng.integers(len(by_lang[langs[k]]))] for k in target]
        for k, g in _backward(m, words, target).items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            lr = rate * (1 - 0.9 * step / steps)
            m.w[k] -= (lr * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return m


def windows(data: bytes) -> list[tuple[int, int, int, int]]:
    """(lo, begin, end, hi) of each window: the bytes [begin, end) are labelled, [lo, hi) are read. Every byte is labelled once."""
    n = len(data)
    return [(max(0, i - CONTEXT), i, min(n, i + WINDOW), min(n, i + WINDOW + CONTEXT)) for i in range(0, n, WINDOW)]


def position_probabilities(m: Model, data: bytes) -> np.ndarray:
    """(bytes, languages): the label probabilities of every position of a text, window by window."""
    made = [_forward(m, [data[lo:hi]])[4][begin - lo : end - lo, 0] for lo, begin, end, hi in windows(data)]
    return np.concatenate(made) if made else np.zeros((0, len(m.langs)))


class Labeller:
    """Labels texts by the sums of their positions' probabilities."""

    def __init__(self, m: Model):
        self.m = m
        # Apart for the gates z and r and the new state: whole arrays are faster than columns of wider ones.
        each = lambda x: [np.ascontiguousarray(y, np.float32) for y in np.split(x, 3, axis=1)]
        self.tables = {d: each(np.vstack([m.w["E"][:256] @ m.w[d + "W"] + m.w[d + "b"], np.zeros((1, 3 * m.hidden))])) for d in "fb"}
        self.loops = {d: each(m.w[d + "U"]) for d in "fb"}

    def _sums(self, ids: np.ndarray, core: np.ndarray) -> np.ndarray:
        """(windows, languages): probabilities summed over the positions in core; both (time, windows), ids 256 after a window's end."""
        h, live = self.m.hidden, (ids < 256)[:, :, None].astype(np.float32)
        padded = live.min(axis=(1, 2)) < 1
        logits = np.empty((len(ids), len(self.m.langs), ids.shape[1]), np.float32)
        logits[:] = self.m.w["o"][:, None]
        for k, d in enumerate("fb"):
            (tz, tr, tn), (uz, ur, un), out = self.tables[d], self.loops[d], np.ascontiguousarray(self.m.w["O"][k * h : (k + 1) * h].T)
            state, z, r, n, a = (np.zeros((ids.shape[1], h), np.float32) for _ in range(5))
            for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
                for gate, table, u in ((z, tz, uz), (r, tr, ur)):
                    np.take(table, ids[t], axis=0, out=gate, mode="clip")
                    np.matmul(state, u, out=a)
                    gate += a
                    np.abs(gate, out=a)
                    a += 1
                    gate /= a
                    gate *= 0.5
                    gate += 0.5
                np.take(tn, ids[t], axis=0, out=n, mode="clip")
                np.matmul(state, un, out=a)
                a *= r
                n += a
                np.abs(n, out=a)
                a += 1
                n /= a
                state -= n
                state *= z
                state += n
                if padded[t]:
                    state *= live[t]
                logits[t] += out @ state.T
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (core / logits.sum(axis=1))[:, None]
        return logits.sum(axis=0, dtype=np.float64).T

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): probabilities summed over all positions of each text."""
        total = np.zeros((len(texts), len(self.m.langs)))
        flat = np.frombuffer(b"".join(texts), np.uint8)
        cut = [(base + lo, begin - lo, end - lo, hi - lo, i) for i, (t, base) in enumerate(zip(texts, np.cumsum([0, *map(len, texts)]).tolist(), strict=False)) for lo, begin, end, hi in windows(t)]
        cut = np.array(sorted(cut, key=lambda w: w[3]), np.int64).reshape(-1, 5)
        at, count = 0, max(1, BATCH_CELLS // ((WINDOW + 2 * CONTEXT) * max(len(self.m.langs), self.m.hidden)))
        while at < len(cut):
            lo, begin, end, n, text = cut[at : at + count].T
            time = np.arange(n[-1])[:, None]
            ids = np.where(time < n, flat[np.minimum(lo + time, len(flat) - 1)].astype(np.intp), 256)
            got = self._sums(ids, ((time >= begin) & (time < end)).astype(np.float32))
            np.add.at(total, text, np.rint(got * 4096) / 4096)  # rounded: alike in any batch
            at += count
        return total

    def __call__(self, texts: list[str | None] | pa.Array) -> tuple[list[str], list[float]]:
        langs, scores, some, size = [], [], [], 0
        for i, t in enumerate(texts, 1):
            t = t.as_py() if isinstance(t, pa.Scalar) else t
            some.append(t.encode("utf-8", "surrogatepass") if t and self.m.langs and any(map(str.isalpha, t)) else b"")
            size += len(some[-1])
            if size < BLOCK_BYTES and i < len(texts):
                continue
            for total in self.sums(some) if self.m.langs else [np.zeros(1)] * len(some):
                k = int(total.argmax())
                known = total[k] > 0
                langs.append(self.m.langs[k] if known else UND)
                scores.append(round(float(min(1.0, total[k] / total.sum())), 4) if known else 0.0)
            some, size = [], 0
        return langs, scores


#: The labeller of a Python worker's latest model.
_LABELLERS: dict[bytes, Labeller] = {}


def _labeller(m: Model) -> Labeller:
    mark = b"".join([repr(m.langs).encode(), *(m.w[k].tobytes() for k in sorted(m.w))])
    if mark not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[mark] = Labeller(m)
    return _LABELLERS[mark]


def label(m: Model, text: Column) -> Column:
    """STRUCT<lang_pred, score> of a text column by a trained model."""

    @F.arrow_udf("lang_pred string, score double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = _labeller(m)
        for part in parts:
            langs, scores = labeller(part)
            part = None
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        give_back()

    return run(text)


def held_out(key: Column) -> Column:
    """True for documents that training never sees: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> Model:
    """Train on a bounded sample of the labelled documents that aren't held out.

    All languages that occur are learned. The sample is bounded by `sample_docs` documents of each language (those
    with the smallest hash of id and text) and `sample_windows` windows of TRAIN_BYTES bytes of each, which begin
    anywhere in the whole text. Only the windows come to the driver.
    """
    rows = take(docs, key, text, lang).toDF("id", "text", "lang")
    rows = rows.where(~held_out(F.col("id")) & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull()).withColumn("h", F.xxhash64("id", "text"))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return train({})
    # A hash threshold for each language leaves about twice the rows asked for, wherever they lie.
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * sample_docs / r["count"])))])
    unit = F.pmod(F.xxhash64("h", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    few = rows.select("lang", "h", unit.alias("unit")).where(F.col("unit") <= share[F.col("lang")]).distinct()
    order = Window.partitionBy("lang").orderBy("unit", "h")
    chosen = few.withColumn("no", F.row_number().over(order)).where(F.col("no") <= sample_docs).select("lang", "h")

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        out = []
        for t, seed in zip(texts, seeds, strict=True):
            data = t.encode("utf-8", "surrogatepass") if any(map(str.isalpha, t)) else b""
            last = max(0, len(data) - TRAIN_BYTES)
            starts = np.random.default_rng(abs(seed)).integers(0, last + 1, sample_windows if last else 1)
            out.append([data[i : i + TRAIN_BYTES] for i in starts.tolist() if data])
        return pd.Series(out)

    # At most sample_docs rows of a hash for each language: broadcast. Repeated rows count once.
    got = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "h", cut("text", "h").alias("w"))
    by_lang: dict[str, list[bytes]] = {}
    for r in sorted(got.collect(), key=lambda r: (r["lang"], r["h"])):
        by_lang.setdefault(r["lang"], []).extend(map(bytes, r["w"]))
    return train(by_lang)


def identify(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each row of docs: key, held_out, lang_pred, score. Trains a model on docs if none is given.

    Every byte of a text is a position that the network labels, and a document's probability is the mean over all its
    positions. The state runs both ways over a window of the text (WINDOW bytes and CONTEXT more on either side), so
    memory doesn't depend on a text's length beyond the text.
    lang_pred is `und` with score 0 if the text is null or has no letter, or if nothing could be
    learned (no labelled text, or an empty table). With one language learned, it is the answer with score 1.
    Null keys count as not held out but aren't trained on; repeated rows give repeated results. Extra columns are ignored.
    """
    m = model or fit(docs, key, text, lang)
    rows = take(docs, key, text)
    got = rows.select(F.col(rows.columns[0]).alias("k"), label(m, F.col(text)).alias("r"))
    return got.select(F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), "r.lang_pred", "r.score")


def keep_identified(docs: DataFrame, columns: tuple[str, ...], min_score: float = 0.3, text: str = "text") -> DataFrame:
    """The documents whose language is identified with at least min_score, with the given columns."""
    m = fit(docs)
    rows = take(docs, *columns)
    said = label(m, F.col(text))
    return rows.withColumn("_said", said).where((F.col("_said.lang_pred") != UND) & (F.col("_said.score") >= min_score)).drop("_said")
