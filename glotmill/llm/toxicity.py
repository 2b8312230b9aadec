"""Toxicity: a classifier chain of logistic regressions, trained with out-of-fold predictions."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import take

#: The training sample has about so many labelled documents at most.
SAMPLE = 6_000
#: Words that become features for each category, and the documents in which a word must occur.
WORDS = 300
LEAST_DOCS = 4
#: Standard errors by which a word's log odds must differ between a category's two values.
LEAST_GAIN = 3.0
FOLDS = 5
#: Texts that a worker scores at a time.
ROWS = 250
#: Letters of a word's beginning, which is a feature, too.
STEM = 5
LETTERS = re.compile(r"[^\W\d_]+")
SHAPES = 6


def shapes(text: str) -> list[float]:
    """Surface features: shares of capitals, symbols, digits and repeated words, word length, length."""
    n = max(1, len(text))
    words = text.split()
    upper = sum(map(str.isupper, text)) / n
    letters = sum(map(len, LETTERS.findall(text)))
    return [
        upper, 1 - (letters + len(words)) / n, len(re.findall(r"\d", text)) / n, 1 - len(set(words)) / max(1, len(words)),
        min(3.0, letters / max(1, len(words)) / 8), math.log1p(len(words)) / 8,
    ]


@dataclass
class Chain:
    """Categories in the order of the chain, the vocabulary, and weights (bias last) by category."""

    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)


def terms(text: str) -> set[str]:
    """A text's words in lower case, and the beginnings of longer ones."""
    words = set(LETTERS.findall(text.lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def features(vocabulary: dict[str, int], texts: Sequence[str | None]) -> np.ndarray:
    """Presence of the vocabulary's words, and shapes()."""
    x = np.zeros((len(texts), len(vocabulary) + SHAPES), np.float32)
    for i, t in enumerate(texts):
        t = t or ""
        found = vocabulary.keys() & terms(t)
        x[i, [vocabulary[w] for w in found]] = 1
        x[i, len(vocabulary) :] = shapes(t)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 0.2, steps: int = 25) -> np.ndarray:
    """L2-penalised logistic regression by Newton steps; returns weights with the bias last."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = _sigmoid(x @ w)
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def predict_linear(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def train(texts: list[str], labels: np.ndarray, categories: Sequence[str], fold: np.ndarray) -> Chain:
    """Fit the chain; labels: (documents, categories) of 0, 1 or -1 (unknown), fold: each document's fold.

    A later model's training features are the probabilities that models of the earlier categories, fitted
    without the document's fold, give it. A category of which one value is missing predicts the other.
    """
    bags = [terms(t) for t in texts]
    words: dict[str, np.ndarray] = {}
    for b, row in zip(bags, labels, strict=True):
        for w in b:
            words.setdefault(w, np.zeros(2 * len(categories)))
            words[w] += np.concatenate([row == 1, row == 0])
    totals = np.concatenate([(labels == 1).sum(axis=0), (labels == 0).sum(axis=0)]) if len(texts) else np.zeros(2 * len(categories))
    chosen: set[str] = set()
    for k in range(len(categories)):
        pos, neg = max(1, totals[k]), max(1, totals[k + len(categories)])

        def gain(w: str, k: int = k, pos: float = pos, neg: float = neg) -> float:
            a, b = words[w][k], words[w][k + len(categories)]
            return abs(math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1))) / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))

        often = [w for w, c in words.items() if c[k] + c[k + len(categories)] >= LEAST_DOCS and gain(w) >= LEAST_GAIN]
        chosen |= set(sorted(often, key=lambda w: (-gain(w), w))[:WORDS])
    chain = Chain(list(categories), {w: i for i, w in enumerate(sorted(chosen))})
    x = features(chain.vocabulary, texts)
    for k in range(len(categories)):
        known = labels[:, k] >= 0
        if not known.any() or len(set(labels[known, k])) < 2:
            w = np.zeros(x.shape[1] + 1)
            w[-1] = 30.0 if known.any() and labels[known, k][0] == 1 else -30.0
            chain.weights.append(w)
            x = np.hstack([x, predict_linear(w, x)[:, None]])
            continue
        out = np.zeros(len(texts))
        for f in range(FOLDS):
            rest = known & (fold != f)
            y = labels[rest, k]
            out[fold == f] = predict_linear(fit_linear(x[rest], y), x[fold == f]) if len(set(y)) == 2 else y.mean() if len(y) else 0.5
        chain.weights.append(fit_linear(x[known], labels[known, k]))
        x = np.hstack([x, out[:, None].astype(x.dtype)])
    return chain


def predict(chain: Chain, texts: Sequence[str | None]) -> np.ndarray:
    """(documents, categories): probabilities down the chain, each fed to the later models."""
    x, out = features(chain.vocabulary, texts), []
    for w in chain.weights:
        out.append(predict_linear(w, x))
        x = np.hstack([x, out[-1][:, None].astype(x.dtype)])
    return np.round(np.stack(out, axis=1), 4) if len(texts) else np.zeros((0, len(chain.weights)))


def score(chain: Chain, text: Column) -> Column:
    """STRUCT of a DOUBLE for each category of the chain."""

    @F.arrow_udf(", ".join(f"`{c}` double" for c in chain.categories))
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:  # texts become Python objects a few at a time
            got = [predict(chain, part.slice(i, ROWS).to_pylist()) for i in range(0, len(part), ROWS)]
            all_ = np.concatenate(got) if got else np.zeros((0, len(chain.categories)))
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in all_.T], chain.categories)

    return run(text)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """Train on at most about `sample` labelled documents, chosen by a hash of their key, up to half of them positive for the last category.

    categories: name to a 0/1 expression over labels, in the order of the chain. Null labels are unknown. A
    document with several labels counts as labelled 1 if any of them says so.
    """
    named = labels.select(F.col(key).alias("k"), *[c.cast("int").alias(f"_{i}") for i, c in enumerate(categories.values())]).where("k IS NOT NULL")
    named = named.groupBy("k").agg(*[F.max(f"_{i}").alias(f"_{i}") for i in range(len(categories))])
    last = F.coalesce(F.col(f"_{len(categories) - 1}"), F.lit(0))
    counts = {r[0]: r[1] for r in named.groupBy(last.alias("v")).count().collect()}
    share = F.lit(1.0)
    for v, n in counts.items():
        share = F.when(last == v, F.lit(min(1.0, sample / 2 / n))).otherwise(share)
    unit = F.pmod(F.xxhash64("k", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    # About `sample` rows of a key and labels: small enough to send to every task that reads texts.
    rows = named.where(unit < share).orderBy(F.xxhash64("k", F.lit(6)), "k").limit(sample + sample // 10)
    texts = take(docs, key, text).toDF("k", "t").where(F.col("t").isNotNull())
    # One text of each key: repeated rows and ties of keys don't make the sample larger.
    one = texts.join(F.broadcast(rows), "k").groupBy("k").agg(F.min_by("t", F.xxhash64("t")).alias("t"), *[F.first(c).alias(c) for c in rows.columns[1:]])
    got = one.toPandas().sort_values("k", ignore_index=True)
    values = got[[f"_{i}" for i in range(len(categories))]].fillna(-1).to_numpy(int) if len(got) else np.zeros((0, len(categories)), int)
    fold = np.array([zlib.crc32(str(k).encode()) % FOLDS for k in got["k"]], int)
    return train(got["t"].tolist(), values, list(categories), fold)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """key, p_low_quality, p_toxic and toxic for each row of docs; the chain is low quality, then toxic.

    labels has key, quality and toxic (0/1). Null texts are empty ones and get what the model says of an empty
    text. Without labels nothing is toxic. Repeated rows and null keys each give their row; extra columns are
    ignored; an empty table gives an empty result. Words count by presence anywhere in the whole text.
    """
    rows = take(docs, key, text)
    said = take(labels, key, "quality", "toxic")
    chain = fit(rows, said, {"p_low_quality": 1 - F.col("quality"), "p_toxic": F.col("toxic")}, key, text)
    out = rows.select(F.col(key), score(chain, F.col(text)).alias("r"))
    return out.select(key, "r.p_low_quality", "r.p_toxic", (F.col("r.p_toxic") >= threshold).alias("toxic"))
