"""Quality classification by regularised quadratic discriminant analysis.

A text is described by transformed counts and shares (log, square root). Each class has a mean and a covariance shrunk
towards a pooled, then a scaled identity matrix, of which the inverse Cholesky factor is kept. A text's log-density difference
from Mahalanobis distances is calibrated to a probability by a logistic of one variable.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents

#: Labelled rows of each class that the fit reads at most, by hash order of doc_id.
SAMPLE = 20_000
_LETTERS = re.compile(r"[^\W\d_]+")
_ENDS = re.compile(r"[.!?]")
NAMES = ("length", "words", "word_length", "distinct", "top_word", "repeats", "pairs", "letters", "upper", "digits", "symbols", "ends", "lines", "line_distinct", "line_length", "packed", "long_words", "short_words", "capital_words", "odd_words")


def features(text: str) -> list[float]:
    """Transformed statistics of a whole text; defined for the empty text too."""
    n = len(text)
    words = text.split()
    k = len(words)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda x, of: math.sqrt(x / of) if of else 0.0
    letters = sum(map(len, _LETTERS.findall(text)))
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    spaces = k - 1 + len(lines)
    digits = len(re.findall(r"\d", text))
    raw = text.encode("utf-8", "surrogatepass")
    packed = sum(len(zlib.compress(raw[i : i + 65536], 1)) for i in range(0, len(raw), 65536))
    lengths = Counter(map(len, words))
    return [
        math.log1p(n),
        math.log1p(k),
        math.log1p((n - spaces) / k if k else 0),
        share(len(counts), k),
        share(max(counts.values(), default=0), k),
        share(same, k),
        share(pairs, k),
        share(letters, n),
        share(upper, k),
        share(digits, n),
        share(max(0, n - letters - digits - spaces), n),
        share(len(_ENDS.findall(text)), k),
        math.log1p(len(lines)),
        share(len(set(lines)), len(lines)),
        math.log1p(k / len(lines) if lines else 0),
        share(packed, len(raw)),
        share(sum(c for x, c in lengths.items() if x > 15), k),
        share(sum(c for x, c in lengths.items() if x < 3), k),
        share(sum(map(str.istitle, words)), k),
        share(k - sum(map(bool, map(_LETTERS.fullmatch, (w.rstrip(".,") for w in words)))), k),
    ]


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    #: Inverses of the covariances' Cholesky factors.
    factors: list[np.ndarray]
    slope: float
    shift: float


def _difference(x: np.ndarray, model: Model) -> np.ndarray:
    """Log density of class 1 less that of class 0."""
    z = (x - model.center) / model.scale
    out = []
    for mean, factor in zip(model.means, model.factors, strict=True):
        r = factor @ (z - mean).T
        out.append(-0.5 * (r * r).sum(axis=0) + np.log(np.diag(factor)).sum())
    return out[1] - out[0]


def probability(x: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * _difference(x, model) / 10 + model.shift, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = 0.3, identity: float = 0.05) -> Model:
    """A class without rows takes the statistics of all rows, so that its score is the calibrated share of the other."""
    d = len(NAMES)
    x = x.reshape(-1, d)
    if not len(x):
        return Model(np.zeros(d), np.ones(d), [np.zeros(d)] * 2, [np.eye(d)] * 2, 0.0, 0.0)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - center) / scale
    spread = lambda v: np.cov(v.T, bias=True).reshape(d, d) if len(v) > 1 else np.eye(d)
    parts = [z[y == k] if (y == k).any() else z for k in (0, 1)]
    common = sum(len(p) * spread(p) for p in parts) / sum(map(len, parts))
    means, factors = [], []
    for part in parts:
        own = (1 - pooled) * spread(part) + pooled * common
        own = (1 - identity) * own + identity * np.trace(own) / d * np.eye(d) + 1e-6 * np.eye(d)
        means.append(part.mean(axis=0))
        factors.append(np.linalg.inv(np.linalg.cholesky(own)))
    model = Model(center, scale, means, factors, 1.0, 0.0)
    g = np.clip(_difference(x, model) / 10, -50, 50)
    a, b = 1.0, 0.0
    for _ in range(50):  # logistic calibration by Newton steps, with a weak ridge
        p = 1 / (1 + np.exp(-np.clip(a * g + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        grad = np.array([(g * (y - p)).sum() - 1e-2 * a, (y - p).sum() - 1e-2 * b])
        hess = np.array([[(w * g * g).sum() + 1e-2, (w * g).sum()], [(w * g).sum(), w.sum() + 1e-2]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return Model(center, scale, means, factors, float(a), float(b))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["doc_id", "x"])

    return documents(docs).mapInArrow(run, "doc_id long, x array<double>")


def score(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, by its whole text alone.

    The model comes from labelled rows whose crc32(doc_id as text) mod `fold` is not `held`, at most `sample` of each
    class; rows with a null label don't count. Null and empty texts have features like any other. Repeated rows are each
    scored; a null doc_id is not held out. Without labels every score is 0.5. An empty table gives an empty result; other
    columns are ignored.
    """
    x = Scratch(docs.sparkSession).save(described(docs), "features")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(fold))
    pool = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(remainder != held)
    picked = [pool.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    rows = sorted((r["doc_id"], r["y"], r["x"]) for r in x.join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("doc_id", "y", "x").collect())
    model = fit(np.array([r[2] for r in rows]), np.array([r[1] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(values, model))], ["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(remainder == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
