"""Compression-distance classification of toxicity.

Two zstandard dictionaries are trained, one on windows of ordinary documents, one on the toxic passages of toxic documents.
Labels are of documents, and most of a toxic document is ordinary text, on which a dictionary would be trained instead. So
the passages are found first: parts of words covered by character grams that toxic documents have significantly more often
(a likelihood-ratio test, which rare grams can pass too). Each window of a text is compressed with the ordinary dictionary
and with both together, the toxic one in front, so that ordinary matter costs the same in both. A document's counts of
windows by the bytes gained go through a logistic calibration. Its features come from dictionaries trained on the other
half of the rows, so that no document is measured with a dictionary that has seen it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, documents
from .likeness import shingles

#: Labelled rows of each class that the fit reads at most, and the longest text among them, in bytes.
SAMPLE, SAMPLE_BYTES = 3000, 20_000
#: Windows, by hash order, that the ordinary dictionary is trained on at most, and the size of a dictionary.
TRAINED, SIZE = 60_000, 16_384
#: Least likelihood ratio of a toxic gram, its length, and the characters beyond it that a passage takes in.
RATIO, GRAM, MARGIN = 14.0, 5, 2
#: Bytes of samples below which a dictionary is the samples themselves, without training: zstandard keeps next to nothing of
#: so little. Seen only where there are about a hundred toxic documents or fewer to learn from.
FEW = 4096
WORDS = 6
GAINS = (2, 3, 4, 6, 8, 11)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def windows(text: str, words: int = WORDS) -> list[bytes]:
    found = text.lower().encode("utf-8", "surrogatepass").split()
    return [b" %b " % b" ".join(found[i : i + words]) for i in range(0, len(found), words)]


class Gauge:
    """Document features: counts of windows by how many bytes the toxic dictionary gains over the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        def packer(content: bytes):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            # thorough matching: a match of four bytes already counts in windows this short
            how = z.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=16, search_log=4, min_match=4, strategy=z.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=how)
            return z.ZstdCompressor(dict_data=d, compression_params=how).compress

        self.ordinary, self.toxic = packer(ordinary), packer(toxic)

    def gains(self, text: str) -> np.ndarray:
        w = windows(text)
        a = np.fromiter(map(len, map(self.ordinary, w)), dtype=np.int64, count=len(w))
        return a - np.fromiter(map(len, map(self.toxic, w)), dtype=np.int64, count=len(w))

    def features(self, text: str) -> np.ndarray:
        g = self.gains(text)
        beyond = [np.count_nonzero(g >= t) for t in GAINS]
        share = [b / max(1, len(g)) for b in beyond]
        return np.array([math.log1p(b) for b in beyond] + [math.sqrt(s) for s in share] + [float(min(20, g.max(initial=0))), math.log1p(len(g))])


def _words(text: str) -> list[bytes]:
    return [b" %b " % w for w in text.lower().encode("utf-8", "surrogatepass").split()]


def _grams(word: bytes, n: int = GRAM) -> set[bytes]:
    return {word[i : i + n] for i in range(len(word) - n + 1)}


def toxic_grams(toxic: list[str], ordinary: list[str], weights: tuple[list[float], list[float]] | None = None, least: float = RATIO) -> set[bytes]:
    """Grams within words that more of the toxic texts have than chance allows: a likelihood ratio of `least` or more.

    `weights` are of the toxic and of the ordinary texts; copies of one text should count as one."""
    weights = weights or ([1.0] * len(toxic), [1.0] * len(ordinary))
    n, m = map(sum, weights)
    held = []
    for texts, each in zip((toxic, ordinary), weights, strict=True):
        found: dict[bytes, float] = {}
        for t, w in zip(texts, each, strict=True):
            for g in set().union(*map(_grams, set(_words(t)))):
                found[g] = found.get(g, 0.0) + w
        held.append(found)

    def ratio(a: float, b: float) -> float:
        even = (a + b) / (n + m)
        return 2 * (a * math.log(a / (even * n)) + (b * math.log(b / (even * m)) if b else 0.0))

    return {g for g, a in held[0].items() if a * m > held[1].get(g, 0.0) * n and ratio(a, held[1].get(g, 0.0)) >= least}


def passages(text: str, grams: set[bytes], margin: int = MARGIN) -> list[bytes]:
    """The parts of a text's words that toxic grams cover, with a margin after them."""
    out = []
    for w in _words(text):
        on = [i for i in range(len(w) - GRAM + 1) if w[i : i + GRAM] in grams]
        if on:
            out.append(w[on[0] : on[-1] + GRAM + margin])
    return out


def copies(texts: list[str]) -> list[int]:
    """A number for each text, the same for texts that are linked by one of their two smallest shingle hashes."""
    group, first = list(range(len(texts))), {}

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    for i, t in enumerate(texts):
        for h in shingles(t)[:2].tolist():
            j = first.setdefault(h, i)
            a, b = sorted((top(i), top(j)))
            group[b] = a
    return [top(i) for i in range(len(texts))]


def dictionaries(texts: list[str], labels: list[int], weights: list[float] | None = None, size: int = SIZE, trained: int = TRAINED, few: int = FEW) -> tuple[bytes, bytes]:
    """The ordinary dictionary, and the toxic one with the ordinary one after it."""
    import xxhash
    import zstandard as z

    def trained_on(samples: list[bytes], **how) -> bytes:
        itself = b" ".join(sorted(set(samples)))[-size:]
        if sum(map(len, samples)) < few:
            return itself
        try:
            return z.train_dictionary(size, samples, **how).as_bytes()
        except z.ZstdError:
            return itself

    weights = weights or [1.0] * len(texts)
    (toxic, wt), (ordinary, wo) = (([t for t, y in zip(texts, labels, strict=True) if y == k], [w for w, y in zip(weights, labels, strict=True) if y == k]) for k in (1, 0))
    plain = sorted((w for t in ordinary for w in windows(t)), key=xxhash.xxh3_64_intdigest)[:trained]
    grams = toxic_grams(toxic, ordinary, (wt, wo)) if toxic and ordinary else set()
    base = trained_on(plain) or b" " * 8
    return base, trained_on([p for t in toxic for p in passages(t, grams)], k=32, d=6) + b" " + base


def fit(texts: list[str], labels: list[int], size: int = SIZE) -> Model:
    """Dictionaries from all rows; the calibration of each half with dictionaries of the other. One class alone gives that
    class's constant score. A class weighs by the square root of how rare it is, and copies of one text weigh as one, and
    lie in one half."""
    group = copies(texts)
    held = Counter(group)
    each = [1.0 / held[g] for g in group]
    side = {g: i % 2 for i, g in enumerate(sorted(held))}
    x = np.zeros((max(1, len(texts)), 2 * len(GAINS) + 2))
    for half in (0, 1):
        other = [i for i, g in enumerate(group) if side[g] != half]
        gauge = Gauge(*dictionaries([texts[i] for i in other], [labels[i] for i in other], [each[i] for i in other], size))
        for i, g in enumerate(group):
            if side[g] == half:
                x[i] = gauge.features(texts[i])
    y, weight = np.array(labels or [0], dtype=float), np.array(each or [1.0])
    mean = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight)) + 1e-6
    z1 = np.c_[(x - mean) / scale, np.ones(len(x))]
    share = min(max(np.average(y, weights=weight), 1e-9), 1 - 1e-9)
    rows = weight * np.where(y == 1, math.sqrt(0.5 / share), math.sqrt(0.5 / (1 - share)))
    prior = math.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5)) if min(y.sum(), (1 - y).sum()) == 0 else 0.0
    beta = np.zeros(z1.shape[1])
    ridge = np.eye(len(beta)) * 1.0
    ridge[-1, -1] = 1e-3
    if not prior:
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z1 @ beta, -30, 30)))
            grad = z1.T @ (rows * (y - p)) - ridge @ beta
            hess = (z1 * (rows * p * (1 - p))[:, None]).T @ z1 + ridge
            step = np.linalg.solve(hess, grad)
            beta = beta + step
            if np.abs(step).max() < 1e-6:
                break
    beta[-1] += prior
    return Model(*dictionaries(texts, labels, each, size), mean, scale, beta)


def train(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from labelled rows whose crc32(doc_id as text) mod `fold` is not `held`: at most `sample` of each class, by
    hash order of doc_id, of which texts beyond `sample_bytes` are passed over. Rows with a null label don't count."""
    doc_id = F.col("doc_id").cast("long")
    pool = labels.select(doc_id.alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(fold)) != held)
    picked = [pool.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    rows = documents(docs).join(F.broadcast(picked[0].union(picked[1])), "doc_id").where(F.octet_length("text") <= sample_bytes)
    rows = sorted((r["doc_id"], r["y"], r["text"]) for r in rows.select("doc_id", "y", "text").collect())
    return fit([r[2] for r in rows], [r[1] for r in rows])


def _scorer(model: Model):
    gauge = Gauge(model.ordinary, model.toxic)

    def score(text: str) -> float:
        v = (gauge.features(text) - model.mean) / model.scale
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(v @ model.weights[:-1] + model.weights[-1])))))

    return score


def score(docs: DataFrame, model: Model, fold: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, by its whole text alone.

    Null and empty texts get the score of a text without windows. Repeated rows are each scored; a null doc_id is not held
    out. An empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = _scorer(model)
        for batch in batches:
            s = [rate(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = documents(docs).mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(fold)) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text scores below the threshold.

    Null text counts as empty. Rows that repeat go or stay together, a null doc_id makes no difference; an empty table
    gives an empty result.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([rate(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)
