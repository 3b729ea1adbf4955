"""Substring dedup by seed and extend.

Words are hashed, and winnowing picks anchors: in every window of `length` words one anchor of `gram` words, chosen by
content alone, so equal windows pick equal anchors. An anchor's *extent* is the run of words covered by all windows that
picked it. Documents meet on anchors. Where all occurrences of a shared anchor have the same extent, it repeats as a
whole; where extents differ (the ends of a repeat), the windows inside are compared one by one, once for each distinct
extent. Thus the smallest doc_id of every window is known exactly, and adjoining windows join to maximal repeats.
Occurrences are never paired with each other: groups of copies are folded to their smallest doc_id first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # fixed values: odd multipliers of the two polynomial hashes


@lru_cache(1)
def _state() -> dict:
    return {}


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both multipliers and of their inverses modulo 2**64, n or more of each."""
    state = _state()
    if len(state.get("powers", [((), ())])[0][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        made = []
        for m in _ODD:
            both = []
            for x in (m, pow(m, -1, 1 << 64)):
                p = np.full(size, x, dtype=np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            made.append(tuple(both))
        state["powers"] = made
    return state["powers"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Words:
    """Hashes of any run of a document's words, in constant time each."""

    def __init__(self, words: list[bytes]):
        import xxhash

        self.n = len(words)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=self.n)
        self.powers = _powers(self.n + 1)
        self.sums = []
        for p, _ in self.powers:
            s = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(h * p[: self.n], out=s[1:])
            self.sums.append(s)

    def run(self, start: np.ndarray, length, which: int = 0) -> np.ndarray:
        s, (_, inverse) = self.sums[which], self.powers[which]
        return _mix((s[start + length] - s[start]) * inverse[start] + np.uint64(1) * np.asarray(length).astype(np.uint64))


def anchors(words: _Words, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor, both hashes of its extent, first window and number of windows, for each run of windows that picks it."""
    n = words.n - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = words.run(np.arange(words.n - gram + 1), gram)
    view = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1)
    pick = np.empty(n, dtype=np.int64)
    for at in range(0, n, 65536):
        pick[at : at + 65536] = view[at : at + 65536].argmin(axis=1)
    pick += np.arange(n)
    first = np.concatenate([[0], np.nonzero(np.diff(pick))[0] + 1])
    count = np.diff(np.concatenate([first, [n]]))
    extent = count + length - 1
    place = (pick[first] - first).astype(np.uint64)
    e1, e2 = words.run(first, extent, 0), words.run(first, extent, 1)
    e2 = _mix(e2 + place)
    return grams[pick[first]].view(np.int64), e1.view(np.int64), e2.view(np.int64), first, count


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def _occurrences(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc is None:
                    continue
                a, e1, e2, first, count = anchors(_Words(text.encode("utf-8", "surrogatepass").split()), length, gram)
                rows.append((a, e1, e2, np.full(len(a), doc), np.full(len(a), key), first.astype(np.int32), count.astype(np.int32)))
                size += len(a)
                if size > 100_000:
                    yield _batch(dict(zip(("anchor", "e1", "e2", "doc_id", "key", "first", "n"), map(np.concatenate, zip(*rows, strict=True)), strict=True)))
                    rows, size = [], 0
            if size:
                yield _batch(dict(zip(("anchor", "e1", "e2", "doc_id", "key", "first", "n"), map(np.concatenate, zip(*rows, strict=True)), strict=True)))

    return run


def _windows(length: int, gram: int):
    """Window hashes of the wanted extents of a document, each extent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _Words(text.encode("utf-8", "surrogatepass").split())
                a, e1, e2, first, count = anchors(words, length, gram)
                wanted = {(w["anchor"], w["e1"], w["e2"]) for w in wanted}
                place = {}
                for i, k in enumerate(zip(a.tolist(), e1.tolist(), e2.tolist(), strict=True)):
                    if k in wanted:
                        place[k] = i
                if not place:
                    continue
                i = np.array(list(place.values()))
                n = count[i]
                at = np.repeat(first[i], n)
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield _batch({"low": np.full(len(at), doc), "anchor": np.repeat(a[i], n), "e1": np.repeat(e1[i], n), "e2": np.repeat(e2[i], n), "off": off.astype(np.int32), "w1": words.run(at + off, length, 0).view(np.int64), "w2": words.run(at + off, length, 1).view(np.int64)})

    return run


def repeats(docs: DataFrame, scratch: Scratch, length: int = 50, gram: int = 10) -> DataFrame:
    """(doc_id, key, spans): for each text the word ranges [start, end) covered by windows that a smaller doc_id has too.

    `key` is xxhash64 of the text. Spans may overlap; together they are the maximal repeats of `length` words or more.
    """
    rows = documents(docs).select("doc_id", F.xxhash64("text").alias("key"), "text")
    occ = scratch.save(rows.mapInArrow(_occurrences(length, gram), "anchor long, e1 long, e2 long, doc_id long, key long, first int, n int"), "occurrences")
    extents = occ.groupBy("anchor", "e1", "e2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("n").alias("n"))
    shared = extents.groupBy("anchor").agg(F.count(F.lit(1)).alias("extents"), F.min("low").alias("least"), F.max("high").alias("most")).where("least < most")
    extents = scratch.save(extents.join(shared.select("anchor", "extents"), "anchor"), "extents")
    whole = extents.where("extents = 1").select("anchor", "e1", "e2", F.array(F.struct(F.lit(0).alias("off"), "n", F.col("low").alias("low"))).alias("runs"))
    ends = extents.where("extents > 1")
    wanted = ends.groupBy(F.col("low").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "e1", "e2")).alias("wanted"))
    windows = rows.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_windows(length, gram), "low long, anchor long, e1 long, e2 long, off int, w1 long, w2 long")
    windows = scratch.save(windows, "windows")
    least = windows.groupBy("anchor", "w1", "w2").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most").drop("most")
    alone = ends.where("low < high").select("anchor", "e1", "e2", F.struct(F.lit(0).alias("off"), "n", F.col("low")).alias("run"))
    partly = windows.join(least, ["anchor", "w1", "w2"]).where("least < low").select("anchor", "e1", "e2", F.struct("off", F.lit(1).alias("n"), F.col("least").alias("low")).alias("run"))
    partly = partly.union(alone).groupBy("anchor", "e1", "e2").agg(F.collect_list("run").alias("runs"))
    runs = scratch.save(whole.union(partly), "runs")
    hit = occ.join(runs, ["anchor", "e1", "e2"]).select("doc_id", "key", F.expr("transform(filter(runs, r -> r.low < doc_id), r -> struct(first + r.off as start, first + r.off + r.n + %d as end))" % (length - 1)).alias("spans")).where("size(spans) > 0")
    return hit.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, text, spans = (c.to_pylist() for c in batch.columns)
        n_words, n_removed, digest = [], [], []
        for t, found in zip(text, spans, strict=True):
            words = t.encode("utf-8", "surrogatepass").split()
            n_words.append(len(words))
            if found:
                step = np.zeros(len(words) + 1, dtype=np.int32)
                np.add.at(step, [s["start"] for s in found], 1)
                np.add.at(step, [s["end"] for s in found], -1)
                stay = np.cumsum(step[:-1]) == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            n_removed.append(n_words[-1] - len(words))
            digest.append((b" ".join(words)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([d.decode("utf-8", "surrogatepass") for d in digest], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches):
        yield batch.set_column(3, "kept_sha256", pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in batch.column(3).to_pylist()], pa.string()))


def _with_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    spans = repeats(docs, Scratch(docs.sparkSession), length, gram)
    rows = documents(docs).withColumn("key", F.xxhash64("text"))
    return rows.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans")


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 10) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that stay, joined by one space.

    A word goes if a window of `length` words that covers it also starts in a document with a smaller doc_id, judged on
    the input. Null text counts as empty. Rows with equal doc_id never remove each other's words; all are returned. Rows
    with null doc_id stay whole and remove nothing. An empty table gives an empty result; other columns are ignored.
    """
    return _with_spans(docs, length, gram).mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def removal_digests(docs: DataFrame, length: int = 50, gram: int = 10) -> DataFrame:
    """As remove_repeats, with kept_sha256 (lowercase hex of the kept text's SHA-256) instead of the text."""
    return _with_spans(docs, length, gram).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
