"""Near copies by the Jaccard likeness of word shingles, for what lies beyond the reach of fingerprints.

At a likeness of 0.8 two 64-bit SimHash fingerprints differ by about ten bits, which no affordable number of keys covers.
Minimal shingle hashes, in bands, give candidates instead: documents that share a bucket of a band. Equal shingle sets are
folded to one document first. A round of stars then holds each document against the center that most of its bands name,
which joins large groups in linear work. In what buckets still hold more than one group, every pair of different groups is
compared by whole shingle sets: crowded buckets are dealt to blocks, and each two blocks meet in one cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, documents

WORDS, LEAST = 5, 0.8
#: At a likeness of 0.8 all bands differ for one pair in 5,000.
BANDS, ROWS = 16, 4
#: Members of one bucket that a block holds, about; a cell holds two blocks.
BLOCK = 256
_SALTS = 16


class _Words:
    """64-bit hashes of words, each computed once while it stays in a cache of bounded size."""

    def __init__(self, most: int = 150_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            pass
        if len(known) > self.most:
            known.clear()
        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(known))
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


_words = _Words()
_ODD = 0x9E3779B97F4A7C15  # fixed value: odd multiplier


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order; a text with fewer words is one shingle, without words none."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    each, k = _words(found), min(words, len(found))
    total = np.full(len(found) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total += each[i : i + len(total)] * np.uint64(pow(_ODD, i + 1, 1 << 64))
    total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(total ^ (total >> np.uint64(29)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def _bands():
    r = np.random.default_rng(11)
    odd, flip = (r.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
    weight = r.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
    odd |= np.uint64(1)

    def keys(h: np.ndarray) -> np.ndarray:
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
        for at in range(0, len(h), 1024):
            least = np.minimum(least, ((h[at : at + 1024] ^ flip) * odd).min(axis=1))
        return (least.reshape(BANDS, ROWS) * weight).sum(axis=1, dtype=np.uint64).view(np.int64)

    return keys


def _keyed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        keys = _bands()
        for batch in batches:
            found, same = [], []
            for t in batch.column(1):  # one text's shingles at a time
                h = shingles(t.as_py())
                found.append(keys(h) if len(h) else [])
                same.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "same", "keys"])

    return rows.mapInArrow(run, "doc_id long, same binary, keys array<long>")


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, near) of rows with both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            near = [likeness(shingles(s), shingles(t)) >= least for s, t in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(near, pa.bool_())], ["a", "b", "near"])

    return pairs.mapInArrow(run, "a long, b long, near boolean")


def _salts() -> Column:
    return F.explode(F.lit(list(range(_SALTS))).cast("array<bigint>")).alias("salt")


def joined(ids: list[int], groups: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (a, b) that connect what likenesses of `least` or more between members of different groups connect, with one
    to the smallest such id of each member that has a smaller one."""
    size = np.array([len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    width = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [at, at + width])
        has = np.zeros((len(sets), width), dtype=np.float32)
        has[row[low:high], column[low:high] - at] = 1
        both += has @ has.T
    group = np.array(groups)
    near = (both / np.maximum(1, size[:, None] + size[None, :] - both) >= least) & (group[:, None] != group[None, :])
    out, rest = [], np.ones(len(sets), dtype=bool)
    for first in range(len(sets)):
        todo = [first] if rest[first] else []
        rest[first] = False
        while todo:
            x = todo.pop()
            hit = np.nonzero(near[x] & rest)[0].tolist()
            rest[hit] = False
            out += [(ids[x], ids[y]) for y in hit]
            todo += hit
    return out + [(ids[x], y) for x in range(len(sets)) if (y := min((ids[k] for k in np.nonzero(near[x])[0]), default=ids[x])) < ids[x]]


def _cells(member: DataFrame, block: int) -> DataFrame:
    """(key, i, j, doc_id, root): each two members of a bucket that have different roots meet in a cell (i, j). The
    bucket's most frequent root has blocks of its own, which do not meet each other."""
    held = member.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("sign"))
    bucket = held.groupBy("key").agg(F.sum("n").alias("n"), F.sum("sign").alias("sign"), F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    # buckets with the same members give the same cells: one of them stays
    bucket = bucket.groupBy("n", "sign").agg(F.min(F.struct("key", F.col("top.root").alias("top"), F.col("top.n").alias("most"))).alias("b"))
    blocks = lambda n: F.when(F.col("n") <= block, 0).otherwise(F.ceil(n / F.lit(block))).cast("int")
    bucket = bucket.select("b.key", "b.top", blocks(F.col("b.most")).alias("own"), blocks(F.col("n") - F.col("b.most")).alias("rest"), _salts())
    rows = member.join(bucket, ["key", "salt"])
    deal = lambda n: F.pmod(F.xxhash64("doc_id", "key"), n).cast("int")
    meets = (
        F.when(F.col("rest") == 0, F.expr("array(struct(0 AS i, 0 AS j))"))
        .when(F.col("root") == F.col("top"), F.expr("transform(sequence(0, rest - 1), r -> struct(at AS i, own + r AS j))"))
        .otherwise(F.expr("concat(transform(sequence(0, own - 1), r -> struct(r AS i, own + at AS j)), transform(sequence(0, rest - 1), r -> struct(own + least(r, at) AS i, own + greatest(r, at) AS j)))"))
    )
    at = F.when(F.col("rest") == 0, 0).when(F.col("root") == F.col("top"), deal(F.greatest("own", F.lit(1)))).otherwise(deal(F.greatest("rest", F.lit(1))))
    return rows.withColumn("at", at).select("key", "doc_id", "root", F.explode(meets).alias("c")).select("key", "c.i", "c.j", "doc_id", "root")


def _several(member: DataFrame) -> DataFrame:
    """Buckets whose members have more than one root, with their smallest member."""
    return member.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("doc_id", "root")).alias("c")).where("low < high")


def _contracted(member: DataFrame, texts: DataFrame, scratch: Scratch, least: float) -> tuple[DataFrame, DataFrame]:
    """Members with the roots after a round of stars, and the links of that round."""
    center = _several(member).select("key", F.col("c.doc_id").alias("center"), F.col("c.root").alias("to"), _salts())
    pairs = member.join(center, ["key", "salt"]).where("root <> to").groupBy(F.col("doc_id").alias("a"), F.col("center").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.first("root").alias("u"), F.first("to").alias("v"))
    best = pairs.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"), "u", "v")).alias("m")).select("a", (-F.col("m.b")).alias("b"), F.col("m.u").alias("u"), F.col("m.v").alias("v"))
    left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    best = scratch.save(best, "stars")
    near = scratch.save(_verified(best.join(left, "a").join(right, "b").select("a", "b", "x", "y"), least).where("near").select("a", "b"), "near")
    moved = components(best.join(near, ["a", "b"]).select("u", "v"), scratch, "u", "v").withColumnRenamed("root", "now")
    member = member.join(moved, member.root == moved.node, "left").select("key", "salt", "doc_id", F.coalesce("now", "root").alias("root"))
    return scratch.save(member, "members"), near


def links(docs: DataFrame, scratch: Scratch, least: float = LEAST, roots: DataFrame | None = None, contract: bool = True, block: int = BLOCK) -> DataFrame:
    """(a, b): verified links that, with those that `roots` (doc_id, root) stands for, connect what all pairs that share
    a band and have a likeness of `least` or more connect. Without `contract` and `roots`, each document that has such a pair
    with a smaller doc_id is also the `a` of a link to a smaller one.

    doc_id must be distinct; rows without one, and texts without words, have no links. An empty table has none.
    """
    rows = documents(docs).where("doc_id is not null")
    keyed = scratch.save(_keyed(rows).where("same is not null"), "keyed")
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)))
    first = scratch.save(keyed.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "sets")
    copied = first.where("n > 1").select("same", "first", _salts())
    equal = scratch.save(salted(keyed).join(copied, ["same", "salt"]).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")), "equal")
    member = salted(keyed.join(equal.select(F.col("a").alias("doc_id")).hint("merge"), "doc_id", "left_anti").select("doc_id", F.explode("keys").alias("key")))
    if roots is None:
        member = member.withColumn("root", F.col("doc_id"))
    else:
        member = member.join(roots.select("doc_id", "root").hint("merge"), "doc_id")
    member = scratch.save(member.join(_several(member).select("key", _salts()), ["key", "salt"]), "members")
    texts = scratch.save(rows.join(member.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "candidates")

    near = None
    if contract:
        member, near = _contracted(member, texts, scratch, least)
    cells = scratch.save(_cells(member, block), "cells")

    def run(cell: pa.Table) -> pa.Table:
        ids, groups, found = (cell.column(c).to_pylist() for c in ("doc_id", "root", "text"))
        out = joined(ids, groups, [shingles(t) for t in found], least) if len(set(groups)) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    met = scratch.save(cells.join(texts, "doc_id").groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct(), "met")
    return equal.union(met) if near is None else equal.union(near).union(met)


def copies(docs: DataFrame, scratch: Scratch, least: float = LEAST) -> DataFrame:
    """(doc_id): documents with a likeness of `least` or more to one with a smaller doc_id, which itself stays or has one.

    doc_id must be distinct; rows without one, and texts without words, are never copies. An empty table has none.
    """
    found = links(docs, scratch, least, contract=False)
    return found.select(F.greatest("a", "b").alias("doc_id")).distinct()
