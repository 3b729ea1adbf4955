"""Benchmark decontamination by spaced-seed hashing.

A mask chooses some of the tokens of a short span and ignores the rest, so a few substituted tokens leave some mask's
hash as it was. Documents are read once: a Bloom filter over the hashes of all benchmark spans passes on the few whose spans
may be among them, with their tokens. Those hashes are joined with the benchmark's by a shuffle, and around each hit the two
token runs are laid side by side: the best stretch (1 for a match, -3 for a difference) must hold enough matches; or the whole
item lies in the document with most of its tokens matching, which also finds short items with a few tokens changed. Equal
items, and equal documents, are looked at once. What a worker holds is the filter: three bytes for each span of the benchmark
up to `MOST_BYTES`, beyond which it passes more documents on and results stay the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, documents

#: Masks over a span of 12 tokens; 1 marks a token that counts.
MASKS = ("110110101101", "111001011011", "101111000111", "111100111001")
SPAN = 12
#: Matching tokens that an overlap needs (an item with fewer tokens: all of them).
LEAST = 13
#: Share of an item's tokens that must match where the whole item is laid against a document (items of a span or more).
SHARE = 0.8
#: Bits of the filter for each span hash, probes of each, bytes of a part of it that is built at once, and of all of it.
BITS, PROBES, PART, MOST_BYTES = 24, 8, 1 << 16, 128 << 20
_TOKEN = re.compile(r"\w+")
_ODD = 0x9E3779B97F4A7C15  # fixed value: odd multiplier


def hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased tokens."""
    import xxhash

    found = _TOKEN.findall(text.lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def spans(tokens: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hashes, under one mask, of the spans that start at each token."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, salt, dtype=np.uint64)
    for place, c in enumerate(mask):
        if c == "1":
            total += tokens[place : place + n] * np.uint64(pow(_ODD, place + 1, 1 << 64))
    return _mix(total)


def _masks(short: list[int]) -> list[tuple[str, int]]:
    """(mask, salt): items shorter than a span are looked up whole, by one full mask for each length."""
    return [(m, k + 1) for k, m in enumerate(MASKS)] + [("1" * n, 100 + n) for n in short]


def item_spans(tokens: np.ndarray) -> Iterator[tuple[int, int]]:
    """(hash, place) of an item's spans under every mask; no two of one hash and place."""
    for mask, salt in _masks([len(tokens)] if 0 < len(tokens) < SPAN else []):
        if len(tokens) >= SPAN or salt > 100:
            yield from zip(spans(tokens, mask, salt).tolist(), range(len(tokens) - len(mask) + 1), strict=True)


class Filter:
    """A Bloom filter in parts of PART bytes: a hash picks a part, and PROBES bits of it."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.parts = bits, len(bits) // PART

    @staticmethod
    def parts_for(n: int, most: int = MOST_BYTES) -> int:
        return max(1, min(-(-n * BITS // (8 * PART)), most // PART))

    @staticmethod
    def part_of(h: np.ndarray, parts: int) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)

    @staticmethod
    def probe(h: np.ndarray, k: int) -> np.ndarray:
        x = _mix(h ^ np.uint64(0x9E3779B97F4A7C15))
        return ((x & np.uint64(0xFFFFFFFF)) + np.uint64(k) * ((x >> np.uint64(32)) | np.uint64(1))) & np.uint64(8 * PART - 1)

    def passed(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes that may have been added; most of the others go with the first probes."""
        at = np.arange(len(h))
        base = self.part_of(h, self.parts).astype(np.int64) * PART
        for k in range(PROBES):
            bit = self.probe(h[at], k)
            at = at[(self.bits[base[at] + (bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return at


def best(own: np.ndarray, tokens: np.ndarray, shifts: np.ndarray, need: int) -> tuple[int, int, int, int] | None:
    """(matches, -length, -start in the document, -start in the item) of the best overlap at these starts."""
    place = shifts[:, None] + np.arange(len(own))
    inside = (place >= 0) & (place < len(tokens))
    same = inside & (own == tokens[np.clip(place, 0, len(tokens) - 1)])
    # beyond the document's ends a stretch neither gains nor goes on
    total = np.cumsum(np.where(same, 1, -3), axis=1)
    total = np.concatenate([np.zeros((len(shifts), 1), dtype=total.dtype), total], axis=1)
    floor = np.minimum.accumulate(total, axis=1)
    end = (total - floor).argmax(axis=1)
    start = np.where(np.arange(total.shape[1]) <= end[:, None], total, total.max() + 1).argmin(axis=1)
    seen = np.concatenate([np.zeros((len(shifts), 1), dtype=np.int64), np.cumsum(same, axis=1)], axis=1)
    row = np.arange(len(shifts))
    found = [(int(m), a - e, -(a + s), -a) for m, a, e, s in zip(seen[row, end] - seen[row, start], start.tolist(), end.tolist(), shifts.tolist(), strict=True) if m >= need]
    if len(own) >= SPAN:
        for i in np.nonzero(inside.all(axis=1) & (seen[:, -1] >= SHARE * len(own)))[0].tolist():
            found.append((int(seen[i, -1]), -len(own), -int(shifts[i]), 0))
    return max(found, default=None)


def starts(pairs: list[tuple[list[int], list[int]]], own: int, tokens: int) -> np.ndarray:
    """Starts of an item relative to a document, of places in the document and in the item with one hash.

    Starts are marked, not listed by pair of places: a document and an item that repeat one span meet at no more starts
    than they have tokens together, however many pairs of places agree.
    """
    marks = np.zeros(own + tokens, dtype=bool)
    for there, here in pairs:
        d = np.array(there, dtype=np.int64)
        for place in here:
            marks[d - place + own] = True
    return np.nonzero(marks)[0] - own


def overlap(own: np.ndarray, tokens: np.ndarray, pairs: list[tuple[list[int], list[int]]], least: int) -> tuple[int, int, int, int] | None:
    """(matching tokens, length, start in the document, start in the item) of the best overlap, or null."""
    shifts, size = starts(pairs, len(own), len(tokens)), max(1, (1 << 20) // max(1, len(own)))
    found = [x for at in range(0, len(shifts), size) if (x := best(own, tokens, shifts[at : at + size], min(least, len(own))))]
    if not found:
        return None
    m, n, d, b = max(found)
    return m, -n, -d, -b


class Benchmark:
    """The items that have tokens, their span hashes and the filter over them."""

    def __init__(self, benchmark: DataFrame, scratch: Scratch, most: int = MOST_BYTES):
        spark = benchmark.sparkSession
        rows = bounded(benchmark).select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")

        def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [hashes(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.astype("<u8").tobytes() for t in found], pa.binary())], ["item_id", "tokens"])

        #: (item_id, item, tokens): `item` stands for all items of the same tokens.
        self.rows = scratch.save(rows.mapInArrow(tokenized, "item_id long, tokens binary").where(F.octet_length("tokens") > 0).withColumn("item", F.sha2("tokens", 256)), "items")
        self.items = self.rows.groupBy("item").agg(F.min("tokens").alias("tokens"))

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    at: dict[int, list[int]] = {}
                    for h, place in item_spans(np.frombuffer(raw, "<u8")):
                        at.setdefault(h, []).append(place)
                    if at:
                        h = np.fromiter(at, np.uint64, len(at)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(at), pa.string()), pa.array(h, pa.int64()), pa.array(list(at.values()), pa.list_(pa.int32()))], ["item", "h", "here"])

        #: (item, h, here): the places of each hash in an item.
        self.spans = scratch.save(self.items.mapInArrow(hashed, "item string, h long, here array<int>"), "spans")
        short = self.items.where(F.octet_length("tokens") < 8 * SPAN).select((F.octet_length("tokens") / 8).cast("int").alias("n")).distinct()
        self.masks = _masks(sorted(r["n"] for r in short.collect()))  # at most eleven lengths
        parts = Filter.parts_for(self.spans.count(), most)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(Filter.part_of(h, parts).astype(np.int32), pa.int32()), batch.column(0)], ["part", "h"])

        def built(table: pa.Table) -> pa.Table:
            h = table["h"].to_numpy().astype(np.int64).view(np.uint64)
            bits = np.zeros(8 * PART, dtype=bool)
            for k in range(PROBES):
                bits[Filter.probe(h, k).astype(np.int64)] = True
            return pa.table({"part": table["part"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        whole = np.zeros(parts * PART, np.uint8)
        for row in self.spans.select("h").distinct().mapInArrow(dealt, "part int, h long").groupBy("part").applyInArrow(built, "part int, bits binary").toLocalIterator():
            whole[row["part"] * PART : (row["part"] + 1) * PART] = np.frombuffer(bytes(row["bits"]), np.uint8)
        self.filter = spark.sparkContext.broadcast(whole)


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with two hashes that stand for the text where texts are compared."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.withColumns({"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(1), text)})


def _found(docs: DataFrame, bench: Benchmark, scratch: Scratch, least: int) -> tuple[DataFrame, DataFrame]:
    """(rows, overlaps): (doc_id, _k1, _k2) of documents that the filter passes, and (_k1, _k2, item, n_matched, n_overlap,
    doc_start, item_start) for each different text among them and each different item that overlap."""
    masks, bits = bench.masks, bench.filter
    kind = "doc_id long, _k1 long, _k2 long, rid long, tokens binary, hits array<struct<h: long, there: array<int>>>"
    hit = pa.list_(pa.struct([("h", pa.int64()), ("there", pa.list_(pa.int32()))]))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sieve, rid = Filter(bits.value), TaskContext.get().partitionId() << 36
        for batch in batches:
            # the documents of a batch end to end: one pass for each mask, of which what spans two documents is left out
            found = [hashes(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            tokens = np.concatenate(found) if found else np.zeros(0, np.uint64)
            hits: dict[int, dict[int, list[int]]] = {}
            for mask, salt in masks:
                h = spans(tokens, mask, salt)
                on = sieve.passed(h)
                doc = np.searchsorted(ends, on, "right") - 1
                inside = on + len(mask) <= ends[doc + 1]
                on, doc = on[inside], doc[inside]
                for i, x, place in zip(doc.tolist(), h[on].view(np.int64).tolist(), (on - ends[doc]).tolist(), strict=True):
                    hits.setdefault(i, {}).setdefault(x, []).append(place)
            out = []
            for i, (doc_id, k1, k2) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                rid += 1
                if i in hits:
                    out.append((doc_id, k1, k2, rid, found[i].astype("<u8").tobytes(), [{"h": h, "there": places} for h, places in hits[i].items()]))
            if out:
                columns = zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), hit), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["doc_id", "_k1", "_k2", "rid", "tokens", "hits"])

    rows = scratch.save(_keyed(documents(docs)).mapInArrow(passed, kind), "passed")
    # of equal texts one is looked at
    one = scratch.save(rows.join(rows.groupBy("_k1", "_k2").agg(F.min("rid").alias("rid")).select("rid"), "rid"), "texts")
    hits = one.select("rid", F.explode("hits").alias("x")).select("rid", "x.h", "x.there").join(bench.spans, "h")
    pairs = hits.groupBy("rid", "item").agg(F.collect_list(F.struct("there", "here")).alias("places"))
    pairs = pairs.join(bench.items.withColumnRenamed("tokens", "own"), "item").join(one.select("rid", "_k1", "_k2", "tokens"), "rid")
    out = "_k1 long, _k2 long, item string, n_matched long, n_overlap long, doc_start long, item_start long"
    names = [c.split()[0] for c in out.split(", ")]

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k1, k2, item, own, tokens, places in zip(*(batch.column(i) for i in range(6)), strict=True):
                at = [(x["there"], x["here"]) for x in places.as_py()]
                o = overlap(np.frombuffer(own.as_py(), "<u8"), np.frombuffer(tokens.as_py(), "<u8"), at, least)
                if o:
                    found.append((k1.as_py(), k2.as_py(), item.as_py(), *o))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "item" else pa.int64()) for n, c in zip(names, zip(*found, strict=True), strict=True)], names)

    laid_out = pairs.select("_k1", "_k2", "item", "own", "tokens", "places").mapInArrow(laid, out)
    return rows.select("doc_id", "_k1", "_k2"), scratch.save(laid_out, "overlaps")


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, most: int = MOST_BYTES) -> DataFrame:
    """doc_id, item_id, n_matched, n_overlap, doc_start, item_start: the best overlap of each leaking pair, in tokens.

    Null texts count as empty; items without tokens or with a null item_id match nothing. Repeated documents each have
    their rows, repeated items likewise; of overlaps with equal matches the shortest, then the first counts. Documents
    with a null doc_id are looked at like any other. Empty tables give an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    bench = Benchmark(benchmark, scratch, most)
    rows, found = _found(docs, bench, scratch, least)
    return rows.join(found, ["_k1", "_k2"]).join(bench.rows.select("item", "item_id"), "item").select("doc_id", "item_id", "n_matched", "n_overlap", "doc_start", "item_start")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, most: int = MOST_BYTES) -> DataFrame:
    """The rows of docs, all columns unchanged, that overlap no benchmark item.

    Null text counts as empty and overlaps nothing. Rows that repeat go or stay together, a null doc_id makes no
    difference; without benchmark items all rows stay, and an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    _, found = _found(docs, Benchmark(benchmark, scratch, most), scratch, least)
    gone = scratch.save(found.select("_k1", "_k2").distinct(), "leaking")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.join(gone, (F.xxhash64(text) == gone["_k1"]) & (F.xxhash64(F.lit(1), text) == gone["_k2"]), "left_anti")
