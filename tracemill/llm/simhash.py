"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last padded with zeros). Each segment is decoded to
the indices of all codewords of the [23,12,7] Golay code within distance 4: one codeword, or six where the nearest is at
distance 3. Two segments that differ in at most 2 bits always share an index. With at most 4 differing bits in all,
either every segment has at most 2 errors and none is clean (key: the three indices), or some segment is clean and one of
the others has at most 2 (key: the clean segment's bits and the other's index). So the keys lose no pair, and each
carries 30 to 36 bits, which keeps chance candidates rare. Candidates are verified by their Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import likeness
from .common import Scratch, components, documents

BITS = 4
#: Members of one key bucket compared with each other in one task; the members of larger ones get finer keys first.
BUCKET = 32_768
_SALTS = 16
_POLY = 0b101011100011  # fixed value: generator polynomial of the Golay code


@lru_cache(1)
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables by syndrome: remainders of low and high bits, nearest error, and index offsets of codewords at distance 4."""

    def rest(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= _POLY << (i - 11)
        return x

    low, high = (np.array([rest(x << s) for x in range(1 << n)], dtype=np.int64) for s, n in ((0, 12), (12, 11)))
    leader = np.zeros(2048, dtype=np.int64)
    weight = np.zeros(2048, dtype=np.int64)
    for w in (1, 2, 3):
        for c in combinations(range(23), w):
            e = sum(1 << i for i in c)
            leader[rest(e)], weight[rest(e)] = e, w
    words = [(m << 11) ^ rest(m << 11) for m in range(4096)]
    sevens = [c for c in words if c.bit_count() == 7]
    more = np.full((2048, 5), -1, dtype=np.int64)
    for s in np.nonzero(weight == 3)[0]:
        e = int(leader[s])
        more[s] = [c >> 11 for c in sevens if c & e == e]
    return low, high, leader, more


def indices(segment: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit segments; -1 where a segment has only one."""
    low, high, leader, more = _code()
    syndrome = low[segment & 0xFFF] ^ high[segment >> 12]
    near = (segment ^ leader[syndrome]) >> 11
    others = more[syndrome]
    return np.concatenate([near[:, None], np.where(others < 0, -1, others ^ near[:, None])], axis=1)


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key of each fingerprint: the fingerprint's place in fp, and the key."""
    u = fp.view(np.uint64)
    parts = [(u >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((0, 0x7FFFFF), (23, 0x7FFFFF), (46, 0x3FFFF))]
    ids = [indices(p) for p in parts]
    a, b, c = ids[0][:, :, None, None], ids[1][:, None, :, None], ids[2][:, None, None, :]
    at, x, y, z = np.nonzero((a >= 0) & (b >= 0) & (c >= 0))
    where, keys = [at], [ids[0][at, x] << 24 | ids[1][at, y] << 12 | ids[2][at, z]]
    for t, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        at, x = np.nonzero(ids[j] >= 0)
        where.append(at)
        keys.append((t + 1) << 40 | parts[i][at] << 12 | ids[j][at, x])
    return np.concatenate(where), np.concatenate(keys)


def simhash(text: str, words: int = 4, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    k = min(words, len(found))
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[: len(found) - k]]
    h = map(xxhash.xxh64_intdigest, map(b" ".join(found).__getitem__, map(slice, starts, (e - 1 for e in ends[k - 1 :]))), repeat(seed))
    h = np.fromiter(h, dtype="<u8", count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [simhash(t, words, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signed values (bitwise_count alone would take the absolute value)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _spanning(v: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the graph that links members of v at `bits` or fewer differing bits."""
    left, right, rest = [], [], v.copy()
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            hit = _differing(rest, x) <= bits
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                left.append(np.full(len(found), x))
                right.append(found)
                todo.extend(found)
    return left, right


def _links(bits: int, bucket: int):
    """Sorted (key, fp) rows to verified edges; members of a bucket beyond `bucket` come out as (fp, null)."""

    def out(left: list[np.ndarray], right: list[np.ndarray], hot: list[np.ndarray]) -> pa.RecordBatch:
        a, b, h = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, hot))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, h])), pa.concat_arrays([pa.array(b), pa.nulls(len(h), pa.int64())])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, flowing = None, np.zeros(0, np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = (batch.column(i).to_numpy() for i in (0, 1))
            left, right, hot = [], [], []
            if held_key is not None and len(held):
                key, fp = np.concatenate([np.full(len(held), held_key), key]), np.concatenate([held, fp])
            cut = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]])
            size = np.diff(cut)
            two = cut[:-1][:-1][size[:-1] == 2]
            near = two[_differing(fp[two], fp[two + 1]) <= bits]
            left.append(fp[near]), right.append(fp[near + 1])
            for i in np.nonzero((size > 2) | (np.arange(len(size)) == 0))[0]:
                if i == len(size) - 1:
                    continue
                run_fp = fp[cut[i] : cut[i + 1]]
                if flowing and i == 0 and key[0] == held_key:
                    hot.append(run_fp)
                elif len(run_fp) > bucket:
                    hot.append(run_fp)
                elif len(run_fp) > 2:
                    x, y = _spanning(run_fp, bits)
                    left += x
                    right += y
            flowing = flowing and len(size) == 1 and key[0] == held_key
            held_key, held = key[-1], fp[cut[-2] :]
            if flowing or len(held) > bucket:
                hot.append(held)
                held, flowing = np.zeros(0, np.int64), True
            yield out(left, right, hot)
        if len(held) and not flowing:
            x, y = _spanning(held, bits)
            yield out(x, y, [])
        elif len(held):
            yield out([], [], [held])

    return run


def _cut(fp: np.ndarray, parts: int) -> list[np.ndarray]:
    """The fingerprints' bits in `parts` pieces of nearly equal length."""
    u, ends = fp.view(np.uint64), [64 * i // parts for i in range(parts + 1)]
    return [u >> np.uint64(a) & np.uint64((1 << (b - a)) - 1) for a, b in zip(ends, ends[1:], strict=False)]


def sub_keys(fp: np.ndarray, parts: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """As `keys_of`, by pigeonhole: values with up to `bits` differing bits agree in `parts - bits` pieces, and each choice
    of so many pieces is a key."""
    pieces = _cut(fp, parts)
    keys = []
    for t, chosen in enumerate(combinations(range(parts), parts - bits)):
        total = np.full(len(fp), t + 1, dtype=np.uint64)
        for c in chosen:
            total = (total ^ pieces[c]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        keys.append(total.view(np.int64))
    return np.tile(np.arange(len(fp)), len(keys)), np.concatenate(keys)


def _blocked(hot: DataFrame, keyed, bits: int, block: int) -> DataFrame:
    """Links in buckets of any size: a bucket's members are dealt to blocks, and each two blocks meet in one task."""
    rows = hot.mapInArrow(_keyed(keyed), "key long, fp long")
    n = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("n"))
    rows = rows.join(n, "key").withColumn("at", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    meets = F.expr("transform(sequence(0, n - 1), r -> struct(least(r, at) AS i, greatest(r, at) AS j))")
    cells = rows.select("key", "fp", F.explode(meets).alias("c"))
    cells = cells.select(F.xxhash64("key", "c.i", "c.j").alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    return cells.mapInArrow(_links(bits, 1 << 62), "a long, b long").distinct()


def _keyed(keys):
    """Rows (fp) to rows (key, fp), by a function as `keys_of`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 512):
                part = fp[at : at + 512]
                where, key = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[where])], ["key", "fp"])

    return run


def links(prints: DataFrame, scratch: Scratch, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints that connect exactly what links at `bits` or fewer connect.

    Members of a bucket with more than `bucket` values get finer keys, in turn of 6 and of 8 pieces; what is crowded even
    then is compared block by block. Every level covers all pairs of its values, so the links are the same for any `bucket`.
    """
    if bits > 4:
        raise ValueError("the keys cover up to 4 bits")
    level, out = prints.select("fp").distinct(), None
    for name, keys in (("golay", keys_of), ("six", lambda fp: sub_keys(fp, 6, 4)), ("eight", lambda fp: sub_keys(fp, 8, 4))):
        keyed = level.mapInArrow(_keyed(keys), "key long, fp long").repartition("key").sortWithinPartitions("key")
        found = scratch.save(keyed.mapInArrow(_links(bits, bucket), "a long, b long").distinct(), name)
        sure = found.where("b is not null")
        out = sure if out is None else out.union(sure)
        level = found.where("b is null").select(F.col("a").alias("fp")).distinct()
        if level.isEmpty():
            return out
    return out.union(_blocked(level, lambda fp: sub_keys(fp, 8, 4), bits, bucket))


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links, itself included).

    Null text counts as empty, and texts without words have fingerprint zero and are linked like any other. Rows that
    repeat are each returned. A null doc_id joins its component but never names it; a component of such rows only has a
    null component_id. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save(fingerprints(docs, words), "prints")
    roots = components(links(prints, scratch, bits, bucket), scratch)
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    each = each.join(roots, each.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = each.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a component of many values must not meet its name in one task
    names = names.select("root", "component_id", F.explode(F.lit(list(range(_SALTS)))).alias("salt"))
    named = each.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(_SALTS)).cast("int")).join(names, ["root", "salt"], "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _staying(rows: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows whose doc_id is among those of `stay`, all columns unchanged whatever their names."""
    ids = stay.select(F.col("doc_id").alias(_free("kept", rows)))
    # the ids that stay grow with the table: they are never broadcast
    return rows.join(ids.hint("merge"), F.col("doc_id").cast("long") == F.col(ids.columns[0]), "left_semi")


def _free(name: str, df: DataFrame) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _once(rows: DataFrame, repeated: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with one row for each doc_id of `repeated` (doc_id); the others unchanged."""
    if repeated.isEmpty():
        return rows
    again = scratch.save(_staying(rows, repeated).dropDuplicates(["doc_id"]), "again")
    ids = repeated.select(F.col("doc_id").alias(_free("again", rows)))
    return rows.join(ids, F.col("doc_id").cast("long") == F.col(ids.columns[0]), "left_anti").union(again)


def keep_one(docs: DataFrame, words: int = 4, bits: int = BITS) -> DataFrame:
    """The rows of docs, all columns unchanged, with one document of each group of near duplicates: its smallest doc_id.

    Rows that repeat a doc_id count as copies, and one of them stays. Rows with a null doc_id all stay.
    """
    scratch = Scratch(docs.sparkSession)
    found = near_duplicates(docs, words, bits).where("doc_id is not null")
    copies = scratch.save(found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows")), "copies")
    rows = _once(docs.where("doc_id is not null"), copies.where("rows > 1").select("doc_id"), scratch)
    return _staying(rows, copies.where("doc_id = component_id")).union(docs.where("doc_id is null"))


def keep_distinct(docs: DataFrame, words: int = 4, bits: int = BITS, least: float = likeness.LEAST) -> DataFrame:
    """The rows of docs, all columns unchanged, with the smallest doc_id of each group that fingerprints within `bits`, and
    five-word shingles with a likeness of `least` or more, connect.

    Documents that go still connect others. Of rows that repeat a doc_id one stays at most, and its shingles count. Rows
    with a null doc_id all stay; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    found = near_duplicates(docs, words, bits).where("doc_id is not null")
    roots = scratch.save(found.groupBy("doc_id").agg(F.min("component_id").alias("root"), F.count(F.lit(1)).alias("rows")), "roots")
    rows = _once(docs.where("doc_id is not null"), roots.where("rows > 1").select("doc_id"), scratch)
    near = likeness.links(rows, scratch, least, roots)
    left, right = (roots.select(F.col("doc_id").alias(end), F.col("root").alias(to)) for end, to in (("a", "u"), ("b", "v")))
    merged = components(near.join(left, "a").join(right, "b").select("u", "v"), scratch, "u", "v")
    gone = merged.where("node <> root").select(F.col("node").alias("doc_id"))
    stay = scratch.save(roots.where("doc_id = root").join(gone, "doc_id", "left_anti").select("doc_id"), "kept")
    return _staying(rows, stay).union(docs.where("doc_id is null"))
