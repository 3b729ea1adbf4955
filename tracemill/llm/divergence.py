"""Source divergence audit: how far each source's words are from its language's and from each other source's.

A count-min sketch of document frequencies is filled in each partition, its counters merged in a tree; it never
underestimates, so a term whose smallest counter stays below the bound cannot be kept and is not shuffled. What is left is
counted exactly. Every two sources of a language are then compared by a join of the terms that both have; what only one of
them has comes from how many of its terms have which count.

Null text, lang and source are empty. A term is a run of ASCII letters and of whatever is not ASCII, with A to Z lower-cased.
Repeated rows, also of one doc_id, are documents of their own. A language without kept terms has no `term` rows, and pairs of 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded

#: Documents of its language that a kept term is in.
LEAST = 10
#: Counters of a sketch: rows by columns. A column is a byte in a merge and a bit afterwards, whatever the corpus' size; a
#: corpus with far more different terms than columns wants more of them, or nothing is discarded (results stay exact).
DEPTH, WIDTH = 4, 1 << 20
_BLOCK = 1 << 16
_FAN = 64
#: Different terms that a task counts before it hands them on.
FLUSH = 200_000
#: Terms of a source that a report lists.
TOP = 10
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """UTF-8 in, UTF-8 terms out: bytes of other than ASCII characters are all over 127."""
    return text.translate(_TERM_BYTES).split()


def cells(lang: bytes, terms: Iterable[bytes], width: int = WIDTH, depth: int = DEPTH) -> np.ndarray:
    """depth x terms: the column of each term in each row, from two halves of one 128-bit hash."""
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang)
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t, seed) for t in terms), ">u8").reshape(-1, 2).astype(np.uint64)
    steps = np.arange(depth, dtype=np.uint64)[:, None]
    return ((raw[:, 0] + steps * (raw[:, 1] | np.uint64(1))) % np.uint64(width)).astype(np.int64)


def _sparse(part: int, counters: np.ndarray) -> pa.RecordBatch:
    """(block, part, at, n): the counters above zero of each block that has any, as packed numbers."""
    out: list[list] = [[], [], [], []]
    for block in range(0, counters.size, _BLOCK):
        at = np.flatnonzero(counters[block : block + _BLOCK])
        if at.size:
            for column, value in zip(out, (block // _BLOCK, part, at.astype("<u2").tobytes(), counters[block + at].astype("u1").tobytes()), strict=True):
                column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["block", "part", "at", "n"])


def _merged(table: pa.Table, least: int) -> pa.Table:
    total = np.zeros(_BLOCK, np.int64)
    for at, n in zip(table["at"].to_pylist(), table["n"].to_pylist(), strict=True):
        total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "u1")
    at = np.flatnonzero(total)
    row = [table["block"][0].as_py(), table["part"][0].as_py(), at.astype("<u2").tobytes(), np.minimum(total[at], least).astype("u1").tobytes()]
    return pa.table([[x] for x in row], schema=pa.schema([("block", pa.int32()), ("part", pa.int64()), ("at", pa.binary()), ("n", pa.binary())]))


def sketch(docs: DataFrame, scratch: Scratch, least: int = LEAST, width: int = WIDTH, depth: int = DEPTH) -> np.ndarray:
    """A bit for each counter of the merged sketch: whether it reached `least` (255 at most).

    Counters stop at `least` in every partition and merge, which keeps sums from `least` on at `least`: nothing below
    the bound is ever taken for more than it is counted, nor what reaches it for less. `docs` has lang and text.
    """
    if not 0 < least < 256 or width % _BLOCK:
        raise ValueError(f"a sketch needs a bound of 1 to 255 and columns in blocks of {_BLOCK}")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counters, seen = np.zeros(depth * width, np.uint32), {}
        shift = (np.arange(depth, dtype=np.int64) * width)[:, None]

        def flush() -> None:
            for lang, found in seen.items():
                if found:
                    n = np.minimum(np.fromiter(found.values(), np.int64, len(found)), least).astype(np.uint32)
                    at = cells(lang, found, width, depth) + shift
                    for row in at:
                        np.add.at(counters, row, n)
            np.minimum(counters, least, out=counters)
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(set(terms_of(text)))
            if sum(map(len, seen.values())) > FLUSH:
                flush()
        flush()
        yield _sparse(TaskContext.get().partitionId(), counters)

    kind = "block int, part long, at binary, n binary"
    parts = scratch.save(docs.select(F.encode("lang", "utf-8"), F.encode("text", "utf-8")).mapInArrow(fill, kind), "sketches")
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = parts.withColumn("part", F.expr(f"part div {_FAN}")).groupBy("block", "part").applyInArrow(lambda t: _merged(t, least), kind)
        left = -(-left // _FAN)
        if left == 1:
            break
    bits = np.zeros(depth * width, bool)
    for row in parts.collect():  # a row for each block, of a fixed number of blocks
        at = np.frombuffer(bytes(row["at"]), "<u2").astype(np.int64)
        bits[row["block"] * _BLOCK + at] = np.frombuffer(bytes(row["n"]), "u1") >= least
    return np.packbits(bits)


def possible(bits: np.ndarray, lang: bytes, terms: list[bytes], width: int = WIDTH, depth: int = DEPTH) -> np.ndarray:
    """Whether the sketch lets each term reach the bound."""
    at = cells(lang, terms, width, depth) + (np.arange(depth, dtype=np.int64) * width)[:, None]
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def occurrences(docs: DataFrame, bits: np.ndarray, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """(lang, source, term, n, docs) of possible terms, summed within stretches of each partition."""
    held = docs.sparkSession.sparkContext.broadcast(bits)
    kind = "lang string, source string, term string, n long, docs long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in seen.items():
                terms = list(n)
                terms = [t for t, ok in zip(terms, possible(held.value, lang, terms, width, depth), strict=True) if ok] if terms else []
                if terms:
                    k = len(terms)
                    strings = [pa.array([x.decode()] * k, pa.string()) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*strings, pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([in_docs[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = terms_of(text)
                n, in_docs = seen.setdefault((lang, source), (Counter(), Counter()))
                n.update(found)
                in_docs.update(set(found))
            if sum(len(n) for n, _ in seen.values()) > FLUSH:
                yield from flush()
        yield from flush()

    return docs.select(*[F.encode(c, "utf-8") for c in ("lang", "source", "text")]).mapInArrow(count, kind)


def share(n: str | int) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 V)) over the columns total and v, exactly."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div nullif(cast(total + 2 * v as decimal(20,0)), 0)").cast("long")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for every other source of the language, `term` rows for the
    `top` terms that the source has more of than its language. Shares count two more of each kept term, in units of 10^-9."""
    scratch = Scratch(docs.sparkSession)
    docs = bounded(docs).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    bits = sketch(docs.select("lang", "text"), scratch, least, width, depth)
    # one shuffle: sums for each source, then for each term of a language, are over rows that lie together
    dealt = occurrences(docs, bits, width, depth).repartition("lang", "term")
    of_term = Window.partitionBy("lang", "term")
    exact = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    exact = exact.withColumns({"docs": F.sum("docs").over(of_term), "all_n": F.sum("n").over(of_term), "first": F.lag("n").over(of_term.orderBy("source")).isNull()})
    counts = scratch.save(exact.where(F.col("docs") >= least).drop("docs"), "counts")

    # tables of languages and of sources are written first: joins see how small they are, and need not deal terms by language
    langs = scratch.save(counts.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("total")), "langs")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left").fillna(0, ["total", "v"])
    groups = scratch.save(groups.withColumn("p0", share(0)), "groups")
    own = counts.join(groups, ["lang", "source"]).withColumn("p", share("n"))

    of_lang = own.drop("total", "v").join(langs, "lang").withColumn("q", share("all_n"))
    terms = of_lang.where("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    terms = _ranked(terms, "term").where(F.col("rank") <= top)

    # for each two sources: all terms as if neither had any, then what the terms of one, and those of both, change
    a = groups.select("lang", "source", "v", F.col("p0").alias("p0a"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("p0b"))
    pairs = a.join(b, "lang").where("source <> item").withColumn("none", F.coalesce(F.col("v") * apart("p0a", "p0b"), F.lit(0)))
    alike = own.groupBy("lang", "source", "p", F.col("p0").alias("p0a")).agg(F.count(F.lit(1)).alias("k"))
    one = alike.join(b, "lang").where("source <> item").withColumn("d", F.col("k") * (apart("p", "p0b") - apart("p0a", "p0b"))).groupBy("lang", "source", "item").agg(F.sum("d").alias("d"))
    x = own.select("lang", "term", "source", F.col("p").alias("pa"), F.col("p0").alias("p0a"))
    y = own.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("pb"), F.col("p0").alias("p0b"))
    change = apart("pa", "pb") - apart("pa", "p0b") - apart("p0a", "pb") + apart("p0a", "p0b")
    both = x.join(y, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(change).alias("d"))
    swapped = lambda rows: rows.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "d")
    changes = one.unionByName(swapped(one)).unionByName(both).unionByName(swapped(both)).groupBy("lang", "source", "item").agg(F.sum("d").alias("d"))
    pairs = pairs.join(changes, ["lang", "source", "item"], "left").withColumn("value", F.col("none") + F.coalesce(F.col("d"), F.lit(0)))
    return _ranked(pairs, "pair").unionByName(terms)
