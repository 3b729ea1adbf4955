"""Order MinHash fingerprints, in DataFrame operations only.

A text's elements are its pairs of adjoining words, each numbered by occurrence. One hash lays the elements on a circle, and
each of 64 points of the circle selects the two elements that come next: the two smallest under that rotation of the hash.
They are kept in text order, and the fingerprint has one tuple hash for each point: 15 bits for the two elements and one for
their order. Two texts agree at a point if they share the selected elements and their order, which edits that move text
break as well. The 64 tuples of a text come from one sort of its elements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, documents

BINS = 64
_DIGITS = 4
#: Bits of a packed element that hold its place; the rest is hash. No text of 2 GB has more word pairs than that.
_PLACE_BITS = 30
_PLACE = (1 << _PLACE_BITS) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def order_minhash(text: Column, bins: int = BINS) -> Column:
    """The fingerprint: 4 hex digits for each point; all zeros for a text without words. `bins` is a power of two up to 1024."""
    bits = bins.bit_length() - 1
    bin_of = lambda x: (F.shiftright(x, 64 - bits) + bins // 2).cast("int")
    hashed = lambda x: F.shiftright(x, _PLACE_BITS)
    place = lambda x: x.bitwiseAND(F.lit(_PLACE))
    packed = lambda h, p: h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(p.cast("long"))
    places = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def elements(words: Column) -> Column:
        """Hashes of word pairs (a single word alone) with their places, in hash order."""
        n = F.greatest(F.size(words) - 1, F.least(F.size(words), F.lit(1)))
        return F.sort_array(F.transform(places(n), lambda i: packed(F.xxhash64(F.get(words, i), F.get(words, i + 1)), i)))

    def numbered(e: Column) -> Column:
        """The same elements hashed with their occurrence number, in the new hash order."""
        starts = F.filter(places(F.size(e)), lambda i: (i == 0) | (hashed(F.get(e, i)) != hashed(F.get(e, i - 1))))
        occurrence = _let(starts, lambda s: F.flatten(F.transform(s, lambda at, j: F.sequence(F.lit(0), F.coalesce(F.get(s, j + 1), F.size(e)) - at - 1))))
        return _let(occurrence, lambda o: F.sort_array(F.transform(e, lambda x, i: packed(F.xxhash64(hashed(x), F.get(o, i)), place(x)))))

    def tuples(e: Column) -> Column:
        """The tuple of each point: the first two elements at or after it, on a circle, with a bit for their text order.

        A point between two filled ranges selects what the next filled range's does, so each range's tuple is repeated
        for the points before it that have none, and the first one's for those after the last.
        """
        first = F.filter(places(F.size(e)), lambda i: (i == 0) | (bin_of(F.get(e, i)) != bin_of(F.get(e, i - 1))))

        def digest(i: Column) -> Column:
            x, y = F.get(e, i), F.get(e, F.pmod(i + 1, F.size(e)))
            both = F.pmod(F.xxhash64(hashed(x), hashed(y)), F.lit((1 << 15) - 1)) + 1
            return F.lpad(F.hex(both * 2 + (place(x) < place(y)).cast("long")), _DIGITS, "0")

        def spread(f: Column) -> Column:
            reach = lambda j: F.when(j < 0, F.lit(-1)).otherwise(bin_of(F.get(e, F.get(f, j))))
            upto = F.flatten(F.transform(f, lambda i, j: F.array_repeat(digest(i), reach(j) - reach(j - 1))))
            return F.concat(upto, F.array_repeat(digest(F.get(f, F.lit(0))), bins - 1 - reach(F.size(f) - 1)))

        return _let(first, lambda f: F.when(F.size(f) > 0, F.array_join(spread(f), "")).otherwise(F.lit("0" * _DIGITS * bins)))

    words = F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), "")
    return F.lower(_let(words, lambda w: _let(elements(w), lambda e: _let(numbered(e), tuples))))


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated share of two texts that an edit leaves alone, from 0 to 1; 1 for two texts without words, 0 for one.

    The elements of a point are all shared with probability J*J, J being the Jaccard likeness of the elements, which gives
    the shared part 2J/(1+J). Of the points that agree but for the order bit, the share that agrees in order measures how
    far the shared part kept its order, and multiplies it: halves that change places halve the likeness.
    """
    cut = lambda s, i: F.conv(F.substring(s, i * _DIGITS + 1, F.lit(_DIGITS)), 16, 10).cast("int")
    slots = F.sequence(F.lit(0), F.lit(bins - 1))
    pairs = F.transform(slots, lambda i: F.struct(cut(a, i).alias("x"), cut(b, i).alias("y")))
    count = lambda p, holds: F.size(F.filter(p, holds)) / F.lit(float(bins))
    part = lambda u: 2 * F.sqrt(u) / (1 + F.sqrt(u))
    found = _let(pairs, lambda p: F.struct(count(p, lambda t: F.shiftright(t.x, 1) == F.shiftright(t.y, 1)).alias("u"), count(p, lambda t: t.x == t.y).alias("c")))
    empty = F.lit("0" * _DIGITS * bins)
    one = F.when((a == empty) & (b == empty), F.lit(1.0)).when((a == empty) | (b == empty), F.lit(0.0))
    return one.otherwise(_let(found, lambda t: F.when(t["u"] > 0, part(t["u"]) * t["c"] / t["u"]).otherwise(F.lit(0.0)))).cast("double")


def followers(ids: DataFrame, scratch: Scratch, key: str = "k") -> DataFrame:
    """(key, next) for distinct keys: the next smaller one, and the largest after the smallest.

    Keys are dealt by range; only the ends of each range meet in one place.
    """
    dealt = scratch.save(ids.select(key).distinct().repartitionByRange(key).withColumn("part", F.spark_partition_id()), "ids")
    ends = dealt.groupBy("part").agg(F.max(key).alias("high"))
    ends = ends.select("part", F.coalesce(F.lag("high").over(Window.orderBy("part")), F.max("high").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("previous"))
    inside = dealt.withColumn("lower", F.lag(key).over(Window.partitionBy("part").orderBy(key)))
    return inside.join(F.broadcast(ends), "part").select(key, F.coalesce("lower", "previous").alias("next"))


def fingerprints(docs: DataFrame, bins: int = BINS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row for each row of docs.

    The edited text ends with the beginning of the next document's instead of its own last third. Null text counts as
    empty. Rows of one doc_id are documents of their own, one after the other in the order of a hash of their texts, the
    largest first; rows that repeat a text as well have one place and equal results. A null doc_id sorts below all others
    and is returned as null. A single document is its own next one. An empty table gives an empty result; other columns
    are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    # one plain column in the order of ids, then hashes: 16 hexadecimal digits of each, the smallest id (or none) first
    digits = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    rows = documents(docs).select(F.concat(digits(F.coalesce("doc_id", F.lit(-(1 << 63)))), digits(F.xxhash64("text"))).alias("k"), "doc_id", "text")
    texts = rows.groupBy("k").agg(F.min("text").alias("text"))  # alike in both uses, so that it is shuffled once
    after = followers(rows, scratch)
    most = rows.groupBy("k").agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("most"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    heads = after.join(most, "k").join(texts.select(F.col("k").alias("next"), F.col("text").alias("other")), "next")
    heads = heads.select("k", "next", "doc_id", "copies", F.substring("other", F.lit(1), F.col("most")).alias("other"))
    both = texts.join(heads, "k")
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("other", F.lit(1), third))
    both = both.select("k", "next", "doc_id", "copies", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    made = both.select("k", "next", "doc_id", "copies", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), order_minhash(F.col("text"), bins).alias("fingerprint"), order_minhash(F.col("edited"), bins).alias("edited_fingerprint"))
    made = scratch.save(made, "prints")
    other = made.select(F.col("k").alias("next"), F.col("fingerprint").alias("next_fingerprint"))
    out = made.join(other, "next").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), bins).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint"), bins).alias("near_next"), "copies")
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "col")
