"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Documents of one text in one shard are interchangeable, so they move as a counted
unit (text, shard, n): a group of any size is at most `shards` rows. In each round a unit looks, by a join over its text,
for the shard that holds most of its neighbours and has room, and the wish is granted in the proportion that the shard's
quota allows. Texts that are still split after these rounds are laid whole, largest first, into the room that is left; if
some do not fit so, all linked texts are. Documents without links then fill every shard to its exact share.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents, ranked

GROUP = ["g", "text_crc32"]


def _propagate(units: DataFrame, quota: list[int], scratch: Scratch, rounds: int) -> DataFrame:
    """Units after at most `rounds` rounds of moves. Only totals of each shard come to the driver."""
    units = scratch.save(units, "units")
    held = {r["shard"]: r["n"] for r in units.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    for turn in range(rounds):
        room = [max(0, q - held.get(s, 0)) for s, q in enumerate(quota)]
        near = units.select(*GROUP, F.col("shard").alias("to"), F.col("n").alias("there")).where(F.get(F.lit(room), F.col("to")) > 0)
        better = (F.col("there") > F.col("n")) | (F.col("there") == F.col("n")) & (F.col("to") < F.col("shard"))
        wish = units.join(near, GROUP).where(better).groupBy(*GROUP, "shard", "n").agg((-F.min(-F.col("there") * 100 + F.col("to"))).alias("most"))
        wish = scratch.save(wish.select(*GROUP, "shard", "n", F.pmod(-F.col("most"), F.lit(100)).cast("int").alias("to")), "wishes")
        asked = {r["to"]: r["n"] for r in wish.groupBy("to").agg(F.sum("n").alias("n")).collect()}
        if not asked:
            break
        share = F.get(F.lit([min(1.0, room[s] / asked[s]) if s in asked else 0.0 for s in range(len(quota))]), F.col("to"))
        dice = F.pmod(F.xxhash64(*GROUP, "shard", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        moved = wish.withColumn("k", F.least(F.col("n"), F.floor(F.col("n") * share + dice)))
        change = moved.select(*GROUP, F.explode(F.array(F.struct("shard", (-F.col("k")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("k").alias("n")))).alias("c")).select(*GROUP, "c.*")
        after = units.select(*GROUP, "shard", "n").union(change).groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")).where("n > 0")
        units = scratch.save(after, "units")
        now = {r["shard"]: r["n"] for r in units.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        if now == held:
            break
        held = now
    return units


def _poured(sizes: dict[int, int], gaps: list[int]) -> tuple[list[dict], int]:
    """Ranges of ranks among the texts of n rows, each with the places (shard, rows) of its texts, and how many texts are
    split: those that fit no shard whole, which share what the others leave. These are fewer than shards."""
    gaps, out, split = list(gaps), [], []
    for n, count in sorted(sizes.items(), reverse=True):
        low = 0
        for s in range(len(gaps)):
            k = min(count - low, max(0, gaps[s]) // n)
            if k:
                out.append({"all": n, "low": low, "high": low + k, "places": [{"shard": s, "n": n}]})
                gaps[s] -= k * n
                low += k
        split += [(n, rank) for rank in range(low, count)]
    for n, rank in split:
        places, left = [], n
        for s in sorted(range(len(gaps)), key=lambda s: -gaps[s]):
            k = min(left, max(0, gaps[s]))
            if k:
                places.append({"shard": s, "n": k})
                gaps[s] -= k
                left -= k
        out.append({"all": n, "low": rank, "high": rank + 1, "places": places})
    return out, len(split)


def _gathered(units: DataFrame, quota: list[int], scratch: Scratch) -> DataFrame:
    """Units with no text split that can be whole. Only totals, and counts of texts by size, come to the driver."""
    texts = scratch.save(units.groupBy(*GROUP).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")), "texts")
    sizes = lambda t: {r["all"]: r["n"] for r in t.groupBy("all").agg(F.count(F.lit(1)).alias("n")).collect()}
    moving = texts.where((F.col("parts") > 1) & (F.col("all") <= max(quota)))
    counts = sizes(moving)
    held = {r["shard"]: r["n"] for r in units.join(moving.select(*GROUP), GROUP, "left_anti").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    gaps = [q - held.get(s, 0) for s, q in enumerate(quota)]
    places, split = _poured(counts, gaps)
    if split or min(gaps, default=0) < 0:
        moving = texts
        places, _ = _poured(sizes(texts), quota)
    if not places:
        return units
    table = units.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(places)), "array<struct<all: bigint, low: bigint, high: bigint, places: array<struct<shard: int, n: bigint>>>>")).alias("p")).select("p.*")
    order = ranked(moving.select(*GROUP, "all"), ["all"], GROUP, "rank")
    order = order.join(F.broadcast(table), "all").where("rank >= low and rank < high")
    new = order.select(*GROUP, F.explode("places").alias("p")).select(*GROUP, "p.shard", "p.n")
    stay = units.join(moving.select(*GROUP), GROUP, "left_anti").select(*GROUP, "shard", "n")
    return scratch.save(stay.union(new), "gathered")


def _by_range(rank: Column, counts: list[int]) -> Column:
    """The place of the range, of the given lengths in order, that a rank from 0 falls in."""
    ends, total = [], 0
    for n in counts:
        total += n
        ends.append(total)
    return F.size(F.filter(F.lit(ends).cast("array<bigint>"), lambda e: e <= rank))


def shard(docs: DataFrame, shards: int = 8, rounds: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law `rows`: the counts of any two shards differ by at most one. Equal texts share a shard as far as that allows; a
    text with more rows than a shard holds fills shards one after another. size is the text's UTF-8 bytes plus 1 (null
    text: none). slot runs gapless from 0 in each shard. Repeated rows are all placed, a null doc_id like any other; an
    empty table gives an empty result; other columns are ignored. grown_shard is null under this law.
    """
    scratch = Scratch(docs.sparkSession)
    rows = documents(docs).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"), F.xxhash64("text").alias("g"))
    rows = scratch.save(rows, "rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int")
    counted = rows.groupBy(*GROUP, start.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    linked = counted.groupBy(*GROUP).agg(F.sum("n").alias("all")).where("all > 1").select(*GROUP)
    units = _gathered(_propagate(counted.join(linked, GROUP), quota, scratch, rounds), quota, scratch)
    plan = units.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("plan"))
    placed = ranked(rows, GROUP, ["doc_id"], "at", attach=plan)
    # the place of a rank in its text's plan: as many entries as end at or before it
    ends = "transform(plan, (p, i) -> aggregate(slice(plan, 1, i + 1), 0L, (s, q) -> s + q.n))"
    placed = placed.withColumn("shard", F.expr(f"get(plan, size(filter({ends}, e -> e <= at))).shard")).drop("plan", "at")
    placed = scratch.save(placed, "placed")
    held = {r["shard"]: r["n"] for r in placed.where("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    sure, free = placed.where("shard is not null"), placed.where("shard is null").drop("shard")
    if any(held.get(s, 0) > q for s, q in enumerate(quota)):  # rounding can overfill a shard by a few: they are placed anew
        sure = scratch.save(ranked(sure, ["shard"], ["g", "doc_id"], "at"), "kept")
        over = F.col("at") >= F.get(F.lit(quota).cast("array<bigint>"), F.col("shard"))
        free = free.union(sure.where(over).select(free.columns))
        sure = sure.where(~over).drop("at")
        held = {s: min(n, quota[s]) for s, n in held.items()}
    gaps = [q - held.get(s, 0) for s, q in enumerate(quota)]
    free = ranked(free.withColumn("one", F.lit(0)), ["one"], ["doc_id"], "at")
    free = free.withColumn("shard", _by_range(F.col("at"), gaps).cast("int"))
    done = scratch.save(sure.select("doc_id", "size", "text_crc32", "shard").union(free.select("doc_id", "size", "text_crc32", "shard")), "sharded")
    out = ranked(done, ["shard"], ["doc_id"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
