"""Calls and replies of conversations in long form: the first violation of each, found by windows over stretches of rows.

Up to its first violation all that is open in a conversation was called by its last message that is no reply. So each row
needs that message, how many replies came since, and whether an id was there before; nothing is folded row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import running_count, stretched

CALLS = "array<struct<id: string, name: string, arguments: string>>"


def _is_object(json: Column) -> Column:
    return F.coalesce(F.get_json_object(json, "$").startswith("{"), F.lit(False))


def _repeated(rows: DataFrame, key: list[str], at: list[str]) -> DataFrame:
    """Rows that are not the first of their key, in the order of `at`: firsts are combined before a shuffle."""
    first = rows.groupBy(*key).agg(F.min(F.struct(*at)).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(first.drop("_n"), key).where(F.struct(*at) > F.col("_first"))


def violations(messages: DataFrame, key: str = "conv_id", at: str = "at", allow_pending: bool = False) -> DataFrame:
    """(key, at, reason) of the first violation of each conversation that has any.

    messages: (key, at, role, calls, reply_to), where calls are CALLS; null calls are none. Key and at are not null, and
    at is unique in a conversation. Replies answer an open call once, before any other message; only the assistant calls;
    ids are not used twice in a conversation; arguments are a JSON object; unless `allow_pending`, none stays open (told at
    the last message). Of a message's faults the first in this order counts.
    """
    rows = messages.select(F.col(key).alias("key"), F.col(at).alias("at"), "role", F.coalesce(F.col("calls"), F.array().cast(CALLS)).alias("calls"), "reply_to")
    rows = running_count(stretched(rows, "key", ["at"]), "key", ["at"], F.col("role") == "tool", "replies")
    reply = F.coalesce(F.col("role") == "tool", F.lit(False))
    ids = F.transform("calls", lambda c: c["id"])
    opener = F.when(~reply, F.struct("at", ids.alias("ids"), "replies"))
    inside = Window.partitionBy("key", "_stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_here", F.last(opener, ignorenulls=True).over(inside))
    # the last opener of the stretches before
    ends = rows.groupBy("key", "_stretch").agg(F.max_by(opener, F.when(~reply, F.col("at"))).alias("_end"), F.max("at").alias("_last"), F.sum(reply.cast("long")).alias("_n"))
    earlier = Window.partitionBy("key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(ends.select("key", "_stretch", F.last("_end", ignorenulls=True).over(earlier).alias("_carried")), ["key", "_stretch"])
    rows = rows.withColumn("_open", F.coalesce("_here", "_carried"))

    open_ids = F.coalesce(F.col("_open.ids"), F.array().cast("array<string>"))
    told = lambda place, rank, reason: F.struct(F.col("at").alias("at"), place.cast("int").alias("place"), F.lit(rank).alias("rank"), F.lit(reason).alias("reason"))
    orphan = F.when(reply & ~F.coalesce(F.array_contains(open_ids, F.col("reply_to")), F.lit(False)), told(F.lit(-1), 0, "reply without an open call"))
    early = F.when(~reply & (F.col("replies") - F.col("_open.replies") < F.size(open_ids)), told(F.lit(-1), 1, "message before a reply"))
    of_call = lambda rank, reason, bad: F.when(~reply, F.array_min(F.filter(F.transform("calls", lambda c, i: F.when(bad(c), told(i, rank, reason))), lambda x: x.isNotNull())))
    other = of_call(2, "call by another role", lambda c: ~F.coalesce(F.col("role") == "assistant", F.lit(False)))
    shape = of_call(4, "arguments are no object", lambda c: ~_is_object(c["arguments"]))
    found = rows.select("key", F.least(orphan, early, other, shape).alias("v"))

    called = rows.where(~reply).select("key", "at", F.posexplode("calls").alias("place", "call")).select("key", "at", "place", F.col("call.id").alias("id"))
    again = _repeated(called, ["key", "id"], ["at", "place"]).select("key", told(F.col("place"), 3, "repeated call id").alias("v"))
    answered = rows.where(reply & F.col("reply_to").isNotNull()).select("key", F.col("_open.at").alias("opened"), "reply_to", "at").where("opened is not null")
    twice = _repeated(answered, ["key", "opened", "reply_to"], ["at"]).select("key", told(F.lit(-1), 0, "reply without an open call").alias("v"))
    found = found.unionByName(again).unionByName(twice)
    if not allow_pending:
        whole = ends.groupBy("key").agg(F.max_by("_end", F.col("_end.at")).alias("e"), F.max("_last").alias("at"), F.sum("_n").alias("n"))
        left = whole.where(F.col("n") - F.col("e.replies") < F.size("e.ids"))
        found = found.unionByName(left.select("key", told(F.lit(1 << 30), 5, "unanswered call").alias("v")))
    return found.groupBy("key").agg(F.min("v").alias("v")).where("v is not null").select(F.col("key").alias(key), F.col("v.at").alias(at), F.col("v.reason").alias("reason"))
