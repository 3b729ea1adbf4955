"""Greedy selection: in order, admit a row if neither of its two keys belongs to a row admitted before."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dropped, written


def _settled(open_rows: DataFrame, order: str, a: str, b: str) -> DataFrame:
    """Orders of open rows that are certainly admitted, written.

    A row that comes first for both its keys is admitted. A row that comes first for one key and second for the other waits
    for one row alone, and is admitted if that one is not: such rows form chains, along which every second one is admitted.
    Chains are shortened by doubling: each pass joins every pointer with the one that it points to.
    """
    tops = []
    for side, key in (("a", a), ("b", b)):
        first = open_rows.groupBy(key).agg(F.min(order).alias("one"))
        later = open_rows.select(key, order).join(first, key).where(F.col(order) > F.col("one")).groupBy(key).agg(F.min(order).alias("two"))
        tops.append(first.join(later, key, "left").select(key, F.col("one").alias(f"{side}1"), F.col("two").alias(f"{side}2")))
    rows = open_rows.select(F.col(order).alias("at"), F.col(a).alias(a), F.col(b).alias(b)).join(tops[0], a).join(tops[1], b).select("at", "a1", "a2", "b1", "b2")
    first_a, first_b = F.col("at") == F.col("a1"), F.col("at") == F.col("b1")
    second_a, second_b = F.coalesce(F.col("at") == F.col("a2"), F.lit(False)), F.coalesce(F.col("at") == F.col("b2"), F.lit(False))
    waits = F.when(first_a & first_b, F.col("at")).when(first_a & second_b, F.col("b1")).when((second_a & first_b) | (second_a & second_b & (F.col("a1") == F.col("b1"))), F.col("a1"))
    known = written(rows.select("at", waits.alias("to")).where("to is not null"), "known")
    roots = known.where("at = to").select("at")
    chains = written(known.where("at <> to").select("at", "to", F.lit(1).alias("steps")), "chains")
    while True:
        ahead = chains.select(F.col("at").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"))
        joined = chains.join(ahead, "to", "left")
        longer = written(joined.select("at", F.coalesce("further", "to").alias("to"), ((F.col("steps") + F.coalesce("more", F.lit(0))) % 2).alias("steps"), F.col("further").isNotNull().alias("moved")), "chains")
        dropped(chains)
        chains = longer
        if chains.where("moved").isEmpty():
            break
    even = chains.where("steps = 0").join(roots.withColumnRenamed("at", "to"), "to", "left_semi").select("at")
    out = written(roots.union(even), "settled")
    dropped(known)
    dropped(chains)
    return out


def greedy_two_keys(rows: DataFrame, order: str, a: str, b: str) -> DataFrame:
    """The admitted rows. Rejected rows leave no trace, so two row numbers would be wrong.

    `order` is unique and not null; rows with a null key are not admitted. Each round admits what is settled and closes every
    open row that shares a key with it; the first open row of all is always settled, so rounds end without a bound. Chains of
    any length take one round, of as many passes as the logarithm of their length. Every pass is a written table, and tables
    that are done with go.
    """
    left, done = written(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()), "open"), None
    while True:
        orders = _settled(left, order, a, b)
        admitted = written(left.join(orders, left[order] == orders["at"], "left_semi"), "admitted")
        done = admitted if done is None else done.union(admitted)
        rest = written(left.join(admitted.select(a), a, "left_anti").join(admitted.select(b), b, "left_anti").select(*rows.columns), "open")
        dropped(left)
        dropped(orders)
        left = rest
        if left.isEmpty():
            return done
