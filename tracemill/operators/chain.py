"""Hash chains over ordered rows."""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import ordered_fold


def fold_chain(rows: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """key, rows and head of each key's chain: every link is the SHA-256 of the previous link and the row's payload.

    A chain is sequential by nature: a key's rows pass through one task in order, of which only the last link is held.
    A null payload is empty text.
    """

    def step(state: list, row: dict) -> tuple:
        state[1:] = [state[1] + 1, hashlib.sha256(f"{state[2]}|{row['payload'] or ''}".encode("utf-8", "surrogatepass")).hexdigest()]
        return ()

    kind = rows.schema[key].dataType.simpleString()
    folded = ordered_fold(rows.select(F.col(key).alias("key"), F.col(order).alias("at"), payload.alias("payload")), "key", ["at", "payload"], lambda k: [k, 0, ""], step, lambda state: [tuple(state)], f"key {kind}, n_rows long, head string")
    return folded.withColumnRenamed("key", key)
