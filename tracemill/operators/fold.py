"""Ordered folds over keys of any length, and running counts that do not gather a key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import written


def ordered_fold(rows: DataFrame, key: str, order: list[str], start: Callable[[Any], Any], step: Callable[[Any, dict], Iterable[tuple]], finish: Callable[[Any], Iterable[tuple]], out: str) -> DataFrame:
    """What `step(state, row)` gives for the rows of each key in order, then `finish(state)`; `start(key)` makes the state.

    Rows are dealt by key, sorted within partitions and streamed: a key that spans Arrow batches goes on where it was, and
    nothing but its state is held. All of a key's rows pass through one task, as a fold needs. A null key is a key.
    """
    names, kinds = rows.columns, StructType.fromDDL(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, state, now, begun = to_arrow_schema(kinds), None, None, False
        at = names.index(key)

        def sent(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            found: list[tuple] = []
            keys = batch.column(at).to_pylist()
            for i, row in enumerate(batch.to_pylist()):
                if not begun or keys[i] != now:
                    if begun:
                        found += finish(state)
                    state, now, begun = start(keys[i]), keys[i], True
                found += step(state, row)
            yield sent(found)
        if begun:
            yield sent(list(finish(state)))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kinds)


def stretched(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows, written in stretches of (key, order): `_stretch` ascends with both, and one key can have many."""
    dealt = rows.repartitionByRange(key, *order).withColumn("_stretch", F.spark_partition_id())
    return written(dealt, "stretches")


def running_count(rows: DataFrame, key: str, order: list[str], holds: Column, name: str) -> DataFrame:
    """Stretched rows with `name`: how many earlier rows of the key meet a condition. Windows hold a stretch of a key, and the
    counts of a key's stretches."""
    hit = F.coalesce(holds, F.lit(False)).cast("long")
    totals = rows.groupBy(key, "_stretch").agg(F.sum(hit).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_stretch")) - F.col("_n")
    totals = totals.select(F.col(key).alias("_key"), F.col("_stretch").alias("_s"), before.alias("_before"))
    inside = F.sum(hit).over(Window.partitionBy(key, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - hit
    found = rows.withColumn(name, inside).join(totals, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_s")))
    return found.withColumn(name, F.col(name) + F.col("_before")).drop("_key", "_s", "_before")
