"""An append-only archive of attempts: each event is chained to the one before it, and a batch that runs again appends nothing.

Where an attempt's chain stands is state of the stream. Each micro-batch writes the links of its own events into a folder of
its number, which a repetition replaces by the same links. An attempt is sealed by its `finish` event; later ones are refused.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.fold import stretched
from .context import _PROVIDER

START = "0" * 64
LINK = "attempt_id long, sequence long, kind string, payload string, previous_sha256 string, sha256 string, refused string"


def link(previous: str, sequence: int, kind: str | None, payload: str | None) -> str:
    """SHA-256 of the link before, the number, the kind and the payload; null is empty text."""
    return hashlib.sha256(f"{previous}|{sequence}|{kind or ''}|{payload or ''}".encode("utf-8", "surrogatepass")).hexdigest()


def _link() -> Column:
    return F.sha2(F.concat_ws("|", "previous_sha256", F.col("sequence").cast("string"), F.coalesce("kind", F.lit("")), F.coalesce("payload", F.lit(""))), 256)


def _processor(finish: str):
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Chain(StatefulProcessor):
        """Value state: the next number, the last link and whether the attempt is sealed. Map state: events that came early."""

        def init(self, handle) -> None:
            self.head = handle.getValueState("head", "sequence long, sha256 string, sealed boolean")
            self.held = handle.getMapState("held", "sequence long", "kind string, payload string")

        def handleInputRows(self, key, rows, timerValues):
            at, previous, sealed = self.head.get() if self.head.exists() else (0, START, False)
            came = {}
            for frame in rows:
                for sequence, kind, payload in frame[["sequence", "kind", "payload"]].sort_values(["sequence", "kind", "payload"]).itertuples(index=False, name=None):
                    came.setdefault(sequence, (kind, payload))
            if self.held.exists():
                came = {s[0]: tuple(v) for s, v in self.held.iterator()} | {s: v for s, v in came.items() if not self.held.containsKey((s,))}
            out = []
            for sequence in sorted(s for s in came if s >= at):
                kind, payload = came[sequence]
                if sealed:
                    out.append((key[0], sequence, kind, payload, None, None, "after the attempt was sealed"))
                elif sequence == at:
                    now = link(previous, at, kind, payload)
                    out.append((key[0], at, kind, payload, previous, now, None))
                    at, previous, sealed = at + 1, now, kind == finish
                    self.held.removeKey((sequence,))
                else:
                    self.held.updateValue((sequence,), (kind, payload))
            self.head.update((at, previous, sealed))
            if out:
                yield pd.DataFrame(out, columns=["attempt_id", "sequence", "kind", "payload", "previous_sha256", "sha256", "refused"])

        def close(self) -> None:
            pass

    return Chain()


def append(spark: SparkSession, events: DataFrame, home: str, finish: str) -> DataFrame:
    """Everything that has come in a stream of (attempt_id, sequence, kind, payload) is appended to the archive in `home`, which
    is returned as LINK rows. Numbers count from 0; an event that comes before its predecessor waits for it, one that
    comes again is passed over. A later call goes on where the last one ended."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        links = events.groupBy("attempt_id").transformWithStateInPandas(_processor(finish), LINK, "Append", "None")

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{home}/links/batch={number}")

        links.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    return archived(spark, home)


def archived(spark: SparkSession, home: str) -> DataFrame:
    return spark.read.schema(LINK).option("recursiveFileLookup", "true").parquet(f"{home}/links")


def broken_links(links: DataFrame) -> DataFrame:
    """(attempt_id, sequence, reason) of links that are not where or what they were: a gap or a repeated number, another
    predecessor, another content. Windows hold a stretch of an attempt; what a stretch begins with is held against the end
    of the one before."""
    rows = stretched(links.where("refused is null").select("attempt_id", "sequence", "kind", "payload", "previous_sha256", "sha256"), "attempt_id", ["sequence"])
    ends = rows.groupBy("attempt_id", "_stretch").agg(F.max_by(F.struct("sequence", "sha256"), "sequence").alias("_end"))
    ends = ends.select("attempt_id", "_stretch", F.lag("_end").over(Window.partitionBy("attempt_id").orderBy("_stretch")).alias("_carried"))
    inside = F.lag(F.struct("sequence", "sha256")).over(Window.partitionBy("attempt_id", "_stretch").orderBy("sequence", "sha256"))
    rows = rows.withColumn("_before", inside).join(ends, ["attempt_id", "_stretch"]).withColumn("_before", F.coalesce("_before", "_carried"))
    why = (
        F.when(F.col("sequence") != F.coalesce(F.col("_before.sequence") + 1, F.lit(0)), "number")
        .when(F.col("previous_sha256") != F.coalesce(F.col("_before.sha256"), F.lit(START)), "predecessor")
        .when(F.col("sha256") != _link(), "content")
    )
    return rows.select("attempt_id", "sequence", why.alias("reason")).where("reason is not null")


def export(links: DataFrame, attempts: DataFrame, finish: str) -> DataFrame:
    """(attempt_id, task_id, split, n_events, head, state): attempts (attempt_id, task_id, split, success) by what became of them.

    `invalid` if a link is broken, `incomplete` without a `finish` event, `admitted` for the first success of a task and
    split, `kept` otherwise. Refused events count for nothing; an attempt without events is incomplete.
    """
    good = links.where("refused is null")
    seen = good.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("n_events"), F.max_by("sha256", "sequence").alias("head"), F.max(F.coalesce(F.col("kind") == finish, F.lit(False))).alias("_sealed"))
    bad = broken_links(links).select("attempt_id").distinct().withColumn("_broken", F.lit(True))
    rows = attempts.join(seen, "attempt_id", "left").join(bad, "attempt_id", "left")
    whole = F.coalesce(F.col("_sealed"), F.lit(False)) & F.col("_broken").isNull()
    first = rows.where(whole & F.col("success")).groupBy("task_id", "split").agg(F.min("attempt_id").alias("_first"))
    rows = rows.join(first, ["task_id", "split"], "left")
    state = F.when(F.col("_broken"), "invalid").when(~whole, "incomplete").when(F.coalesce(F.col("attempt_id") == F.col("_first"), F.lit(False)), "admitted").otherwise("kept")
    return rows.select("attempt_id", "task_id", "split", F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"), "head", state.alias("state"))
