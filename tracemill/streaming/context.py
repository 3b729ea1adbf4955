"""The visible context of conversations as keyed state of a stream, and the same as a fold over a stored table.

Before each message of the assistant its context is brought within a budget by compactions; each compaction and each
message of the assistant gives an event that says what it saw, so that `operators.replay` can check it afterwards.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from ..operators import compaction
from ..operators.fold import ordered_fold
from ..operators.linkage import CALLS
from ..sources.tables import shared_path

MESSAGE = f"struct<role: string, content: string, calls: {CALLS}, reply_to: string>"
EVENT = (
    f"seq int, type string, turn long, mode string, input array<{MESSAGE}>, message {MESSAGE}, pinned array<{MESSAGE}>, source array<{MESSAGE}>, retained array<{MESSAGE}>, split_index int, "
    f"keep array<int>, summary string, summary_message {MESSAGE}, result array<{MESSAGE}>, budget long, tokens_before long, tokens_after long, accepted boolean, reason string"
)
FIELDS = ("seq type turn mode input message pinned source retained split_index keep summary summary_message result budget tokens_before tokens_after accepted reason").split()
SUMMARY_HEAD = "Summary of earlier messages, for reference only:\n"
Message = dict[str, Any]


def conservative(said: Iterable[Message]) -> int:
    """Bytes of each message as JSON with sorted keys, and 16 for each."""
    return sum(len(json.dumps({k: v for k, v in m.items() if v is not None}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8", "surrogatepass")) + 16 for m in said)


class Policy:
    """How a context is kept: mode, budget, what tokens cost, and how messages become a summary (`choose` for manual)."""

    def __init__(self, mode: str, budget: int, summarise: Callable[[list[Message]], str], cost: Callable[[Iterable[Message]], int] = conservative, choose=None):
        if mode not in compaction.MODES or budget <= 0:
            raise ValueError("a context needs a known mode and a positive budget")
        self.mode, self.budget, self.summarise, self.cost, self.choose = mode, budget, summarise, cost, choose


class Context:
    """What a conversation shows the model, and how it came about. `stopped` says why it could not be brought within its budget;
    later messages are then counted, but neither shown nor answered."""

    def __init__(self, said: list[Message] | None = None, turns: int = 0, events: int = 0, compactions: int = 0, stopped: str | None = None):
        self.said, self.turns, self.events, self.compactions, self.stopped = said or [], turns, events, compactions, stopped

    def add(self, message: Message, policy: Policy) -> Iterator[dict]:
        """Take the next message; its events come out."""
        if self.stopped is None and message["role"] == "assistant":
            while self.stopped is None and policy.cost(self.said) > policy.budget:
                yield self._compacted(policy)
            if self.stopped is None:
                yield self._event("assistant", input=self.said, message=message)
        if self.stopped is None:
            self.said = [*self.said, message]
        self.turns += 1

    def _event(self, kind: str, **what) -> dict:
        self.events += 1
        return {"seq": self.events - 1, "type": kind, "turn": self.turns} | what

    def _compacted(self, policy: Policy) -> dict:
        before = policy.cost(self.said)
        done = compaction.plan(self.said, policy.mode, policy.cost, policy.summarise, policy.choose)
        if isinstance(done, str):
            self.stopped = done
            return self._event("error", mode=policy.mode, input=self.said, budget=policy.budget, tokens_before=before, reason=done)
        summary = {"role": "user", "content": SUMMARY_HEAD + done["summary"]}
        result = [*done["pinned"], summary, *done["retained"]]
        after = policy.cost(result)
        event = self._event("compaction", mode=policy.mode, input=self.said, **done, summary_message=summary, result=result, budget=policy.budget, tokens_before=before, tokens_after=after, accepted=after < before)
        if after < before:
            self.said, self.compactions = result, self.compactions + 1
        else:
            self.stopped = "not smaller"
        return event

    def shown(self) -> tuple:
        return (self.turns, self.compactions, self.stopped, [full(m) for m in self.said])


def full(m: Message | None) -> dict | None:
    return None if m is None else {"role": m["role"], "content": m["content"], "calls": m.get("calls"), "reply_to": m.get("reply_to")}


def bare(m) -> Message:
    """A message of a row without its null fields; null role and content are empty."""
    rest = {"calls": [dict(c) if isinstance(c, dict) else c.asDict() for c in m["calls"]] if m["calls"] else None, "reply_to": m["reply_to"]}
    return {"role": m["role"] or "", "content": m["content"] or ""} | {k: v for k, v in rest.items() if v is not None}


def _event_row(key, e: dict) -> tuple:
    lists, ones = ("input", "pinned", "source", "retained", "result"), ("message", "summary_message")
    return (key, *(None if e.get(f) is None else [full(m) for m in e[f]] if f in lists else full(e[f]) if f in ones else e[f] for f in FIELDS))


def messages_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content, calls, reply_to) of a conversations table; calls and reply_to are null where it has none."""
    more = {"calls": F.lit(None).cast(CALLS), "reply_to": F.lit(None).cast("string")}
    content = "content" if "content" in rows.columns else "text"
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.col(content).alias("content"), *[F.col(c) if c in rows.columns else x.alias(c) for c, x in more.items()])


def context_events(rows: DataFrame, policy: Policy) -> DataFrame:
    """(conv_id, seq, type, ...) events of stored conversations, in one streamed fold.

    Turns count from 0; what follows a missing turn is not taken, as the stream would still wait for it. Of rows that repeat
    a turn the first in the order of their contents counts.
    """

    def step(state: list, row: dict) -> Iterable[tuple]:
        if row["turn"] == state[1].turns:
            yield from [_event_row(state[0], e) for e in state[1].add(bare(row), policy)]

    return ordered_fold(messages_of(rows), "conv_id", ["turn", "role", "content"], lambda key: [key, Context()], step, lambda state: (), f"conv_id long, {EVENT}")


def contexts(rows: DataFrame, policy: Policy) -> DataFrame:
    """(conv_id, turns, compactions, stopped, messages) of stored conversations: the context that each ends with."""

    def step(state: list, row: dict) -> Iterable[tuple]:
        if row["turn"] == state[1].turns:
            for _ in state[1].add(bare(row), policy):
                pass
        return ()

    return ordered_fold(messages_of(rows), "conv_id", ["turn", "role", "content"], lambda key: [key, Context()], step, lambda state: [(state[0], *state[1].shown())], f"conv_id long, {SHOWN}")


SHOWN = f"turns long, compactions int, stopped string, messages array<{MESSAGE}>"
_STATE = "turns long, events int, compactions int, stopped string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _processor(policy: Policy):
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Keeper(StatefulProcessor):
        """Value state: the counts. List state: the context. Map state: turns that came before their predecessors."""

        def init(self, handle) -> None:
            self.counts = handle.getValueState("counts", _STATE)
            self.context = handle.getListState("context", f"role string, content string, calls {CALLS}, reply_to string")
            self.held = handle.getMapState("held", "turn long", f"role string, content string, calls {CALLS}, reply_to string")

        def handleInputRows(self, key, rows, timerValues):
            counts = self.counts.get() if self.counts.exists() else (0, 0, 0, None)
            said = [bare(dict(zip(("role", "content", "calls", "reply_to"), m, strict=True))) for m in self.context.get()] if self.context.exists() else []
            at = Context(said, counts[0], counts[1], counts[2], counts[3])
            came = [r for frame in rows for r in frame[["turn", "role", "content", "calls", "reply_to"]].itertuples(index=False, name=None)]
            new = {}
            for turn, role, content, calls, reply_to in sorted(came, key=lambda r: (r[0], r[1] or "", r[2] or "")):
                if turn >= at.turns and turn not in new:
                    new[turn] = (role, content, None if calls is None else [Row(**c) if isinstance(c, dict) else c for c in calls], reply_to)
            compactions, begun, waiting = at.compactions, at.turns, self.held.exists()
            while True:
                turn = at.turns
                if waiting and self.held.containsKey((turn,)):
                    message = tuple(self.held.getValue((turn,)))
                    self.held.removeKey((turn,))
                    new.pop(turn, None)
                elif turn in new:
                    message = new.pop(turn)
                else:
                    break
                for _ in at.add(bare(dict(zip(("role", "content", "calls", "reply_to"), message, strict=True))), policy):
                    pass
            for turn, message in new.items():
                if not self.held.containsKey((turn,)):
                    self.held.updateValue((turn,), message)
            if at.turns > begun:
                rows_now = [(m["role"], m["content"], [Row(**c) for c in m["calls"]] if m.get("calls") else None, m.get("reply_to")) for m in at.said]
                if at.compactions > compactions or not said:
                    self.context.put(rows_now)
                elif len(rows_now) > len(said):
                    self.context.appendList(rows_now[len(said) :])
                self.counts.update((at.turns, at.events, at.compactions, at.stopped))
                turns, done, stopped, shown = at.shown()
                yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "compactions": [done], "stopped": [stopped], "messages": [shown]})

        def close(self) -> None:
            pass

    return Keeper()


def stream_contexts(spark: SparkSession, path: str, policy: Policy, files_per_trigger: int = 8, home: str | None = None) -> DataFrame:
    """(conv_id, turns, compactions, stopped, messages): the last context of each conversation in files that have come so far.

    The state store keeps each conversation's context; a turn that comes early is held until the ones before it are there.
    `home` is a folder with the checkpoint and the results of earlier calls: a later call goes on where they ended. Each
    micro-batch writes its own folder, so that one which runs again changes nothing.
    """
    home = home or shared_path(spark, "contexts")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        raw = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
        kept = messages_of(raw).groupBy("conv_id").transformWithStateInPandas(_processor(policy), f"conv_id long, {SHOWN}", "Update", "None")

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{home}/result/batch={number}")

        running = kept.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    states = spark.read.schema(f"conv_id long, {SHOWN}, _batch int").option("recursiveFileLookup", "true").parquet(f"{home}/result")
    last = states.groupBy("conv_id").agg(F.max("turns").alias("turns"))
    return states.join(last, ["conv_id", "turns"]).select("conv_id", "turns", "compactions", "stopped", "messages")
