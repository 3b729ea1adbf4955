"""Shorten conversations by replacing old messages with a summary, whole tool exchanges at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = dict[str, str]
MODES = ("full", "half", "manual")


def groups(said: list[Message]) -> list[list[Message]]:
    """Messages in units that stay together: whatever is not a tool's reply opens one."""
    units: list[list[Message]] = []
    for m in said:
        if m["role"] == "tool" and units:
            units[-1].append(m)
        else:
            units.append([m])
    return units


def halfway(units: list[list[Message]], cost: Callable[[list[Message]], int], pinned: list[Message] | None = None) -> int:
    """How many leading units, at least one and not all, come closest to half the cost; of equals the fewest.

    Costs are of whole prefixes after the pinned messages, less the pinned ones' own, so that a cost need not add up.
    """
    front = list(pinned or [])
    own = cost(front)
    total, said, best = max(0, cost(front + [m for u in units for m in u]) - own), front, None
    for n, unit in enumerate(units[:-1], 1):
        said = said + unit
        found = (abs(2 * max(0, cost(said) - own) - total), n)
        best = min(best or found, found)
    return best[1]


def plan(said: list[Message], mode: str, cost, summarise, choose=None) -> dict | str:
    """What a compaction of these messages would do, or why there is none: pinned, source, retained, split_index, keep and summary.

    Leading system messages are pinned. `full` summarises all the rest, `half` the older half by cost, `manual` all but the
    units whose numbers `choose(units)` gives.
    """
    front = next((i for i, m in enumerate(said) if m["role"] != "system"), len(said))
    units, keep = groups(said[front:]), []
    if len(units) < (2 if mode == "half" else 1):
        return "nothing to compact"
    cut = halfway(units, cost, said[:front]) if mode == "half" else len(units)
    old, kept = units[:cut], units[cut:]
    if mode == "manual":
        keep = sorted(choose(units))
        if len(set(keep)) < len(keep) or any(not 0 <= k < len(units) for k in keep):
            return "bad choice"
        kept = [units[k] for k in keep]
    source = [m for u in old for m in u]
    text = summarise(source)
    if not text or not text.strip():
        return "empty summary"
    return {"pinned": said[:front], "source": source, "retained": [m for u in kept for m in u], "split_index": None if mode == "manual" else front + len(source), "keep": keep, "summary": text}


def compact(said: list[Message], mode: str, cost, summarise, choose=None) -> tuple[list[Message], str | None]:
    """(messages, reason) after a `plan`. Reason is null if the result costs less; otherwise the messages come back unchanged
    with the reason why not."""
    done = plan(said, mode, cost, summarise, choose)
    if isinstance(done, str):
        return said, done
    now = [*done["pinned"], {"role": "user", "content": done["summary"]}, *done["retained"]]
    return (now, None) if cost(now) < cost(said) else (said, "not smaller")


def fit(said: list[Message], budget: int, mode: str, cost, summarise, choose=None) -> tuple[list[Message], int, str | None]:
    """Compact until the cost is within budget: (messages, rounds, reason that it is not)."""
    rounds = 0
    while cost(said) > budget:  # each round costs less than the one before
        said, why = compact(said, mode, cost, summarise, choose)
        if why:
            return said, rounds, why
        rounds += 1
    return said, rounds, None


#: Conversations that are held at a time.
ROWS = 256


def fit_all(traces: DataFrame, key: str, messages: str, budget: int, mode: str, cost, summarise, choose=None) -> DataFrame:
    """(key, messages, before, after, rounds, reason) for traces whose `messages` are array<struct<role, content>>.

    `cost`, `summarise` and `choose` are functions of lists of messages or units and run on the executors. A null list is
    empty, null content is empty text. At most `ROWS` conversations are held at a time beyond their batch.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    kind = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            out = []
            for said in batch.column(1).to_pylist():
                said = [{"role": m["role"] or "", "content": m["content"] or ""} for m in said or []]
                now, rounds, why = fit(said, budget, mode, cost, summarise, choose)
                out.append((now, cost(said), cost(now), rounds, why))
            now, before, after, rounds, why = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(now, kind), pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(rounds, pa.int32()), pa.array(why, pa.string())], ["key", "messages", "before", "after", "rounds", "reason"])

    return traces.select(F.col(key).cast("long").alias("key"), F.col(messages)).mapInArrow(run, "key long, messages array<struct<role string, content string>>, before long, after long, rounds int, reason string")
