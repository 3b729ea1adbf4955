"""Encode conversations for training: only tokens wholly inside what the assistant says are supervised."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100
#: Tokens of an output batch, but for its last example: what a worker holds does not depend on how many rows it is given.
TOKENS = 1 << 17
_OUT = "key long, input_ids array<int>, labels array<int>, reason string"


def encoded(batches: Iterator[pa.RecordBatch], one: Callable[[list[dict]], tuple]) -> Iterator[pa.RecordBatch]:
    """Batches (key, input_ids, labels, reason) of batches (key, messages), each example by `one`."""
    for batch in batches:
        out, start, held = [], 0, 0
        for at in range(batch.num_rows):
            out.append(one(batch.column(1)[at].as_py() or []))
            held += 1 if out[-1][0] is None else len(out[-1][0])
            if held >= TOKENS or at == batch.num_rows - 1:
                ids, labels, why = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(out)), pa.array(ids, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.int32())), pa.array(why, pa.string())], ["key", "input_ids", "labels", "reason"])
                out, start, held = [], at + 1, 0


def encode(traces: DataFrame, key: str, messages: str, tokenizer: str, limit: int, last_only: bool = False) -> DataFrame:
    """(key, input_ids, labels, reason) of traces whose `messages` are array<struct<role, content>>.

    A message reads as its upper-case role, a colon, its content and a line end; the assistant's content with its line end
    is supervised, the role line is not. `tokenizer` is the path of a tokenizers file. A trace over `limit` tokens, or
    without a supervised token after the first, has a reason and null arrays: nothing is cut. Null content is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.no_truncation()
        model.encode_special_tokens = True
        return encoded(batches, lambda said: one(model, said))

    def one(model, said: list[dict]) -> tuple[np.ndarray | None, np.ndarray | None, str | None]:
        parts, spans, at = [], [], 0
        for i, m in enumerate(said):
            head, body = f"{(m['role'] or '').upper()}:\n", f"{m['content'] or ''}\n"
            if m["role"] == "assistant" and (not last_only or i == len(said) - 1):
                spans.append((at + len(head), at + len(head) + len(body)))
            parts.append(head + body)
            at += len(head) + len(body)
        found = model.encode("".join(parts), add_special_tokens=False)
        if len(found.ids) > limit:
            return None, None, f"{len(found.ids)} tokens"
        labels, k = [], 0
        for token, (start, end) in zip(found.ids, found.offsets, strict=True):  # tokens and spans both ascend
            while k < len(spans) and spans[k][1] < end:
                k += 1
            labels.append(token if k < len(spans) and spans[k][0] <= start < end <= spans[k][1] else IGNORED)
        if all(x == IGNORED for x in labels[1:]):
            return None, None, "nothing to supervise"
        return np.array(found.ids, np.int32), np.array(labels, np.int32), None

    return traces.select(F.col(key).cast("long").alias("key"), F.col(messages)).mapInArrow(run, _OUT)


def stats(encoded: DataFrame) -> DataFrame:
    """examples, total_tokens, supervised_tokens and longest over what was encoded; zeros for none."""
    n = F.size("input_ids").cast("long")
    kept = F.size(F.filter("labels", lambda x: x != IGNORED)).cast("long")
    return encoded.where("reason is null").agg(F.count(F.lit(1)).alias("examples"), F.coalesce(F.sum(n), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum(kept), F.lit(0)).alias("supervised_tokens"), F.coalesce(F.max(n), F.lit(0)).alias("longest"))


def padded(ids: Column | str, length: int, pad: int) -> Column:
    """An array padded on the right to `length`; an error if it is longer."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.when(F.size(ids) > length, F.raise_error(F.lit("longer than the padded length"))).otherwise(F.concat(ids, F.array_repeat(F.lit(pad), length - F.size(ids))))
