"""Search by shared words: the documents with the most distinct words of a query."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query text that are broadcast at most; larger sets of queries are joined word by word.
BROADCAST = 32 << 20
_WORD = re.compile("[a-z0-9_]+")


def _joined(docs: DataFrame, queries: DataFrame) -> DataFrame:
    tokens = lambda df, key: df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("word"))
    return tokens(queries, "item_id").join(tokens(docs, "doc_id"), "word").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("score"))


def top_matches(docs: DataFrame, queries: DataFrame, n: int, most_bytes: int = BROADCAST) -> DataFrame:
    """item_id, doc_id, score, place: the `n` documents with the highest scores above 0 for each query, ties by doc_id.

    docs (doc_id, text), queries (item_id, text), ids distinct. One pass over the documents keeps the best `n` of each
    query in each partition; only those are shuffled. Null text has no words; a query without matches has no rows.
    """
    size = queries.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if size > most_bytes:
        scored = _joined(docs, queries)
    else:
        words = [(r["item_id"], set(_WORD.findall((r["text"] or "").lower()))) for r in queries.select("item_id", "text").collect()]
        shared = docs.sparkSession.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, list[int]] = defaultdict(list)
            for at, (_, own) in enumerate(shared.value):
                for w in own:
                    held[w].append(at)
            index = {w: np.array(places) for w, places in held.items()}
            best: list[list[tuple[int, int]]] = [[] for _ in shared.value]
            least = np.ones(len(best), dtype=np.int64)
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    hits = [index[w] for w in set(_WORD.findall((text or "").lower())) & index.keys()]
                    if not hits:
                        continue
                    score = np.bincount(np.concatenate(hits), minlength=len(best))
                    for at in np.nonzero(score >= least)[0].tolist():
                        best[at] = sorted([*best[at], (-int(score[at]), doc)])[:n]
                        if len(best[at]) == n:
                            least[at] = -best[at][-1][0]
            rows = [(shared.value[at][0], doc, -score) for at, found in enumerate(best) for score, doc in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item_id", "doc_id", "score"])

        scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")).cast("long")
    return scored.withColumn("place", place).where(F.col("place") <= n)
