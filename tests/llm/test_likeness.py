"""Near copies by shingles, against all pairs of a small table."""

import numpy as np
import pyarrow as pa

from tracemill.llm import likeness, simhash
from tracemill.llm.common import Scratch

SCHEMA = "doc_id long, text string, key string, a string, near string, doc string"


def _rows():
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abcdefghij"), 6))
    texts = []
    passage = " ".join(word() for _ in range(120))
    for _ in range(12):
        base = [word() for _ in range(int(r.integers(60, 400)))]
        for edits in (0, 0, 1, 2, 3, 5, 8, 20):
            w = list(base)
            for _ in range(edits):
                w[int(r.integers(len(w)))] = word()
            texts.append(" ".join(w))
    texts += [f"{passage} {' '.join(word() for _ in range(n))}" for n in range(5, 60, 3)]
    order = r.permutation(len(texts))
    return [(int(i), texts[k]) for i, k in enumerate(order)] + [(900, None), (901, ""), (902, "  \n"), (903, "two words"), (904, "Two  Words"), (None, texts[0]), (None, None)]


def _near(a, b):
    if not len(a) or not len(b):
        return False
    return len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8


def test_copies_brute_force(spark):
    rows = [x for x in _rows() if x[0] is not None]
    docs = spark.createDataFrame([(i, t, "k", "a", "n", "d") for i, t in rows], SCHEMA)
    gone = {r.doc_id for r in likeness.copies(docs, Scratch(spark)).collect()}
    sets = {i: likeness.shingles(t or "") for i, t in rows}
    for i in gone:
        assert any(j < i and _near(sets[i], sets[j]) for j in sets)
    kept = sorted(set(sets) - gone)
    assert not [(i, j) for i in kept for j in kept if i < j and _near(sets[i], sets[j])]
    assert {900, 901, 902, 903} <= set(kept) and 904 in gone


def test_no_copies_among_no_rows(spark):
    assert likeness.copies(spark.createDataFrame([], SCHEMA), Scratch(spark)).collect() == []


def test_keep_distinct_drops_edited_copies(spark):
    docs = spark.createDataFrame([(i, t, "k", "a", "n", "d") for i, t in _rows()], SCHEMA)
    out = simhash.keep_distinct(docs)
    kept = [(r.doc_id, likeness.shingles(r.text or "")) for r in out.collect()]
    assert out.columns == docs.columns and sum(i is None for i, _ in kept) == 2
    named = [(i, s) for i, s in kept if i is not None]
    assert not [(i, j) for i, s in named for j, t in named if i < j and _near(s, t)]


def test_every_pair_of_a_crowded_bucket_is_compared(spark):
    r = np.random.default_rng(8)
    word = lambda: "".join(r.choice(list("abcdefghij"), 6))
    template = [word() for _ in range(120)]
    texts = [" ".join([*template, *(word() for _ in range(20))]) for _ in range(60)]
    twins = range(0, 30, 3)
    texts += [" ".join([*texts[i].split()[:-2], word(), word()]) for i in twins]
    docs = spark.createDataFrame([(i, t, "k", "a", "n", "d") for i, t in enumerate(texts)], SCHEMA)
    sets = [likeness.shingles(t) for t in texts]
    assert sum(_near(a, b) for i, a in enumerate(sets) for b in sets[:i]) == len(twins)
    assert {r.doc_id for r in likeness.copies(docs, Scratch(spark)).collect()} == {60 + k for k in range(len(twins))}
    for block in (likeness.BLOCK, 8):
        found = likeness.links(docs, Scratch(spark), block=block).collect()
        assert {(max(x), min(x)) for x in found} == {(60 + k, i) for k, i in enumerate(twins)}


def test_keep_distinct_follows_chains(spark):
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefghij"), 6))
    texts = []
    for _ in range(6):
        w = [word() for _ in range(300)]
        for at in (0, 70, 140, 210, 250):  # each version edits the one before
            texts.append(" ".join(w))
            w = [*w[:at], *(word() for _ in range(22)), *w[at + 22 :]]
    sets = [likeness.shingles(t) for t in texts]
    assert all(_near(sets[i], sets[j]) == (i // 5 == j // 5 and i - j == 1) for i in range(30) for j in range(i))
    docs = spark.createDataFrame([(i, t, "k", "a", "n", "d") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in simhash.keep_distinct(docs).collect()) == list(range(0, 30, 5))


def test_batches_are_bounded_in_bytes(spark):
    from tracemill.llm import common

    key = common._BATCH
    before = spark.conf.get(key, None)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    def most():
        rows = common.documents(spark.range(40, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 100000) AS text"))
        found = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(found) == 40
        return max(found)

    try:
        spark.conf.unset(key)
        assert most() <= 10
        spark.conf.set(key, str(1 << 30))  # a session's own bound stays
        assert most() == 40
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
