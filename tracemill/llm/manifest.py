"""Merkle manifest of a dataset: every row a leaf, a tree for each language, a tree over their roots, and a proof for each row.

A sparse forest holds the nodes of trees whose sibling runs are not complete yet, by (tree, level, index). Two forests merge
by union; whenever a run has all its members, of which the width of the tree says how many there are, the run gives way to
its parent. Merging is associative and commutative, so forests of sorted partitions are reduced in a tree of rounds, each a
written table; what is unresolved of a stretch of leaves grows with the logarithm of its length. A second sweep goes down the
same rounds and hands every unresolved node the siblings above it, so no row looks up a node that all rows need.

Rows of one doc_id are leaves of their own, ordered by their digests. Null values have a digest of their own, a null language
a tree of its own before all others. An empty table has no root and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that make a parent.
ARITY = 2
#: Leaves of a partition, about, and forests that a round merges.
LEAVES, FAN = 1 << 15, 64
Key = tuple[str, int, int]


def digest(values: Iterable[str]) -> str:
    return hashlib.sha256("".join(values).encode()).hexdigest()


def width(leaves: int, level: int, arity: int = ARITY) -> int:
    """Nodes of a level, of a tree with so many leaves."""
    for _ in range(level):
        leaves = -(-leaves // arity)
    return leaves


class Forest:
    """Unresolved nodes by (tree, level, index); `every` also has the resolved ones where `keep` is set."""

    def __init__(self, widths: dict[str, int], arity: int = ARITY, keep: bool = False):
        self.widths, self.arity, self.open, self.every = widths, arity, {}, {} if keep else None

    def run(self, tree: str, level: int, index: int) -> range:
        """The indices of a node and its siblings; a lone root's run is itself."""
        first = index // self.arity * self.arity
        return range(first, min(first + self.arity, width(self.widths[tree], level, self.arity)))

    def is_root(self, tree: str, level: int) -> bool:
        return width(self.widths[tree], level, self.arity) == 1

    def add(self, key: Key, value: str) -> None:
        tree, level, index = key
        while True:
            self.open[tree, level, index] = value
            if self.every is not None:
                self.every[tree, level, index] = value
            if self.is_root(tree, level):
                return
            run = [(tree, level, i) for i in self.run(tree, level, index)]
            if not all(k in self.open for k in run):
                return
            value = digest([self.open.pop(k) for k in run])
            level, index = level + 1, index // self.arity

    def merge(self, other: Forest) -> Forest:
        self.widths.update(other.widths)
        for key, value in other.open.items():
            self.add(key, value)
        return self

    def climb(self, key: Key) -> tuple[Key, list[str]]:
        """The unresolved node over a node, and the siblings on the way to it, from below, left to right."""
        tree, level, index = key
        found = []
        while (tree, level, index) not in self.open:
            found += [self.every[tree, level, i] for i in self.run(tree, level, index) if i != index]
            level, index = level + 1, index // self.arity
        return (tree, level, index), found


def fold(value: str, index: int, leaves: int, siblings: str, arity: int = ARITY) -> tuple[str, str]:
    """The root that a leaf and its siblings, 64 digits each, give; and the siblings that are left over."""
    while leaves > 1:
        first = index // arity * arity
        n = min(arity, leaves - first) - 1
        run = [siblings[64 * i : 64 * i + 64] for i in range(n)]
        value = digest([*run[: index - first], value, *run[index - first :]])
        siblings, index, leaves = siblings[64 * n :], index // arity, -(-leaves // arity)
    return value, siblings


def leaf(fields: Iterable[Column]) -> Column:
    """The digest of a row's values, each `-` if null, else its bytes, a colon and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, order: list[str], scratch: Scratch, leaves: int = LEAVES) -> DataFrame:
    """rows (tree, digest, ...), sorted by tree and `order`, with part, index within the tree and the tree's width.

    A range of the order is a part; equal rows are dealt to parts by where they were read. `rows` is a written table.
    """
    n = rows.count()
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id())
    keys = ["tree", *order, "_salt"]
    dealt = dealt.repartitionByRange(max(1, -(-n // leaves)), *keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_at", F.monotonically_increasing_id())
    dealt = scratch.save(dealt.withColumn("part", F.shiftright("_at", 33)), "sorted")
    counts = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    counts = counts.withColumn("_before", F.sum("_n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).withColumn("width", F.sum("_n").over(tree))
    rows = dealt.join(counts.drop("_n"), ["tree", "part"]).withColumn("index", F.col("_before") + F.col("_at") - F.col("_first"))
    return scratch.save(rows.drop("_at", "_first", "_before"), "placed")


_NODE = "part long, tree string, width long, level int, index long, digest string, root boolean"
_UPPER = "part long, tree string, level int, index long, siblings string, above_index long, above_width long"


def _columns(table: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(table[n].to_pylist() for n in names), strict=True)


def _grown(table: pa.Table, arity: int, keep: bool) -> Forest:
    forest = Forest({}, arity, keep)
    for tree, leaves, level, index, value in _columns(table, "tree", "width", "level", "index", "digest"):
        forest.widths[tree] = leaves
        forest.add((tree, level, index), value)
    return forest


def up(leaves: DataFrame, scratch: Scratch, arity: int = ARITY, fan: int = FAN) -> list[DataFrame]:
    """The unresolved nodes after each round; a node of the last, or with `root`, is the root of its tree."""

    def merge(table: pa.Table) -> pa.Table:
        forest = _grown(table, arity, False)
        rows = [(tree, forest.widths[tree], level, index, value, forest.is_root(tree, level)) for (tree, level, index), value in forest.open.items()]
        tree, leaves, level, index, value, root = zip(*rows, strict=True)
        return pa.table([pa.array([table["part"][0].as_py()] * len(rows), pa.int64()), pa.array(tree, pa.string()), pa.array(leaves, pa.int64()), pa.array(level, pa.int32()), pa.array(index, pa.int64()), pa.array(value, pa.string()), pa.array(root, pa.bool_())], ["part", "tree", "width", "level", "index", "digest", "root"])

    now = leaves.withColumn("level", F.lit(0)).select("part", "tree", "width", "level", "index", "digest")
    rounds = []
    while True:
        rounds.append(scratch.save(now.groupBy("part").applyInArrow(merge, _NODE), "forest"))
        now = rounds[-1].where("not root").withColumn("part", F.expr(f"part div {fan}")).drop("root")
        if now.isEmpty():
            return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree."""
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.where("root").select("tree", "digest")


def _below(nodes: DataFrame, uppers: DataFrame, arity: int, out: str, columns: list[str]) -> DataFrame:
    """`columns` of nodes with the siblings of each, up to the root: cogroups of a part's nodes and what lies above them."""

    def lower(table: pa.Table, above: pa.Table) -> pa.Table:
        forest = _grown(table, arity, True)
        over = {(t, level, i): rest for t, level, i, *rest in _columns(above, "tree", "level", "index", "siblings", "above_index", "above_width")}
        found = []
        for key in _columns(table, "tree", "level", "index"):
            top, siblings = forest.climb(key)
            rest, index, leaves = over[top]
            found.append(("".join(siblings) + rest, index, leaves))
        siblings, index, leaves = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([*(table[c] for c in columns), pa.array(siblings, pa.string()), pa.array(index, pa.int64()), pa.array(leaves, pa.int64())], [*columns, "siblings", "above_index", "above_width"])

    return nodes.groupBy("_group").cogroup(uppers.withColumn("_group", F.col("part")).groupBy("_group")).applyInArrow(lower, out)


def down(leaves: DataFrame, rounds: list[DataFrame], above: DataFrame, scratch: Scratch, arity: int = ARITY, fan: int = FAN) -> DataFrame:
    """leaves with siblings (64 digits each, from below), above_index and above_width.

    `above` has (tree, siblings, above_index, above_width): what is over the root of each tree.
    """
    columns = ["part", "tree", "level", "index", "siblings", "above_index", "above_width"]
    uppers = None
    for nodes in reversed(rounds):
        here = nodes.where("root").join(above, "tree").select(*columns)
        if uppers is not None:
            rest = nodes.where("not root").withColumn("_group", F.expr(f"part div {fan}"))
            here = here.unionByName(_below(rest, uppers, arity, _UPPER, columns[:4]))
        uppers = scratch.save(here, "uppers")
    kept = [c for c in leaves.columns if c != "part"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema if f.name in kept)
    leaves = leaves.withColumn("level", F.lit(0)).withColumn("_group", F.col("part"))
    return _below(leaves, uppers, arity, f"{kinds}, siblings string, above_index long, above_width long", kept)


def manifest(rows: DataFrame, order: list[str], scratch: Scratch, arity: int = ARITY, leaves: int = LEAVES, fan: int = FAN) -> tuple[DataFrame, DataFrame, str | None]:
    """(proofs, subroots, root) of rows (tree, digest, ...): proofs are the rows with index, width, siblings and the place of
    their tree among all; subroots are (tree, subroot); root is null for no rows."""
    rows = placed(scratch.save(rows, "leaves"), [*order, "digest"], scratch, leaves)
    rounds = up(rows, scratch, arity, fan)
    subroots = scratch.save(roots(rounds), "roots")
    tops = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], scratch, leaves)
    top = up(tops, scratch, arity, fan)
    root = roots(top).first()
    nothing = roots(top).select("tree", F.lit("").alias("siblings"), F.lit(0).cast("long").alias("above_index"), F.lit(1).cast("long").alias("above_width"))
    above = down(tops, top, nothing, scratch, arity, fan).select(F.col("name").alias("tree"), "siblings", F.col("index").alias("above_index"), F.col("width").alias("above_width"))
    proofs = down(rows, rounds, scratch.save(above, "above"), scratch, arity, fan)
    return proofs, subroots.withColumnRenamed("digest", "subroot"), root and root["digest"]


def folded(proofs: DataFrame, value: str, name: str, arity: int = ARITY) -> DataFrame:
    """proofs with `name`, the root that the digest in column `value` gives with the siblings of its row."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema)
    used = [proofs.columns.index(c) for c in (value, "index", "width", "siblings", "above_index", "above_width")]

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, index, leaves, siblings, above_index, above_width in zip(*(batch.column(i).to_pylist() for i in used), strict=True):
                x, siblings = fold(x, index, leaves, siblings, arity)
                out.append(fold(x, above_index, above_width, siblings, arity)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, name])

    return proofs.mapInArrow(climb, f"{kinds}, `{name}` string")


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, and each row's place: every seventh row by crc32 of its id is folded with one more n_chars."""
    scratch = Scratch(docs.sparkSession)
    fields = [F.col(c) for c in FIELDS]
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(changed))
    rows = bounded(docs).select(F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(fields).alias("digest"), tampered.alias("tampered"))
    proofs, subroots, root = manifest(rows, ["doc_id"], scratch)
    proofs = folded(proofs.withColumn("_seen", F.coalesce("tampered", "digest")), "_seen", "folded_root")
    root = F.lit(root).cast("string")
    return proofs.join(subroots, "tree").select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))
