"""Merkle manifest of a table: one tree of digests for each value of a column, and one tree over those.

The trees are built by events. A row's digest is an event for its parent, whose place and number of children follow from
the number of rows. A task combines the events that it sees: a partial parent holds its children's digests by place, and
as soon as it has as many as its arity it becomes a digest itself, that is, an event for its own parent. Rows are dealt to
tasks in order, so only parents at the edges of a task's rows stay partial. These are the frontier: they go to the tasks
that own their ancestors three levels further up, where partial parents of one place are merged, until none is left. Every
parent that is done keeps its children's digests, so proofs follow the links backwards, from the root to the rows, in
blocks of at most 512 rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_small, partitions, written

#: Children of a full parent, as a power of two.
BITS = 3
#: Levels by which the owners of the frontier rise in each round, and levels of a block of the proofs.
STRIDE = 3
#: The columns of a document that its digest covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

NODE = "tree string, n long, level int, idx long, slots binary, children binary, digest binary, top boolean"


@functools.lru_cache(4096)
def sizes(n: int) -> tuple[int, ...]:
    """How many nodes each level has, from ``n`` rows up to the root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] >> BITS))
    return tuple(out)


def parent_digest(children: list[bytes]) -> bytes:
    """SHA-256 of the children's digests as lowercase hex, one after the other."""
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


class Parents:
    """Partial parents by place, and the parents that are done but not yet given out."""

    def __init__(self) -> None:
        self.partial: dict[tuple[str, int, int, int], dict[int, bytes]] = {}
        self.done: list[tuple] = []

    def event(self, tree: str, n: int, level: int, idx: int, digest: bytes) -> None:
        """Node ``idx`` of ``level`` is known: add it to its parent, and go on upwards while parents get done."""
        self.merge(tree, n, level + 1, idx >> BITS, {idx & ((1 << BITS) - 1): digest})

    def merge(self, tree: str, n: int, level: int, idx: int, children: dict[int, bytes]) -> None:
        """Combine a partial parent with what is known of it."""
        count = sizes(n)
        while level < len(count):
            key = (tree, n, level, idx)
            known = self.partial.get(key)
            if known is None:
                known = self.partial[key] = children
            else:
                known |= children
            if len(known) < min(1 << BITS, count[level - 1] - (idx << BITS)):
                return
            del self.partial[key]
            inorder = [known[k] for k in sorted(known)]
            digest = parent_digest(inorder)
            top = count[level] == 1
            self.done.append((tree, n, level, idx, bytes(sorted(known)), b"".join(inorder), digest, top))
            level, children, idx = level + 1, {idx & ((1 << BITS) - 1): digest}, idx >> BITS

    def give(self, last: bool = False) -> pa.RecordBatch:
        """The parents that are done; with ``last`` also those that stay partial, without a digest."""
        rows, self.done = self.done, []
        if last:
            rows += [(t, n, lv, i, bytes(sorted(k)), b"".join(k[s] for s in sorted(k)), None, False) for (t, n, lv, i), k in self.partial.items()]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
        names = [c.split()[0] for c in NODE.split(", ")]
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _digests(children: bytes) -> list[bytes]:
    return [children[k : k + 32] for k in range(0, len(children), 32)]


def _from_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parents = Parents()
    for b in batches:
        for tree, n, pos, digest in zip(*[b.column(c).to_pylist() for c in ("tree", "n", "pos", "digest")], strict=True):
            parents.event(tree, n, 0, pos, digest)
        yield parents.give()
    yield parents.give(last=True)


def _from_frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parents = Parents()
    for b in batches:
        for tree, n, level, idx, slots, children in zip(*[b.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "slots", "children")], strict=True):
            parents.merge(tree, n, level, idx, dict(zip(slots, _digests(children), strict=True)))
        yield parents.give()
    yield parents.give(last=True)


def placed(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their tree's number of rows n and their place pos in the order of ``keys``; and a small table (part, tree, count, start, n).

    Ranges of (tree, keys) are sorted apart from each other, so no tree is sorted in one task; the keys should tell all
    rows apart, else equal rows share a task.
    """
    order = [F.col(k).asc_nulls_first() for k in ("tree", *keys)]
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
    counts = ranged.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("count"))
    by_tree = F.expr("sum(count) over (partition by tree)").alias("n")
    start = F.expr("sum(count) over (partition by tree order by part) - count").alias("start")
    counts = written(counts.select("part", "tree", "first", "count", start, by_tree), f"{name}-starts")
    out = join_small(ranged, counts.select("part", "tree", "first", "start", "n"), ["part", "tree"], "inner")
    return out.withColumn("pos", F.expr("start + at - first")).drop("part", "at", "first", "start"), counts


def build(rows: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """All parents (``NODE``) over ``rows`` (tree, n, pos, digest); trees of one row have none."""
    spark = rows.sparkSession
    got = written(rows.select("tree", "n", "pos", "digest").mapInArrow(_from_rows, NODE), name)
    nodes, frontier = got.filter("digest IS NOT NULL"), got.filter("digest IS NULL")
    level = len(sizes(max(1, counts.agg(F.max("count")).first()[0] or 1))) - 1
    while frontier.head(1):
        level += STRIDE
        owner = F.expr(f"shiftright(idx, {BITS} * greatest({level} - level, 0))")
        dealt = frontier.repartition(partitions(spark), F.col("tree"), F.greatest(F.col("level"), F.lit(level)), owner)
        got = written(dealt.mapInArrow(_from_frontier, NODE), f"{name}-frontier")
        nodes, frontier = nodes.unionByName(got.filter("digest IS NOT NULL")), got.filter("digest IS NULL")
    return nodes


def roots(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, digest): the root of each tree; the only row of a tree is its root."""
    return nodes.filter("top").select("tree", "digest").union(rows.filter("n = 1").select("tree", "digest"))


BLOCK = "kind int, tree string, n long, block long, level int, idx long, children binary, path array<binary>"


def _paths(table: pa.Table, base: int) -> tuple[list[dict], dict[int, tuple]]:
    """The leaf rows of a block, and the path of each node of level ``base`` in it: (place, siblings) of every level upwards."""
    rows = table.to_pylist()
    children = {(r["level"], r["idx"]): _digests(r["children"]) for r in rows if r["kind"] == 1}
    # A path is (entry, path of the parent), so that what nodes share is kept once.
    above: dict[int, tuple] = {}
    for r in rows:
        if r["kind"] == 0:
            path: tuple = ()
            for entry in reversed(r["path"]):
                path = (entry, path)
            above[r["idx"]] = path
    level = max((lv for lv, _ in children), default=base)
    while level > base:
        below = {}
        for idx, path in above.items():
            own = children[level, idx]
            for slot in range(len(own)):
                below[(idx << BITS) + slot] = (bytes([slot]) + b"".join(own[:slot] + own[slot + 1 :]), path)
        above, level = below, level - 1
    return [r for r in rows if r["kind"] == 2], above


def _down(base: int):
    """The paths of a block's nodes of level ``base``."""

    def run(table: pa.Table) -> pa.Table:
        _, got = _paths(table, base)
        tree, n = table.column("tree")[0].as_py(), table.column("n")[0].as_py()
        return pa.table({"tree": pa.array([tree] * len(got)), "n": pa.array([n] * len(got), pa.int64()), "idx": pa.array(list(got), pa.int64()), "path": pa.array([_flat(p) for p in got.values()], pa.list_(pa.binary()))})

    return run


def _flat(path: tuple) -> list[bytes]:
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return out


def fold(digest: bytes, path: list[bytes]) -> bytes:
    """The root that follows from a digest and the siblings on its way up."""
    for entry in path:
        slot, others = entry[0], _digests(entry[1:])
        digest = parent_digest([*others[:slot], digest, *others[slot:]])
    return digest


def _blocks(nodes: DataFrame, above: DataFrame, base: int) -> DataFrame:
    """Nodes of the levels base + 1 to base + STRIDE and the paths above them, by block."""
    high = base + STRIDE
    inside = nodes.filter(f"level > {base} AND level <= {high}").select(
        F.lit(1).alias("kind"), "tree", "n", F.expr(f"shiftright(idx, {BITS} * ({high} - level))").alias("block"), "level", "idx", "children", F.lit(None).cast("array<binary>").alias("path")
    )
    # A path belongs to a node of level high, or to the root of a tree that is lower.
    return inside.unionByName(above.select(F.lit(0).alias("kind"), "tree", "n", F.col("idx").alias("block"), F.lit(None).cast("int").alias("level"), "idx", F.lit(None).cast("binary").alias("children"), "path"))


def _height() -> Column:
    """The level of the root over n rows."""
    return F.expr(" + ".join(f"CASE WHEN n > {1 << BITS * k} THEN 1 ELSE 0 END" for k in range(20)))


def paths(rows: DataFrame, nodes: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """Blocks of rows with all that their proofs take: ``BLOCK`` columns; kind 2 are the rows, with their columns.

    ``above`` has (tree, n, path), the path of each tree's root in what lies above it; ``most`` is the largest n.
    """
    above = above.withColumn("height", _height()).withColumn("idx", F.lit(0).cast("long"))
    height = len(sizes(max(1, most))) - 1
    carried = None
    for base in range((max(0, height - 1) // STRIDE) * STRIDE, -1, -STRIDE):
        least = base if base else -1
        here = above.filter(f"height > {least} AND height <= {base + STRIDE}").select("tree", "n", "idx", "path")
        carried = here if carried is None else carried.unionByName(here)
        blocks = _blocks(nodes, carried, base)
        if base == 0:
            own = rows.withColumns({"kind": F.lit(2), "block": F.shiftright("pos", BITS * STRIDE), "level": F.lit(0), "idx": F.col("pos")}).drop("pos")
            return blocks.unionByName(own, allowMissingColumns=True)

        carried = written(blocks.groupBy("tree", "block").applyInArrow(_down(base), "tree string, n long, idx long, path array<binary>"), "merkle-paths")
    raise AssertionError


def row_digest(df: DataFrame, columns: dict[str, Column]) -> Column:
    """SHA-256 of a row: for each column ``-`` if null, else its length in UTF-8, a colon, and the value as text."""
    parts = []
    for c in columns.values():
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def manifest(df: DataFrame, columns: tuple[str, ...] = COLUMNS, tree_col: str = "lang", order_col: str = "doc_id", tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, a row for each row of ``df``.

    A row's leaf is the digest of ``columns``. Each value of ``tree_col`` has a tree of arity 8 over its leaves in the order
    of ``order_col``; a tree over their roots, null first, then bytewise, gives ``root``. The proof of a row is its
    siblings, level by level. ``folded_root`` is what the row's present content and its proof give; with ``tampered`` the
    content of the rows that meet ``when`` is changed in these columns first. Digests are lowercase hex.

    Rows with equal or null ``order_col`` stand in the order of null first, then their leaves, so repeated rows differ in
    their proofs only. Null columns are a part of the digest, empty texts too; texts of any length are hashed whole by
    Spark. An empty table gives no rows. Other columns are not read, so their names can't clash.
    """
    cols = {c: F.col(f"`{c}`") for c in columns}
    # A change of null is null, which is what the row's digest has for it too.
    changed = F.when(when, row_digest(df, cols | (tampered or {}))) if when is not None else F.lit(None).cast("binary")
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit(""))
    rows = df.select(tree.alias("tree"), F.col(f"`{order_col}`").alias("id"), row_digest(df, cols).alias("digest"), changed.alias("changed"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-rows")
    rows, counts = placed(rows, ["id", "digest", "row"], "merkle-placed")
    rows = rows.drop("row")
    nodes = build(rows, counts, "merkle-nodes")
    subroots = written(roots(rows, nodes), "merkle-subroots")
    tops, top_counts = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest"), ["id"], "merkle-tops")
    top_nodes = build(tops, top_counts, "merkle-top-nodes")
    root = written(roots(tops, top_nodes).select(F.lower(F.hex("digest")).alias("root")), "merkle-root")
    # Downwards: the paths of the trees' roots, then those of the rows.
    start = root.select(F.lit("").alias("tree"), F.array().cast("array<binary>").alias("path")).crossJoin(top_counts.agg(F.max("n").alias("n")))
    most = counts.agg(F.max("n")).first()[0] or 1
    most_trees = top_counts.agg(F.max("n")).first()[0] or 1

    def tree_paths(table: pa.Table) -> pa.Table:
        leaves, got = _paths(table, 0)
        return pa.table({"tree": pa.array([r["id"] for r in leaves], pa.string()), "path": pa.array([_flat(got[r["idx"]]) for r in leaves], pa.list_(pa.binary()))})

    over = paths(tops, top_nodes, start, most_trees).groupBy("tree", "block").applyInArrow(tree_paths, "tree string, path array<binary>")
    over = written(join_small(over, counts.groupBy("tree").agg(F.max("n").alias("n")), ["tree"], "inner"), "merkle-tree-paths")
    kind = rows.schema["id"].dataType

    def prove(table: pa.Table) -> pa.Table:
        leaves, got = _paths(table, 0)
        proofs, folded = [], []
        for r in leaves:
            path = _flat(got[r["idx"]])
            proofs.append(hashlib.sha256(b"".join([e[1:] for e in path]).hex().encode()).hexdigest())
            folded.append(fold(r["digest"] if r["changed"] is None else r["changed"], path).hex())
        mask = pc.equal(table.column("kind"), 2)
        own = table.filter(mask)
        return pa.table({"doc_id": own.column("id"), "leaf": pa.array([r["digest"].hex() for r in leaves], pa.string()), "tree": own.column("tree"), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})

    out = paths(rows, nodes, over, most).groupBy("tree", "block").applyInArrow(prove, f"doc_id {kind.simpleString()}, leaf string, tree string, proof_sha256 string, folded_root string")
    known = written(subroots.select("tree", F.lower(F.hex("digest")).alias("subroot")).crossJoin(F.broadcast(root)), "merkle-roots")
    out = join_small(out, known, ["tree"], "inner")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def lowered(c: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
