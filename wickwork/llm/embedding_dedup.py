"""Near-duplicate vectors by lattice hashing.

Vectors of length 1 are turned by a random rotation and cut into blocks of eight numbers, a table for each block. Of two
vectors at a squared distance of d, one block has at most d / tables of it. So each vector is kept under the E8 lattice
point next to each of its blocks, and looks into all cells that come that close to it: for the pair's closest block, one of
the two looks into the cell of the other, and no pair is missed. A pair is counted in that table only.

First the blocks alone are compared, eight numbers of a byte each, which rules out nearly all vectors that are not near.
Only cells in which something is near get whole vectors, and these are compared in squares of at most ``SQUARE`` vectors a
side. Squares leave a count for each vector and one edge to its group's smallest vector, never the pairs themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice
from .components import min_label_components
from .shared import join_small, partitions, written

#: Radius of the search within a block, in units of the lattice: smaller is fewer cells to look into, larger is smaller cells.
RADIUS = 0.31
#: Vectors on each side of a square.
SQUARE = 384
SEED = 1


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random rotation of ``size`` numbers to the next multiple of eight."""
    whole = -(-size // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(whole, whole)))
    return (q * np.sign(np.diag(r)))[:size]


def _unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows of length 1."""
    x = np.array(vectors, np.float64)
    # By its greatest number first, so that no square is too large or too small for a double.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True)), x


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest for each vector, null where it can't link."""
    for b in batches:
        keys = []
        for v in b.column("vector").to_pylist():
            ok = v is not None and len(v) and None not in v and all(map(math.isfinite, v)) and any(v)
            keys.append(hashlib.blake2b(np.array(v, np.float64).tobytes(), digest_size=16).digest() if ok else None)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=[*b.schema.names, "key"])


def _cell_keys(label: str, table: int, size: int, points: np.ndarray) -> np.ndarray:
    """A hash of each lattice point, with the table's number in the last twelve bits."""
    head = f"{label}:{size}:".encode()
    hashes = [xxhash.xxh64_intdigest(head + p.tobytes(), table) for p in (points * 2).astype(np.int16)]
    return (np.array(hashes, np.uint64) >> np.uint64(12) << np.uint64(12) | np.uint64(table)).view(np.int64)


CELL = "cell long, id long, block long, reach int, own boolean"


def _cells(cosine: float, seed: int):
    """Each vector's own cell in each table, and those of the neighbouring cells within reach whose key is greater than its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[tuple[str, int], list[int]] = {}
            labels, vectors, ids = b.column("label").to_pylist(), b.column("vector").to_pylist(), b.column("id").to_numpy()
            for k, (label, v) in enumerate(zip(labels, vectors, strict=True)):
                by.setdefault((label, len(v)), []).append(k)
            for (label, size), rows in by.items():
                turned = _unit([vectors[k] for k in rows])[0] @ rotation(size, seed)
                tables = turned.shape[1] // 8
                reach = math.sqrt((2 - 2 * cosine) / tables) * (1 + 1e-6) + 1e-9
                bytes_ = np.rint(turned * 127).astype(np.int8)
                for t in range(tables):
                    own, row, other = lattice.cells_within(turned[:, 8 * t : 8 * t + 8] * (RADIUS / reach), RADIUS)
                    mine, theirs = _cell_keys(label, t, size, own), _cell_keys(label, t, size, other)
                    up = theirs > mine[row]
                    row, theirs = row[up], theirs[up]
                    block = np.ascontiguousarray(bytes_[:, 8 * t : 8 * t + 8]).view(np.int64)[:, 0]
                    at, within = ids[rows], np.full(len(mine) + len(row), math.floor((127 * reach + math.sqrt(8)) ** 2) + 1, np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.r_[mine, theirs]), pa.array(np.r_[at, at[row]]), pa.array(np.r_[block, block[row]]), pa.array(within), pa.array(np.r_[np.ones(len(mine), bool), np.zeros(len(row), bool)])],
                        names=["cell", "id", "block", "reach", "own"],
                    )

    return run


def _apart(a: str, b: str) -> str:
    """The squared distance of two blocks of eight bytes, in SQL."""
    byte = lambda x, k: f"shiftright(shiftleft({x}, {56 - 8 * k}), 56)"
    d = [f"({byte(a, k)} - {byte(b, k)})" for k in range(8)]
    return " + ".join(f"{x} * {x}" for x in d)


def _near(cosine: float, seed: int):
    """The links within a square: how many vectors each is linked with, by weight, and the smallest vector of its group."""

    def run(table: pa.Table) -> pa.Table:
        labels, vectors = table.column("label").to_pylist(), table.column("vector").to_pylist()
        ids, weights, same, side, cells = (table.column(c).to_numpy() for c in ("id", "weight", "same", "side", "cell"))
        t = int(cells[0]) & 0xFFF
        groups: dict[tuple, list[int]] = {}
        for k, (label, v) in enumerate(zip(labels, vectors, strict=True)):  # one group, unless hashes meet
            groups.setdefault((label, len(v)), []).append(k)
        out: list[list[np.ndarray]] = [[], [], []]
        for (_, size), rows_ in groups.items():
            rows = np.array(rows_)
            unit, raw = _unit([vectors[k] for k in rows_])
            turned = unit @ rotation(size, seed)
            x, y = np.flatnonzero(side[rows] == 0), np.flatnonzero(side[rows] == 1)
            length = np.sqrt((raw * raw).sum(1))
            cos = (raw[x] @ raw[y].T) / (length[x][:, None] * length[y][None, :])
            i, j = np.nonzero((cos >= cosine) & (ids[rows[x]][:, None] != ids[rows[y]][None, :]))
            i, j = x[i], y[j]
            closest = np.empty(len(i), np.int64)
            for lo in range(0, len(i), 8192):
                d = (turned[i[lo : lo + 8192]] - turned[j[lo : lo + 8192]]).reshape(-1, turned.shape[1] // 8, 8)
                # Blocks that differ by rounding only are alike, so that the first of them is meant in every square.
                closest[lo : lo + 8192] = np.rint((d * d).sum(2) * 1e9).argmin(1)
            i, j = i[closest == t], j[closest == t]
            n = np.bincount(i, weights[rows[j]], len(rows))
            # Only one of the two looks into the cell of the other if they live in different ones, so that look counts for both.
            across = ~same[rows[i]]
            n += np.bincount(j[across], weights[rows[i[across]]], len(rows))
            root = ids[rows].copy()
            while len(i):
                low, before = np.minimum(root[i], root[j]), root.copy()
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                if (before == root).all():
                    break
            linked = np.unique(np.r_[i, j])
            for to, v in zip(out, (ids[rows], n.astype(np.int64), root), strict=True):
                to.append(v[linked])
        return pa.table({c: pa.array(np.concatenate(v), pa.int64()) for c, v in zip(("id", "n", "root"), out, strict=True)})

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row for each row of ``df``.

    Vectors of equal labels and lengths link if their cosine is at least ``cosine``; none is missed. ``n_links`` counts the
    other rows that a row is linked with, ``component_id`` is the smallest vec_id that links reach, and ``kept`` says
    whether that is the row's own. Rows with a null label, and vectors that are null, empty, zero or have null or
    non-finite numbers, link with nothing.

    Equal vectors of a label are one class before anything is compared, so repeated rows cost one row. A row with a null
    id links like any other; a component of such rows only has a null component_id. An empty table gives no rows; other
    columns are not read, so their names can't clash. Vectors may have up to 32,768 numbers; there is a table for every
    eight.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the search is for vectors at an angle of less than 90 degrees")
    vector = F.col(f"`{vector_col}`")
    if df.schema[vector_col].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), vector.alias("vector"))
    rows = rows.withColumn("vector", F.when(F.col("label").isNotNull(), F.col("vector")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = written(rows.mapInArrow(_keyed, f"{schema}, key binary"), "vectors")
    classes = rows.filter("key IS NOT NULL").groupBy("label", "key").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    cells = written(classes.select("id", "label", "vector").mapInArrow(_cells(cosine, seed), CELL), "cells")
    # Whose block has another next to it: eight bytes each, rounded by half a unit per number.
    p, s = cells.alias("p"), cells.filter("own").alias("s")
    near = (F.col("p.cell") == F.col("s.cell")) & (F.col("p.id") != F.col("s.id")) & F.expr(f"{_apart('p.block', 's.block')} <= p.reach")
    hits = written(p.join(s, near, "left_semi").select("cell", "id", F.col("own").alias("same")), "hits")
    looked = hits.groupBy("cell").agg(F.count(F.lit(1)).alias("looking"))
    lives = cells.filter("own").join(looked.select("cell"), "cell", "left_semi").select("cell", "id")
    counts = written(looked.join(lives.groupBy("cell").agg(F.count(F.lit(1)).alias("living")), "cell"), "cell-counts")
    sides = hits.select("cell", "id", "same", F.lit(0).alias("side")).unionByName(lives.select("cell", "id", F.lit(True).alias("same"), F.lit(1).alias("side")))
    sides = join_small(sides, counts, ["cell"], "inner").join(classes.select("id", "label", "vector", "weight"), "id")
    part = lambda c: f"cast(ceil({c} / {SQUARE}) AS int)"
    mine = lambda c: F.expr(f"cast(pmod(xxhash64(id), {part(c)}) AS int)")
    every = lambda c: F.expr(f"sequence(0, {part(c)} - 1)")
    sides = sides.withColumn("x", F.when(F.col("side") == 0, F.array(mine("looking"))).otherwise(every("looking"))).withColumn("y", F.when(F.col("side") == 1, F.array(mine("living"))).otherwise(every("living")))
    squares = sides.withColumn("x", F.explode("x")).withColumn("y", F.explode("y")).drop("looking", "living")
    found = written(squares.groupBy("cell", "x", "y").applyInArrow(_near(cosine, seed), "id long, n long, root long"), "near")
    labels = min_label_components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    labels = labels.select(F.col("node").alias("id"), F.col("label").alias("component"))
    known = classes.select("id", "label", "key", "vec_id", "weight").join(labels, "id", "left").join(found.groupBy("id").agg(F.sum("n").alias("n")), "id", "left")
    known = written(known.select("label", "key", "vec_id", F.coalesce("component", "id").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "linked")
    first = known.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = written(known.join(first, "component").select("label", "key", "n_links", "component_id"), "vector-components")
    out = join_small(rows.select("vec_id", "label", "key"), known.withColumn("found", F.lit(True)), ["label", "key"], "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
