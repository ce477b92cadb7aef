"""Lattice hashing of vectors against all pairs."""

import numpy as np
import pytest
from helpers import SF

from wickwork.llm import embedding_dedup, lattice, queries


def brute(rows, cosine=0.98):
    """vec_id -> (n_links, component_id) by row number."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    links = [set() for _ in rows]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and ok[i] and ok[j] and a == b and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
                    links[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), component, rows[i][0] == component))
    return out


def check(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, lab, "clash", 1) for i, v, lab in rows], f"vec_id long, embedding array<{kind}>, label int, key string, id int")
    got = embedding_dedup.near_vectors(df).collect()
    order = lambda t: tuple((v is not None, v if v is not None else 0) for v in t)
    rounded = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None and kind == "float" else v, lab) for i, v, lab in rows]
    assert sorted((tuple(r) for r in got), key=order) == sorted(brute(rounded), key=order)


def cloud(rng, size, groups, spread):
    out = []
    for n in groups:
        centre = rng.normal(size=size)
        centre /= np.linalg.norm(centre)
        out += [centre + rng.normal(size=size) * spread * rng.random() / np.sqrt(size) for _ in range(n)]
    return out


def test_all_links_of_clouds_and_edges(spark):
    rng = np.random.default_rng(3)
    vectors = cloud(rng, 64, [60, 25, 9, 2, 2, *[1] * 60], 0.25)
    rows = [(k, list(v), k % 2) for k, v in enumerate(vectors)]
    rows += [(1000 + k, [3 * x for x in vectors[k]], k % 2) for k in range(4)]  # the same directions
    rows += [(k, list(vectors[0]), 0) for k in (2000, 2001, 2001)]  # the same vectors, one row twice
    rows += [(None, list(vectors[0]), 0), (3000, list(vectors[0]), None), (3001, None, 0), (3002, [0.0] * 64, 0), (3003, [float("nan")] + [1.0] * 63, 0), (3004, [None] + [1.0] * 63, 0), (3005, [], 0), (3006, list(vectors[0][:63]), 0), (3007, [float("inf")] * 64, 0)]
    check(spark, rows)


def test_other_lengths_and_doubles(spark):
    rng = np.random.default_rng(4)
    rows = [(k, list(v), 1) for k, v in enumerate(cloud(rng, 5, [20, 10, 5], 0.3))]
    rows += [(100 + k, list(v), 1) for k, v in enumerate(cloud(rng, 20, [20, 10, 5], 0.3))]
    rows += [(200 + k, [x], 2) for k, x in enumerate((1.0, -1.0, 1e-300, 1e300))]
    check(spark, rows, "double")


def test_squares_split_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SQUARE", 16)
    rng = np.random.default_rng(5)
    check(spark, [(k, list(v), 0) for k, v in enumerate(cloud(rng, 16, [90, 30], 0.3))])


def test_empty_table(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    with pytest.raises(ValueError, match="angle"):
        embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), cosine=0.0)


def test_lattice_points_are_the_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)) * 3
    own = lattice.nearest(x)
    assert np.all((own.sum(1) % 2 == 0) & (np.all(own % 1 == 0, axis=1) | np.all(own % 1 == 0.5, axis=1)))
    around = lattice.neighbours()
    assert len(around) == len(np.unique(around, axis=0)) == 2400
    far = ((x[:, None] - own[:, None] - around[None]) ** 2).sum(2).min(1)
    assert np.all(((x - own) ** 2).sum(1) <= far + 1e-9)


def test_cells_within_reach_of_a_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    _, row, points = lattice.cells_within(x, 0.31)
    for k in range(300):
        step = rng.normal(size=(200, 8))
        step *= 0.31 / np.linalg.norm(step, axis=1, keepdims=True) * rng.random((200, 1))
        near = {tuple(p) for p in lattice.nearest(x[k] + step)}
        assert near <= {tuple(p) for p in points[row == k]} | {tuple(lattice.nearest(x[k : k + 1])[0])}


def test_query_against_all_pairs(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    got = sorted(tuple(r) for r in queries.op13_embedding_near_dedup(spark, SF).collect())
    assert got == sorted(brute([tuple(r) for r in table]))
