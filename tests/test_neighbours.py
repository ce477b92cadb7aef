"""Mutual information from nearest neighbours against all pairs."""

import numpy as np
import pytest
from helpers import SF, same

from wickwork import queries
from wickwork.operators import neighbours, select


def psi(n):
    return -0.5772156649015329 + sum(1 / k for k in range(1, int(n)))


def by_pairs(x, y, k=3):
    keep = np.array([(y == c).sum() > 1 for c in y])
    x, y = x[keep], y[keep]
    total = 0.0
    for i in range(len(x)):
        own = np.sort(np.abs(x[y == y[i]] - x[i]))[1:]  # without the row itself
        kk = min(k, len(own))
        radius = np.nextafter(own[kk - 1], 0)
        total += psi(kk) - psi(len(own) + 1) - psi(max(1, (np.abs(x - x[i]) <= radius).sum()))
    return max(0.0, psi(len(x)) + total / len(x))


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_as_by_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 500)
    y[0] = 9  # alone in its class
    y[1:3] = 8  # two rows
    a, b, c = y + rng.normal(size=500), rng.normal(size=500), np.round(y + rng.normal(size=500))  # the last one with many ties
    rows = [(int(t), *map(float, v)) for t, v in zip(y, np.c_[a, b, c], strict=True)] + [(None, 1.0, 1.0, 1.0), (1, None, 0.5, None)]
    df = spark.createDataFrame(rows, "target int, a double, b double, c double").repartition(3)
    got = {r["Feature"]: r["MI"] for r in select.explain_model_mutual_info(df, ["a", "b", "c"]).collect()}
    for name, x, extra in (("a", a, []), ("b", b, [0.5]), ("c", c, [])):
        want = by_pairs(np.r_[x, extra], np.r_[y, [1] * len(extra)])
        assert got[name] == pytest.approx(want, abs=1e-9)
    assert got["a"] > 0.2 > got["b"]
    assert select.explain_model_mutual_info(df.filter("target > 99"), ["a"]).count() == 0
    assert select.explain_model_mutual_info(df, ["a", "b"], bins=8).count() == 2


def test_query_matches_sql(spark):
    same(spark, SF, queries.queries()["mutual_information"], queries.oracle_sql()["mutual_information"])
