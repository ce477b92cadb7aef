"""The Merkle manifest against a tree built by plain Python, and its query against SQL."""

import hashlib
import zlib

from helpers import SF, same
from pyspark.sql import functions as F

from wickwork.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def climb(nodes):
    """The root, and for every node its (place, siblings) on the way up."""
    up = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for k, place in enumerate(at):
            run = runs[place // 8]
            up[k].append((place % 8, run[: place % 8] + run[place % 8 + 1 :]))
        nodes, at = [h(*r) for r in runs], [p // 8 for p in at]
    return nodes[0], up


def manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees, out = {}, []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, *climb([leaf(r) for r in own])
    root, above = climb([trees[lang][1] for lang in langs])
    for lang, over in zip(langs, above, strict=True):
        own, sub, paths = trees[lang]
        for r, path in zip(own, paths, strict=True):
            path = path + over
            changed = r if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 else (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            now = leaf(changed)
            for place, others in path:
                now = h(*others[:place], now, *others[place:])
            out.append((r[0], leaf(r), sub, root, h(*[x for _, others in path for x in others]), now, now == root))
    return out


def documents():
    rows = [(k, f"s{k % 3}", "en", k, f"Text {k} É\n") for k in range(700)]  # four levels, the last run of one node
    rows += [(k, "x", "de", None, None if k % 2 else "") for k in range(700, 765)]
    rows += [(800, None, "fr", 1, "Lone"), (None, "s", "en", 0, "No id"), (None, "s", "en", 0, "No id"), (5, "s1", "en", 9, "Same id"), (7, "s1", None, 7, "Null lang"), (7, "s1", None, 7, "Null lang"), (8, "s1", "", 7, "Empty lang"), (9, "é", "日", 2, "A" * 300_000)]
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return merkle.manifest(df, tampered={"text": merkle.lowered(F.col("text"))}, when=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def test_every_proof_as_in_plain_python(spark):
    rows = documents()
    order = lambda t: tuple((v is not None, str(v)) for v in t)
    got = sorted((tuple(r) for r in run(spark, rows).collect()), key=order)
    want = sorted(manifest(rows), key=order)
    assert got == want
    assert {r[6] for r in got} == {True, False}


def test_one_row_one_tree_and_none(spark):
    rows = [(1, "s", "en", 1, "Xy")]
    assert [tuple(r) for r in run(spark, rows).collect()] == manifest(rows)
    assert run(spark, []).count() == 0
    one = [(k, "s", None, 1, "a") for k in range(9)]
    assert sorted(tuple(r) for r in run(spark, one).collect()) == sorted(manifest(one))


def test_partial_parents_in_any_order():
    digests = [bytes([k % 256, k // 256]) * 16 for k in range(600)]
    one, two, both = merkle.Parents(), merkle.Parents(), merkle.Parents()
    for k in list(range(0, 600, 2))[::-1]:
        one.event("t", 600, 0, k, digests[k])
    for k in range(1, 600, 2):
        two.event("t", 600, 0, k, digests[k])
    for parents in (one, two):
        for (tree, n, level, idx), slots in parents.partial.items():
            both.merge(tree, n, level, idx, dict(slots))
    assert not both.partial
    assert both.done[-1][6].hex() == climb([d.hex() for d in digests])[0]


def test_query_matches_sql(spark):
    same(spark, SF, queries.queries()["op11_merkle_manifest"], queries.oracle_sql()["op11_merkle_manifest"])
