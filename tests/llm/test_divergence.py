"""The source divergence audit against plain Python, its tries against sorted counts, and its query against SQL."""

import re
from collections import Counter, defaultdict

import pytest
from helpers import SF, same
from hypothesis import given, settings
from hypothesis import strategies as st

from wickwork.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit(rows, least=10):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text)]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups.add((lang, source))
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for g, s in groups if g == lang)
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        p = {}
        for s in sources:
            n = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (n + 2 * v) for t in kept}
        n = sum(counts[lang, s][t] for s in sources for t in kept)
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 2) // (n + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:10]
            for part, items in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(items, 1)]
    return sorted(out)


def rows_of(spark, rows):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "lang string, source string, text string, rank int, item string")
    return sorted(tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())


def test_whole_result_as_in_plain_python(spark):
    words = ["Der", "die", "Das", "naïve", "ÉCOLE", "日本", "x", "tie1", "tie2", "ab", "abc", "abd", "b"]
    rows = []
    for k in range(180):
        text = " ".join(w for i, w in enumerate(words) if (k * (i + 3)) % 7 < 4) + f" rare{k}" + ("," * (k % 3)) + " Der" * (k % 5)
        rows.append((("en", "de", None, "fr")[k % 4], f"src{k % 5}" if k % 9 else None, text))
    rows += [("en", "empty", ""), ("en", "nulls", None), ("solo", "only", "word " * 20), ("none", "a", "few"), ("none", "b", None), ("en", "long", "lang " * 300_000 + "é" * 3_000_000 + " ende")]
    rows += [("rep", s, "same text here") for s in ("a", "b") for _ in range(12)]
    assert rows_of(spark, rows) == audit(rows)


def test_empty_table(spark):
    assert rows_of(spark, []) == []


def test_tries_poured_early_give_the_same(spark, monkeypatch):
    rows = [("en", f"s{k % 3}", " ".join(f"w{(k * j) % 23}" for j in range(9)) + " and the") for k in range(120)]
    whole = list(divergence._tries(iter([])))
    assert whole == []
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"lang": ["en"] * 10, "source": pa.array([k % 3 for k in range(10)], pa.int32()), "text": pa.array([r[2].encode() for r in rows[n : n + 10]])}) for n in range(0, 120, 10)]
    monkeypatch.setattr(divergence, "TRIE_LEAVES", 5)
    small = list(divergence._tries(iter(batches)))
    monkeypatch.setattr(divergence, "TRIE_LEAVES", 1 << 18)
    large = list(divergence._tries(iter(batches)))
    assert len(small) > len(large) == 1
    total = Counter()
    for b in small:
        for r in b.to_pylist():
            for s, n in zip(r["sources"], r["counts"], strict=True):
                total[r["term"], s] += n
            total[r["term"], "docs"] += r["docs"]
    for r in large[0].to_pylist():
        assert total[r["term"], "docs"] == r["docs"] and [total[r["term"], s] for s in r["sources"]] == r["counts"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6), max_size=40))
def test_trie_walks_in_byte_order(terms):
    trie = divergence.Trie()
    for t in terms:
        trie.at(t)[0] += 1
    assert [(t, leaf[0]) for t, leaf in trie.walk()] == sorted(Counter(terms).items())


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60), st.integers(1, 9))
def test_terms_of_pieces(text, size):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(divergence, "PIECE", size)
        got = [t.decode() for part in divergence.terms_of(text.encode()) for t in part]
    assert got == ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text)]


def test_shares_beyond_64_bits():
    import numpy as np

    big = np.array([0, 10**14, 7], np.int64)
    assert divergence.share(big, 3 * 10**14, 5).tolist() == [1 + 10**9 * (int(c) + 2) // (3 * 10**14 + 10) for c in big]


def test_query_matches_sql(spark):
    same(spark, SF, queries.queries()["op12_source_divergence"], queries.oracle_sql()["op12_source_divergence"])
