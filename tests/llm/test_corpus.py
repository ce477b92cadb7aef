"""WARC, mixing, language-model scores, toxicity and the pipeline."""

import base64
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import SF
from pyspark.sql import functions as F

from wickwork.llm import mixing, pseudo_likelihood, toxicity, warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(0)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted((rng.choice("abc"), str(rng.randrange(5)), rng.randrange(50)) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.loser_tree(runs)) == sorted(x for r in runs for x in r)


def test_archives_hold_every_payload(spark):
    rows = [(1, "http://www.Example.com:80/a?b#c", "<p>one</p>"), (2, "https://example.com/b", "<p>one</p>"), (3, None, None), (4, "x\r\ny", ""), (5, "http://example.com/a", "é\r\n\r\nWARC/1.1\r\n" * 50), (6, "http://example.com/a", "z" * 200_000), (6, "http://example.com/a", "z" * 200_000), (None, "http://n.org", "nobody")]
    got = warc.archive_and_index(pages(spark, rows)).orderBy("range_no", "range_pos").collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        data = (html or "").encode()
        assert by[i].payload_bytes == len(data) and by[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {i: r.refers_to for i, r in by.items() if r.record_type == "revisit"} == {2: 1, 4: 3}
    keys = [(r.url_key, r.captured_at, r.page_id is None, r.page_id or 0) for r in got]
    assert keys == sorted(keys) and by[1].url_key == "com,example)/a?b"
    assert warc.archive_and_index(pages(spark, rows).limit(0)).count() == 0
    assert [r.capture_no for r in got] == list(range(1, len(rows) + 1))
    few = warc.archive_and_index(pages(spark, rows[:4]).selectExpr("*", "1 AS size", "'x' AS url_key", "2 AS value"), min_bytes=1).collect()
    assert {r.page_id for r in few if r.record_type == "revisit"} == {2}


def test_archives_of_several_gzip_members():
    record = lambda i: f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {i}\r\n\r\n{'x' * i}\r\n\r\n".encode()
    sizes = [5, 0, 70_000, 3_000_000, 1]
    for group in ([sizes], [[n] for n in sizes], [sizes[:2], sizes[2:]]):
        data = b"".join(gzip.compress(b"".join(map(record, g))) for g in group)
        assert [len(block) for _, _, block in warc._stream(data)] == sizes
        for cut in (1, 9):
            with pytest.raises(ValueError):
                list(warc._stream(data[:-cut]))
    assert list(warc._stream(b"")) == []


def plain_split(budget, capacity, weight):
    """Raise a common level until the budget is used."""
    share = dict.fromkeys(capacity, 0.0)
    open_ = set(capacity)
    while open_:
        level = (budget - sum(capacity[c] for c in capacity if c not in open_)) / sum(weight[c] for c in open_)
        full = {c for c in open_ if capacity[c] <= weight[c] * level}
        if not full:
            return {c: int(weight[c] * level) if c in open_ else capacity[c] for c in capacity}
        open_ -= full
    return capacity


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 100, 1), ("a", "y", 1000, 1), ("b", "x", 5000, 1), ("b", "y", 10, 1)], "d string, l string, tokens long, docs long")
    got = {(r.d, r.l): r.share for r in mixing.leaf_shares(leaves, ["d", "l"], {"d": {"a": 1, "b": 3}, "l": {"x": 2, "y": 1}}, F.lit(2000), 1).collect()}
    top = plain_split(2000, {"a": 1100, "b": 5010}, {"a": 1, "b": 3})
    want = {("a", k): v for k, v in plain_split(top["a"], {"x": 100, "y": 1000}, {"x": 2, "y": 1}).items()} | {("b", k): v for k, v in plain_split(top["b"], {"x": 5000, "y": 10}, {"x": 2, "y": 1}).items()}
    assert got == want and got["a", "x"] == 100 and got["a", "y"] == 400


def test_prefixes_of_epochs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SMALL_PART", 4)  # several rounds of narrowing
    rng = random.Random(2)
    rows = [(i, "t" * rng.randrange(0, 40), rng.choice(["en", "de", None]), f"s{rng.randrange(3)}", "x") for i in range(600)] + [(1000, "abc", "en", "s0", "x")] * 3 + [(1001, None, "en", "s1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, w string").selectExpr("*", "1 AS __lang", "2 AS __id", "3 AS __need")
    tree = {"lang": F.col("lang"), "source": F.col("source")}
    for percent, epochs in ((60, 1), (150, 3), (0, 1), (1000, 2)):
        out = mixing.copies(docs, tree, {"lang": {"en": 5}}, percent, epochs, seed=3)
        assert out.columns == [*docs.columns, "__copies"]
        got = {}
        for r in out.collect():
            got.setdefault(r.doc_id, set()).add(r["__copies"])
        size = lambda t: (len((t or "").encode()) + 3) // 4
        leaf = {}
        for i, t, lang, s, _ in rows:
            leaf.setdefault((lang or "", s), []).append((i, size(t)))
        tokens = {k: sum(n for _, n in v) for k, v in leaf.items()}
        cap = {}
        for (a, _), n in tokens.items():
            cap[a] = cap.get(a, 0) + n * epochs
        top = plain_split(sum(tokens.values()) * percent // 100, cap, {a: 5 if a == "en" else 1 for a in cap})
        for a in cap:
            own = {k: tokens[k] * epochs for k in tokens if k[0] == a}
            for k, share in plain_split(top[a], own, dict.fromkeys(own, 1)).items():
                whole, rest = divmod(share, tokens[k])
                h = lambda i: hashlib.md5(f"3:{whole}:{i}".encode()).hexdigest()  # noqa: B023, E731
                used, want = 0, {}
                for i in sorted({i for i, _ in leaf[k]}, key=h):
                    want[i] = whole + (used < rest)
                    used += sum(n for j, n in leaf[k] if j == i)
                assert {i: got[i] for i in want} == {i: {c} for i, c in want.items()}
    assert mixing.copies(docs.limit(0), tree, {}, 50).count() == 0
    with pytest.raises(ValueError):
        mixing.copies(docs, tree, {"lang": {"en": 0}}, 50)


def plain_words(text):
    return (text or "").encode().lower().split()


def chain_rows():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(30)]
    chain = lambda: " ".join(words[(s + 1 + rng.integers(2)) % 30] for s in np.cumsum(rng.integers(1, 3, 120)))
    rows = [(i, chain()) for i in range(120)] + [(500, " ".join(rng.permutation(chain().split()))), (501, None), (502, ""), (503, "unheard"), (504, "w1"), (505, "Twice said"), (505, "twice said"), (None, "w2 w3"), (506, "w1 w2 " * 5000)]
    return rows


def test_pseudo_likelihood_is_that_of_the_definition(spark, monkeypatch):
    """Counts, triples and scores against plain loops; the rarer words are joined, the others are at hand."""
    monkeypatch.setattr(pseudo_likelihood, "HEAD", 20)
    rows = chain_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    model, vocab = pseudo_likelihood.train(df)
    counts, c = {}, pseudo_likelihood.CLASSES
    for _, t in rows:
        for w in plain_words(t):
            counts[w] = counts.get(w, 0) + 1
    assert sorted(r.n for r in vocab.collect()) == sorted(counts.values()) and len(model.heads) == 20
    hashed = {w: pseudo_likelihood.xxhash.xxh64_intdigest(w) - (1 << 63) for w in counts}
    by_rank = sorted(counts, key=lambda w: (-counts[w], hashed[w]))
    alone = {w: i for i, w in enumerate(by_rank[:20], 1)}
    cls = {w: alone.get(w, pseudo_likelihood.shared_class(w)) for w in counts}
    total, types = np.zeros(c), np.zeros(c)
    for w, n in counts.items():
        total[cls[w]] += n
        types[cls[w]] += 1
    assert (total == model.total).all() and (types == model.types).all()
    sums = np.zeros((c, c, c), np.int64)
    for _, t in rows:
        near = [0, *[cls[w] for w in plain_words(t)], 0]
        for x in zip(near, near[1:], near[2:], strict=False):
            sums[x] += 1
    assert (pseudo_likelihood.count_triples(df.selectExpr("coalesce(text, '') AS text"), model).reshape(c, c, c) == sums).all()
    want = []
    for i, t in rows:
        ws, value, unseen = plain_words(t), 0.0, 0
        near = [0, *[cls[w] for w in ws], 0]
        for w, x in zip(ws, zip(near, near[1:], near[2:], strict=False), strict=False):
            k, own = ws.count(w), sum(cls[v] == cls[w] for v in ws)
            value += float(model.table[x]) + np.log((counts[w] - k + 0.5) / (total[cls[w]] - own + 0.5 * (types[cls[w]] + 1)))
            unseen += counts[w] == k
        want.append((i, len(ws), round(value, 3) + 0.0, unseen))
    got = pseudo_likelihood.score(df, model, vocab).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.log_likelihood, 3) + 0.0, r.n_unseen) for r in got), key=str) == sorted(want, key=str)
    by = {r.doc_id: r for r in got}
    assert by[501].mean_log_likelihood is None and by[500].mean_log_likelihood < np.mean([by[i].mean_log_likelihood for i in range(120)])
    empty, none = pseudo_likelihood.train(df.limit(0))
    assert pseudo_likelihood.score(df.limit(0), empty, none).count() == 0


def test_what_is_left_of_a_class_sums_to_one():
    """Words of one class with counts 10, 5 and 5, whatever the text takes out, and a share for unseen words."""
    n = np.array([10.0, 5, 5, 0])
    for own in ([10, 5, 0, 0], [0, 0, 0, 0], [1, 2, 3, 0]):
        k = np.array(own, float)
        p = np.exp(pseudo_likelihood.word_log_probability(n, k, n.sum(), k.sum(), 3))
        assert p.sum() == pytest.approx(1)


def test_gradients_of_the_window_network():
    rng = np.random.default_rng(5)
    by_context = rng.integers(0, 4, (7, 7, 7)).astype(float)
    w = pseudo_likelihood.initial_weights(rng.normal(size=7), 1, float)
    loss, g = pseudo_likelihood.gradients(w, by_context, by_context.sum())
    plain = 0.0
    for a in range(7):
        for b in range(7):
            logit = np.tanh(w["e"][a] @ w["l"] + w["e"][b] @ w["r"] + w["h"]) @ w["o"] + w["b"]
            plain -= (by_context[a, b] * (logit - np.log(np.exp(logit).sum()))).sum() / by_context.sum()
    assert loss == pytest.approx(plain)
    for k, v in w.items():
        for _ in range(5):
            at = tuple(int(rng.integers(n)) for n in v.shape)
            old, sides = v[at], []
            for e in (1e-5, -1e-5):
                v[at] = old + e
                sides.append(pseudo_likelihood.gradients(w, by_context, by_context.sum())[0])
            v[at] = old
            assert g[k][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-3, abs=1e-8)


def test_neighbours_tell_of_words():
    """On triples it has not seen, the network is better than the frequency of the word alone by half a nat."""
    rng = np.random.default_rng(2)
    c = pseudo_likelihood.CLASSES
    walk = lambda n: np.cumsum(rng.integers(1, 4, n)) % 60 + 1
    count = lambda s: np.bincount(pseudo_likelihood.triples(s), minlength=c**3)
    seen, held = count(walk(60_000)), count(walk(20_000))
    table = pseudo_likelihood.fit(seen)
    assert np.abs(np.exp(table.astype(float)).sum(1) - 1).max() < 1e-4
    unigram = (seen.reshape(c, c, c).sum((0, 2)) + 1.0) / (seen.sum() + c)
    n = held.reshape(c, c, c)
    assert (n * table).sum() / n.sum() > (n.sum((0, 2)) * np.log(unigram)).sum() / n.sum() + 0.5


def plain_kernel(a, b):
    from itertools import combinations

    total = 0.0
    for p in combinations(range(len(a)), 3):
        for q in combinations(range(len(b)), 3):
            if all(a[i] == b[j] for i, j in zip(p, q, strict=True)):
                total += toxicity.DECAY ** (p[2] - p[0] + 1 + q[2] - q[0] + 1)
    return total


def test_kernel_is_that_of_the_definition():
    texts, marks = ["idiot", "id*iot", "idi", "xyz", "aaaa", "banana", "", "ab"], ["^idiot", "idiots", "idi", "aaa", "ban", "nab", "idiot"]
    got = toxicity.kernels(toxicity._codes(texts), marks)
    for i, a in enumerate(texts):
        for j, b in enumerate(marks):
            assert got[i, j] == pytest.approx(plain_kernel(a, b), rel=1e-4, abs=1e-6)


def test_sentences_have_the_best_of_their_words():
    marks = ["^idiot", "^scum"]
    model = toxicity.Model(marks, np.eye(2), np.ones(2))
    text = "You ID-IOT!! and more\nwords. q" + "scum" * 20 + "? s c u m"
    parts = toxicity.sentences(text)
    assert parts == [["you", "id-iot"], ["and", "more"], ["words"], ["q" + "scum" * 20], ["s", "c", "u", "m"], ["scum"]]
    model.learn(sorted({w for p in parts for w in p}))
    got = model.features(parts)
    for row, ws in zip(got, parts, strict=True):
        for j, mark in enumerate(marks):
            best = max(min(1, plain_kernel(x, mark) / plain_kernel(mark, mark)) for w in ws for x in toxicity.windows(w))
            assert row[j] == pytest.approx(best**toxicity.POWER, rel=1e-3, abs=1e-6)
    keep = {"you", "scum"}
    model.forget(keep)
    assert set(model.place) == keep and model.features([["scum"]])[0, 1] == pytest.approx(1)


def test_machine_and_curve_are_optima():
    """Newton's results against the gradients of what they minimise."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    y, cost = np.sign(x[:, 0] + 0.5 * rng.normal(size=200)), rng.random(200) + 0.1
    w = toxicity._newton_svm(x, y, cost, rounds=200)
    z = np.c_[x, np.ones(200)]
    slack = np.maximum(0, 1 - y * (z @ w))
    assert np.abs(np.r_[1e-2 * w[:-1], 1e-6 * w[-1]] - z.T @ (cost * y * slack)).max() < 1e-4
    f = np.c_[x[:, :1] * 2, rng.normal(size=(200, 2)), rng.random(200)]
    slope, offset = toxicity._curve(f, y > 0)
    assert (slope[:3] >= 0).all() and ((f @ slope + offset > 0) == (y > 0)).mean() > 0.8


def toxic_rows(n=700):
    rng = random.Random(4)
    syll = ["ka", "lo", "mi", "ren", "tu", "sha", "vo", "ped", "gri", "no"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(n):
        ws = [word() for _ in range(rng.randint(20, 60))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(["blarghead", "zumpkin", "dworfle"]))
        rows.append((i, " ".join(ws), int(bad)))
    return rows


def test_toxicity_generalises_and_tolerates_gaps(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9001, None, "x"), (9002, "", "x"), (None, "zumpkin", "x"), (9003, "z u m p k i n and blarg-head with dwor*fle", "x"), (9004, "q" * 5000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held) and sum(got[i].predicted == y for i, y in held) / len(held) > 0.97
    assert 0 <= got[9001].score < 0.5 and got[9001].score == got[9002].score and got[None].held_out is None
    assert got[9003].predicted == 1 and got[9004].predicted == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    assert model is None and [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.with_score(docs, model, "s").columns == ["doc_id", "text", "s"]


def test_pipeline_stages_do_what_their_operators_say(spark):
    import corpus_pipeline as cp

    rows = toxic_rows(260)
    texts = {i: t for i, t, _ in rows}
    more = [(1000 + k, texts[i] + " ", "en", "src1", 0) for k, i in enumerate((1, 2, 3))] + [(2000, None, None, None, None), (2001, "", "de", "src2", 0)]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t, _ in rows] + more, "doc_id long, text string, lang string, source string, n_chars long")
    root = cp.scratch_path(spark, "pipe")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mix_sources", "byte_bpe"]
    clean = cp.drop_toxic(spark, docs, root)
    ids = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and len({i for i, _, y in rows if not y} - ids) <= 4 and len({i for i, _, y in rows if y} & ids) <= 4
    once = cp.drop_exact_copies(spark, docs, root)
    left = [r.doc_id for r in once.collect()]
    assert once.columns == docs.columns and {1, 2, 3}.isdisjoint(left) and {1000, 1001, 1002, 2000} <= set(left) and 2001 not in left
    twice = cp.drop_exact_copies(spark, docs.union(docs.filter("doc_id = 5")), root)
    assert sorted(r.doc_id for r in twice.collect()) == sorted(left)
    near = cp.drop_near_copies(spark, docs, root)
    assert {1000, 1001, 1002}.isdisjoint({r.doc_id for r in near.collect()}) and near.columns == docs.columns
    mixed = cp.mix(spark, docs, root)
    assert mixed.columns == docs.columns and 0 < mixed.count() < docs.count()
    # Row by row: what each stage must keep, from the scores and by brute force, then the ids of the library.
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    model = toxicity.train(docs, spark.read.parquet(f"{root}/labels.parquet"))
    left = [r for r in toxicity.with_score(docs, model, "p").collect() if r.p < 0.5]
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    longest = {}
    for r in left:
        longest[bare(r.text)] = min(longest.get(bare(r.text), r), r, key=lambda r: (-len(r.text or ""), r.doc_id))
    sets = {r.doc_id: set(zip(*((r.text or "").split()[i:] for i in range(5)), strict=False)) for r in longest.values()}
    assert not any(a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0 for a in sets for b in sets)  # no near copies among them
    kept = spark.createDataFrame(list(longest.values()), "doc_id long, text string, lang string, source string, n_chars long, p double").drop("p")
    mixed = cp.mix(spark, kept, root).collect()
    leaf = lambda r: (r.lang, r.source)
    tokens = lambda r: -(-len((r.text or "").encode()) // 4)
    order = lambda r: hashlib.md5(f"17:0:{r.doc_id}".encode()).hexdigest()
    for g in {leaf(r) for r in longest.values()}:  # a prefix of the leaf's epoch
        inside = sorted((r for r in longest.values() if leaf(r) == g), key=order)
        got = {r.doc_id for r in mixed if leaf(r) == g}
        assert {r.doc_id for r in inside[: len(got)]} == got
    total = sum(map(tokens, longest.values()))
    assert 0.9 * total - 5 <= sum(map(tokens, mixed)) < 0.9 * total + sum(max(tokens(r) for r in longest.values() if leaf(r) == g) for g in {leaf(r) for r in longest.values()})
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = cp.run(spark, root)
    assert {r.doc_id: list(r.ids) for r in out.collect()} == {r.doc_id: library.encode_ordinary(r.text or "") for r in mixed} and out.count() == len(mixed)


def test_pipeline_on_empty_and_clashing_tables(spark):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity int, copies int, `row` int, digest string, label string, component string"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    texts = ["one text of its own, long enough to be judged", "One text of its own, long enough to be judged", "another one", "another  one", None, "a third text"]
    rows = [(i, t, "en", "src1", 1, i, i, i, "d", "l", "c") for i, t in enumerate(texts)]
    for docs, most in ((spark.createDataFrame([], schema), 0), (spark.createDataFrame(rows, schema), 4)):
        root = cp.scratch_path(spark, "pipe")
        docs.write.parquet(f"{root}/documents.parquet")
        labels.write.parquet(f"{root}/labels.parquet")
        kept = cp.drop_toxic(spark, docs, root)
        once = cp.drop_exact_copies(spark, kept, root)
        near = cp.drop_near_copies(spark, once, root)
        assert all(x.columns == docs.columns for x in (kept, once, near, cp.mix(spark, docs, root)))
        assert sorted(r.doc_id for r in near.collect()) == [0, 3, 4, 5][:most]
        out = cp.run(spark, root)
        got = {r.doc_id for r in out.collect()}
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and got <= {0, 3, 4, 5} and bool(got) == bool(most)


def test_exact_copies_go_by_row(spark):
    """Rows that share an id but not the text, and rows without an id, are judged by themselves."""
    import corpus_pipeline as cp

    rows = [(1, "a b c"), (2, "abc"), (2, "only here"), (3, "only here too"), (3, "a bc"), (4, "d e"), (4, "de"), (4, "de"), (None, "f"), (None, "f "), (None, "g"), (None, "abc"), (5, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.drop_exact_copies(spark, docs, "").collect()]
    want = [(1, "a b c"), (2, "only here"), (3, "only here too"), (4, "d e"), (None, "f "), (None, "g"), (5, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert cp.drop_exact_copies(spark, docs.limit(0), "").count() == 0


def test_near_copies_of_the_pipeline(spark, monkeypatch):
    """Links of similarity 0.8 and more, far beyond three bits of a SimHash, and one row of each group, null ids included."""
    import corpus_pipeline as cp
    from wickwork.llm import near_copies

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, groups = [], 12
    for g in range(groups):
        base = [word() for _ in range(300)]
        for k in range(8):
            own = list(base)
            for at in rng.sample(range(300), rng.randint(0, 9) if g else 4):
                own[at] = word()
            rows.append((100 * g + k, " ".join(own)))
    rows += [(None, rows[3][1]), (None, "nobody's text " * 9), (None, "Nobody's text  " * 9), (5000, ""), (5001, None), (5002, "one two"), (5003, "One  two"), (5004, "one"), (102, "another text under a known id"), (5005, "x y z")]
    sets = [set(zip(*((t or "").lower().split()[i:] for i in range(5)), strict=False)) if len((t or "").split()) > 5 else {tuple((t or "").lower().split())} for _, t in rows]
    label = list(range(len(rows)))
    close = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while True:
        before = list(label)
        for i, j in close:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    want = [min((rows[i] for i in range(len(rows)) if label[i] == c), key=key) for c in set(label)]
    docs = spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for most in (8, 0):  # pairs of a bucket at once, or all by their rarest shingles
        monkeypatch.setattr(near_copies, "PAIRS_PER_ROW", most)
        got = [(r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs, "").collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert 0 < len(close) and groups < len(want) < len(rows)
    assert cp.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_pairs_by_rare_shingles(spark):
    """All pairs of 0.8 and more, and few of the pairs that share a frequent passage but are no near copies."""
    from wickwork.llm.near_copies import rare_shingle_pairs, shingles

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    texts = [passage + [word() for _ in range(rng.randint(15, 40))] for _ in range(60)]
    for base in texts[:20]:
        own = list(base)
        own[rng.randrange(len(own))] = word()
        texts.append(own)
    texts += [passage, passage[:-1], [], ["one"], passage[:49], passage[:48]]
    rows = [(str(i).encode(), len(shingles(" ".join(t))), str(i).encode(), " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingles(r[3]) for r in rows]
    jaccard = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)]
    want = {frozenset(p) for p in pairs if jaccard(*p) >= 0.8}
    found = rare_shingle_pairs(spark.createDataFrame(rows, "key binary, n int, label binary, text string"), 0.8, 5).collect()
    got = {frozenset((int(bytes(a)), int(bytes(b)))) for a, b in found}
    assert want <= got and len(want) > 10
    assert len(got) < len([p for p in pairs if jaccard(*p) >= 0.4]) / 4


def test_parities_spare_texts_and_lose_no_link(spark):
    """Whatever the sizes, pairs that are similar enough stay, and those that are far from it go before any text travels."""
    from wickwork.llm import near_copies

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = ["", "one two"]
    for n in (5, 30, 63, 68, 69, 70, 130, 133, 260, 900):
        base = [word() for _ in range(n)]
        texts += [" ".join(base[:cut] + [word() for _ in range(more)]) for cut, more in ((n, 0), (n, n // 9), (n - n // 8, 0), (n // 2, n // 8), (n // 3, 0), (n // 9, n // 7))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    known = near_copies._signatures(docs, "text", 5).select("key", "n", "parities")
    sets = {hashlib.sha256(t.encode()).digest(): near_copies.shingles(t) for t in texts}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    frame = spark.createDataFrame([tuple(map(bytearray, p)) for p in pairs], "a binary, b binary")
    jaccard = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    for least in (0.8, 0.3):
        got = {(bytes(a), bytes(b)) for a, b in near_copies._possible(frame, known.distinct(), least).collect()}
        want = {p for p, s in jaccard.items() if s >= least}
        assert want <= got and len(want) > 10
        # Pairs of other sizes are no candidates.
        alike = {(a, b) for a, b in pairs if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b]))}
        assert least < 0.8 or len(got & alike) < (len(want) + len(alike)) / 2


def test_llm_queries_run(spark):
    from wickwork.llm.queries import queries

    for name in ("op9_pseudo_likelihood", "op10_toxicity"):
        assert queries()[name](spark, SF).count() == 200
