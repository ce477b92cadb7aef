"""Exact, substring and near dedup, components, fingerprints."""

import hashlib
import re
import struct

import numpy as np
import pytest
import xxhash
from helpers import SF, same
from pyspark.sql import functions as F

from wickwork.llm import components, exact_dedup, golay, order_minhash, simhash, substring_dedup
from wickwork.llm.queries import oracle_sql, queries

WORDS = "the quick brown fox jumps over a lazy dog while seven bright stars fall on cold water near old stone walls".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp1 int, kept string")


def text(seed, n=80):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(50)) for i in rng.integers(len(WORDS), size=n))


@pytest.mark.parametrize("name", ["op2_warc", "op3_mix_sources", "op4_substring_dedup", "op7_exact_dedup"])
def test_query_matches_sql(spark, name):
    same(spark, SF, queries()[name], oracle_sql()[name])


def test_chunk_hashes_combine(spark):
    data = np.random.default_rng(0).integers(0, 256, 20_000, dtype=np.uint8).tobytes()
    whole = exact_dedup.chunk_hash(data)
    assert whole == tuple(sum(x * pow(b, len(data) - 1 - i, exact_dedup.P) for i, x in enumerate(data)) % exact_dedup.P for b in exact_dedup.BASES)
    for cuts in ([1], [4096], [5000, 5000, 12_000], [0, 20_000]):
        edges = [0, *cuts, len(data)]
        parts = [data[a:b] for a, b in zip(edges, edges[1:])]
        chunks = [(no, *[x for i in (0, 1) for x in (exact_dedup.chunk_hash(p)[i], pow(exact_dedup.BASES[i], len(p), exact_dedup.P))], len(p)) for no, p in enumerate(parts)]
        df = spark.createDataFrame([(chunks[::-1],)], "parts array<struct<no int, fp1 long, shift1 long, fp2 long, shift2 long, n_bytes long>>")
        assert tuple(df.select(exact_dedup.combined(df.parts).alias("x")).select("x.*").first()) == (*whole, len(data))


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for bare, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), hashlib.sha256(bare.encode()).hexdigest()) for i, _ in members]
    return out


def test_exact_groups(spark):
    rows = [(1, "a b"), (2, "ab "), (3, "a  b"), (4, None), (5, ""), (6, " \n"), (7, "ä" * 300), (8, "ä " * 300), (9, "b" * 700), (9, "b" * 700), (10, "ä" * 299 + "b"), (None, "ab")]
    for chunk in (64, 1 << 16):  # the long ones are hashed in chunks, or whole
        got = exact_dedup.exact_groups(frame(spark, rows), chunk=chunk).collect()
        key = lambda r: (r[0] is None, r[0] or 0)
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute_exact(rows), key=key)
        kept = [r.doc_id for r in got if r.kept]
        assert sorted(kept) == [3, 6, 8, 9, 10]
    assert exact_dedup.exact_groups(frame(spark, rows).limit(0)).count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    """Rows that share id and length, in either order, and null ids in the comparison."""
    rows = [(1, "xx yy"), (1, "ab cd"), (2, "abcd"), (None, "ab cd"), (None, "xx yy"), (None, "zz"), (3, "z z"), (3, "z z")]
    for order in (rows, rows[::-1]):
        got = exact_dedup.exact_groups(frame(spark, order)).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[3])
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute_exact(order), key=key)
        assert sorted((r.doc_id, r.group_size) for r in got if r.kept) == [(1, 2), (1, 3), (3, 3)]


def test_collisions_are_told_apart(spark, monkeypatch):
    """Fingerprints that are all equal leave it to the comparison of chunks."""
    real = exact_dedup.fingerprints

    def blind(*args, **kwargs):
        return real(*args, **kwargs).withColumns({c: F.lit(7).cast("long") for c in ("fp1", "fp2", "n_bytes")})

    monkeypatch.setattr(exact_dedup, "fingerprints", blind)
    rows = [(1, "same text"), (2, "sametext"), (3, "other"), (4, "other"), (5, "third"), (None, "other"), (1, "nine char")]
    got = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == sorted([(1, 1, 2), (2, 1, 2), (3, 3, 3), (4, 3, 3), (5, 5, 1), (None, 3, 3), (1, 1, 1)], key=str)


def test_repeated_units(spark):
    line = "one two three four five six seven eight nine."
    rows = [(1, f"Intro.\n{line}\nend"), (2, f"x {text(1)}. {line.upper()}  "), (3, line + " " + line), (4, "too short a line."), (5, "too short a line."), (6, None), (7, text(2) + ".")]
    df = frame(spark, rows)
    df = df.withColumn("__spans", F.lit(1)).withColumn("id", F.lit(2))
    sentences = {"pattern": substring_dedup.SENTENCE, "min_words": substring_dedup.SENTENCE_WORDS}
    spans = substring_dedup.repeated_units(df, **sentences)
    got = sorted((r.doc_id, r.start, r.end, r.keep_doc_id, r.copies) for r in spans.collect())
    texts = dict(rows)
    assert [(g[0], texts[g[0]][g[1] : g[2]].lower()) for g in got] == [(2, line), (3, line), (3, line)] and all(g[3] == 1 and g[4] == 4 for g in got)
    clean = {r.doc_id: r.text for r in substring_dedup.without_units(df, spans).collect()}
    assert clean[3].strip() == "" and clean[1] == texts[1] and clean[6] is None and line not in clean[2].lower()
    assert substring_dedup.repeated_units(df.limit(0)).count() == 0


def test_repeated_lines_and_paragraphs(spark):
    """Every line or paragraph counts; repeated rows are one document, other rows of an id, or without one, their own."""
    rows = [(2, "Licensed under\nown words\n\nA b\nc d"), (1, "licensed  UNDER\r\nx"), (3, "x\n\na b\nC d\n\nown words"), (3, "x\n\na b\nC d\n\nown words"), (3, "zz\nown words"), (None, "x\nnobody's\nx"), (None, "nobody's"), (4, None), (5, "\n \n")]
    df = frame(spark, rows)
    for pattern in (substring_dedup.LINE, substring_dedup.PARAGRAPH):
        spans = substring_dedup.repeated_units(df, pattern=pattern)
        keys = {r.t: r.k for r in df.selectExpr("text AS t", "xxhash64(text) AS k").collect()}
        places = {}
        for i, t in set(rows):
            for m in re.finditer(pattern, t or ""):
                if words := m[0].lower().split():
                    places.setdefault(" ".join(words), set()).add((i is None, i or 0, m.start() + len(m[0]) - len(m[0].lstrip()), keys[t], m.start() + len(m[0].rstrip()), t))
        want = {(None if p[0] else p[1], p[5], p[2], p[4]) for v in places.values() for p in v if p != min(v)}
        texts = {k: t for t, k in keys.items()}
        assert {(r.doc_id, texts[r.text_key], r.start, r.end) for r in spans.collect()} == want and want
        clean = substring_dedup.without_units(df, spans)
        left = []
        for i, t in rows:
            for _, _, s, e in sorted((w for w in want if w[:2] == (i, t)), key=lambda w: -w[2]):
                t = t[:s] + t[e:]
            left.append((i, t))
        assert clean.columns == df.columns and sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(left, key=str)


def plain_passages(rows, least=8):
    """Spans of runs of sentences, at least ``least`` words long but no longer on both sides than it takes, that have an earlier copy."""
    places = {}
    for i, t in rows:
        units = [(m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip()), m[0].lower().split()) for m in re.finditer(r"[^.!?\n]+[.!?]*|[.!?]+", t or "") if m[0].split()]
        n = [len(u[2]) for u in units]
        for a in range(len(units)):
            for b in range(a, len(units)):
                if sum(n[a : b + 1]) >= least and (sum(n[a:b]) < least or sum(n[a + 1 : b + 1]) < least):
                    places.setdefault(" ".join(w for u in units[a : b + 1] for w in u[2]), []).append((i, units[a][0], units[b][1]))
    return sorted((*p, len(v), *min(v)[:2]) for v in places.values() for p in v if p[:2] != min(v)[:2])


def test_repeated_passages_of_short_sentences(spark):
    short = "It rained. We ran home! Nobody spoke? The door was shut. Too late. Yes."
    rng = np.random.default_rng(8)
    chance = [" ".join(rng.choice(["Yes.", "It rained.", "No one came\n", "Ä b c."], 12)) for _ in range(12)]
    rows = [(1, f"Start here.\n{short} {text(11, 20)}."), (2, f"{text(12, 20)}. {short.upper()} Another end."), (3, "It rained. Yes."), (4, "Yes. It rained."), (5, None), (6, "... ")] + [(10 + k, t) for k, t in enumerate(chance)]
    df, texts = frame(spark, rows), dict(rows)
    assert not [r for r in substring_dedup.repeated_units(df, pattern=substring_dedup.SENTENCE, min_words=8).collect() if r.doc_id < 10]
    spans = substring_dedup.repeated_passages(df)
    got = sorted((r.doc_id, r.start, r.end, r.copies, r.keep_doc_id, r.keep_start) for r in spans.collect())
    assert got == plain_passages(rows) and {g[0] for g in got if g[0] < 10} == {2}
    clean = {r.doc_id: r.text for r in substring_dedup.without_units(df, spans).collect()}
    assert clean[2].split() == texts[2].replace(short.upper(), "").split() and all(clean[i] == texts[i] for i in (1, 3, 4, 5, 6))
    bare = lambda ts: {" ".join(u.lower().split()) for t in ts for u in re.findall(r"[^.!?\n]+[.!?]*", t or "") if u.strip()}
    assert bare(clean.values()) == bare(texts.values())  # each sentence stays somewhere


def test_golay_code():
    words = golay.codewords()
    assert len(set(words.tolist())) == 4096 and np.bitwise_count(words[1:]).min() == 7
    nearest, near = golay.keys(16)
    rng = np.random.default_rng(0)
    for s in rng.integers(0, 1 << 16, 300).tolist():
        for t in [s, *[s ^ 1 << b for b in range(16)]]:
            assert nearest[s] in near[t]


def brute_components(ids, fps):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min(label[j] for j in ids if (fps[i] ^ fps[j]).bit_count() <= 3)
            if low < label[i]:
                label[i], changed = low, True
    return label


def test_links_lose_none(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for bit in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                x ^= 1 << bit
            fps.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)


def plain_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_duplicates(spark):
    long = text(5, 400)
    rows = [(1, long), (2, long.replace(" ", "  ", 3)), (3, long + " tail"), (4, text(6)), (5, ""), (6, None), (7, "One"), (8, "one"), (9, "Ä B"), (9, "Ä B"), (None, "one"), (None, "alone here")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = {i: plain_fingerprint(t or "") for i, t in rows}
    want = brute_components([i for i in fps if i is not None], fps)
    named = [r for r in got if r.doc_id is not None]
    assert len(got) == len(rows) and all(r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in named)
    assert sorted((r.component_id or -1) for r in got if r.doc_id is None) == [-1, 7]
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_null_ids_link(spark, monkeypatch):
    """Components by brute force over rows, null ids and repeated ids included."""
    rng = np.random.default_rng(1)
    rows, at = [], 0
    for i in range(60):
        at = int(rng.integers(0, 1 << 62)) if i % 6 == 0 else at ^ sum(1 << int(b) for b in rng.choice(62, 3, replace=False))
        rows.append((None if i % 3 else int(rng.integers(100)), at))
    rows += [(None, at), (7, 5), (7, 5 << 20)]
    df = spark.createDataFrame([(i, str(f)) for i, f in rows], "doc_id long, text string")
    monkeypatch.setattr(simhash, "fingerprints", lambda d, *_: d.select("doc_id", F.col("text").cast("long").alias("fp")))
    group = list(range(len(rows)))
    for _ in rows:
        for i, (_, f) in enumerate(rows):
            low = min(group[j] for j, (_, g) in enumerate(rows) if (f ^ g).bit_count() <= 3)
            group[i] = min(group[i], low)
    want = [(i, f"{f:016x}", min((rows[j][0] for j in range(len(rows)) if group[j] == g and rows[j][0] is not None), default=None)) for (i, f), g in zip(rows, group, strict=True)]
    got = [tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, 7), (7, 103), (5, 5), (200, 201), (201, 200)]
    got = {r.node: r.label for r in components.min_label_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 7: 7, 100: 7, 103: 7, 200: 200, 201: 200}


def plain_sketch(t, k=3, rows=32, length=2):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    chain = lambda parts, seed: seed if not parts else chain(parts[1:], xxhash.xxh64_intdigest(parts[0], seed))
    if not words:
        return [0] * rows
    grams = [words[i : i + k] for i in range(len(words) - k + 1)] or [words]
    seen, values = {}, []
    for place, g in enumerate(grams):
        h = chain([w.encode() for w in g], 42) >> 28
        values.append((chain([struct.pack("<Q", h), struct.pack("<I", seen.get(h, 0))], 42) >> 28) << 27 | place)
        seen[h] = seen.get(h, 0) + 1
    out = []
    for no, anchor in enumerate(order_minhash._anchors(rows)):
        least = sorted(sorted(v ^ anchor << 27 for v in values)[:length], key=lambda v: v & (1 << 27) - 1)
        out.append(chain([struct.pack("<Q", v >> 27) for v in least] + [struct.pack("<I", no)], 42))
    return out


def test_order_minhash(spark):
    rows = [(3, text(1, 300)), (9, text(1, 300)), (4, "a b a b a b a b a b"), (7, None), (5, ""), (6, "solo"), (8, "x" * 3001), (10, text(2, 50)), (10, text(2, 50))]
    got = order_minhash.edited_and_next(frame(spark, rows)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    hexed = lambda f: "".join(f"{x:016x}" for x in f)
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(nxt)
        near = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / len(x)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), near(a, b), near(a, c)))
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert order_minhash.edited_and_next(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(TypeError):
        order_minhash.edited_and_next(frame(spark, rows).selectExpr("string(doc_id) AS doc_id", "text"))


def test_more_kmers_than_places_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "PLACE_BITS", 4)
    few = spark.createDataFrame([(" ".join("abcdefghijklmnopqr"),)], "t string")  # 16 k-mers
    assert len(few.select(order_minhash.numbered_kmers(few.t, 3).alias("x")).first().x) == 16
    with pytest.raises(Exception, match="k-mers"):
        few.select(order_minhash.numbered_kmers(F.concat(few.t, F.lit(" s")), 3)).collect()


def test_order_counts_in_fingerprints(spark):
    words = text(7, 400).split()
    swapped = " ".join(words[200:] + words[:200])
    df = spark.createDataFrame([(" ".join(words), swapped)], "a string, b string")
    likeness = {n: df.select(order_minhash.likeness(*[order_minhash.fingerprint(df[c], length=n) for c in "ab"]).alias("x")).first().x for n in (1, 2)}
    assert likeness[1] > 0.9 > likeness[2]
