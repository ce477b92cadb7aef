"""Token counts and byte-level BPE against the libraries."""

import base64
import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")

from wickwork.llm import bpe, token_counts  # noqa: E402

ALPHABET = ["a", "ab", "  ", "\n", "aaaa", "<|endoftext|>", "é", "漢", "9", "'s", " ", " ", "\x1c", "　", "!", "Zx", "​", "\t", "12"]


def texts(n=300, seed=0):
    rng = random.Random(seed)
    return ["", " ", "a" * 5000, "x " * 3000] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def rows(spark, values):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(values)], "doc_id long, text string, n_tokens string")


def test_counts_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    path, values = P.path("byte_bpe_50k.json"), texts()
    want = [len(e) for e in Tokenizer.from_file(path).encode_batch(values, add_special_tokens=False)]
    got = token_counts.count_tokens(rows(spark, [*values, None]), path).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [*want, 0]
    assert [r.n_bytes for r in got][:-1] == [len(t.encode()) for t in values] and got[2].over_limit == (want[2] > 512)


def test_sentencepiece_models_get_whole_texts(spark):
    import sentencepiece

    path, values = P.path("piece_bpe_32k.model"), texts(50)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(rows(spark, values), path).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(x) for x in model.encode(values)]


def test_batches_are_bounded_by_bytes():
    runs = list(token_counts.byte_batches(["a" * 4, "b" * 4, "c" * 20, "d"], 8))
    assert runs == [["a" * 4, "b" * 4], ["c" * 20], ["d"]]


def codecs():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Codec(path, P.PATTERN)
    return path, own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_ids_are_those_of_tiktoken_and_come_back(spark):
    path, own, library = codecs()
    values = texts()
    for t in values:
        assert own.encode(t) == library.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()
    got = bpe.encode_documents(rows(spark, [*values, None]), path, P.PATTERN, with_ids=True).orderBy("doc_id").collect()
    for r, t in zip(got, [*values, ""], strict=True):
        ids = library.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_very_long_pretoken():
    _, own, library = codecs()
    t = "ab" * 60_000 + "a" * 70_001
    assert own.encode(t) == library.encode_ordinary(t)


def test_a_smaller_rank_goes_before_the_rest_of_its_bucket(tmp_path):
    """A vocabulary in which a merge makes a pair of smaller rank, which tiktoken takes at once."""
    import tiktoken

    tokens = [bytes([i]) for i in range(256)] + [b"abc", b"cab", b"ab", b"bc", b"ca", b"abab", b"aba"]
    path = tmp_path / "v.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    own = bpe.Codec(str(path), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        assert own.encode(t) == library.encode_ordinary(t), t


def test_a_bucket_is_merged_by_one_pass(monkeypatch):
    """New pairs are filed by one entry for each rank, not by one for each pair."""
    _, own, library = codecs()
    rng, calls, put = random.Random(2), [], bpe.RankQueue.put
    text = " ".join("".join(rng.choice("the on ing ti er en st le ou re".split()) for _ in range(5)) for _ in range(20_000))
    monkeypatch.setattr(bpe.RankQueue, "put", lambda *a: (calls.append(1), put(*a))[1])
    assert own.encode(text) == library.encode_ordinary(text)
    assert len(calls) < 10_000


def test_texts_encoded_together_are_those_of_tiktoken(tmp_path, monkeypatch):
    """Vocabularies in any order: overlapping pairs, and smaller ranks that come up beside only some of the merges."""
    import tiktoken

    rng = random.Random(3)
    monkeypatch.setattr(bpe, "AT_ONCE", 20)
    for v in range(30):
        tokens = {bytes(rng.choice(b"abc"[: 2 + v % 2]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 40))}
        tokens = [bytes([i]) for i in range(256)] + rng.sample(sorted(tokens), len(tokens))
        path = tmp_path / f"{v}.tiktoken"
        path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
        own = bpe.Codec(str(path), P.PATTERN)
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
        values = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + rng.choice(["", " é a", "  ", " \n a"]) for _ in range(50)]
        ids, n = own.encode_texts(values)
        of_ids, of_text = own.digests(ids, n)
        want = [library.encode_ordinary(t) for t in values]
        assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]
        assert of_ids == [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in want]
        assert of_text == [hashlib.sha256(t.encode()).hexdigest() for t in values]


def test_queue_gives_ranks_in_order():
    q, rng = bpe.RankQueue(50_000), random.Random(0)
    filed = {}
    for _ in range(500):
        r, p = rng.randrange(50_000), rng.randrange(1000)
        q.put(r, p)
        filed.setdefault(r, []).append(p)
    out = []
    while (x := q.take()) is not None:
        out.append(x)
    assert out == [(r, sorted(ps)) for r, ps in sorted(filed.items())] and not any(map(any, q.levels))


def test_empty_tables(spark):
    empty = rows(spark, ["a"]).limit(0)
    assert token_counts.count_tokens(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert bpe.encode_documents(empty, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
