"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of pre-tokens form linked lists. Every neighbouring pair that can merge is filed in the bucket of its merge
rank, and a bitmap with a bit for each rank says which buckets hold something; a bit of the level above says which
words of the level below are not zero. Taking the next merge is a find-first-set per level, and filing or taking a
position costs the same for any length. A merge does not search the buckets for the pairs it ends: their entries turn
stale and are skipped when they come up. One queue serves many pre-tokens at a time: those do not touch each other,
and each sees its merges in rank order. So a bucket holds pairs of thousands of pre-tokens, and they are merged by one
pass of array operations. Only where a merge brings up a smaller rank does the rest of its pre-token wait for that one.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

#: Bits of a bitmap word; three levels cover 262,144 ranks.
WORD = 64
#: Texts are cut before a space that is followed by a visible character: the pattern always starts a match there.
SAFE_BOUNDARY = re.compile(r" (?=\S)")
#: Characters of pieces and bytes of their ids that a worker remembers, each piece with PIECE more; the memory is emptied
#: beyond that. Longer pieces than LONG characters are not remembered.
REMEMBERED, PIECE, LONG = 37_500_000, 140, 256
#: Bytes of pre-tokens that share one linked list and one queue; a longer pre-token has its own.
RUN_BYTES = 1 << 20
#: Bytes of rows that are encoded together by default.
BATCH_BYTES = 4 << 20
#: Ids that are written out and decoded at once.
AT_ONCE = 1 << 18


class RankQueue:
    """Positions filed under ranks; ``take`` empties the bucket of the smallest rank."""

    def __init__(self, ranks: int):
        self.levels = []
        while ranks > 1:
            ranks = -(-ranks // WORD)
            self.levels.append([0] * ranks)
        self.buckets: dict[int, list] = {}

    def put(self, rank: int, positions) -> None:
        """File a position, or an array of positions if ``take_filed`` is what empties the buckets."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word, bit = divmod(rank, WORD)
            old = level[word]
            level[word] = old | 1 << bit
            if old:
                return
            rank = word

    def put_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """File each position under its rank, by one array for each rank; negative ranks are left out."""
        some = np.flatnonzero(ranks >= 0)
        if len(some):
            ranks = ranks[some]
            order = ranks.argsort(kind="stable")
            ranks, positions = ranks[order], positions[some[order]]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for rank, lo, hi in zip(ranks[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
                self.put(rank, positions[lo:hi])

    def take_filed(self) -> tuple[int, list] | None:
        """The smallest rank with a bucket, and what has been filed there."""
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            if not word:
                return None
            rank = rank * WORD + (word & -word).bit_length() - 1
        at = rank
        for level in self.levels:
            word, bit = divmod(at, WORD)
            level[word] &= ~(1 << bit)
            if level[word]:
                break
            at = word
        return rank, self.buckets.pop(rank)

    def take(self) -> tuple[int, list[int]] | None:
        """The smallest rank with a bucket, and that bucket's positions from left to right."""
        taken = self.take_filed()
        return taken and (taken[0], sorted(taken[1]))


class Partners:
    """For each id, the ids that can stand on one side of it in a merge, and the ranks of those merges."""

    def __init__(self, own: np.ndarray, other: np.ndarray, rank: np.ndarray, size: int):
        order = own.argsort(kind="stable")
        self.other, self.rank = other[order], rank[order]
        self.start = np.searchsorted(own[order], np.arange(size + 1)).tolist()
        self.dense = np.full(size + 1, -1, np.int32)  # the last one is that of id -1: no token

    def ranks(self, own: int, others: np.ndarray) -> np.ndarray:
        """The ranks of the merges of ``own`` with each of ``others``, -1 where there is none."""
        lo, hi = self.start[own], self.start[own + 1]
        if lo == hi:
            return np.full(len(others), -1, np.int32)
        other = self.other[lo:hi]
        self.dense[other] = self.rank[lo:hi]
        out = self.dense[others]
        self.dense[other] = -1
        return out


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of runs of ``lengths`` that begin at ``starts``, one run after the other."""
    ends = lengths.cumsum()
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _offsets(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


class Codec:
    """Encodes and decodes by a rank file (base64 token, rank) and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        self.queue = RankQueue(size)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.byte_pairs = np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int32)
        get = self.ranks.get
        merges = [(a, b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        left, right, rank = np.array(merges, np.int32).reshape(-1, 3).T
        self.rights, self.lefts = Partners(left, right, rank, size), Partners(right, left, rank, size)
        #: Ids with a merge of smaller rank than their own.
        self.early = {*left[rank < left].tolist(), *right[rank < right].tolist()}
        tokens = [b""] * size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.token_length = np.array([len(t) for t in tokens], np.int64)
        self.token_start = _offsets(self.token_length)[:-1]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        #: The digits of an id and a comma in eight bytes, filled with zero bytes.
        self.digits = np.array([f"{i}," for i in range(size)], "S8")
        self.digits_length = np.array([len(str(i)) + 1 for i in range(size)], np.int64)
        #: The ids (as bytes of int32) of a piece without the space before it; a piece without such a space has one more as its key.
        self.known: dict[str, bytes] = {}
        self.size = 0

    def encode_pretokens(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens in ``data``, and how many each has; they lie in one linked list that is cut between them."""
        flat = np.frombuffer(b"".join(data), np.uint8)
        sizes = np.array(list(map(len, data)), np.int64)
        ends = sizes.cumsum()
        n = len(flat)
        if not n:
            return np.zeros(0, np.int32), sizes
        # Position n stands for "none": it has the id -1, which merges with nothing.
        first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        first[0] = True
        first[ends] = True
        last[ends - 1] = True
        ids, due = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
        ids[:n] = self.bytes[flat]
        due[: n - 1] = np.where(last[: n - 1], -1, self.byte_pairs[flat[:-1], flat[1:]])
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[last], before[first] = n, n

        queue, rights, lefts = self.queue, self.rights, self.lefts
        queue.put_all(due, np.arange(n + 1))
        while (taken := queue.take_filed()) is not None:
            r, filed = taken
            at = filed[0]
            if len(filed) > 1:
                at = np.concatenate(filed)
                at.sort()
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            at = at[due[at] == r]  # the others are stale: the pair there has changed since
            if not len(at):
                continue
            j = after[at]
            waiting = None
            if (due[j] == r).any():
                # Pairs of this rank overlap: of a chain of them, every other one is merged, from the left.
                at = np.sort(at)
                waiting = at
                start = np.concatenate(([True], after[at[:-1]] != at[1:]))
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0]
                j = after[at]
            k = after[j]
            if r in self.early:
                at, j, k, rest = self._up_to_smaller_rank(r, at, j, k, waiting, (ids, before, ends))
            else:
                rest = None
            ids[at], ids[j], due[j] = r, -1, -1
            after[at] = k
            before[k] = at
            right = rights.ranks(r, ids[k])
            due[at] = right
            p = before[at]
            left = lefts.ranks(r, ids[p])
            changed = np.flatnonzero(left != due[p])
            p, left = p[changed], left[changed]
            due[p] = left
            queue.put_all(np.concatenate((right, left)), np.concatenate((at, p)))
            if rest is not None:
                queue.put(r, rest)
        keep = ids[:n] >= 0
        kept = _offsets(keep)[_offsets(sizes)]
        return ids[:n][keep], np.diff(kept)

    def _up_to_smaller_rank(self, r: int, at: np.ndarray, j: np.ndarray, k: np.ndarray, waiting: np.ndarray | None, lists: tuple) -> tuple:
        """The merges of rank ``r`` that come before a smaller rank has come up beside one of them in their pre-token.

        That smaller rank goes first; the last of what is returned are the positions that wait for it, if there are any.
        """
        ids, before, ends = lists
        was, was_j = ids[at], ids[j]
        stop = self.rights.ranks(r, ids[k])  # what stands to the right is merged later
        stop = (stop >= 0) & (stop < r)
        ids[at], ids[j] = r, r  # what stands to the left has been merged, and j is its end
        left = self.lefts.ranks(r, ids[before[at]])
        stop |= (left >= 0) & (left < r)
        ids[at], ids[j] = was, was_j
        if not stop.any():
            return at, j, k, None
        order = at.argsort()
        at, j, k, stop = at[order], j[order], k[order], stop[order]
        # The first stop of each pre-token.
        own, one = np.unique(ends.searchsorted(at[stop], "right"), return_index=True)
        limit = np.full(len(ends), len(ids))
        limit[own] = at[stop][one]
        go = at <= limit[ends.searchsorted(at, "right")]
        waiting = at if waiting is None else waiting
        return at[go], j[go], k[go], waiting[waiting > limit[ends.searchsorted(waiting, "right")]]

    def _whole_or_merged(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens, and how many each has. One that is a token is taken whole; the others are merged."""
        data = [x.encode() for x in found]
        whole = np.array([-1 if r is None else r for r in map(self.ranks.get, data)], np.int32)
        lengths = np.ones(len(data), np.int64)
        others = np.flatnonzero(whole < 0)
        merged, lo = [], 0
        upto = np.array(list(map(len, data)), np.int64)[others].cumsum()
        while lo < len(others):
            hi = max(lo + 1, int(upto.searchsorted((upto[lo - 1] if lo else 0) + RUN_BYTES, "right")))
            merged.append(self.encode_pretokens([data[i] for i in others[lo:hi].tolist()]))
            lo = hi
        if not merged:
            return whole, lengths
        lengths[others] = np.concatenate([n for _, n in merged])
        start = _offsets(lengths)
        out = np.empty(start[-1], np.int32)
        free = np.ones(len(out), bool)
        at = start[:-1][whole >= 0]
        out[at] = whole[whole >= 0]
        free[at] = False
        out[free] = np.concatenate([ids for ids, _ in merged])
        return out, lengths

    def learn(self, keys: list[str]) -> None:
        """Encode the pieces of ``keys`` and remember their ids; every match of the pattern is a pre-token of its own."""
        spaced, first = [k for k in keys if k[0] != " "], [k for k in keys if k[0] == " "]
        found = self.pattern.findall("".join([" " + k for k in spaced]))
        ends = _offsets(list(map(len, found)))
        begins = _offsets(list(map(len, spaced))) + np.arange(len(spaced) + 1)
        starts = ends.searchsorted(begins)
        if not np.array_equal(ends[np.minimum(starts, len(found))], begins):
            raise ValueError("the pattern does not begin a match at every space before a visible character")
        starts = starts.tolist()
        for k in first:
            found += self.pattern.findall(k[1:])
            starts.append(len(found))
        code = {m: i for i, m in enumerate(dict.fromkeys(found))}
        codes = np.array(list(map(code.__getitem__, found)), np.int64)
        ids, lengths = self._whole_or_merged(list(code))
        each = lengths[codes]
        raw = ids[_spread(_offsets(lengths)[codes], each)].tobytes()
        bounds = (4 * _offsets(each)[starts]).tolist()
        for k, lo, hi in zip([*spaced, *first], bounds[:-1], bounds[1:], strict=True):
            self.known[k] = raw[lo:hi]

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        if self.size > REMEMBERED:
            self.known.clear()
            self.size = 0
        known = self.known
        split = [(" " + text).split(" ")[1:] for text in texts]
        for pieces in split:
            pieces[0] = " " + pieces[0]
        new = set().union(*split).difference(known)
        # Known pieces stand between safe boundaries. Texts with others are split again.
        unsafe = {p for p in new if not p or (p[0] != " " and p[0].isspace())}
        if unsafe:
            for i, pieces in enumerate(split):
                if not unsafe.isdisjoint(pieces):
                    split[i] = SAFE_BOUNDARY.split(texts[i])
                    split[i][0] = " " + split[i][0]
            new = set().union(*split).difference(known)
        self.learn(list(new))
        found = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        for p in new:
            if len(p) > LONG:
                del known[p]
            else:
                self.size += len(p) + len(known[p]) + PIECE
        return np.frombuffer(b"".join(found), np.int32), np.array([len(x) // 4 for x in found], np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def decode(self, ids) -> bytes:
        """The bytes of ``ids``."""
        ids = np.asarray(ids, np.int64)
        return self.token_bytes[_spread(self.token_start[ids], self.token_length[ids])].tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The decimal ``ids``, each with a comma after it."""
        return self.digits[ids].tobytes().translate(None, b"\0")

    def digests(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[list[str], list[str]]:
        """For each text, SHA-256 of its decimal ids joined by commas, and of the bytes that they decode to."""
        bounds, a = _offsets(lengths), 0
        of_ids, of_text = [], []
        while a < len(lengths):
            b = int(bounds.searchsorted(bounds[a] + AT_ONCE, "right")) - 1
            if b > a:
                some = ids[bounds[a] : bounds[b]]
                at = bounds[a : b + 1] - bounds[a]
                made, upto = self.decimals(some), _offsets(self.digits_length[some])[at].tolist()
                of_ids += [hashlib.sha256(made[lo : max(lo, hi - 1)]).hexdigest() for lo, hi in zip(upto[:-1], upto[1:], strict=True)]
                made, upto = self.decode(some), _offsets(self.token_length[some])[at].tolist()
                of_text += [hashlib.sha256(made[lo:hi]).hexdigest() for lo, hi in zip(upto[:-1], upto[1:], strict=True)]
            else:  # one text of many ids
                b, comma = a + 1, b""
                one, two = hashlib.sha256(), hashlib.sha256()
                for lo in range(bounds[a], bounds[b], AT_ONCE):
                    some = ids[lo : min(lo + AT_ONCE, bounds[b])]
                    one.update(comma + self.decimals(some)[:-1])
                    two.update(self.decode(some))
                    comma = b","
                of_ids.append(one.hexdigest())
                of_text.append(two.hexdigest())
            a = b
        return of_ids, of_text


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a file, kept for the life of the worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of at least ``least`` bytes (the last one: what is left)."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row of ``df``: doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the bytes
    that the ids decode to, and the ids themselves if ``with_ids``.

    Null texts count as empty: no ids, digests of nothing. Repeated rows and null ids pass through, an empty table
    gives no rows, and other columns are not read. Nothing is shuffled. Texts are encoded together until they have
    ``batch_bytes``: the more there are, the fuller the queue's buckets, and the more memory a worker takes.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(df, text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        gc.disable()  # what is remembered has no cycles, and there is much of it to look through
        try:
            yield from encoded(own, batches)
        finally:
            gc.enable()

    def encoded(own: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, batch_bytes):
            ids, n = own.encode_texts(batch.column("text").to_pylist())
            of_ids, of_text = own.digests(ids, n)
            cols = [batch.column("doc_id"), pa.array(n), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.ListArray.from_arrays(pa.array(_offsets(n), pa.int32()), pa.array(ids))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
