"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two strings counts their common subsequences of three characters, each weighted by a decay for every
position it spans, so an insult with gaps, inserted characters or another ending still resembles itself. A sentence is
compared with a landmark by the best of its words (each a window that slides over longer ones, and spelled-out runs of
single characters once more as a word). Landmarks are word beginnings that cover the toxic training texts; a sentence's
similarities to them, whitened by the landmarks' own kernel matrix, are its features.

The machine is trained on sentences. All sentences of clean texts are negative; a toxic text has at least one toxic
sentence: those that the machine puts on the toxic side, or its highest one, are positive, which is decided anew after
every fit. Positive sentences also come with a character inserted into each word. A logistic curve over a text's three highest sentences and their number,
fitted on the training texts, maps them to 0..1, so one sentence that merely resembles an insult weighs less than several.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import text_or_empty

#: Training texts of each label at most, and bytes of one: the bound on what the driver fits to.
TRAIN_ROWS, TRAIN_BYTES = 1500, 1 << 15
ORDER, DECAY = 3, 0.7
#: Power of the kernel, which is a kernel too: chance likeness of the many words of a sentence weighs less.
POWER = 2
#: Characters of a word that are compared at a time; longer words are cut into windows that overlap by half.
SPAN = 24
MAX_LANDMARKS, LANDMARK_LENGTHS = 48, range(4, 13)
#: Bytes of words whose similarities a worker remembers.
REMEMBERED_BYTES = 24 << 20
#: Single characters with something between them: s p e l l e d or s.p.e.l.l.e.d words.
SPELLED = re.compile(r"(?<!\w)\w(?:[\W_]{1,2}\w(?!\w)){2,}")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
SENTENCE_END = re.compile(r"[.!?]+\s+|\n+")


def sentences(text: str) -> list[list[str]]:
    """The raw words of each sentence in lower case, and every spelled-out run as a sentence of one word."""
    text = text.lower()
    out = [ws for part in SENTENCE_END.split(text) if (ws := part.split())]
    return out + [["".join(c for c in m if c.isalnum())] for m in SPELLED.findall(text)]


def trim(word: str) -> str:
    return word if word[:1].isalnum() and word[-1:].isalnum() else EDGES.sub("", word)


def windows(word: str) -> list[str]:
    """What the kernel sees of a raw word: trimmed, marked at its start, cut into spans that cover it."""
    word = "^" + trim(word)
    if len(word) <= SPAN:
        return [word]
    return [word[i : i + SPAN] for i in range(0, len(word) - SPAN // 2, SPAN // 2)]


def _codes(texts: list[str]) -> np.ndarray:
    """Code points, a row each, padded with 0."""
    n = np.array([len(t) for t in texts])
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros((len(texts), max(1, n.max(initial=1))), np.uint32)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out


def kernels(codes: np.ndarray, marks: list[str]) -> np.ndarray:
    """The gap-weighted kernel of order 3 of every row of code points (0 as padding) against every mark.

    One step takes a character of a mark and all characters of all rows. Marks that begin alike share their first steps.
    """
    codes = np.ascontiguousarray(codes.T)  # a row for each place, so that neighbours in an array are different texts
    width, n = codes.shape
    out = np.zeros((n, len(marks)), np.float32)
    lam = np.float32(DECAY)
    back = np.arange(width)[:, None] - np.arange(width)
    decay = np.where(back >= 0, lam ** np.maximum(back, 0), 0).astype(np.float32)
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # where a character stands, and what that adds to `one`

    def walk(members: list[int], depth: int, one: np.ndarray | None, two: np.ndarray | None, total: np.ndarray | None) -> None:
        # one, two: weights of subsequences of 1 and of 2 characters that end before each place; None: there are none yet
        by_next: dict[str, list[int]] = {}
        for m in members:
            if len(marks[m]) > depth:
                by_next.setdefault(marks[m][depth], []).append(m)
            elif total is not None:
                out[:, m] = total
        for char, rest in by_next.items():
            ahead = max(len(marks[m]) for m in rest) - depth - 1  # what the last characters add to `one` and `two` is never used
            if char not in found:
                hit = (codes == ord(char)) * (lam * lam)
                found[char] = hit, decay @ hit
            hit, adds = found[char]
            next_total = total if two is None else (hit * two[:-1]).sum(0)
            if two is not None and total is not None:
                next_total += total
            next_one = next_two = None
            if ahead > 1:
                next_one = np.zeros((width + 1, n), np.float32) if one is None else lam * one
                next_one[1:] += adds
            if ahead > 0 and one is not None:
                next_two = np.zeros((width + 1, n), np.float32) if two is None else lam * two
                next_two[1:] += decay @ (hit * one[:-1])
            walk(rest, depth + 1, next_one, next_two, next_total)

    walk(list(range(len(marks))), 0, None, None, None)
    return out


@dataclass
class Model:
    """Landmarks, the whitening matrix, the machine and the curve."""

    landmarks: list[str]
    whiten: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: np.ndarray = field(default_factory=lambda: np.zeros(4))
    offset: float = 0.0

    def __post_init__(self):
        self.own = kernels(_codes(self.landmarks), self.landmarks).diagonal()
        self.forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "known")}

    def __setstate__(self, state):
        self.__dict__ = state
        self.forget()

    def forget(self, but: set[str] = frozenset()) -> None:
        """Drop the similarities of all words but those of ``but``."""
        old = {w: p for w, p in self.place.items() if w in but} if but else {}
        self.known = self.known[list(old.values())] if old else np.zeros((0, len(self.landmarks)), np.float32)
        self.place: dict[str, int] = dict(zip(old, range(len(old)), strict=True))
        self.size = self._bytes(old)

    def _bytes(self, words) -> int:
        return sum(map(len, words)) + (150 + 4 * len(self.landmarks)) * len(words)

    def similarity(self, texts: list[str]) -> np.ndarray:
        """The kernel of each text against each landmark, as a share of the landmark's own, 1 at most, to the power of POWER."""
        out = np.zeros((len(texts), len(self.landmarks)), np.float32)
        order = np.argsort([len(t) for t in texts], kind="stable")
        for lo in range(0, len(texts), 1000):
            rows = order[lo : lo + 1000]
            out[rows] = np.minimum(1, kernels(_codes([texts[i] for i in rows]), self.landmarks) / self.own)
        return out**POWER

    def learn(self, new: list[str]) -> None:
        """Remember the similarities of raw words: the highest of their windows."""
        found = [self.known]
        for lo in range(0, len(new), 10_000):
            cut = [windows(w) for w in new[lo : lo + 10_000]]
            found.append(np.maximum.reduceat(self.similarity([x for c in cut for x in c]), np.cumsum([0, *map(len, cut)])[:-1]))
        self.place |= dict(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.known = np.concatenate(found)
        self.size += self._bytes(new)

    def features(self, parts: list[list[str]]) -> np.ndarray:
        """A row for each sentence: its similarities to the landmarks."""
        out = np.zeros((len(parts), len(self.landmarks)), np.float32)
        lo = 0
        while lo < len(parts):  # in runs of sentences, so that not all words' similarities are there at once
            hi, n = lo, 0
            while hi < len(parts) and n < 50_000:
                n += len(parts[hi])
                hi += 1
            raw = chain.from_iterable(parts[lo:hi])
            rows = self.known[np.fromiter(map(self.place.__getitem__, raw), np.int64, n)]
            out[lo:hi] = np.maximum.reduceat(rows, np.cumsum([0, *map(len, parts[lo:hi])])[:-1])
            lo = hi
        return out

    def margins(self, features: np.ndarray) -> np.ndarray:
        return features @ (self.whiten @ self.weights) + self.bias

    def summary_of(self, features: np.ndarray, sizes: tuple[int, ...] | None = None) -> np.ndarray:
        """A row for each text, given the features of all sentences and how many each text has (one text with all of them).

        The three highest margins of a text's sentences, that of an empty one where there are fewer, and the logarithm of their number.
        """
        m, at = self.margins(features), 0
        sizes = (len(m),) if sizes is None else sizes
        out = np.full((len(sizes), 4), self.bias)
        for row, n in zip(out, sizes, strict=True):
            own = np.sort(m[at : at + n])[::-1][:3]
            row[: len(own)], row[3] = own, math.log1p(n)
            at += n
        return out

    def score_texts(self, texts: list[str]) -> np.ndarray:
        parts = [sentences(t) for t in texts]
        needed = set(chain.from_iterable(chain.from_iterable(parts)))
        if self.size > REMEMBERED_BYTES:
            self.forget(needed)
        self.learn(list(needed.difference(self.place)))
        f = self.summary_of(self.features([ws for p in parts for ws in p]), tuple(map(len, parts)))
        return 1 / (1 + np.exp(-np.clip(f @ self.slope + self.offset, -40, 40)))


def choose_landmarks(texts: list[list[str]], toxic: np.ndarray, most: int = MAX_LANDMARKS) -> list[str]:
    """Word beginnings that together cover the toxic texts several times and hardly occur in clean ones.

    Of those that occur in toxic texts more often than chance allows, given how many are tried; if there are none, of all.

    A beginning counts once for every word that it follows where it first occurs in a text, so copies of one text, which
    have the same word there, do not make its words landmarks.
    """
    n1, n0 = max(1, toxic.sum()), max(1, (~toxic).sum())
    floor = max(3, 0.006 * n1)
    frequent: set[str] = set()
    alive: set[str] | None = None
    for k in LANDMARK_LENGTHS:  # a beginning is frequent only if its own beginning is
        count: Counter = Counter()
        for i in np.flatnonzero(toxic):
            count.update({w[:k] for w in set(texts[i]) if len(w) >= k and (alive is None or w[: k - 1] in alive)})
        alive = {s for s, n in count.items() if n >= floor}
        frequent |= alive
    good: Counter = Counter()
    where: dict[str, list[int]] = {}
    after: dict[str, set[str]] = {}
    for i in np.flatnonzero(toxic):
        seen = set()
        for before, w in zip(["", *texts[i]], texts[i], strict=False):
            for k in LANDMARK_LENGTHS[: max(0, len(w) - 3)]:
                if (s := w[:k]) not in frequent:
                    break
                if s not in seen:
                    seen.add(s)
                    after.setdefault(s, set()).add(before)
        for s in seen:
            where.setdefault(s, []).append(i)
    cand = {s for s in where if min(len(where[s]), len(after[s])) >= floor}
    for i in np.flatnonzero(~toxic):
        good.update({s for w in set(texts[i]) for k in LANDMARK_LENGTHS[: max(0, len(w) - 3)] if (s := w[:k]) in cand})
    tests = max(2, len(cand))
    cand = {s for s in cand if len(where[s]) / n1 > 6 * (good[s] + 0.5) / n0}
    if sure := {s for s in cand if _surprise(min(len(where[s]), len(after[s])), good[s], n1, n0) > math.log(tests)}:
        cand = sure
    left = np.where(toxic, 1.0, 0.0)
    chosen: list[str] = []
    for _ in range(most):
        gain, best = max(((left[where[s]].sum() * min(1, len(after[s]) / len(where[s])) * (1 - 5 * good[s] / n0 * n1 / len(where[s])), len(s), s) for s in cand), default=(0, 0, ""))[::2]
        if gain < 0.4 * floor:
            break
        chosen.append("^" + best)
        left[where[best]] *= 0.5
        cand = {s for s in cand if not s.startswith(best) and not best.startswith(s)}
    return chosen


def _surprise(k: int, g: int, n1: int, n0: int) -> float:
    """A bound on -ln of the chance that k of k + g texts drawn at random are among the n1 toxic ones."""
    share, expected = k / (k + g), n1 / (n1 + n0)
    kl = share * math.log(share / expected) + (0 if share == 1 else (1 - share) * math.log((1 - share) / (1 - expected)))
    return (k + g) * kl if share > expected else 0.0


def _newton_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Weights, bias last, of the squared-hinge machine."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    reg = ridge * np.eye(len(w))
    reg[-1, -1] = 1e-6
    for _ in range(rounds):
        on = y * (x @ w) < 1
        xs = x[on]
        new = np.linalg.solve(reg + xs.T @ (xs * cost[on, None]), xs.T @ (cost[on] * y[on]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = 0.3 * w + 0.7 * new
    return w


def inserted(words: list[str]) -> list[str]:
    """The words with a character inserted into each, at places that depend on the word."""
    return [w[: at] + "*-.x_"[len(w) % 5] + w[at:] for w in words for at in [1 + zlib.crc32(w.encode("utf-8", "replace")) % max(1, len(w) - 1)]]


def _fit_machine(model: Model, bags: list[np.ndarray], bent: list[np.ndarray], toxic: np.ndarray, rounds: int = 6) -> None:
    """Set the machine: negatives are all sentences of clean texts, positives those of toxic texts that it puts on that side.

    The highest sentence of a toxic text is positive in any case. ``bags`` are the sentences' features by text, ``bent``
    the same with characters inserted. At first the sentences much like a landmark are positive.
    """
    negative = np.concatenate([b for b, t in zip(bags, toxic, strict=True) if not t]) @ model.whiten
    texts = [i for i in np.flatnonzero(toxic) if len(bags[i])]
    value = lambda f: f.max(1) - 0.8
    for _ in range(rounds):
        chosen = []
        for i in texts:
            v = value(bags[i])
            chosen.append((v > 0) | (np.arange(len(v)) == v.argmax()))
        plain = np.concatenate([bags[i][c] for i, c in zip(texts, chosen, strict=True)]) @ model.whiten
        gapped = np.concatenate([bent[i][c] for i, c in zip(texts, chosen, strict=True)]) @ model.whiten
        x = np.r_[negative, plain, gapped]
        y = np.r_[-np.ones(len(negative)), np.ones(len(plain) + len(gapped))]
        # Both labels weigh the same; so do near misses, the clean sentences closest to a landmark, and all the others.
        near = np.concatenate([b.max(1) for b, t in zip(bags, toxic, strict=True) if not t and len(b)] or [np.zeros(0)]) > 0.25
        cost = np.r_[20 / max(1, len(negative)) + near * (10 / max(1, near.sum())), np.full(len(plain), 10 / len(plain)), np.full(len(gapped), 5 / len(gapped))]
        w = _newton_svm(x, y, cost)
        same = np.allclose(w[:-1], model.weights, atol=1e-4)
        model.weights, model.bias = w[:-1], float(w[-1])
        value = model.margins
        if same:
            break


def fit(texts: list[str], toxic: list[int]) -> Model | None:
    """Train on labelled texts; None if one of the labels is missing or no landmark tells them apart."""
    y = np.array(toxic, bool)
    pool: dict[str, str] = {}  # words repeat: one string for each
    one = lambda ws: [pool.setdefault(w, w) for w in ws]
    parts = [[one(ws) for ws in sentences(t)] for t in texts]
    if not y.any() or y.all() or not (landmarks := choose_landmarks([one([w for ws in p for r in ws if (w := trim(r))]) for p in parts], y)):
        return None
    model = Model(landmarks, np.eye(len(landmarks)), np.zeros(len(landmarks)))
    gram = (kernels(_codes(landmarks), landmarks) / np.sqrt(np.outer(model.own, model.own))) ** POWER
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    model.whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T

    model.learn(sorted({w for p in parts for ws in p for w in ws}))
    bags = [model.features(p) for p in parts]
    bent = []
    for p, t in zip(parts, y, strict=True):
        gapped = [inserted(ws) for ws in p] if t else []
        if model.size > REMEMBERED_BYTES:
            model.forget()
        model.learn(list({w for ws in gapped for w in ws}.difference(model.place)))
        bent.append(model.features(gapped))
    del pool
    _fit_machine(model, bags, bent, y)
    model.slope, model.offset = _curve(np.concatenate([model.summary_of(b) for b in bags]), y)
    model.forget()
    return model


def _curve(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of the logistic curve, by Newton's steps with a little ridge; a higher margin never lowers a score."""
    n = f.shape[1]
    mean, std = f.mean(0), f.std(0) + 1e-9
    z = np.c_[(f - mean) / std, np.ones(len(f))]
    use = np.ones(n + 1, bool)
    while True:
        w, zu = np.zeros(n + 1), z[:, use]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w[use] += np.linalg.solve(zu.T @ (zu * (p * (1 - p))[:, None]) + 0.5 * np.eye(use.sum()), zu.T @ (y - p) - 0.5 * w[use] * (np.arange(n + 1) < n)[use])
        falling = np.flatnonzero(w[: n - 1] < 0)
        if not len(falling):
            return w[:n] / std, float(w[n] - (w[:n] * mean / std).sum())
        use[falling] = False


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most ``rows`` labelled texts of each label, those whose ids hash lowest; held-out ids are left out.

    So are texts of more than TRAIN_BYTES. Rows with a null label or id teach nothing. Of several labels of one id the
    highest counts, of several texts of one id the first in order.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most 2 x rows small rows: a fixed bound, so they may be broadcast.
    pick = known.filter("toxic > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).union(known.filter("toxic <= 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(docs, text_col).alias("text")).filter(F.octet_length("text") <= TRAIN_BYTES)
    got = texts.join(F.broadcast(pick), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    return fit(got.column("text").to_pylist(), got.column("toxic").to_pylist())


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score in 0..1 and predicted (1 if the score is at least 0.5).

    Null texts count as empty; an empty text scores as one that resembles no landmark. Without a model (no labelled rows
    of both kinds) every score is 0. Repeated rows and null ids pass through (held_out is null for a null id); very
    long texts are scored whole; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            p = model.score_texts(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array(p >= 0.5).cast(pa.int32())], names=["doc_id", "score", "predicted"])

    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def with_score(docs: DataFrame, model: Model | None, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and the score of its texts as the column ``name``, which must be new."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            p = model.score_texts(texts) if model else np.zeros(len(texts))
            yield batch.append_column(name, pa.array(p, pa.float64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
