"""LM scoring by masked pseudo-likelihood.

Every word is predicted from both sides, in two steps. A bidirectional window network predicts the word's class from
the words around it: an embedding of each neighbour, a hidden layer, a softmax. The word within its class is then
predicted from how often each word of the corpus occurs: the vocabulary is a Spark table with a row for every distinct
word, so it grows with the corpus. All words of a text are taken out of these counts before it is scored, as is usual for
a likelihood of texts that belong to the corpus: a word that no other text has is scored as an unseen word, and what is
left of a class, with a share for words that nobody has, sums up to 1. The network is fitted to all texts, the scored one too.

Frequent words are classes of their own; the others share classes by their endings, which tell languages and kinds of
words apart. With a window of one class on either side the corpus enters the network's loss only through the counts of
class triples, so all words of all texts take part: every task counts its triples, Spark adds them up, and the network
is fitted to the sums in numpy. Words above a bounded number of most frequent ones are looked up by a join with the
vocabulary, not by a broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty, written

#: Class 0 stands for the outside of a text, the next ones for a frequent word each, the rest for words by their endings.
CLASSES, FREQUENT = 160, 95
#: Most frequent words whose counts every task holds (16 bytes each); the counts of the others are joined.
HEAD = 1 << 16
HIDDEN, EMBEDDING, STEPS, RATE = 48, 24, 60, 0.02
#: Counts that an unseen word of a class has.
PRIOR = 0.5
#: Bytes of words whose hashes a worker remembers, and words whose counts it keeps before it passes them on.
REMEMBERED_BYTES, COUNTED = 12 << 20, 200_000


def shared_class(word: bytes) -> int:
    """The class of a word that has none of its own: by its last three bytes."""
    return FREQUENT + 1 + zlib.crc32(word[-3:]) % (CLASSES - FREQUENT - 1)


class Words:
    """Hashes and shared classes of words: runs of anything but ASCII white space, A-Z in lower case."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.size, self.both = 0, np.empty((4096, 2), np.int64)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(hash, shared class) of every word of a text."""
        words = text.encode().lower().split()
        if self.size > REMEMBERED_BYTES:
            self.forget()
        place = self.place
        for w in set(words).difference(place):
            if len(place) == len(self.both):
                self.both = np.concatenate([self.both, np.empty_like(self.both)])
            self.both[len(place)] = xxhash.xxh64_intdigest(w) - (1 << 63), shared_class(w)
            place[w] = len(place)
            self.size += len(w) + 150
        rows = self.both[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]
        return rows[:, 0], rows[:, 1]


def triples(classes: np.ndarray) -> np.ndarray:
    """left * CLASSES**2 + middle * CLASSES + right for every word; 0 is the class beyond either end."""
    padded = np.zeros(len(classes) + 2, np.int64)
    padded[1:-1] = classes
    return (padded[:-2] * CLASSES + padded[1:-1]) * CLASSES + padded[2:]


def vocabulary(texts: DataFrame) -> DataFrame:
    """(h, c, n): every distinct word's hash, shared class and number of occurrences; counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hs, cs, size = Words(), [], [], 0

        def counted() -> pa.RecordBatch:
            h, first, n = np.unique(np.concatenate(hs), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.concatenate(cs)[first], pa.int32()), pa.array(n, pa.int64())], names=["h", "c", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                h, c = words.of(text)
                hs.append(h)
                cs.append(c)
                size += len(h)
                if size > COUNTED:
                    yield counted()
                    hs, cs, size = [], [], 0
        if size:
            yield counted()

    return texts.select("text").mapInArrow(run, "h long, c int, n long").groupBy("h").agg(F.first("c").alias("c"), F.sum("n").alias("n"))


@dataclass
class Model:
    """Counts of the most frequent words, classes, and the fitted network; none of it grows with the corpus.

    heads: hashes, sorted; head_n: their counts; own: the class of each, FREQUENT of which are classes of their own.
    total, types: occurrences and distinct words of every class. table: log P(middle | left, right) of classes.
    """

    heads: np.ndarray
    head_n: np.ndarray
    own: np.ndarray
    total: np.ndarray
    types: np.ndarray
    table: np.ndarray | None = None

    def classes(self, h: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count) of words given by hash and shared class; the count of a word that isn't frequent is -1."""
        if not len(self.heads):
            return shared, np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.heads, h), len(self.heads) - 1)
        there = self.heads[at] == h
        return np.where(there, self.own[at], shared), np.where(there, self.head_n[at], -1)


def count_words(vocab: DataFrame) -> Model:
    """The model's counts from the vocabulary: its most frequent words, and the sums of every class."""
    head = vocab.orderBy(F.desc("n"), "h").limit(HEAD).toArrow()
    h, c, n = (head.column(x).to_numpy() for x in ("h", "c", "n"))
    total, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for row in vocab.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():  # a row for each class
        total[row.c], types[row.c] = row.n, row.types
    own = c.astype(np.int64)
    alone = np.lexsort((h, -n))[:FREQUENT]
    np.subtract.at(total, own[alone], n[alone])
    np.subtract.at(types, own[alone], 1)
    own[alone] = np.arange(1, len(alone) + 1)
    total[own[alone]], types[own[alone]] = n[alone], 1
    order = np.argsort(h)
    return Model(h[order], n[order], own[order], total, types)


def count_triples(texts: DataFrame, model: Model) -> np.ndarray:
    """How often each triple of classes occurs: counted in each task, added up by Spark, CLASSES**3 sums in the end."""
    size = CLASSES**3
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own, total, waiting, n = Words(), shared.value, np.zeros(size, np.int32), [], 0

        def add():
            at, times = np.unique(np.concatenate(waiting), return_counts=True)
            total[at] += times.astype(np.int32)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                keys = triples(own.classes(*words.of(text))[0])
                waiting.append(keys)
                n += len(keys)
                if n > COUNTED:
                    add()
                    waiting, n = [], 0
        if n:
            add()
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part], pa.int64())], names=["k", "n"])

    sums = texts.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[sums.column("k").to_numpy()] = sums.column("n").to_numpy()
    return out


def gradients(w: dict[str, np.ndarray], by_context: np.ndarray, total: float) -> tuple[float, dict[str, np.ndarray]]:
    """The loss, the mean negative log-probability of a class given its neighbours, and its gradients.

    ``by_context`` [left, right, middle] holds how often each triple occurs.
    """
    c, hidden_size = by_context.shape[0], w["h"].shape[0]
    g, loss = {k: np.zeros_like(v) for k, v in w.items()}, 0.0
    from_right = w["e"] @ w["r"] + w["h"]
    for lo in range(0, c, 32):
        left, counts = w["e"][lo : lo + 32], by_context[lo : lo + 32].reshape(-1, c)
        hidden = np.tanh((left @ w["l"])[:, None, :] + from_right[None, :, :]).reshape(-1, hidden_size)
        logit = hidden @ w["o"] + w["b"]
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        norm = p.sum(1, keepdims=True)
        loss -= float((counts * (logit - np.log(norm))).sum()) / total
        d = (p / norm * counts.sum(1, keepdims=True) - counts) / np.asarray(total, p.dtype)
        g["o"] += hidden.T @ d
        g["b"] += d.sum(0)
        dh = ((d @ w["o"].T) * (1 - hidden * hidden)).reshape(-1, c, hidden_size)
        by_left, by_right = dh.sum(1), dh.sum(0)
        g["l"] += left.T @ by_left
        g["e"][lo : lo + 32] += by_left @ w["l"].T
        g["r"] += w["e"].T @ by_right
        g["e"] += by_right @ w["r"].T
        g["h"] += by_right.sum(0)
    return loss, g


def initial_weights(unigram: np.ndarray, seed: int, kind=np.float32) -> dict[str, np.ndarray]:
    rng, c = np.random.default_rng(seed), len(unigram)
    w = {
        "e": rng.normal(0, 0.3, (c, EMBEDDING)), "l": rng.normal(0, 0.3, (EMBEDDING, HIDDEN)), "r": rng.normal(0, 0.3, (EMBEDDING, HIDDEN)),
        "h": np.zeros(HIDDEN), "o": rng.normal(0, 0.1, (HIDDEN, c)), "b": unigram,
    }
    return {k: v.astype(kind) for k, v in w.items()}


def fit(counts: np.ndarray, seed: int = 0) -> np.ndarray:
    """Fit the network to triple counts; log P(middle | left, right) as an array [left, middle, right], float32.

    Full-batch Adam on the counts; before the first step it predicts the frequency of a class, whatever its neighbours.
    """
    c = CLASSES
    counts = counts.reshape(c, c, c)
    by_context = counts.transpose(0, 2, 1).astype(np.float32)
    w = initial_weights(np.log((counts.sum((0, 2)) + 1.0) / (counts.sum() + c)), seed)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    total = max(1.0, float(counts.sum()))
    for step in range(1, STEPS + 1 if counts.any() else 1):
        _, g = gradients(w, by_context, total)
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
            w[k] = (w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    out = np.empty((c, c, c), np.float32)
    from_right = w["e"] @ w["r"]
    for i in range(c):
        logit = np.tanh(w["e"][i] @ w["l"] + from_right + w["h"]) @ w["o"] + w["b"]
        top = logit.max(1, keepdims=True)
        out[i] = (logit - top - np.log(np.exp(logit - top).sum(1, keepdims=True))).T
    return out


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), text_or_empty(df, text_col).alias("text"))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model and the vocabulary (h, c, n). Two passes over all texts: word counts, then counts of class triples."""
    texts = _texts(df, id_col, text_col)
    vocab = written(vocabulary(texts), "vocabulary")
    model = count_words(vocab)
    model.table = fit(count_triples(texts, model))
    return model, vocab


def word_log_probability(n, k, total, own, types):
    """Of a word that occurs n times, k of them in the text itself, in a class of ``total`` occurrences, ``own`` of them in the text, of ``types`` words.

    Works on arrays and on columns: all of the text's words are taken out, each word has PRIOR occurrences more, and so have unseen ones together.
    """
    log = np.log if isinstance(n, np.ndarray) else F.log
    return log((n - k + PRIOR) / (total - own + PRIOR * (types + 1)))


def score(df: DataFrame, model: Model, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, n_words, log_likelihood (the pseudo-log-likelihood), mean_log_likelihood and n_unseen.

    n_unseen counts words that occur in no other row. The corpus is what ``model`` and ``vocab`` were counted on, and it
    has the row's own text in it. Null and empty texts have no words, a sum of 0 and a null mean. Repeated rows are other texts to
    one another; null ids pass through. Very long texts are scored whole. An empty table gives no rows; other columns
    are not read.
    """
    rows = _texts(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # HEAD words and CLASSES**3 numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = shared.value, Words()
        table = own.table.reshape(-1)
        for batch in batches:
            n_words, sums, unseen, rare_h, rare_k, rare_c, rare_own = [], [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                h, c = words.of(text)
                c, _ = own.classes(h, c)
                value = table[triples(c)].sum(dtype=np.float64)
                of_class = np.bincount(c, minlength=CLASSES)
                h, first, k = np.unique(h, return_index=True, return_counts=True)
                c, n = own.classes(h, c[first])
                known = n >= 0
                value += (k[known] * word_log_probability(n[known].astype(float), k[known], own.total[c[known]], of_class[c[known]], own.types[c[known]])).sum()
                n_words.append(int(k.sum()))
                sums.append(float(value))
                unseen.append(int(k[known & (n <= k)].sum()))
                rare_h.append(h[~known])
                rare_k.append(k[~known].astype(np.int32))
                rare_c.append(c[~known].astype(np.int16))
                rare_own.append(of_class[c[~known]])
            ends = pa.array(np.cumsum([0, *map(len, rare_h)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), kind)) for x, kind in ((rare_h, pa.int64()), (rare_k, pa.int32()), (rare_c, pa.int16()), (rare_own, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(sums, pa.float64()), pa.array(unseen, pa.int64()), *lists], names=["doc_id", "n_words", "known", "unseen", "h", "k", "c", "own"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    first = rows.mapInArrow(run, f"doc_id {kind}, n_words long, known double, unseen long, h array<long>, k array<int>, c array<smallint>, own array<long>")
    first = written(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = first.select("row", F.explode(F.arrays_zip("h", "k", "c", "own")).alias("w")).select("row", "w.h", "w.k", "w.c", "w.own").join(vocab.select("h", "n"), "h")
    total, types = (F.get(F.lit([float(x) for x in v]), F.col("c").cast("int")) for v in (model.total, model.types))
    value = F.col("k") * word_log_probability(F.col("n"), F.col("k"), total, F.col("own"), types)
    sums = rare.groupBy("row").agg(F.sum(value).alias("rare"), F.sum(F.when(F.col("n") <= F.col("k"), F.col("k")).otherwise(0)).alias("rare_unseen"))
    out = first.select("row", "doc_id", "n_words", "known", "unseen").join(sums, "row", "left")
    total = F.col("known") + F.coalesce("rare", F.lit(0.0))
    return out.select("doc_id", "n_words", total.alias("log_likelihood"), F.try_divide(total, F.col("n_words")).alias("mean_log_likelihood"), (F.col("unseen") + F.coalesce("rare_unseen", F.lit(0))).alias("n_unseen"))
