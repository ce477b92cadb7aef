"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from the Golay keys of ``simhash``, over shingles of that width. Links of three bits miss most pairs of
that similarity, which differ in seven bits or more, so texts that share a band of a MinHash signature are candidates
too, and every link is verified on the shingles themselves. A pair of similarity s shares none of the bands with
probability (1 - s**ROWS)**BANDS, 0.0002 at 0.8.

Texts travel for few candidates only. A text's parities are bits that its shingles flip by their hashes: two texts differ
in at least as many shingles as in parities, so a pair whose parities differ more than its similarity allows is no link.

A bucket is a SimHash component or a band's value, with the texts that have it. Its texts are first compared with one of
them, its hub, since most of a large group of near copies are linked by that; further hubs follow as long as each halves
what is left. Then texts of a small bucket that no links join yet are compared pair by pair. Those of large buckets,
which share frequent passages without being near copies, are joined by their rarest shingles: two texts of similarity t
share one of the first n - ceil(t * n) + 1 in any order, so with the frequent ones last they seldom meet, and no pair is
lost. No bucket is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import min_label_components
from .shared import join_small, text_or_empty, written
from .simhash import near_duplicates

BANDS, ROWS = 28, 6
_RNG = np.random.default_rng(28)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
#: Pairs a bucket's row may cost; in buckets where it would cost more, texts are joined by their rarest shingles.
PAIRS_PER_ROW = 8
#: Keeps a bound that is a whole number from being rounded up.
_SLACK = 1e-9


def shingles(text: str, width: int = 5) -> set[bytes]:
    """The runs of ``width`` words; a shorter text is one shingle. Words are those of ``simhash.fingerprint``."""
    words = text.encode().lower().split()
    if len(words) <= width:
        return {b" ".join(words)}
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return {flat[a : b - 1] for a, b in zip([0, *ends], ends[width - 1 :], strict=False)}


def hashes(grams: set[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64)


def bands(hashed: np.ndarray) -> list[int]:
    """A hash of each band's least values under ROWS permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashed), 512):
        np.minimum(least, ((hashed[lo : lo + 512] ^ _MASKS[:, None]) * _FACTORS[:, None]).min(1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), no) - (1 << 63) for no, row in enumerate(least.reshape(BANDS, ROWS))]


def parities(hashed: np.ndarray) -> np.ndarray:
    """As many bits as there are hashes, up to the next power of two and 64 at least, in whole numbers of 64 bits.

    A bit says whether an odd number of hashes falls on it. Twice as many bits, folded in half by an exclusive or, are the
    bits that half as many would have been.
    """
    size = max(64, 1 << max(0, len(hashed) - 1).bit_length())
    odd = np.bincount((hashed & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _signatures(df: DataFrame, text_col: str, width: int) -> DataFrame:
    """(key, n, bands, parities) by row: the text's digest, how many shingles it has, and what is known of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, banded, odd = [], [], []
            for text in batch.column("text").to_pylist():
                hashed = hashes(shingles(text, width))
                n.append(len(hashed))
                banded.append(bands(hashed))
                odd.append(parities(hashed))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int32()), pa.array(banded, longs), pa.array(odd, longs)], names=["key", "n", "bands", "parities"])

    return _texts(df, text_col).mapInArrow(run, "key binary, n int, bands array<long>, parities array<long>")


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    """(key, text) by row. The texts are read again from ``df`` where they are needed, not stored once more."""
    rows = df.select(text_or_empty(df, text_col).alias("text"))
    return rows.select(F.unhex(F.sha2("text", 256)).alias("key"), "text")


def _texts_of(texts: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """(key, text) of each of ``keys``; only their texts are shuffled if the keys are few enough to be broadcast."""
    return join_small(texts, written(keys.distinct(), name), ["key"], "left_semi").groupBy("key").agg(F.first("text").alias("text"))


def _possible(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that may be as similar by their parities in ``known`` (key, n, parities)."""
    x, y = (known.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("parities").alias(f"p_{k}")) for k in ("a", "b"))
    both = pairs.join(x, "a").join(y, "b")
    xor = lambda p, q: F.zip_with(p, q, lambda v, w: v.bitwiseXOR(w))
    size = F.least(F.size("p_a"), F.size("p_b"))

    def folded(p: str) -> Column:
        parts = F.sequence(F.lit(0), (F.size(p) / size).cast("int") - 1)
        return F.aggregate(parts, F.array_repeat(F.lit(0).cast("long"), size), lambda bits, k: xor(bits, F.slice(p, k * size + 1, size)))

    differ = F.aggregate(xor(folded("p_a"), folded("p_b")), F.lit(0), lambda sum_, v: sum_ + F.bit_count(v))
    return both.filter(differ <= (1 - least) / (1 + least) * (F.col("n_a") + F.col("n_b")) + _SLACK).select("a", "b")


def _verified(pairs: DataFrame, rows: DataFrame, known: DataFrame, least: float, width: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts in ``rows`` (key, text) are that similar, as (src, dst)."""
    pairs = written(_possible(pairs, known, least), "pairs")
    texts = written(_texts_of(rows, pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))), "wanted"), "texts")
    both = pairs.join(texts.withColumnsRenamed({"key": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"key": "b", "text": "tb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, grams = None, set()
        for batch in batches:
            keep = []
            for b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("b", "ta", "tb")), strict=True):
                if b != last:
                    last, grams = b, shingles(tb, width)
                other = shingles(ta, width)
                common = len(grams & other)
                keep.append(common >= least * (len(grams) + len(other) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["src", "dst"])

    return written(both.select("a", "b", "ta", "tb").mapInArrow(run, "src binary, dst binary"), "links")


def _alike(least: float) -> Column:
    """No pair of other sizes can be similar enough."""
    return F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n") - _SLACK


def _bucket_pairs(labelled: DataFrame, least: float) -> DataFrame:
    """Pairs of texts of different labels in a bucket."""
    x, y = labelled.alias("x"), labelled.alias("y")
    found = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") < F.col("y.label")) & _alike(least))
    return found.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def _hub_pairs(labelled: DataFrame, least: float, seed: float) -> DataFrame:
    """Pairs of a bucket's hub, which ``seed`` picks, and its texts of other labels."""
    hub = F.min(F.struct(F.xxhash64("key", F.lit(seed)).alias("h"), "key", "n", "label")).alias("y")
    x, y = labelled.alias("x"), labelled.groupBy("bucket").agg(hub).select("bucket", "y.*").alias("y")
    found = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label")) & _alike(least))
    return found.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def _tokens(texts: DataFrame, width: int) -> DataFrame:
    """(key, n, label, token): a row for each different shingle of ``texts`` (key, n, label, text), as its XXH64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                tokens = np.array([xxhash.xxh64_intdigest(g, 42) for g in shingles(one.column("text")[0].as_py(), width)], np.uint64).view(np.int64)
                for lo in range(0, len(tokens), 65536):
                    part = pa.array(tokens[lo : lo + 65536])
                    same = pa.array(np.zeros(len(part), np.int32))
                    yield pa.RecordBatch.from_arrays([*(one.column(c).take(same) for c in ("key", "n", "label")), part], names=["key", "n", "label", "token"])

    return texts.select("key", "n", "label", "text").mapInArrow(run, "key binary, n int, label binary, token long")


def rare_shingle_pairs(texts: DataFrame, least: float, width: int) -> DataFrame:
    """Pairs (a, b) of ``texts`` (key, n, label, text) of different labels: all of that similarity, and few others.

    Shingles are ordered by how many texts have them. A pair is found by its first common shingle, whose place in either
    text leaves room for as many common ones as the similarity takes; later ones need not be looked at.
    """
    tokens = written(_tokens(texts, width), "tokens")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("texts"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    order = Window.partitionBy("key").orderBy("texts", "token")
    placed = tokens.join(counts, "token").withColumn("place", F.row_number().over(order) - 1)
    # Shingles that one label has alone join nothing, but they take their places.
    prefix = placed.filter((F.col("place") <= F.col("n") - F.ceil(least * F.col("n") - _SLACK)) & (F.col("lo") < F.col("hi")))
    prefix = written(prefix.select("token", "key", "n", "label", "place"), "prefixes")
    x, y = prefix.alias("x"), prefix.alias("y")
    smaller = F.struct("x.n", "x.key") < F.struct("y.n", "y.key")
    size = F.col("x.n") >= least * F.col("y.n") - _SLACK
    common = F.ceil(least / (1 + least) * (F.col("x.n") + F.col("y.n")) - _SLACK)
    room = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= common
    found = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & smaller & size & room)
    return found.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def _buckets(df: DataFrame, signatures: DataFrame, text_col: str, width: int) -> DataFrame:
    """(bucket, key, n): the buckets that several rows have. A text travels as a hash of its key until most buckets are gone."""
    short = F.xxhash64("key").alias("short")
    banded = signatures.select(F.explode("bands").alias("bucket"), short)
    texts = df.select(text_or_empty(df, text_col).alias("text")).select(F.sha2("text", 256).alias("key"), "text")
    golay = near_duplicates(texts, "key", "text", width).select(F.xxhash64(F.lit("simhash"), "component_id").alias("bucket"), F.unhex("doc_id").alias("key")).distinct()
    members = banded.union(golay.select("bucket", short))
    several = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("bucket")
    members = members.join(several, "bucket", "left_semi").distinct()
    # Keys of one hash would all be members: candidates more, none less.
    return written(members.join(signatures.select(short, "key", "n").distinct(), "short").select("bucket", "key", "n"), "buckets")


def near_copies(df: DataFrame, text_col: str = "text", least: float = 0.8, width: int = 5) -> DataFrame:
    """(text_sha256, component): every text that is linked to another, and the smallest digest reachable over links.

    Texts are told apart by the SHA-256 digest of what they are, null counting as empty. Texts without words are alike.
    """
    signatures = written(_signatures(df, text_col, width), "signatures")
    rows = _texts(df, text_col)
    labelled = _buckets(df, signatures, text_col, width).withColumn("label", F.col("key"))
    members = written(labelled.select("key").distinct(), "members")
    known = written(join_small(signatures.select("key", "n", "parities"), members, ["key"], "left_semi").dropDuplicates(["key"]), "known")
    links, before = None, float("inf")
    while True:
        by_label = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
        live = by_label.filter("s * s > q").select("bucket", (F.expr("s * s - q") > 2 * PAIRS_PER_ROW * F.col("s")).alias("large"), ((F.col("s").cast("double") * F.col("s") - F.col("q")) / 2).alias("pairs"))
        left = live.agg(F.sum("pairs")).first()[0]
        if not left:
            break
        labelled = written(labelled.join(live.select("bucket", "large"), "bucket"), "live")
        last = left > before / 2
        before = left
        if last:
            found = _bucket_pairs(labelled.filter("not large"), least)
            large = labelled.filter("large").select("key", "n", "label").distinct()
            texts = _texts_of(rows, large.select("key"), "large").join(large, "key")
            found = found.union(rare_shingle_pairs(texts, least, width)).distinct()
        else:
            found = _hub_pairs(labelled, least, before)
        more = _verified(found, rows, known, least, width)
        links = more if links is None else links.union(more)
        if last:
            break
        labels = min_label_components(links, stored=True)
        # What is joined so far goes on as one edge for each text, to the least of its component.
        links = labels.filter("node != label").select(F.col("node").alias("src"), F.col("label").alias("dst"))
        labelled = labelled.drop("label", "large").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key")).select("bucket", "key", "n", "label")
    if links is None:
        return df.sparkSession.createDataFrame([], "text_sha256 string, component string")
    labels = min_label_components(links, stored=True)
    return labels.select(F.lower(F.hex("node")).alias("text_sha256"), F.lower(F.hex("label")).alias("component"))
