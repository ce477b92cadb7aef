"""Exact dedup by composable polynomial fingerprints.

A text, freed of white space, has the fingerprint ``sum(byte[i] * base**(n-1-i)) mod p`` under two bases. The
fingerprint of two strings in a row is ``H(a) * base**len(b) + H(b)``, so long texts are cut into chunks that
different tasks hash; the chunks' hashes, shifted by the lengths behind them, add up to that of the whole.
Rows of equal fingerprint and length are compared with the first of their group chunk by chunk. A row that differs
from it, which takes a collision, is grouped by its SHA-256 digest instead.

A row is known by its id, its length and the SHA-256 digest of its text without white space, so rows that share an id, or
have none, are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions, small_side, text_or_empty, written

#: The Mersenne prime 2**31 - 1: products of two residues fit 64 bits.
P = (1 << 31) - 1
BASES = (1_000_003, 998_244_353)
#: Bytes that one step of the vectorised hash folds.
BLOCK = 4096
#: Code points of a chunk; a longer text is hashed in several tasks.
CHUNK = 1 << 16
WHITE = r"[\x20\x09-\x0D]+"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    x = 1
    for i in range(n - 1, -1, -1):
        out[i] = x
        x = x * base % P
    return out


_POWERS = tuple(_powers(b, BLOCK) for b in BASES)
_STEP = tuple(pow(b, BLOCK, P) for b in BASES)


def chunk_hash(data: bytes) -> tuple[int, int]:
    """The fingerprint of ``data`` under both bases; (0, 0) for no bytes."""
    if len(data) <= BLOCK:
        a = np.frombuffer(data, np.uint8).astype(np.int64)
        return tuple(int(a @ w[BLOCK - len(a) :]) % P for w in _POWERS)
    head = len(data) % BLOCK
    body = np.frombuffer(data, np.uint8)[head:].reshape(-1, BLOCK).astype(np.int64)
    out = []
    for w, step in zip(_POWERS, _STEP, strict=True):
        h = int(np.frombuffer(data, np.uint8)[:head].astype(np.int64) @ w[BLOCK - head :]) % P
        for x in (body @ w).tolist():
            h = (h * step + x) % P
        out.append(h)
    return tuple(out)


def combined(parts: Column) -> Column:
    """The fingerprint of an array of chunks (no, fp1, shift1, fp2, shift2, n_bytes) in the order of ``no``; shift is base**n_bytes mod P."""
    begin = F.struct(*[F.lit(0).cast("long").alias(x) for x in ("fp1", "fp2", "n_bytes")])

    def step(acc: Column, c: Column) -> Column:
        after = lambda fp, shift: (acc[fp] * c[shift] + c[fp]) % P
        return F.struct(after("fp1", "shift1").alias("fp1"), after("fp2", "shift2").alias("fp2"), (acc.n_bytes + c.n_bytes).alias("n_bytes"))

    return F.aggregate(F.sort_array(parts), begin, step)


def bare_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_chars, sha256, bare): the text without white space, its digest, and the length of the text as it was."""
    text = text_or_empty(df, text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.regexp_replace(text, WHITE, "").alias("bare"))
    return rows.select("doc_id", "n_chars", F.sha2("bare", 256).alias("sha256"), "bare")


def _pieces(chunk: int) -> Column:
    """The text ``bare`` in chunks of ``chunk`` code points: an array of (no, part), of one empty part for an empty text."""
    n = F.greatest(F.ceil(F.length("bare") / chunk), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("no"), F.substring(F.col("bare"), i * chunk + 1, F.lit(chunk)).alias("part")))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per row: doc_id, n_chars, sha256 and, of the text without white space, fp1, fp2, n_bytes.

    Rows of up to ``chunk`` code points are hashed where they are read. Longer ones are cut into chunks that are dealt
    out over the cluster; of these only the hashes, shifts and lengths come together again.
    """
    rows = bare_rows(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for text in batch.column("bare").to_pylist():
                data = text.encode()
                for col, x in zip(out, (*chunk_hash(data), len(data)), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "n_chars", "sha256")], *(pa.array(c, pa.int64()) for c in out)], names=["doc_id", "n_chars", "sha256", "fp1", "fp2", "n_bytes"])

    is_short = F.col("n_chars") <= chunk
    short = rows.filter(is_short).mapInArrow(whole, f"doc_id {kind}, n_chars long, sha256 string, fp1 long, fp2 long, n_bytes long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x.encode() for x in batch.column("part").to_pylist()]
            fps = [chunk_hash(x) for x in data]
            shift = lambda base: pa.array([pow(base, len(x), P) for x in data], pa.int64())  # noqa: B023, E731
            one, two = (pa.array([f[i] for f in fps], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("no"), one, shift(BASES[0]), two, shift(BASES[1]), pa.array(map(len, data), pa.int64())], names=["row", "no", "fp1", "shift1", "fp2", "shift2", "n_bytes"])

    long = written(rows.filter(~is_short).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    parts = long.select("row", F.explode(_pieces(chunk)).alias("p")).select("row", "p.no", "p.part").repartition(partitions(df.sparkSession), "row", "no")
    parts = parts.mapInArrow(hashed, "row long, no int, fp1 long, shift1 long, fp2 long, shift2 long, n_bytes long")
    whole_fp = parts.groupBy("row").agg(combined(F.collect_list(F.struct("no", "fp1", "shift1", "fp2", "shift2", "n_bytes"))).alias("fp"))
    return short.unionByName(long.drop("bare").join(whole_fp, "row").select("doc_id", "n_chars", "sha256", "fp.*"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Groups of texts that are equal once white space is deleted; a row for each row of ``df``.

    doc_id; keep_id, the row of the group that stays: most code points in the original text, then smallest doc_id;
    group_size in rows; kept; text_sha256 of the text without white space. Null texts count as empty, and empty
    texts are one group. Of repeated rows with one id and text exactly one is kept; rows of one id with different texts
    are judged each by its text. Null ids come after all others, so they are kept only where a group has no other id. Very
    long texts are hashed and compared in chunks. An empty table gives no rows. Other columns are not read.
    """
    fps = written(fingerprints(df, id_col, text_col, chunk), "fingerprints")
    key = ["fp1", "fp2", "n_bytes"]
    who = F.struct("doc_id", "n_chars", "sha256")
    # Copies of one row count as one from here on; `copies` remembers how many there were.
    rows = written(fps.groupBy("doc_id", "n_chars", "sha256", *key).agg(F.count(F.lit(1)).alias("copies")), "rows")
    order = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("sha256").alias("d"))
    as_who = F.struct(F.col("lead.c").alias("doc_id"), (-F.col("lead.a")).alias("n_chars"), F.col("lead.d").alias("sha256"))
    leaders = rows.groupBy(*key).agg(F.min(order).alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key, as_who.alias("lead"))

    # Compare what shares a fingerprint, chunk by chunk; only rows of groups of several are read again.
    members = written(rows.join(leaders, key).select(who.alias("who"), "lead"), "members")
    texts = bare_rows(df, id_col, text_col).select(who.alias("who"), "bare")
    again = texts.join(small_side(members), "who")
    is_lead = F.col("who") == F.col("lead")
    lead = again.filter(is_lead).groupBy("lead").agg(F.first("bare").alias("bare")).select("lead", F.explode(_pieces(chunk)).alias("p")).select("lead", "p.no", F.col("p.part").alias("lead_part"))
    own = again.filter(~is_lead).select("who", "lead", F.explode(_pieces(chunk)).alias("p")).select("who", "lead", "p.no", "p.part")
    differs = own.join(lead, ["lead", "no"], "left").filter(F.col("lead_part").isNull() | (F.col("part") != F.col("lead_part"))).select("who").distinct()
    differs = written(differs.withColumn("apart", F.lit(True)), "differs")

    rows = rows.withColumn("who", who)
    rows = rows.join(differs, "who", "left") if differs.limit(1).count() else rows.withColumn("apart", F.lit(False))
    rows = rows.withColumn("own", F.when(F.col("apart"), F.col("sha256")).otherwise(F.lit("")))
    groups = rows.groupBy(*key, "own").agg(F.min(order).alias("lead"), F.sum("copies").alias("group_size")).withColumn("lead", as_who)
    out = rows.join(groups, [*key, "own"])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", F.col("lead.doc_id").alias("keep_id"), "group_size", ((F.col("who") == F.col("lead")) & (F.col("copy") == 1)).alias("kept"), F.col("sha256").alias("text_sha256"))
