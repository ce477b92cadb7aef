"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four segments of 16 bits. Of at most three differing bits one segment has none,
and of any two others one has at most one. So each fingerprint is looked up under (an exact segment, the Golay
codeword next to another segment) and is stored under (the exact segment, each of up to six codewords near the
other): two linked fingerprints always meet. Candidates are verified inside the join, so only links leave it.
Equal fingerprints are one class before anything is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .components import min_label_components
from .shared import join_small, text_or_empty, written

SEGMENTS, BITS = 4, 16
#: (exact segment, decoded segment): any two of the three others will do.
PAIRS = tuple((i, (i + k) % SEGMENTS) for i in range(SEGMENTS) for k in (1, 2))


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """SimHash of the shingles of ``width`` words; 0 where there is no word.

    Words are runs of anything but ASCII white space, A-Z in lower case. Fewer than ``width`` words are one shingle.
    A bit is 1 if it is set in more than half of the shingles' XXH64 values, repeats included.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(flat, seed)
    hashes = [digest(flat[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 4096):
        part = np.array(hashes[lo : lo + 4096], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(df, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [(u >> np.uint64(BITS * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(SEGMENTS)]


def _key(pair: int, exact: np.ndarray, index: np.ndarray) -> np.ndarray:
    return (pair << (BITS + golay.DIMENSION)) | (exact << golay.DIMENSION) | index.astype(np.int64)


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nearest, _ = golay.keys(BITS)
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        seg = _segments(fp)
        for p, (i, j) in enumerate(PAIRS):
            yield pa.RecordBatch.from_arrays([pa.array(_key(p, seg[i], nearest[seg[j]])), pa.array(fp)], names=["key", "a"])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, near = golay.keys(BITS)
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        seg = _segments(fp)
        for p, (i, j) in enumerate(PAIRS):
            row, place = np.nonzero(near[seg[j]] >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(_key(p, seg[i][row], near[seg[j][row], place])), pa.array(fp[row])], names=["key", "b"])


def links(classes: DataFrame, most: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints in ``classes.fp`` that differ in at most ``most`` <= 3 bits."""
    if not 0 <= most <= 3:
        raise ValueError("the segments' pigeonhole holds for at most 3 differing bits")
    fp = classes.select("fp")
    probes, stored = fp.mapInArrow(_probes, "key long, a long"), fp.mapInArrow(_stored, "key long, b long")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    return probes.alias("p").join(stored.alias("s"), (F.col("p.key") == F.col("s.key")) & near).select("a", "b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id reachable over links.

    A row for each row of ``df``. Null texts count as empty; texts without words have the fingerprint 0 and are linked
    like any others. Repeated rows, and rows of one id with different texts, are judged by their fingerprints. Rows with a
    null id link others like any row; a component of such rows only has a null component_id. An empty table gives no
    rows; other columns are not read. Very long texts are hashed piece by piece.
    """
    fps = written(fingerprints(df, id_col, text_col, width), "simhash")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    # Nodes are fingerprints: rows that share one are one node, whatever their ids.
    labels = written(min_label_components(links(classes, most).select(F.col("a").alias("src"), F.col("b").alias("dst"))), "labels")
    classes = join_small(classes, labels.withColumnRenamed("node", "fp"), ["fp"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    first = classes.groupBy("label").agg(F.min("rep").alias("component_id"))
    classes = written(classes.join(first, "label").select("fp", "component_id"), "components")
    out = fps.join(classes, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
