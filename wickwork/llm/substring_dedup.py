"""Substring dedup by line or paragraph hashing.

Texts are cut into units, each keeping its offsets in the original text. A normalised unit is known by its digest; of all
units of one digest the earliest ranked stays and the others are removed. The earliest is a grouped minimum, combined
before the shuffle, so a line that half of all texts share weighs no more than another; repeats then find theirs by an
equi-join, which Spark splits where one digest is frequent.

Units are lines by default, or paragraphs, or the sentences of lines, so that a passage set into the middle of another line
is found too. Every unit counts, whatever its length, unless a least number of words is asked for: short sentences
repeat by chance.

Short units say nothing on their own, but a passage may be built of them. ``repeated_passages`` compares every unit,
together with as many of its neighbours as it takes to have enough words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty, written

#: Patterns of a unit: a sentence of a line, a line, a paragraph (lines up to an empty one).
SENTENCE, LINE, PARAGRAPH = r"[^.!?\n]+[.!?]*|[.!?]+", r"[^\n]+", r"[^\n]+(?:\n[^\n]+)*"
#: Words that a sentence, or a run of them, takes to say something; shorter ones, such as "The end.", repeat by chance.
SENTENCE_WORDS = 8


def units_of(text: str, pattern: re.Pattern, min_words: int) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the units that count; offsets in code points, white space at the ends left out."""
    out = []
    for m in pattern.finditer(text):
        raw = m.group().encode().lower()
        words = raw.split()
        if len(words) >= min_words:
            found = m.group()
            start = m.start() + len(found) - len(found.lstrip(" \t\n\r\x0b\x0c"))
            end = m.end() - len(found) + len(found.rstrip(" \t\n\r\x0b\x0c"))
            out.append((start, end, hashlib.md5(b" ".join(words), usedforsecurity=False).digest()))
    return out


def passages_of(text: str, pattern: re.Pattern, min_words: int) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the least runs of adjacent units that have ``min_words`` words, whatever their units' lengths.

    A run begins or ends at every unit that has enough words after or before it, so where a passage repeats, each
    of its units is in a run that repeats. Units of enough words are runs of their own; units without a word are passed over.
    """
    spans = [(start, end, text[start:end].encode().lower().split()) for start, end, _ in units_of(text, pattern, 1)]
    runs, first, total = set(), 0, 0
    for last, (_, _, words) in enumerate(spans):  # the shortest run that ends here
        total += len(words)
        while total - len(spans[first][2]) >= min_words:
            total -= len(spans[first][2])
            first += 1
        if total >= min_words:
            runs.add((first, last))
    last, total = -1, 0
    for first, (_, _, words) in enumerate(spans):  # the shortest run that begins here
        while total < min_words and last + 1 < len(spans):
            last += 1
            total += len(spans[last][2])
        if total < min_words:
            break
        runs.add((first, last))
        total -= len(words)
    digest = lambda a, b: hashlib.md5(b" ".join([w for s in spans[a : b + 1] for w in s[2]]), usedforsecurity=False).digest()
    return [(spans[a][0], spans[b][1], digest(a, b)) for a, b in sorted(runs)]


def units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = LINE, min_words: int = 1, cut: Callable = units_of) -> DataFrame:
    """(doc_id, text_key, start, end, digest): every unit of at least ``min_words`` words, or what else ``cut`` makes of a text.

    Normalised means A-Z in lower case and runs of ASCII white space as one space, none at the ends.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(df, text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    compiled = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                found = [cut(t, compiled, min_words) for t in part.column("text").to_pylist()]
                row = pa.array([i for i, us in enumerate(found) for _ in us], pa.int32())
                flat = [u for us in found for u in us]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), part.column("text_key").take(row), pa.array([u[0] for u in flat], pa.int32()), pa.array([u[1] for u in flat], pa.int32()), pa.array([u[2] for u in flat], pa.binary())], names=["doc_id", "text_key", "start", "end", "digest"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, start int, end int, digest binary")


def repeated_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = LINE, min_words: int = 1) -> DataFrame:
    """The units to remove: doc_id, text_key, start, end (code points of the original text), unit_md5, copies, keep_doc_id, keep_start.

    A text is known by its id and a hash, text_key. Units rank by doc_id, then by place; the first of each digest stays, within one text as well. ``copies`` counts all
    units of the digest. Null texts count as empty and have no units. Rows with a null id rank behind all others.
    Repeated rows of one id and text are one document: what is removed goes from all of them. Rows of one id, or none, with
    other texts are documents of their own. Very long texts are cut whole. An empty table gives no rows; other columns are not read.
    """
    return _repeated(units(df, id_col, text_col, pattern, min_words))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = SENTENCE, min_words: int = SENTENCE_WORDS) -> DataFrame:
    """Like ``repeated_units``, but of runs of adjacent units that have ``min_words`` words together; every unit is compared.

    Spans may overlap. The first place of each unit is never in one: a run over it that repeats an earlier run would
    have the unit at an earlier place.
    """
    return _repeated(units(df, id_col, text_col, pattern, min_words, passages_of))


def _repeated(spans: DataFrame) -> DataFrame:
    found = written(spans, "units")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("text_key").alias("k"))
    first = found.groupBy("digest").agg(F.min(rank).alias("f"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    first = written(first.select("digest", "f", "copies"), "repeated")
    out = found.join(first, "digest").filter(rank != F.col("f"))
    return out.select("doc_id", "text_key", "start", "end", F.lower(F.hex("digest")).alias("unit_md5"), "copies", F.col("f.d").alias("keep_doc_id"), F.col("f.s").alias("keep_start"))


def without_units(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the spans of ``spans`` cut out of its texts; a text's own spans are gathered, at most two for each of its units.

    Columns of ``df`` may have any names; null ids are ids like any other.
    """
    own = spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(own, F.col("id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_key")), "left")
    text = F.col("text")
    # Pieces between spans, which may overlap: from the furthest end so far to the start of the next.
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))
    step = lambda acc, s: F.struct(F.greatest(acc.at, s.end).alias("at"), F.concat(acc.pieces, F.array(F.substring(text, acc.at + 1, F.greatest(s.start - acc.at, F.lit(0))))).alias("pieces"))
    kept = F.aggregate("spans", begin, step, lambda acc: F.concat(F.array_join(acc.pieces, ""), F.substring(text, acc.at + 1, F.length(text))))
    kept = F.when(F.col("spans").isNotNull(), kept).otherwise(text)
    return rows.select(*[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])
