"""Document fingerprints by Order MinHash, in DataFrame operations only.

A text is a sequence of word k-mers, each numbered by how often it has occurred before, so repeats count. For each of
``rows`` permutations the ``length`` smallest numbered k-mers are chosen, put back into text order and hashed together.
Two texts agree in a row if they share those k-mers in the same order, which becomes the less likely the more edits
lie between them, moves included. Everything happens within a row of the table: nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import text_or_empty, written

#: Words of a k-mer, rows of a fingerprint, k-mers of a row.
WORDS, ROWS, LENGTH = 3, 32, 2
#: K-mers near a row's anchor that are looked at first, on average.
NEAR = 6
#: Low bits that hold a k-mer's place in the text, and bits of its hash. A text of 2**27 k-mers has at least 268 MB and
#: takes arrays of gigabytes; Spark holds no row with many more, and a longer one is an error.
PLACE_BITS, HASH_BITS = 27, 36


def _anchors(rows: int) -> list[int]:
    """A number of HASH_BITS bits for each permutation: its own top bits, then multiples of the golden ratio.

    The permutation of a hash is its exclusive or with the anchor, so a row's smallest k-mers are those whose hashes
    share most leading bits with its anchor.
    """
    if rows & (rows - 1):
        raise ValueError("rows is a power of two")
    low = HASH_BITS - (rows.bit_length() - 1)
    return [j << low | (j * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64) >> (64 - low) for j in range(rows)]


def numbered_kmers(text: Column, k: int) -> Column:
    """An array of longs: HASH_BITS bits of the hash of each occurrence-numbered k-mer, then its place in the text.

    Fewer than ``k`` words are one k-mer; no word is none. Sorting (hash, place) puts the occurrences of a k-mer in a row,
    in text order; where a row begins is known from its neighbour, so numbering takes one pass.
    """
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    low = (1 << PLACE_BITS) - 1

    def packed(h: Column, place: Column) -> Column:
        return F.shiftleft(F.shiftrightunsigned(h, 64 - HASH_BITS), PLACE_BITS).bitwiseOR(place.cast("long"))

    def kmers(ws: Column) -> Column:
        n = F.size(ws)
        full = F.transform(F.sequence(F.lit(0), n - k), lambda i: packed(F.xxhash64(*[ws[i + j] for j in range(k)]), i))
        full = F.when(n - k < 1 << PLACE_BITS, full).otherwise(F.raise_error(F.lit(f"a text has more than 2**{PLACE_BITS} k-mers")).cast("array<bigint>"))
        return F.when(n >= k, full).when(n > 0, F.array(packed(F.xxhash64(ws), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))

    def number(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.shiftright(x, PLACE_BITS) != F.shiftright(F.get(s, i - 1), PLACE_BITS)), i)), lambda i: i.isNotNull())

        def again(x: Column, occurrence: Column) -> Column:
            return packed(F.xxhash64(F.shiftright(x, PLACE_BITS), occurrence), x.bitwiseAND(low))

        def runs(starts: Column) -> Column:
            return F.flatten(F.transform(starts, lambda at, j: F.transform(F.slice(s, at + 1, F.coalesce(F.get(starts, j + 1), F.size(s)) - at), again)))

        # Most texts repeat few k-mers: without any, the numbers are all 0.
        return _let(begins, lambda starts: F.when(F.size(starts) == F.size(s), F.transform(s, lambda x: again(x, F.lit(0)))).otherwise(runs(starts)))

    return _let(words, lambda ws: _let(F.sort_array(kmers(ws)), number))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def sketch(numbered: Column, rows: int, length: int) -> Column:
    """The fingerprint of an array of numbered k-mers: a long for each row; 0s if the text has no word.

    Rows have different top bits, so a row's smallest k-mers nearly always share its top bits and are near its anchor.
    One pass picks what is near the anchor of its own top bits, NEAR k-mers a row on average; a row that finds fewer
    than ``length`` there looks at all k-mers, so the result is that of the plain definition.
    """
    low, top = (1 << PLACE_BITS) - 1, HASH_BITS - (rows.bit_length() - 1)
    anchors = [a << PLACE_BITS for a in _anchors(rows)]
    table = F.array(*map(F.lit, anchors))

    def row(values: Column, near: Column, anchor: Column, no: Column) -> Column:
        own = F.filter(near, lambda v: F.shiftright(v, top + PLACE_BITS) == no)
        keyed = _let(own, lambda found: F.transform(F.when(F.size(found) >= length, found).otherwise(values), lambda v: v.bitwiseXOR(anchor)))
        least = _let(keyed, lambda keys: _smallest(keys, [], length))
        by_place = F.sort_array(F.transform(least, lambda v: F.struct(v.bitwiseAND(low).alias("p"), F.shiftrightunsigned(v, PLACE_BITS).alias("h"))))
        return F.xxhash64(F.transform(by_place, lambda x: x.h), no)

    def all_rows(values: Column) -> Column:
        reach = F.floor(F.lit(float(1 << (top + PLACE_BITS))) * (NEAR * rows) / F.greatest(F.size(values), F.lit(1)))
        near = F.filter(values, lambda v: v.bitwiseXOR(F.get(table, F.shiftright(v, top + PLACE_BITS).cast("int"))) < reach)
        found = _let(near, lambda picked: F.transform(table, lambda anchor, no: row(values, picked, anchor, no)))
        return F.when(F.size(values) > 0, found).otherwise(F.array_repeat(F.lit(0).cast("long"), rows))

    return _let(numbered, all_rows)


def _smallest(keys: Column, found: list[Column], more: int) -> Column:
    """``found`` and the next ``more`` smallest of different keys, as far as there are any."""
    if not more:
        return F.array_compact(F.array(*found))
    rest = F.filter(keys, lambda v: v > found[-1]) if found else keys
    return _let(F.array_min(rest), lambda x: _smallest(keys, [*found, x], more - 1))


def likeness(a: Column, b: Column) -> Column:
    """The share of rows in which two fingerprints agree."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.size(same)


def fingerprint(text: Column, k: int = WORDS, rows: int = ROWS, length: int = LENGTH) -> Column:
    return sketch(numbered_kmers(text, k), rows, length)


def as_hex(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _bounds_above(x: Column, bounds: list[int]) -> Column:
    """How many of ``bounds``, given from the highest down, are above x: looks for the run of bounds, then within it."""
    width = max(1, round(len(bounds) ** 0.5))
    runs = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    above = lambda values: F.size(F.filter(values, lambda b: b > x))
    # Runs whose highest bound is above x: all but the last of them lie above x as a whole.
    found = above(F.lit([r[0] for r in runs]))
    return F.when(found == 0, 0).otherwise((found - 1) * width + above(F.get(F.lit(runs), found - 1)))


def with_next(rows: DataFrame, per_part: int = 2000) -> DataFrame:
    """``rows`` (doc_id, text) in descending order of doc_id: adds the text of the next row, after the last the first.

    Ids are cut into parts of about ``per_part`` rows at approximate quantiles. Each part also gets the first row of
    the part behind it as a guest, so the next row is always at hand, and texts are shuffled once. Rows of one id
    follow each other in the order of their texts; null ids come last.
    """
    spark = rows.sparkSession
    n, low = rows.agg(F.count(F.lit(1)), F.min("doc_id")).first()
    parts = max(1, min(10_000, -(-n // per_part)))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or [low or 0]
    part = _bounds_above(F.coalesce("doc_id", F.lit(-(1 << 63))), sorted(set(cuts), reverse=True))
    rows = rows.withColumn("part", part)
    ids = rows.groupBy("part").agg(F.max("doc_id").alias("doc_id"))
    heads = written(ids, "heads")
    first = heads.agg(F.min("part")).first()[0]
    # One row for each part: few rows, however many texts there are.
    behind = heads.withColumn("host", F.coalesce(F.lag("part").over(Window.orderBy("part")), F.lit(heads.agg(F.max("part")).first()[0]))).withColumn("last", F.col("part") == F.lit(first))
    guests = rows.join(F.broadcast(behind.withColumnRenamed("doc_id", "head")), "part").filter(F.col("doc_id").eqNullSafe(F.col("head")))
    guests = guests.groupBy("host", "doc_id", "last").agg(F.min("text").alias("text"))
    both = rows.select("part", "doc_id", "text", F.lit(False).alias("guest")).unionByName(guests.select(F.col("host").alias("part"), "doc_id", "text", F.lit(True).alias("guest")))
    order = Window.partitionBy("part").orderBy(F.col("guest"), F.col("doc_id").desc_nulls_last(), "text")
    return both.withColumn("next_text", F.lead("text").over(order)), order


def edited_and_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, rows: int = ROWS, length: int = LENGTH) -> DataFrame:
    """Each text's fingerprint, that of an edited text, and their likeness; also the likeness to the next text.

    doc_id, n_chars (code points), edited_sha256, fingerprint and edited_fingerprint (16 hex digits for each row),
    near_edited, near_next. The edited text has the last floor(n_chars / 2) code points replaced by the first as many,
    or all, of the next text in descending order of doc_id; the last row's next is the first. Null texts count as empty;
    texts without words have a fingerprint of zeros, like one another. Repeated rows follow each other. A single row is
    its own next. An empty table gives no rows; other columns are not read. Ids of another type than whole numbers and texts
    of more than 2**PLACE_BITS k-mers raise an error.
    """
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError("ids are whole numbers: their order is cut into parts at quantiles")
    table = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(df, text_col).alias("text"))
    both, order = with_next(table)
    n = F.length("text")
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substring("next_text", F.lit(1), F.floor(n / 2).cast("int"))))
    both = both.select("part", "doc_id", "guest", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text"), k, rows, length).alias("fp"), F.when(~F.col("guest"), fingerprint(F.col("edited"), k, rows, length)).alias("edited_fp"))
    both = both.withColumn("next_fp", F.lead("fp").over(order)).filter(~F.col("guest"))
    return both.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
