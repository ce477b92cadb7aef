"""How the sources of a language differ in their terms: byte tries with a counter for each source, merged by ranges.

Every task counts the terms of its documents into a radix trie over their UTF-8 bytes; a leaf holds how many documents
have its term and how often each source has it. The trie is walked in the order of its bytes and travels as its leaves in
that order. Ranges of terms are merged from these sorted walks: leaves of one term are added up, and what is complete is
given out before the next term is looked at, so no range holds more than one leaf and the batch at hand. The merged leaves
of the kept terms are read twice: for the sums of each source, and for the pairs of sources and the candidates of each.
"""

from __future__ import annotations

import gc
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_small, partitions, written

#: Terms of a task's counters (a term counts once for each source) at which they are made a trie and given out.
TRIE_LEAVES = 3 << 18
#: Bytes of a text that are split into terms at a time.
PIECE = 1 << 20
#: Scale of the shares, and what every count is raised by. Fixed values of the audit.
SCALE, RAISED = 1_000_000_000, 2
#: A-Z in lower case, other bytes below 128 that are no letters as spaces, all else as it is.
_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

LEAF = "lang string, term binary, docs long, sources array<int>, counts array<long>"


class Trie:
    """A radix trie over bytes. A node has edges by first byte, each with its label and the node below, and maybe a leaf."""

    __slots__ = ("edges", "leaf")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Trie]] | None = None
        self.leaf: list[int] | None = None

    def at(self, term: bytes) -> list[int]:
        """The leaf of ``term``, made if there is none: documents, then a source and its count, again and again."""
        node, rest = self, term
        while rest:
            edges = node.edges
            if edges is None:
                edges = node.edges = {}
            edge = edges.get(rest[0])
            if edge is None:
                node = Trie()
                edges[rest[0]] = (rest, node)
                break
            label, below = edge
            if rest.startswith(label):
                node, rest = below, rest[len(label) :]
                continue
            same = 1
            while same < len(rest) and label[same] == rest[same]:
                same += 1
            node = Trie()
            node.edges = {label[same]: (label[same:], below)}
            edges[rest[0]] = (label[:same], node)
            rest = rest[same:]
        if node.leaf is None:
            node.leaf = [0]
        return node.leaf

    def walk(self) -> Iterator[tuple[bytes, list[int]]]:
        """(term, leaf) in the order of the bytes."""
        todo = [(b"", self)]
        while todo:
            path, node = todo.pop()
            if node.leaf is not None:
                yield path, node.leaf
            if node.edges:
                for first in sorted(node.edges, reverse=True):
                    label, below = node.edges[first]
                    todo.append((path + label, below))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        piece = text[at:end].translate(_TERMS)
        if end < len(text):
            # Go on to the end of the term that the piece ends in.
            while end < len(text) and _TERMS[text[end]] != 32:
                step = text[end : end + 4096].translate(_TERMS)
                cut = step.find(b" ")
                piece += step if cut < 0 else step[:cut]
                end += len(step) if cut < 0 else cut
        yield piece.split()
        at = end


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, dict[int, Counter]] = {}
    docs: dict[str, Counter] = {}

    def pour() -> Iterator[pa.RecordBatch]:
        # Nodes form no cycles, and looking for some among them takes a third of the time.
        gc.disable()
        for lang in sorted(counts):
            trie, leaves = Trie(), {}
            for source, terms in counts[lang].items():
                for term, n in terms.items():
                    leaf = leaves.get(term)
                    if leaf is None:
                        leaf = leaves[term] = trie.at(term)
                    leaf += (source, n)
            for term, n in docs[lang].items():
                leaves[term][0] = n
            rows: list[tuple[bytes, list]] = []
            for row in trie.walk():
                rows.append(row)
                if len(rows) == 4096:
                    yield _leaves(lang, rows)
                    rows = []
            if rows:
                yield _leaves(lang, rows)
        counts.clear()
        docs.clear()
        gc.enable()

    for b in batches:
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
            own = counts.setdefault(lang, {}).setdefault(source, Counter())
            here: set[bytes] = set()
            for terms in terms_of(text.as_py()):
                own.update(terms)
                here.update(terms)
            docs.setdefault(lang, Counter()).update(here)
        if sum(len(c) for of in counts.values() for c in of.values()) >= TRIE_LEAVES:
            yield from pour()
    yield from pour()


def _leaves(lang: str, rows: list[tuple[bytes, list]]) -> pa.RecordBatch:
    terms, leaves = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(rows)), pa.array(terms, pa.binary()), pa.array([x[0] for x in leaves], pa.int64()), pa.array([x[1::2] for x in leaves], pa.list_(pa.int32())), pa.array([x[2::2] for x in leaves], pa.list_(pa.int64()))],
        names=["lang", "term", "docs", "sources", "counts"],
    )


def _merged(least: int):
    """Add up the leaves of each term in sorted batches; terms of fewer than ``least`` documents go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, term, docs, counts = None, None, 0, Counter()

        def complete() -> list[tuple[bytes, list]]:
            return [(term, [docs, *itertools.chain.from_iterable(sorted(counts.items()))])] if term is not None and docs >= least else []

        for b in batches:
            if not b.num_rows:
                continue
            langs, terms, n = b.column("lang"), b.column("term"), b.num_rows
            new = np.ones(n, bool)
            if n > 1:
                new[1:] = pc.or_(pc.not_equal(terms[1:], terms[:-1]), pc.not_equal(langs[1:], langs[:-1])).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            sums = np.add.reduceat(b.column("docs").to_numpy(), starts)
            ends = [*starts[1:].tolist(), n]
            offsets, sources, amounts = b.column("sources").offsets.to_numpy(), b.column("sources").values.to_numpy(), b.column("counts").values.to_numpy()
            out: dict[str, list] = {}
            for k, (lo, hi) in enumerate(zip(starts.tolist(), ends, strict=True)):
                last = k == len(starts) - 1
                # Between the first run, which may go on from the batch before, and the last, which may go on in the next, rare terms are passed by.
                if not last and k and sums[k] < least:
                    continue
                here = (langs[lo].as_py(), terms[lo].as_py())
                if here != (lang, term):
                    if got := complete():
                        out.setdefault(lang, []).extend(got)
                    (lang, term), docs, counts = here, 0, Counter()
                docs += int(sums[k])
                for s, a in zip(sources[offsets[lo] : offsets[hi]].tolist(), amounts[offsets[lo] : offsets[hi]].tolist(), strict=True):
                    counts[s] += a
            for name, rows in out.items():
                yield _leaves(name, rows)
        if got := complete():
            yield _leaves(lang, got)

    return run


def share(count: np.ndarray, total, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + RAISED) / (total + RAISED * terms)), exactly."""
    bottom = total + RAISED * terms
    if (int(count.max(initial=0)) + RAISED) * SCALE < 2**62 and int(np.max(bottom)) < 2**62:
        return 1 + SCALE * (count.astype(np.int64) + RAISED) // bottom
    return 1 + SCALE * (count.astype(object) + RAISED) // bottom


def parts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)), exactly: shares are at most SCALE + 1, so squares fit."""
    d = (p - q).astype(np.int64)
    return d * d // (p + q).astype(np.int64)


PART = "lang string, source int, other int, term binary, value long"


def _audit(ranks: int):
    """Partial sums of each pair of sources (other, with source < other), and the best terms of each source (other null)."""

    def best(old: list, terms: list[bytes], values: np.ndarray) -> list:
        """The greatest values of both, ties by term; whatever order the terms come in."""
        least = old[-1][0] if len(old) == ranks else None
        if len(values) > ranks:
            cut = -int(np.partition(values, len(values) - ranks)[len(values) - ranks])
            least = cut if least is None else min(least, cut)
        new = [(-v, terms[k]) for k, v in enumerate(values.tolist()) if least is None or -v <= least]
        return sorted(old + new)[:ranks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        pairs: dict[str, np.ndarray] = {}
        tops: dict[tuple[str, int], list] = {}
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                rows = pa.Table.from_batches([b]).filter(pa.array(langs == lang))
                if lang not in known:
                    ids, totals = np.array(rows.column("ids")[0].as_py(), np.int64), np.array(rows.column("totals")[0].as_py(), np.int64)
                    order = np.argsort(ids)
                    known[lang] = ids[order], totals[order], rows.column("kept")[0].as_py()
                ids, totals, v = known[lang]
                lists = rows.column("counts").combine_chunks()
                sizes = np.diff(lists.offsets.to_numpy())
                line = np.repeat(np.arange(len(sizes)), sizes)
                at = np.searchsorted(ids, rows.column("sources").combine_chunks().flatten().to_numpy())
                count = np.zeros((len(sizes), len(ids)), np.int64)
                count[line, at] = lists.flatten().to_numpy()
                p = share(count, totals[None, :], v)
                q = share(count.sum(1), int(totals.sum()), v)
                sums = pairs.setdefault(lang, np.zeros((len(ids), len(ids)), np.int64))
                for s in range(len(ids) - 1):
                    sums[s, s + 1 :] += parts(p[:, s, None], p[:, s + 1 :]).sum(0)
                terms = rows.column("term").to_pylist()
                values = parts(p, q[:, None])
                above = (count > 0) & (p > q[:, None])
                for s in range(len(ids)):
                    there = np.flatnonzero(above[:, s])
                    if len(there):
                        tops[lang, s] = best(tops.get((lang, s), []), [terms[k] for k in there.tolist()], values[there, s])
        for lang, sums in pairs.items():
            ids = known[lang][0]
            a, c = np.triu_indices(len(ids), 1)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(ids[a], pa.int32()), pa.array(ids[c], pa.int32()), pa.nulls(len(a), pa.binary()), pa.array(sums[a, c], pa.int64())], names=[c.split()[0] for c in PART.split(", ")])
        for (lang, s), rows in tops.items():
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([int(known[lang][0][s])] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.array([t for _, t in rows], pa.binary()), pa.array([-v for v, _ in rows], pa.int64())], names=[c.split()[0] for c in PART.split(", ")])

    return run


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, ranks: int = 10) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source of a language is from the others, and by which terms.

    Part ``pair`` has a row for each other source of the language, part ``term`` the ``ranks`` terms that the source uses
    most above the language's share. Terms are runs of letters A-Z, in lower case, and of anything beyond ASCII; those in
    at least ``least_docs`` documents of the language count. Shares and divergences are whole numbers, computed exactly.

    Null texts, languages and sources count as empty. A source without terms has its pairs, and a language without kept
    terms has pairs of 0; a language of one source has no pairs. Repeated rows are documents of their own. Texts are split
    piece by piece. An empty table gives no rows; other columns are not read, so their names can't clash.
    """
    col = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = df.select(col(lang_col).alias("lang"), col(source_col).alias("name"), col(text_col).cast("binary").alias("text"))
    # The sources of a language by number; a row for each, however many documents it has.
    groups = docs.select("lang", "name").distinct().withColumn("source", F.row_number().over(Window.partitionBy("lang").orderBy("name")))
    groups = written(groups, "sources")
    numbered = join_small(docs, groups, ["lang", "name"], "inner").select("lang", "source", "text")
    walks = written(numbered.mapInArrow(_tries, LEAF), "walks")
    order = ["lang", "term"]
    ranged = walks.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    kept = written(ranged.mapInArrow(_merged(least_docs), LEAF), "terms")
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    totals = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    by_lang = totals.groupBy("lang").agg(F.collect_list(F.struct("source", "total")).alias("t"))
    by_lang = by_lang.select("lang", F.expr("transform(t, x -> x.source)").alias("ids"), F.expr("transform(t, x -> x.total)").alias("totals")).join(terms, "lang")
    by_lang = written(by_lang, "totals")
    found = written(join_small(kept, by_lang, ["lang"], "inner").mapInArrow(_audit(ranks), PART), "divergences")
    name = lambda which: groups.select("lang", F.col("source").alias(which), F.col("name").alias(f"{which}_name"))
    sums = found.filter("other IS NOT NULL").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    # Every pair of a language's sources is a row of the result, with or without terms.
    pairs = name("source").join(name("other"), "lang").filter("source <> other").join(both, ["lang", "source", "other"], "left")
    pairs = pairs.select("lang", F.col("source_name").alias("source"), F.lit("pair").alias("part"), F.col("other_name").alias("item"), F.coalesce("value", F.lit(0)).alias("value"))
    best = join_small(found.filter("other IS NULL"), written(name("source"), "names"), ["lang", "source"], "inner")
    best = best.select("lang", F.col("source_name").alias("source"), F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", ranked).union(best.withColumn("rank", ranked).filter(F.col("rank") <= ranks))
