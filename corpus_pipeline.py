"""A training corpus from ``documents``: toxicity, exact dedup, near-dedup, mixing, encoding.

Every stage takes what its predecessor kept and gives a table that is written and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.llm import bpe, exact_dedup, mixing, near_copies, toxicity
from wickwork.llm.queries import MIX_WEIGHTS, mix_tree
from wickwork.llm.shared import bound_batches, fresh, join_small, scratch_path, text_or_empty, written


def _one_of_each(docs: DataFrame, digest: Column, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each group; rows are known by ``digest``.

    ``groups`` has (digest, keep_id, keep_digest) once for every digest in a group of several rows. Rows without an entry stay;
    a group keeps the longest of its rows of that id, null or not, and digest.
    """
    groups = written(groups, "groups")
    # The columns of ``docs`` are one struct, whatever their names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest.alias("digest"))
    stay = join_small(rows, groups.select("digest"), ["digest"], "left_anti").select("row.*")
    chosen = join_small(rows, written(groups.filter("digest = keep_digest").select("digest", "keep_id"), "chosen"), ["digest"], "inner")
    chosen = chosen.filter(F.col("row.doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.max_by("row", F.struct(F.length("row.text"), F.col("row.text"))).alias("row"))
    return stay.unionByName(chosen.select("row.*"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't reject.

    Null texts count as empty and stay; repeated rows are judged alike; very long texts are scored whole; without labels of
    both kinds, or without rows, all stay.
    """
    bound_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "toxicity")
    return toxicity.with_score(docs, model, score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space, null ids included.

    Null texts count as empty; very long ones are compared chunk by chunk; an empty table stays empty.
    """
    bound_batches(spark)
    groups = exact_dedup.exact_groups(docs).filter("group_size > 1").groupBy("text_sha256").agg(F.first("keep_id").alias("keep_id"))
    digest = F.sha2(F.regexp_replace(text_or_empty(docs), r"[\x20\x09-\x0D]+", ""), 256)
    return _one_of_each(docs, digest, groups.select(F.col("text_sha256").alias("digest"), "keep_id", F.col("text_sha256").alias("keep_digest")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a five-word Jaccard similarity of 0.8, the row with the smallest id, null last.

    Candidates are links of SimHash fingerprints, found by their Golay keys, and of MinHash bands; every link is verified.

    Null and empty texts, and texts without words, are one group; of repeated rows one stays; very long texts are compared
    with all their shingles; an empty table stays empty.
    """
    bound_batches(spark)
    digest = F.sha2(text_or_empty(docs), 256)
    linked = written(near_copies.near_copies(docs), "near")
    rows = join_small(docs.select("doc_id", digest.alias("text_sha256")), linked, ["text_sha256"], "left")
    rows = written(rows.select("doc_id", "text_sha256", F.coalesce("component", "text_sha256").alias("component")), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"))).alias("f")
    first = rows.groupBy("component").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = rows.select("text_sha256", "component").distinct().join(first, "component")
    return _one_of_each(docs, digest, groups.select(F.col("text_sha256").alias("digest"), F.col("f.id").alias("keep_id"), F.col("f.digest").alias("keep_digest")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """At most one epoch of each source, nine tenths of all tokens, towards the target weights.

    Null sources and languages are a leaf of their own; repeated rows of an id go or stay together; very long texts count
    with all their tokens, so that a prefix ends at most one text beyond its budget; an empty table stays empty.
    """
    copies = fresh(docs, "copies")
    return mixing.copies(docs, mix_tree(), MIX_WEIGHTS, budget_percent=90, max_epochs=1, seed=17, name=copies).filter(F.col(copies) > 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, how many they are, and digests of them and of what they decode to, a row for each row.

    Null texts count as empty; very long ones are encoded whole; an empty table gives no rows.
    """
    bound_batches(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, batch_bytes=1 << 20)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("byte_bpe", encode),
]

#: The classifier and the fingerprints have no SQL form; tests hold the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
