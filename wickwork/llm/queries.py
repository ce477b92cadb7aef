"""The queries of this subpackage for ``__spark_entry__.py``: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embedding_dedup, exact_dedup, merkle, mixing, order_minhash, pseudo_likelihood, simhash, substring_dedup, token_counts, toxicity, warc
from .shared import bound_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_and_index(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured_at", "url_key", "capture_no")


#: The domains of the sources src0 to src19, five each; any other source is of the domain "other".
DOMAINS = ("web", "news", "books", "forum")
MIX_WEIGHTS = {"domain": {"web": 30, "news": 20, "books": 40, "forum": 10}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}}


def mix_tree() -> dict:
    """Domain, language, source of a document."""
    no = F.expr("try_cast(substring(source, 4) as int)")
    domain = F.when(F.col("source").startswith("src") & (no >= 0) & (no < 20), F.element_at(F.array(*map(F.lit, DOMAINS)), F.floor(no / 5).cast("int") + 1)).otherwise("other")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.approximate_tokens(F.col("text")).alias("n_tokens"))
    out = mixing.copies(docs, mix_tree(), MIX_WEIGHTS, budget_percent=80, max_epochs=3, seed=17, tokens=F.col("n_tokens"))
    return out.select("doc_id", "lang", "source", "n_tokens", F.col("__copies").alias("copies"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of eight words and more, since repeated passages stand in the middle of lines."""
    return substring_dedup.repeated_units(_table(spark, sf_dir, "documents"), pattern=substring_dedup.SENTENCE, min_words=substring_dedup.SENTENCE_WORDS).drop("text_key")


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_substring_dedup is bound by its SQL to units of eight words; this one compares shorter ones too."""
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents")).drop("text_key")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_and_next(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pseudo_likelihood.score(docs, *pseudo_likelihood.train(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(docs, tampered={"text": merkle.lowered(F.col("text"))}, when=third)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_warc, op3_mix_sources, op4_substring_dedup, op4_passage_dedup, op5_simhash_near_dedup, op6_order_minhash, op7_exact_dedup, op8_byte_bpe, op9_pseudo_likelihood, op10_toxicity, op11_merkle_manifest, op12_source_divergence, op13_embedding_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC, "op3_mix_sources": MIX_SOURCES, "op4_substring_dedup": SUBSTRING_DEDUP, "op7_exact_dedup": EXACT_DEDUP, "op11_merkle_manifest": _merkle_sql(), "op12_source_divergence": SOURCE_DIVERGENCE}


EXACT_DEDUP = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER g AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER g = 1 AS kept,
       text_sha256
FROM t
WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""

WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first,
    strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id % 315360000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at, lower(coalesce(url, '')) AS u,
    '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]+)?(.*)$' AS form
  FROM pages
),
keyed AS (
  SELECT *, CASE WHEN regexp_matches(u, form)
    THEN array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(u, form, 1), '^www\.', ''), '.')), ',') || ')' || coalesce(nullif(split_part(regexp_extract(u, form, 2), '#', 1), ''), '/')
    ELSE u END AS url_key FROM p
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (k // 8 * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, captured_at, url_key,
  row_number() OVER (ORDER BY url_key, captured_at, page_id) AS capture_no
FROM keyed
"""
SUBSTRING_DEDUP = r"""
WITH parts AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?]*|[.!?]+|\n')) AS raw, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?]*|[.!?]+|\n'), 1) AS no
  FROM (SELECT DISTINCT doc_id, text FROM documents)
),
placed AS (
  SELECT doc_id, raw, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM parts
),
bare AS (
  SELECT doc_id, pos + length(raw) - length(regexp_replace(raw, '^[\x20\x09-\x0D]+', '')) AS start, pos + length(regexp_replace(raw, '[\x20\x09-\x0D]+$', '')) AS "end",
    trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS unit FROM placed
),
units AS (SELECT doc_id, start, "end", md5(unit) AS unit_md5 FROM bare WHERE length(unit) - length(replace(unit, ' ', '')) >= 7),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY unit_md5) AS copies, first_value(doc_id) OVER r AS keep_doc_id, first_value(start) OVER r AS keep_start, row_number() OVER r AS no
  FROM units WINDOW r AS (PARTITION BY unit_md5 ORDER BY doc_id, start)
)
SELECT doc_id, start::INT AS start, "end"::INT AS "end", unit_md5, copies, keep_doc_id, keep_start::INT AS keep_start FROM ranked WHERE no > 1
"""
_WEIGHT = {
    "domain": "CASE domain WHEN 'web' THEN 30 WHEN 'news' THEN 20 WHEN 'books' THEN 40 WHEN 'forum' THEN 10 ELSE 1 END",
    "lang": "CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 10 ELSE 1 END",
    "source": "1",
}


def _split_sql(level: str, parents: str, above: str) -> str:
    """The CTEs that split the budgets of one level."""
    here = f"{parents}, {level}" if parents else level
    part = f"PARTITION BY {parents}" if parents else ""
    return f"""
{level}_nodes AS (
  SELECT *, capacity / w AS ratio FROM (
    SELECT {here}, sum(tokens)::BIGINT * 3 AS capacity, ({_WEIGHT[level]})::BIGINT AS w FROM leaves GROUP BY {here}
  ) {f"JOIN {above} USING ({parents})" if parents else f"CROSS JOIN {above}"}
),
{level}_levels AS (
  SELECT *, (budget - coalesce(sum(capacity) OVER ({part} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER ({part} ORDER BY ratio, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {level}_nodes
),
{level}_share AS (
  SELECT {here}, CASE WHEN ratio <= level THEN capacity
    ELSE floor(w * max(CASE WHEN ratio > level THEN level END) OVER ({part}))::BIGINT END AS budget FROM {level}_levels
)"""


MIX_SOURCES = f"""
WITH docs AS (
  SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '') AS lang, coalesce(source, '') AS source, (strlen(coalesce(text, '')) + 3) // 4 AS n_tokens,
    CASE WHEN source LIKE 'src%' AND try_cast(substring(source, 4) AS INT) BETWEEN 0 AND 19
      THEN list_extract(['web', 'news', 'books', 'forum'], try_cast(substring(source, 4) AS INT) // 5 + 1) ELSE 'other' END AS domain
  FROM documents
),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
root AS (SELECT floor(coalesce(sum(tokens), 0) * 80 / 100)::BIGINT AS budget FROM leaves),
{_split_sql("domain", "", "root")},
{_split_sql("lang", "domain", "domain_share")},
{_split_sql("source", "domain, lang", "lang_share")},
plan AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
  FROM leaves JOIN source_share USING (domain, lang, source)
),
hashed AS (SELECT docs.*, whole, rest, md5('17:' || whole || ':' || doc_id) AS h FROM docs JOIN plan USING (domain, lang, source)),
cut AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  - sum(n_tokens) OVER (PARTITION BY domain, lang, source, h) AS before FROM hashed)
SELECT doc_id, lang0 AS lang, source0 AS source, n_tokens, (whole + CASE WHEN rest > 0 AND before < rest THEN 1 ELSE 0 END)::INT AS copies FROM cut
"""


def _climb_sql(name: str, src: str, by: str, levels: int) -> str:
    """CTEs that hash runs of eight, level by level: {name}0 is ``src`` (by, i, h), {name}k has the nodes k levels up; a lone node stays as it is."""
    out = [f"{name}0 AS MATERIALIZED (SELECT {by} AS t, i, h, count(*) OVER (PARTITION BY {by}) AS n FROM {src})"]
    for k in range(1, levels + 1):
        out.append(f"{name}{k} AS MATERIALIZED (SELECT t, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(n) + 7) // 8 AS n FROM {name}{k - 1} GROUP BY t, i // 8)")
    return ",\n".join(out)


def _siblings_sql(name: str, k: int, place: str, tree: str) -> str:
    """What stands before and after a node in its run, in the order of the run."""
    same = f"FROM {name}{k} AS s WHERE s.t IS NOT DISTINCT FROM {tree} AND s.i // 8 = ({place}) // 8"
    return f"(SELECT coalesce(string_agg(s.h, '' ORDER BY s.i), '') {same} AND s.i < ({place})) AS a, (SELECT coalesce(string_agg(s.h, '' ORDER BY s.i), '') {same} AND s.i > ({place})) AS z"


def _merkle_sql(levels: int = 7, top: int = 3) -> str:
    """For at most 8^7 documents of a language and 8^3 languages."""
    hashed = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bit = "list_reduce([{x}, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda s, c: {bit.format(x='xor(s, c)')}), 4294967295)"
    steps, last = [], "d"
    for name, count, place, tree in (("l", levels, "i", "lang"), ("r", top, "j", "''")):
        for k in range(count):
            where = f"p.{place} // {8**k}"
            lone = f"(SELECT any_value(n) FROM {name}{k} AS s WHERE s.t IS NOT DISTINCT FROM {'p.lang' if tree == 'lang' else tree}) = 1"
            sides = _siblings_sql(name, k, where, "p.lang" if tree == "lang" else tree)
            steps.append(f"p_{name}{k} AS MATERIALIZED (SELECT * EXCLUDE (a, z, lone), proof || a || z AS proof, CASE WHEN lone THEN now ELSE sha256(a || now || z) END AS now FROM (SELECT p.* EXCLUDE (proof, now), proof, now, {lone} AS lone, {sides} FROM {last} AS p))".replace("* EXCLUDE (a, z, lone), proof ||", "* EXCLUDE (a, z, lone, proof, now), proof ||"))
            last = f"p_{name}{k}"
    return f"""WITH leaves AS MATERIALIZED (SELECT doc_id, lang, {hashed("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {hashed("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
{_climb_sql("l", "(SELECT lang, i, leaf AS h FROM placed)", "lang", levels)},
subs AS MATERIALIZED (SELECT t AS lang, h AS subroot, row_number() OVER (ORDER BY encode(t) NULLS FIRST) - 1 AS j FROM l{levels}),
{_climb_sql("r", "(SELECT '' AS t, j AS i, subroot AS h FROM subs)", "t", top)},
d AS MATERIALIZED (SELECT p.*, subroot, j, '' AS proof, coalesce(changed, leaf) AS now FROM placed AS p JOIN subs AS s ON s.lang IS NOT DISTINCT FROM p.lang),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = root.h AS verified FROM {last}, r{top} AS root"""


SOURCE_DIVERGENCE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS no,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
words AS (SELECT lang, source, no, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT no) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0)::HUGEINT AS c FROM groups AS g JOIN kept AS k USING (lang) LEFT JOIN counts AS c USING (lang, source, term)),
p AS MATERIALIZED (SELECT lang, source, term, c, 1 + 1000000000::HUGEINT * (c + 2) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM grid JOIN v USING (lang)),
q AS MATERIALIZED (SELECT lang, term, 1 + 1000000000::HUGEINT * (c + 2) // (sum(c) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM counts GROUP BY ALL) JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p AS a JOIN p AS b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups AS a JOIN groups AS b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sums AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
best AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' FROM best))
WHERE part = 'pair' OR rank <= 10
"""
