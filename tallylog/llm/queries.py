"""The contract queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.llm.decontaminate import decontaminate
from tallylog.llm.exact_dedup import exact_duplicates
from tallylog.llm.language_id import predict_languages
from tallylog.llm.merkle import checked_manifest
from tallylog.llm.mixing import mix_sources
from tallylog.llm.ngram_join import near_duplicate_classes
from tallylog.llm.packing import pack
from tallylog.llm.pii import LOOSE, find_personal_data
from tallylog.llm.quality import score_quality
from tallylog.llm.secrets import find_secrets
from tallylog.llm.token_store import tokenized
from tallylog.llm.warc import archive_pages
from tallylog.llm.whitening import whiten

#: The tokenizer's file; the vocabularies are never part of this repository.
TOKENIZER = os.environ.get("TALLYLOG_TOKENIZER", public_tokenizers.path("byte_bpe_50k.json"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, and the number of links of each."""
    found = near_duplicate_classes(_documents(spark, sf_dir), count_links=True)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, through the content-addressed store."""
    return tokenized(_documents(spark, sf_dir), TOKENIZER)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity posteriors of all documents; documents with ``kept`` false are rejected by either."""
    scored = score_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "evidence", "host_mean", "path_mean", "quality", "toxic_evidence", "toxic", F.col("accepted").alias("kept"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = find_secrets(_documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_spans_text(F.col("base")), 256).alias("base_sha256"), _spans_text(F.col("spans")).alias("spans"), "n_random",
        F.size("spans").cast("long").alias("n_spans"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, through WARC archives."""
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents."""
    return exact_duplicates(_documents(spark, sf_dir))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source."""
    return mix_sources(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return predict_languages(_documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = find_personal_data(_documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(_spans_text(F.col("base")), 256).alias("base_sha256"), _spans_text(F.col("spans")).alias("spans"),
        *[f"n_{kind}" for kind in LOOSE], F.size("spans").cast("long").alias("n_spans"),
    )


def op11_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences along a Hilbert curve."""
    pieces = pack(_documents(spark, sf_dir), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents, held against tampered ones."""
    return checked_manifest(_documents(spark, sf_dir))


def op13_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened along their first four components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_token_store, op3_quality_classifier, op4_secret_scan, op5_warc,
        op6_exact_dedup, op7_decontaminate, op8_mix_sources, op9_language_id, op10_pii,
        op11_curve_packing, op12_merkle_manifest, op13_whiten_embeddings,
    )
}

ORACLE_SQL: dict[str, str] = {}

#: A-Z in lower case, and nothing else.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op6_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

ORACLE_SQL["op7_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1),
    lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, lens WHERE len(w) >= n),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw),
hits AS (SELECT DISTINCT dg.doc_id, iw.item_id, dg.i, dg.n FROM dg JOIN iw ON dg.g = iw.g AND dg.n = iw.n),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits),
nh AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
ni AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    sha256(array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',')) AS s
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh ON d.doc_id = nh.doc_id LEFT JOIN ni ON d.doc_id = ni.doc_id
"""

ORACLE_SQL["op8_mix_sources"] = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0'), 1, 15) AS BIGINT) AS k
  FROM documents),
p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM s GROUP BY source),
f AS (
  SELECT *, 2 * source_size AS cap,
    sum(source_size) OVER () * 150 / 100 - coalesce(sum(2 * source_size) OVER o, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest_weight
  FROM p WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT *, first_value(CASE WHEN weight * rest < cap * rest_weight THEN {'r': rest, 'w': rest_weight} END IGNORE NULLS)
    OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open
  FROM f),
t AS (SELECT source, source_size, CAST(CASE WHEN open IS NULL THEN cap ELSE weight * open.r / open.w END AS DOUBLE) AS target FROM l),
x AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM x)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM y
"""

ORACLE_SQL["op1_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links
FROM s JOIN c ON c.doc_id = s.doc_id LEFT JOIN k ON k.doc_id = s.doc_id
"""

ORACLE_SQL["op5_warc"] = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
d AS (
  SELECT page_id, octet_length(b) AS payload_bytes, b,
    array_to_string(list_transform(range(0, 32),
      lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1)), '') AS payload_digest
  FROM p),
f AS (SELECT b, min(page_id) AS first FROM d GROUP BY b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS verified
FROM d JOIN f ON d.b = f.b
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0})) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "{n}", "text")) + ")"

ORACLE_SQL["op12_merkle_manifest"] = rf"""
WITH RECURSIVE bits AS (
  SELECT CAST(b AS BIGINT) AS b, (WITH RECURSIVE t AS (SELECT 0 AS i, CAST(b AS BIGINT) AS c UNION ALL SELECT i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM t WHERE i < 8)
    SELECT c FROM t WHERE i = 8) AS c FROM range(256) AS r(b)),
crc AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 1 AS i, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, s, i + 1, xor(bits.c, crc.c // 256) FROM crc JOIN bits ON bits.b = xor(crc.c % 256, CAST(ascii(s[i]) AS BIGINT)) WHERE i <= len(s)),
hit AS (SELECT doc_id FROM crc WHERE i = len(s) + 1 AND xor(c, 4294967295) % 7 = 0),
l AS (
  SELECT doc_id, lang, {_LEAF.format(n="CAST(n_chars AS VARCHAR)")} AS leaf,
    {_LEAF.format(n="CAST(n_chars + CASE WHEN doc_id IN (SELECT doc_id FROM hit) THEN 1 ELSE 0 END AS VARCHAR)")} AS now
  FROM documents),
p AS (SELECT *, coalesce('=' || lang, '-') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
n1 AS (
  SELECT 0 AS lv, tree, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p
  UNION ALL
  SELECT lv + 1, tree, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM n1 WHERE n > 1 GROUP BY lv, tree, pos // 2, n),
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM n1 WHERE n = 1),
n2 AS (
  SELECT 0 AS lv, pos, subroot AS h, n FROM sub
  UNION ALL
  SELECT lv + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM n2 WHERE n > 1 GROUP BY lv, pos // 2, n),
steps AS (
  SELECT p.tree, p.pos, n1.lv AS step, n1.h AS sibling, n1.pos % 2 AS side FROM p JOIN n1 ON n1.tree = p.tree AND n1.pos = xor(p.pos // CAST(pow(2, n1.lv) AS BIGINT), 1) WHERE n1.n > 1
  UNION ALL
  SELECT p.tree, p.pos, 1000 + n2.lv, n2.h, n2.pos % 2 FROM p JOIN sub ON sub.tree = p.tree JOIN n2 ON n2.pos = xor(sub.pos // CAST(pow(2, n2.lv) AS BIGINT), 1) WHERE n2.n > 1),
every AS (
  SELECT p.tree, p.pos, x.lv AS step FROM p JOIN (SELECT DISTINCT tree, lv FROM n1 WHERE n > 1) x ON x.tree = p.tree
  UNION ALL SELECT p.tree, p.pos, 1000 + x.lv FROM p, (SELECT DISTINCT lv FROM n2 WHERE n > 1) x),
path AS (
  SELECT tree, pos, list({{'l': CASE WHEN side = 0 THEN sibling ELSE '' END, 'r': CASE WHEN side = 1 THEN sibling ELSE '' END}} ORDER BY step) AS steps
  FROM every LEFT JOIN steps USING (tree, pos, step) GROUP BY tree, pos),
fold AS (
  SELECT p.tree, p.pos, now AS h, 1 AS i, coalesce(steps, []) AS steps FROM p LEFT JOIN path USING (tree, pos)
  UNION ALL
  SELECT tree, pos, sha256(steps[i].l || h || steps[i].r), i + 1, steps FROM fold WHERE i <= len(steps))
SELECT p.doc_id, p.leaf, sub.subroot, r.h AS root, sha256(array_to_string(list_transform(f.steps, lambda s: s.l || s.r), '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM p JOIN sub ON sub.tree = p.tree JOIN (SELECT h FROM n2 WHERE n = 1) r ON true
JOIN fold f ON f.tree = p.tree AND f.pos = p.pos AND f.i = len(f.steps) + 1
"""
