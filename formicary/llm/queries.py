"""The contract queries: each one applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formicary.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formicary.llm.pieces import decode, encode

    model = vocabulary("piece_bpe_32k.model")
    out = decode(encode(_table(spark, sf_dir, "documents"), model), model)
    return out.select("doc_id", F.col("n_chunks").cast("long").alias("n_chunks"), F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formicary.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, similarity=(85, 100))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formicary.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of operator 4: documents that meet in a band of their signatures, with verified Jaccard."""
    from formicary.llm.fingerprints import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formicary.llm.lines import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formicary.llm.quality import judge

    out = judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formicary.llm.language import fit, identify

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return identify(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formicary.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formicary.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: fixed values: the rules of the contract
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formicary.llm.urls import judge_urls

    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules, ["page_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_sentencepiece, op3_minhash_near_dedup, op4_document_fingerprints, fingerprint_groups, op5_line_dedup, op6_license_scan, op7_warc, op8_quality_rules, op9_language_id, op10_url_filter)
}


def _op7_sql() -> str:
    return """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM r"""


def _op10_sql() -> str:
    host = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    ordered = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {host.format(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    blocked = ", ".join(f"'{h}{p}'" for action, h, p in URL_RULES if action == "block")
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {rule} END AS rule FROM b)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({blocked}) THEN 'block' ELSE 'allow' END AS verdict FROM c"""


_LINE_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op5_sql() -> str:
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS spot FROM documents),
k AS (SELECT doc_id, spot, line, {_LINE_KEY} AS line_key FROM l),
f AS (SELECT line_key, max(doc_id) AS keeper FROM k WHERE length(line_key) >= 40 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.spot, k.line, coalesce(f.keeper <> k.doc_id, false) AS gone FROM k LEFT JOIN f ON f.line_key = k.line_key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


def _groups_sql() -> str:
    """Exact groups at a Jaccard similarity of 0.8 of five-word shingles; equal sets are one node."""
    return """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))) END AS shingles FROM w),
n AS (SELECT min(doc_id) AS node, shingles, len(shingles) AS size FROM s WHERE len(shingles) > 0 GROUP BY shingles),
x AS (SELECT node, size, unnest(shingles) AS shingle FROM n),
p AS (SELECT a.node AS a, b.node AS b, count(*) AS common, any_value(a.size + b.size) AS total FROM x a JOIN x b ON a.shingle = b.shingle AND a.node < b.node
  WHERE 100 * a.size >= 80 * b.size AND 100 * b.size >= 80 * a.size GROUP BY a.node, b.node),
l AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (total - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT node, node AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, coalesce(c.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN n ON n.shingles = s.shingles LEFT JOIN c ON c.node = n.node"""


def _op6_sql() -> str:
    from formicary.llm.licenses import oracle

    return oracle()


#: Those that SQL can express; the others are held against brute force, round trips or held-out accuracy in tests.
ORACLE_SQL: dict[str, str] = {
    "fingerprint_groups": _groups_sql(),
    "op5_line_dedup": _op5_sql(),
    "op6_license_scan": _op6_sql(),
    "op7_warc": _op7_sql(),
    "op10_url_filter": _op10_sql(),
}
