"""Every contract query on the smallest tables; those with SQL against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from formicary.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op3_minhash_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op4_document_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op5_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op7_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op8_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op9_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op10_url_filter": {"page_id", "host", "path", "rule", "verdict"},
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    out = QUERIES[name](spark, SF)
    assert COLUMNS.get(name, set()) <= set(out.columns)
    rows = out.collect()
    table = "pages" if name in ("op7_warc", "op10_url_filter") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert len(rows) == n or name == "op1_best_fit_packing"
    if name in ORACLE_SQL:
        duck = duckdb.connect()
        for t in ("documents", "pages"):
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        columns = sorted(out.columns)
        want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in rows)
    if name == "op9_language_id":
        truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        held = [r for r in rows if r.held_out]
        assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
