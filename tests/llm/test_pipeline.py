from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from formicary.llm import shared
from tests.llm.helpers import SCHEMA, frame, prose
from tests.llm.test_language import sample
from tests.llm.test_lines import LONG
from tests.llm.test_quality import brute_force


def test_stages_one_after_the_other(spark, tmp_path):
    rows = [(k, t + " 1", lang, "s", len(t)) for k, (_, t, lang, *_) in enumerate(sample(80, 4))]
    rows += [(200, None, "xx", "s", 0), (201, "12 34 56", "xx", "s", 8), (202, "ka tu", "xx", "s", 5)]
    rows += [(300 + k, f"{prose(k, 60)}\n{LONG}", "zz", "s", 1) for k in range(6)]
    base = prose(50, 200)
    rows += [(400, base, "zz", "s", 1), (401, base, "zz", "s", 1), (402, base + " ka", "zz", "s", 1)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names, name
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[k] = {r.doc_id: r for r in docs.collect()}
    assert not {200, 201} & seen[0].keys() and 202 in seen[0] and len(seen[0]) == len(rows) - 2
    assert seen[1].keys() == {d for d, r in seen[0].items() if not brute_force(r.text)[5]}
    kept = [d for d in seen[2] if 300 <= d < 306 and LONG in seen[2][d].text]
    assert kept == [305] and seen[2].keys() == seen[1].keys()
    assert all(r.n_chars == len(r.text) for d, r in seen[2].items() if 300 <= d < 305)
    assert {400} == {d for d in seen[3] if d >= 400}
    assert seen[4].keys() == seen[3].keys()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == seen[4].keys()


def test_empty_corpus(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows_and_columns_in_every_stage(spark, tmp_path):
    """Null ids, repeated rows, ids that repeat with other texts, and columns named like the operators' own."""
    clean = [t + " 1" for _, t, *_ in sample(60, 4)]
    long = f"{LONG}, which many documents share"
    rows = [(k, f"{t}\n{long}", "xx", "s", 7) for k, t in enumerate(clean[:10])]
    rows += [rows[0], rows[0], (3, clean[11], "yy", "s", 1), (None, clean[12], "xx", "s", 1), (None, clean[13], None, None, None), (None, clean[13], None, None, None), (None, None, "xx", "s", None), (40, None, None, None, None), (41, "", "xx", "s", 0)]
    extra = {"kept": "kept", "node": "n", "_row": "r", "__gone": "g", "__n_lines": "l", "__quality_n_words": "q", "__join_rest": "j", "rule": "x", "__node": "m"}
    docs = frame(spark, rows)
    for k, (name, value) in enumerate(extra.items()):
        docs = docs.withColumn(name, F.lit(f"{value}{k}"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(0, 1, 0), (0, 0, 0), (None, 0, 0), (3, None, 0), (3, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        if k < 4:
            assert all(r[name] == f"{value}{j}" for r in seen[-1] for j, (name, value) in enumerate(extra.items()))
    texts = [Counter((r.doc_id, r.text) for r in x) for x in seen[:4]]
    assert texts[0] == Counter((r[0], r[1]) for r in rows if r[1])
    assert texts[1] == texts[0]
    assert texts[2] == Counter((d, t if d == 9 else t.replace(f"\n{long}", "")) for d, t in texts[1].elements())
    want = Counter(texts[2])
    want[(0, clean[0])] = 1  # of the rows that repeat an id, one of equal texts
    assert texts[3] == want
    assert Counter(r.doc_id for r in seen[4]) == Counter(d for d, _ in texts[3].elements())


def test_stages_alone_take_null_and_empty_texts(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "xx", "s", 0), (None, None, "xx", "s", 3), (3, " \n ", "xx", "s", 3)]
    docs = frame(spark, rows)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {name: Counter(tuple(r) for r in stage(spark, docs, str(tmp_path)).collect()) for name, stage in corpus_pipeline.STAGES[:4]}
    assert not got["language ID"] and not got["quality rules"]
    assert got["line dedup"] == got["MinHash near-dedup"] == Counter(rows)
    assert sorted((r.length, r.piece) for r in corpus_pipeline.STAGES[4][1](spark, docs, "").collect()) == [(1, 0)] * 4


def test_only_the_last_stage_is_left(spark, tmp_path):
    rows = [(k, t + " 1", "xx", "s", len(t)) for k, (_, t, *_) in enumerate(sample(20, 4))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = shared.written()
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = [p for p in shared._written[at:] if p]
    assert out.count() >= 20 and len(left) == 2  # the documents that are packed, and their pieces
