from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from formicary.llm import quality
from tests.llm.helpers import SCHEMA, frame, odd_documents, prose, rows_of

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, r, n < 10 or 100 * r > 20 * n


def labelled(n=400):
    draw = random.Random(3)
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        text = prose(k, draw.randint(40, 120))
        rows.append((100 + k, re.sub(r"(\w+)\.", r"\1 $$$ ***", text) if bad else text, "en", "s", 1))
        labels.append((100 + k, 0 if bad else 1, 0))
    return rows, labels


def test_counts_and_minimum_are_those_of_brute_force(spark):
    rows, labels = labelled(40)
    rows += odd_documents() + [(90, "a b c d e " * 30, None, None, None), (91, "a b c d e f a b c d e f", None, None, None)]
    out = quality.judge(frame(spark, rows).withColumnRenamed("lang", "n_words"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = rows_of(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((r[0], *brute_force(r[1])) for r in rows), key=repr)
    assert all(not r.kept for r in out.collect() if r.base_failed)


def test_held_out_labels(spark):
    """Learns from half of the labels and is scored on the other half, which it has not seen."""
    rows, labels = labelled(800)
    known = [x for x in labels if x[0] // 4 % 2]
    out = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows), spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect()}
    unseen = [x for x in labels if not x[0] // 4 % 2]
    right = sum(out[d] == bool(q) for d, q, _ in unseen)
    assert right >= 0.97 * len(unseen) and all(out[d] for d, q, _ in unseen if q)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_held_out_labels_of_the_tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.judge(spark.read.parquet(f"{SF}/documents.parquet"), labels.filter("doc_id % 2 = 0"))
    seen = out.join(labels.filter("doc_id % 2 = 1 and quality is not null"), "doc_id").select("quality", "kept").collect()
    bad, good = [r.kept for r in seen if r.quality == 0], [r.kept for r in seen if r.quality == 1]
    assert len(bad) > 20 and len(good) > 100
    assert bad.count(False) >= 0.9 * len(bad) and good.count(True) >= 0.95 * len(good)


def test_the_label_sample_is_bounded_and_never_empty(spark, monkeypatch):
    many = spark.range(200_000).selectExpr("if(id % 2 = 0, null, id % 50000) as doc_id", "cast(id % 3 as int) as quality")
    chosen = quality.sampled_labels(many, sample_rows=1000)
    assert chosen.count() == 1000 and chosen.filter("_label_id is null or _label is null").isEmpty()
    rows, labels = labelled(40)
    again = [(r[0], r[1] + f" {k}", *r[2:]) for r in rows for k in range(5)]  # ids that repeat with other texts
    seen = []
    monkeypatch.setattr(quality, "learn", lambda x, bad, **how: seen.append(len(bad)) or [])
    known = quality.sampled_labels(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    quality.fit(quality.with_counts(frame(spark, [*again, *again]), keep=["doc_id"]), known, sample_rows=30)
    quality.fit(quality.with_counts(frame(spark, [*rows, *rows]), keep=["doc_id"]), known)
    assert seen == [30, 40]


def test_noise_teaches_nothing():
    draw = np.random.default_rng(1)
    x = {name: draw.random(600) for name in quality.FEATURES}
    assert quality.learn(x, draw.random(600) < 0.3) == []
    assert quality.learn({k: v[:0] for k, v in x.items()}, np.zeros(0, bool)) == []


def test_rules_are_ordered_conjunctions():
    draw = np.random.default_rng(2)
    x = {name: draw.random(3000) for name in quality.FEATURES}
    bad = (x["symbol_share"] > 0.8) | ((x["digit_share"] > 0.6) & (x["n_words"] < 0.3))
    rules = quality.learn(x, bad)
    caught = np.zeros(3000, bool)
    for rule in rules:
        caught |= rule.holds(x)
    assert (caught & bad).sum() > 0.85 * bad.sum() and (caught & ~bad).sum() < 0.05 * bad.sum()


def test_stage_keeps_columns_and_empty_tables(spark):
    rows, labels = labelled(60)
    labels = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.keep_good(frame(spark, [*rows, *odd_documents()]), labels)
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert {r.doc_id for r in out.collect()} >= {1, 2, 9}
    assert quality.keep_good(frame(spark, []), labels).collect() == []
    assert quality.judge(frame(spark, rows), labels.limit(0)).filter("rule > 0").count() == 0


def test_long_texts_are_counted_across_slices():
    text = prose(9, 200_000)
    got = quality.text_counts(pa.array([text, None, "a"]))
    assert tuple(got[c][0] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_force(text)[:5]
