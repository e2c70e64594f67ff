from __future__ import annotations

import random

import numpy as np
import pytest

from formicary.llm import language
from tests.llm.helpers import SCHEMA, frame, odd_documents

SOUNDS = {"xx": ["ka", "tu", "mi", "ro", "nge"], "yy": ["sch", "ei", "ung", "der", "ß"], "zz": ["eau", "ou", "é", "ment", "la"], "vv": ["ción", "ado", "el", "ñ", "os"]}


def sample(n=240, seed=1):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        lang = draw.choice(sorted(SOUNDS))
        text = " ".join("".join(draw.choice(SOUNDS[lang]) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(20, 60)))
        out.append((1000 + k, text, lang, "s", 1))
    return out


def test_held_out_accuracy(spark):
    train, test = sample(240, 1), sample(120, 2)
    model = language.fit(frame(spark, train))
    out = {r.doc_id: r for r in language.identify(frame(spark, test), model, ["doc_id"]).collect()}
    right = sum(out[d].lang_pred == lang for d, _, lang, *_ in test)
    assert right >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_only_the_text_counts_and_odd_texts_are_unknown(spark):
    rows = odd_documents()
    model = language.fit(frame(spark, sample()))
    out = language.identify(frame(spark, rows).withColumnRenamed("lang", "score"), model, ["doc_id"]).collect()
    unknown = sorted(r.doc_id for r in out if r.lang_pred == "und")
    assert unknown == [5, 6, 7, 12, 12, 15]
    assert all(r.score == 0 for r in out if r.lang_pred == "und") and len(out) == len(rows)
    kept = language.keep_identified(frame(spark, rows), model)
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert not {r.doc_id for r in kept.collect()} & set(unknown)
    assert language.identify(frame(spark, []), model, ["doc_id"]).collect() == []


def test_nothing_to_learn_from(spark):
    model = language.fit(frame(spark, [(1, "abc", None, None, 1), (2, None, "xx", None, 1)]))
    assert model.languages == [] and model.predict(b"abc") == ("und", 0.0, True)
    one = language.fit(frame(spark, [(1, "abc def", "xx", None, 1)]))
    assert one.predict(b"abc")[0] == "xx"


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9, 20])
def test_codewords_are_far_apart_and_correct_errors(n):
    codes = language.codewords(n)
    apart = [(codes[a] != codes[b]).sum() for a in range(n) for b in range(a)]
    assert min(apart) >= (1 if n == 2 else 2 ** (n - 2) if n <= 6 else 7)
    assert (np.abs(codes.sum(0)) < n).all()
    model = language.Model([str(k) for k in range(n)], codes, np.zeros((1, codes.shape[1])), np.ones(codes.shape[1]), np.ones(codes.shape[1]))
    for k in range(n):
        wrong = codes[k].astype(float).copy()
        wrong[: (min(apart) - 1) // 2] *= -1
        assert model.decode(wrong)[0] == str(k)


def test_equal_margins_are_ambiguous():
    codes = language.codewords(4)
    model = language.Model(list("abcd"), codes, np.zeros((1, 7)), np.ones(7), np.ones(7))
    assert model.decode(np.zeros(7))[2] and not model.decode(codes[2].astype(float))[2]


def test_long_texts_are_read_whole():
    model = language.build(["xx", "yy"], np.ones((2, language.BINS)))
    text = ("ab " * 300_000).encode()
    model.weights = np.ones_like(model.weights)
    assert abs(model.margins(text)[0] - 1) < 1e-6
    assert b"".join(language.slices(("é" * 400_000).encode())) == ("é" * 400_000).encode()


def test_rare_languages_stay_in_the_model_of_a_large_table(spark):
    rare = [r for r in sample(400, 3) if r[2] == "vv"][:20]
    train = [r for r in sample(1200, 4) if r[2] != "vv"] + [(9000 + k, *r[1:]) for k, r in enumerate(rare)]
    model = language.fit(frame(spark, train), sample_rows=100)
    assert model.languages == ["vv", "xx", "yy", "zz"]
    assert [model.predict(r[1].encode())[0] for r in rare] == ["vv"] * 20
    assert language.fit(frame(spark, train[:-16]), sample_rows=100).languages == ["xx", "yy", "zz"]


def test_parts_are_even():
    assert language.even_part([3, 10, 1000], 10_000) == 10_000
    assert language.even_part([100, 9000, 9000], 12_000) == 5950
    assert language.even_part([10**6] * 1000, 12_000) == language.LEAST_ROWS


def test_without_labels_every_text_with_a_letter_stays(spark):
    rows = [(k, t, None, None, 1) for k, t in enumerate(["abc", None, "", "12 34", "日本", "é"])]
    docs = frame(spark, rows)
    assert sorted(r.doc_id for r in language.keep_identified(docs, language.fit(docs)).collect()) == [0, 4, 5]


def test_the_sample_is_bounded_however_rows_repeat(spark):
    """Null ids are told apart by their texts; rows that repeat both are one."""
    from pyspark.sql import functions as F

    many = spark.range(300_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "ka tu").otherwise(F.concat(F.lit("mi ro "), F.col("id"))).alias("text"), F.lit("xx").alias("lang"))
    chosen, share = language.sampled(many, "doc_id", "text", "lang", 1200)
    rows = chosen.collect()
    assert len(rows) == 1200 and share == {"xx": 1200 / 300_000}
    assert len({r.text for r in rows}) == 1200 and sum(r.copies for r in rows) in (1200, 101_199)


def test_a_language_of_one_in_many_thousands_is_learned(spark):
    from pyspark.sql import functions as F

    common = spark.range(100_000).select("id", F.concat(F.lit("ka tu mi "), F.col("id")).alias("text"), F.lit("xx").alias("lang"))
    rare = frame(spark, [(-1 - k, "sch ei ung der", "yy", "s", 1) for k in range(5)]).select(F.col("doc_id").alias("id"), "text", "lang")
    assert language.fit(common.union(rare), "id").languages == ["xx", "yy"]


def test_no_share_is_too_small():
    from formicary.llm.shared import draw_bound

    assert draw_bound(1.25 * 3000 / 5e10) > 10**11 and draw_bound(1.5) == (1 << 63) - 1
