from __future__ import annotations

import hashlib
import re
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from formicary.llm import licenses
from tests.llm.helpers import frame, odd_documents


def test_equivalent_texts_have_the_licences_digest(spark):
    mit = licenses.TEXTS[0][1]
    rows = [
        (1, mit, None, None, None), (2, "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + mit.upper().replace(",", " --"), None, None, None), (3, mit + " And more.", None, None, None),
        (4, licenses.TEXTS[3][1].replace("license", "licence"), None, None, None), (5, "Prose.\nReleased under the MIT Licence!\nMore.\nlicensed under CC BY-NC 4.0", None, None, None), (6, None, None, None, None), (6, None, None, None, None),
    ]
    got = sorted((r.doc_id, r.license, r.n_license_lines, r.line_licenses) for r in licenses.scan(frame(spark, rows).withColumnRenamed("lang", "license")).collect())
    assert got[:3] == [(1, "MIT", 0, ""), (2, "MIT", 0, ""), (3, None, 0, "")]
    assert got[3][:2] == (4, "BSD-2-Clause")
    assert got[4] == (5, None, 2, "CC-BY-NC-4.0,MIT")
    assert got[5:] == [(6, None, 0, "")] * 2


def test_every_known_text_is_found_and_they_are_told_apart(spark):
    rows = [(k, t, None, None, None) for k, (_, t) in enumerate(licenses.TEXTS + licenses.NOTICES)]
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {k: name for k, (name, _) in enumerate(licenses.TEXTS + licenses.NOTICES)}


WORDS = re.compile(r"[^\W_]+")
BODY = ("notice", "holder", "owner", "law", "license", "licence", "statement", "interest", "permission", "disclaimer")


def by_hand(text):
    """The canonical form by loops over words, without the patterns."""
    paragraphs = []
    for line in (text or "").replace("\u00a9", "(c)").split("\n"):
        line = "".join(c.lower() if c.isascii() else c for c in line)
        paragraphs.append(WORDS.findall(line))

    def after(w):
        """What follows the word copyright, None if the line doesn't begin with it."""
        w = w[1:] if w[:1] == ["c"] else w
        w = w[1:] if w[:1] == ["portions"] else w
        return w[1:] if w[:1] == ["copyright"] else None

    def named(w):
        w = after(w)
        return bool(w) and w[0] not in BODY and w[0].removesuffix("s") not in BODY and w[0] not in ("and", "or", "in", "on", "is", "of", "to", "for")

    def dated(w):
        year = lambda x: len(x) == 4 and x.isdecimal() and x.isascii()
        rest = after(w)
        return w[:3] == ["all", "rights", "reserved"] or (bool(rest) and (rest[0] in ("c", "year", "yyyy") or year(rest[0]))) or (w[:1] == ["c"] and len(w) > 1 and year(w[1]))

    lines = []
    for k, w in enumerate(paragraphs):
        above = paragraphs[k - 1] if k else []
        head = not above or named(above) or above[:3] == ["all", "rights", "reserved"]
        title = any(x in ("license", "licence") and j >= len(above) - 2 and j <= 5 for j, x in enumerate(above))
        if w and not dated(w) and not (named(w) and (head or title)):
            lines.append(w)
    titles = ["mit license", "the mit license", "the mit license mit", "isc license", "the isc license", "bsd 3 clause license", "the 2 clause bsd license", "zlib license"]
    if lines and " ".join(lines[0]) in titles:
        lines = lines[1:]
    out, k = [], 0
    words = [w for x in lines for w in x]
    table = dict(licenses.SPELLINGS)
    while k < len(words):
        two = " ".join(words[k : k + 2])
        step = 2 if two in table and " " in two else 1
        out.append(table.get(two if step == 2 else words[k], two if step == 2 else words[k]))
        k += step
    return " ".join(out)


def oddities():
    mit, isc, bsd = licenses.TEXTS[0][1], licenses.TEXTS[1][1], licenses.TEXTS[4][1]
    return [
        "ISC\n\u00a9 2020 me\nReleased under the ISC licence.", "\u00a9 2020 Jane\n" + mit, "The MIT License (MIT)\n\nCopyright \u00a9 2019 Jane <j@x.org>\n\n" + mit, "The ISC License\n\n" + isc,
        "BSD 3-Clause License\n\nCopyright (c) 2017, Jane\nAll rights reserved.\n\n" + bsd, "upper central fulfiller licencee", "sub-licence per cent Licence", "1. Licences\n- Copyright law\n\nCopyright Foo",
        "Zlib License", "Copyright", "Portions Copyright 2001 x\nCOPYRIGHT HOLDERS AND CONTRIBUTORS be", mit + "\nx", mit.replace("charge", "charges"), "\u0130 \u00e9Copyright 2020", "Foo License\nCopyright Foo\nBody",
    ]


def test_the_sql_and_plain_loops_say_the_same(spark):
    import duckdb
    import pandas as pd

    rows = odd_documents()
    rows = [r for k, r in enumerate(rows) if r[0] not in [q[0] for q in rows[:k]]] + [(40 + k, t, None, None, None) for k, t in enumerate(oddities())]
    rows += [(100 + k, t, None, None, None) for k, (_, t) in enumerate(licenses.TEXTS + licenses.NOTICES)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    names = ["doc_id", "n_canonical", "canonical_sha256", "license", "n_license_lines", "line_licenses"]
    got = sorted((tuple(r) for r in licenses.scan(frame(spark, rows)).select(*names).collect()), key=repr)
    want = duckdb.sql(f"SELECT {', '.join(names)} FROM ({licenses.oracle()})").fetchall()
    assert sorted(want, key=repr) == got
    known = {by_hand(t): name for name, t in reversed(licenses.TEXTS + licenses.NOTICES)}
    hand = [(r[0], len(c := by_hand(r[1])), hashlib.sha256(c.encode()).hexdigest(), known.get(c)) for r in rows]
    assert sorted(hand, key=repr) == [r[:4] for r in got]


def test_titles_and_holders_of_every_kind(spark):
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, [(k, t, None, None, None) for k, t in enumerate(oddities())])).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == ["MIT", "MIT", "ISC", "BSD-3-Clause"]
    assert all(got[k] is None for k in (0, 5, 6, 7, 8, 9, 10, 11, 12))


def test_spellings_are_whole_words(spark):
    asked = ["upper central", "per cent", "licence licence licences", "sub licence x sub license", "https httpss", ""]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(asked)], "k int, x string").orderBy("k").select(licenses.spelled(F.col("x"))).collect()]
    assert got == ["upper central", "percent", "license license licenses", "sublicense x sublicense", "http httpss", ""]
    assert all(licenses.IN_NOTICES in by_hand(t) for _, t in licenses.NOTICES)


def test_long_licences_as_distributed(spark):
    names = ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "CC0-1.0", "Artistic"]
    found = [n for n in names if (Path("/usr/share/common-licenses") / n).exists()]
    if not found:
        pytest.skip("no such texts here")
    rows = []
    for k, n in enumerate(found):
        text = (Path("/usr/share/common-licenses") / n).read_text()
        rows += [(4 * k, text), (4 * k + 1, "\n".join(" ".join(x.split()) for x in text.split("\n")).upper()), (4 * k + 2, text.replace("copyright", "copyrights")), (4 * k + 3, "\u00a9 2021 Somebody\n\n" + text)]
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, rows, "doc_id long, text string")).collect()}
    for k, n in enumerate(found):
        assert got[4 * k].startswith(n) and got[4 * k + 1] == got[4 * k + 3] == got[4 * k] and got[4 * k + 2] is None, n


def test_no_python_in_the_plan_and_no_shuffle_of_texts(spark):
    plan = licenses.scan(frame(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licenses.scan(frame(spark, [])).collect() == []
    assert licenses.known_digests(spark).filter(F.col("license").isNull()).count() == 0


def test_known_texts_are_found_at_any_width(spark):
    heads = ["", "Copyright (c) 2020, Somebody\nAll rights reserved.\n\n", "Copyright Some Body Inc.\nCopyright The Other Authors\n\n", "\n \u00a9 Copyright 2019 me\n\n", "\u00a9 2020 Jane\n\n"]
    want, rows = [], []
    for width in [12, 30, 40, 50, 60, 66, 70, 72, 76, 78, 80, 100, 200]:
        for name, text in licenses.TEXTS:
            wrapped = "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))
            for head in heads:
                rows.append((len(rows), head + wrapped))
                want.append((name, width, head))
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, rows, "doc_id long, text string")).collect()}
    assert [(k, w) for k, w in enumerate(want) if got[k] != w[0]] == []


def test_isc_as_commonly_published(spark):
    isc = next(t for name, t in licenses.TEXTS if name == "ISC").replace("above copyright", "above\ncopyright")
    rows = [(1, isc, None, None, None), (2, "ISC text of\nCopyright law and\ncopyright Foo", None, None, None), (3, "Some License\nCopyright Foo\nPortions copyright Bar\nx", None, None, None)]
    got = {r.doc_id: (r.license, r.n_canonical) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {1: ("ISC", got[1][1]), 2: (None, len("isc text of copyright law and copyright foo")), 3: (None, len("some license x"))}
