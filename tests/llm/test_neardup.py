from __future__ import annotations

import random
import time
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from formicary.llm import neardup
from formicary.llm.components import components
from formicary.llm.fingerprints import similar_documents
from tests.llm.helpers import SCHEMA, frame, odd_documents, rows_of, words

SF = "/root/testdata/sf0.1"


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_force(rows, size, num, den):
    sets = [shingles(r[1], size) for r in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    out = []
    for k, r in enumerate(rows):
        ids = [q[0] for j, q in enumerate(rows) if root(j) == root(k) and q[0] is not None]
        least = min(ids) if ids else None
        if not sets[k]:
            least = r[0]
        out.append((r[0], len(sets[k]), least, least is None if r[0] is None else r[0] == least))
    return sorted(out, key=repr)


def copies(seed, n, edits):
    """n variants of a text, each with up to `edits` words changed: similarities on both sides of a threshold."""
    draw = random.Random(seed)
    base = words(seed, 150)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(len(w))] = "w%d" % draw.randrange(10**6)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("size", "similarity"), [(3, (85, 100)), (5, (80, 100))])
def test_groups_are_those_of_brute_force(spark, size, similarity):
    rows = odd_documents() + [(100 + k, t, None, None, None) for k, t in enumerate(copies(1, 60, 8) + copies(2, 12, 3))]
    got = rows_of(neardup.near_duplicates(frame(spark, rows).withColumnRenamed("lang", "kept"), shingle=size, similarity=similarity))
    assert got == brute_force(rows, size, *similarity)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 1500)
    rows = [(k, t, None, None, None) for k, t in enumerate(copies(3, 70, 9))]
    assert rows_of(neardup.near_duplicates(frame(spark, rows), shingle=3, similarity=(85, 100))) == brute_force(rows, 3, 85, 100)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_all_groups_of_the_tables_are_found(spark):
    """Every component of sf0.1, by pairs that share one of their rarest shingles and then plain sets."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, shingles(r.text, 3)) for r in docs.select("doc_id", "text").collect()]
    often = Counter(x for _, s in rows for x in s)
    up = {d: d for d, _ in rows}

    def root(d):
        while up[d] != d:
            up[d] = up[up[d]]
            d = up[d]
        return d

    sets, holders = dict(rows), defaultdict(list)
    for d, s in rows:
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-85 * len(s) // 100) + 1]:
            for other in holders[x]:
                if root(other) != root(d) and 100 * len(s & sets[other]) >= 85 * len(s | sets[other]):
                    up[max(root(d), root(other))] = min(root(d), root(other))
            holders[x].append(d)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, shingle=3, similarity=(85, 100)).collect()}
    assert got == {d: root(d) for d in up} and len(set(got.values())) < len(got) - 500


def test_unlike_texts_of_one_bucket_cost_in_proportion():
    """4,000 variants with a common passage, none near another: looked up by their rare shingles, not pair by pair."""
    draw = np.random.default_rng(1)
    sets = [np.concatenate([np.arange(150), 1000 + 200 * k + draw.integers(0, 200, 150)]) for k in range(4000)]
    sets = [np.unique(x) for x in sets]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    inverted, seconds = neardup._Inverted(np.concatenate(sets), offsets), neardup._Inverted(np.zeros(4000, np.int64), np.arange(4001))
    began = time.perf_counter()
    assert neardup.spanning_links(np.arange(4000), np.arange(4000), np.zeros(4000, int), seconds, inverted, 80, 100) == []
    assert time.perf_counter() - began < 8
    near = [*sets[:50], *(np.append(x, 10**7 + k) for k, x in enumerate(sets[:50]))]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in near])])
    found = neardup.spanning_links(np.arange(100), np.arange(100), np.zeros(100, int), neardup._Inverted(np.zeros(100, np.int64), np.arange(101)), neardup._Inverted(np.concatenate(near), offsets), 80, 100)
    assert sorted(tuple(sorted(x)) for x in found) == [(k, 50 + k) for k in range(50)]


def test_signature_bands_find_the_same_groups(spark):
    rows = odd_documents() + [(100 + k, t, None, None, None) for k, t in enumerate(copies(4, 25, 4))]
    assert rows_of(similar_documents(frame(spark, rows))) == brute_force(rows, 5, 80, 100)


def test_empty_table_and_only_empty_texts(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == []
    assert rows_of(neardup.near_duplicates(frame(spark, [(1, None, None, None, None), (2, "", None, None, None)]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_keep_one_keeps_the_columns(spark):
    rows = odd_documents()
    out = neardup.keep_one(frame(spark, rows))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    kept = {r.doc_id for r in out.collect()}
    assert {5, 6, 7, 8, 9, 12, None} <= kept
    assert not {10, 11} & kept


def test_keep_one_tells_the_texts_of_an_id_apart(spark):
    one, near, other, more = " ".join(words(1, 60)), " ".join(words(1, 60)[:-1]), " ".join(words(2, 60)), " ".join(words(3, 60))
    texts = [(1, one), (1, one), (1, one.replace(" ", "  ")), (1, near), (2, near), (2, other), (3, other), (4, more), (5, None), (5, None), (2, other)]
    out = neardup.keep_one(frame(spark, [(i, t, "en", f"s{k}", k) for k, (i, t) in enumerate(texts)]))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = sorted(((r.doc_id, " ".join((r.text or "").split())) for r in out.collect()))
    assert got in [[(1, x), (2, other), (4, more), (5, ""), (5, "")] for x in (one, near)]


def test_components_of_chains_and_cycles(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(50, 51), (51, 52), (52, 50), (60, 60), (51, 50)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {**{k: 0 for k in range(41)}, 50: 50, 51: 50, 52: 50}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_of_stars_take_no_round(spark):
    edges = [(k, 3) for k in range(4, 40)] + [(50, 41), (41, 51), (41, 50)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "u long, v long"), max_rounds=1)))
    assert got == {**{k: 3 for k in range(3, 40)}, 41: 41, 50: 41, 51: 41}
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([*edges, (2, 39)], "u long, v long"), max_rounds=1)


def test_tensored_bands_are_reproducible():
    column = pa.array(["a b c d e", None, "a b c d e f"])
    one, two = (list(neardup._signatures(3, 12, 3, 1)(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([4, 5, 6]), column], ["doc_id", "row", "text"])]))) for _ in range(2))
    assert [x.to_pylist() for x in one] == [x.to_pylist() for x in two]
    assert one[0].column("halves")[1].as_py() is None
