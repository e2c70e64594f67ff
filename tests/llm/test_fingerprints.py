from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa

from formicary.llm.fingerprints import as_text, fingerprint_edits, fingerprints, likeness
from tests.llm.helpers import frame, odd_documents, prose


def test_rows_follow_each_other_in_descending_ids(spark):
    rows = odd_documents()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        want.append((doc, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    for parts in (1, 4):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = fingerprint_edits(frame(spark, rows).withColumnRenamed("lang", "fingerprint")).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(next(x[1] or "" for x in rows if x[0] == r.doc_id), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


M64 = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_minhash(text, n=128, seed=2):
    """The fingerprint by loops over words, shingles and functions, in whole numbers."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    hashes = []
    for word in words:
        value, power = 0, 1
        for byte in word:
            value = (value + (byte + 32 if 65 <= byte <= 90 else byte) * power + power) & M64
            power = power * (0x9E3779B97F4A7C15 | 1) & M64
        hashes.append(mixed(value))
    if not hashes:
        return "ff" * n
    shingles = [hashes[k : k + 5] for k in range(len(hashes) - 4)] or [hashes]
    values = set()
    for shingle in shingles:
        value = len(shingle) * 0xD6E8FEB86659FD93 & M64
        for k, word in enumerate(shingle + [0] * (5 - len(shingle))):
            value = (value * 0xFF51AFD7ED558CCD + mixed((word + k + 1) & M64)) & M64
        value = mixed(value)
        values.add((value ^ value >> 32) & 0xFFFFFFFF)
    draw = np.random.default_rng(seed)
    a, b = draw.integers(0, 1 << 32, n, np.uint32).tolist(), draw.integers(0, 1 << 32, n, np.uint32).tolist()
    return "".join(f"{min(((x | 1) * v + y) & 0xFFFFFFFF for v in values) & 255:02x}" for x, y in zip(a, b, strict=True))


def plain_likeness(one, two):
    same = sum(one[k : k + 2] == two[k : k + 2] for k in range(0, 256, 2)) / 128
    return max(0.0, same - 1 / 256) / (1 - 1 / 256)


def test_fingerprints_and_likeness_are_those_of_brute_force(spark):
    rows = [r for r in odd_documents() if len(r[1] or "") < 10_000]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        own, changed, following = (plain_minhash(x) for x in (text, text[: len(text) - half] + after[:half], after))
        want.append((doc, own, changed, round(plain_likeness(own, changed), 9), round(plain_likeness(own, following), 9)))
    got = fingerprint_edits(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=repr) == sorted(want, key=repr)


def test_many_rows_over_many_ranges(spark):
    rows = [(k * 3, f"text {k} " * (k % 5), None, None, None) for k in range(500)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprint_edits(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for k, (doc, text, *_) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(text) // 2
        assert got[doc] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_likeness_is_near_the_jaccard_similarity():
    base = prose(1, 3000).split()
    for cut in (300, 1000, 2000):
        one, two = " ".join(base), " ".join(base[:cut])
        a, b = ({tuple(x.lower().split()[k : k + 5]) for k in range(len(x.split()) - 4)} for x in (one, two))
        got = likeness(*(fingerprints(pa.array([x])) for x in (one, two)))[0]
        assert abs(got - len(a & b) / len(a | b)) < 0.15
    assert likeness(fingerprints(pa.array([one])), fingerprints(pa.array([one])))[0] == 1
    assert len(as_text(fingerprints(pa.array([one, None])))[1]) == 256


def test_one_row_and_none(spark):
    row = fingerprint_edits(frame(spark, [(1, "abcd", None, None, None)])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1
    assert fingerprint_edits(frame(spark, [])).collect() == []
    assert fingerprint_edits(frame(spark, [(None, "b", None, None, None), (None, "a", None, None, None)])).count() == 2
