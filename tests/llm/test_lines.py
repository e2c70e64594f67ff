from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from formicary.llm import lines
from formicary.llm.perfect_hash import PerfectHash
from tests.llm.helpers import frame, odd_documents, rows_of

SPACE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
LONG = "A line of forty characters or rather more, é"


def brute_force(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(SPACE).translate(FOLD)
    found = defaultdict(set)
    for doc, text, *_ in rows:
        for x in (text or "").split("\n"):
            found[key(x)].add(doc)
    out = []
    for doc, text, *_ in rows:
        all_ = (text or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(found[key(x)]) >= min_docs and max((d for d in found[key(x)] if d is not None), default=None) != doc for x in all_]
        kept = "\n".join(x for x, g in zip(all_, gone, strict=True) if not g)
        out.append((doc, None if text is None else kept, len(all_), sum(gone)))
    return sorted(out, key=repr)


def documents():
    rows = odd_documents()
    for k in range(7):
        rows.append((30 + k, f"{LONG.upper() if k % 2 else LONG}  \nown line {k}\n\t{LONG.lower()}\n{'x' * 39}\n{'é' * 40}\n", "en", "s", 1))
    return rows


@pytest.mark.parametrize(("shard", "room", "hot"), [(50_000, 64 << 20, 1000), (1, 100, 2), (2, 100, 0), (50_000, 1, 1000)])
def test_lines_are_those_of_brute_force(spark, monkeypatch, shard, room, hot):
    """Broadcast; and dealt to a shard a line, a shard of two lines, and one shard in several copies."""
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", shard)
    monkeypatch.setattr(lines, "HOT_KEYS", hot)
    rows = documents()
    out = lines.dedup_lines(frame(spark, rows), broadcast_bytes=room)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    assert rows_of(out, "doc_id", "text", "n_lines", "n_dropped") == brute_force(rows)
    assert sum(r[3] for r in brute_force(rows)) > 10


def test_many_lines_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 20)
    monkeypatch.setattr(lines, "HOT_KEYS", 3)
    common = [f"line number {k} of several hundred that are common, no less" for k in range(300)]
    draw = random.Random(1)
    rows = [(k, "\n".join([common[0], *draw.sample(common, 12), f"own line of document {k} that is long enough, too"]), "en", "s", 1) for k in range(150)]
    rows += [(None, "\n".join(common[:20]), "en", "s", 1)] * 3 + [(7, rows[7][1], "en", "s", 1)]
    out = lines.dedup_lines(frame(spark, rows), broadcast_bytes=10)
    assert rows_of(out, "doc_id", "text", "n_lines", "n_dropped") == brute_force(rows)


def test_shard_arrays_are_compact_and_read(spark):
    draw = np.random.default_rng(4)
    hi, lo = draw.integers(-(1 << 63), 1 << 63, (2, 5000))
    n_docs, keeper = draw.integers(2, 900, 5000), draw.integers(10**12, 10**12 + 60_000, 5000)
    shard = lines.Shard.build(hi, lo, n_docs, keeper, 200)
    assert shard.counts.dtype == np.uint8 and shard.keepers.dtype == np.uint16 and shard.low.itemsize + shard.high.itemsize == lines.FINGER_BITS // 8
    for least in (2, 50, 200):
        assert (shard.dropped(hi, lo, np.zeros(5000, np.int64), least) == (n_docs >= least)).all()
    assert not shard.dropped(hi, lo, keeper, 2).any()
    assert not shard.dropped(lo, hi, np.zeros(5000, np.int64), 2).any()
    odd = lines.Shard.build(hi[:2], lo[:2], n_docs[:2], np.array([lines.NO_ID, (1 << 63) - 1]), 5)
    assert odd.dropped(hi[:2], lo[:2], np.array([0, (1 << 63) - 1]), 2).tolist() == [True, False]


def test_clashing_columns_and_empty_table(spark):
    clash = frame(spark, documents()).withColumnRenamed("lang", "n_lines").withColumnRenamed("source", "hi")
    assert rows_of(lines.dedup_lines(clash), "doc_id", "text", "n_lines", "n_dropped") == brute_force(documents())
    assert lines.dedup_lines(frame(spark, [])).collect() == []


def test_perfect_hash_is_minimal_and_rejects_by_fingerprint():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    places = PerfectHash.build(keys)
    assert sorted(places.index(keys)) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).index(keys[:3]).tolist() == [-1, -1, -1]
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash.build(np.array([1, 1], np.uint64))
