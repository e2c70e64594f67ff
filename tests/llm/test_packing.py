from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from formicary.llm.packing import pack, part_counts, plan, seats, word_ids
from tests.llm.helpers import frame, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_and_is_about_as_tight_as_best_fit(seed):
    draw = random.Random(seed)
    lengths = [min(100, max(1, int(draw.lognormvariate(3, 1)))) for _ in range(800)]
    runs = plan(dict(Counter(lengths)), 100)
    held = Counter()
    for count, bin_ in runs:
        assert sum(bin_) <= 100
        for x in bin_:
            held[x] += count
    assert held == Counter(lengths)
    bins = sum(n for n, _ in runs)
    assert bins <= best_fit_decreasing(lengths, 100) * 1.02 + 1
    table = seats(runs)
    assert (np.diff(table["length"]) >= 0).all()


def test_plan_of_nothing_and_of_one_length():
    assert plan({}, 2048) == []
    assert sum(n for n, _ in plan({2048: 7}, 2048)) == 7
    assert sum(n for n, _ in plan({1024: 7}, 2048)) == 4
    assert sum(n for n, _ in plan({1: 5000}, 2048)) == 3


def test_word_ids_are_the_tokenizers():
    ids, plain = word_ids(PATH), Tokenizer.from_file(PATH)
    draw = random.Random(5)
    parts = ["A", "b", "'s", "'", "é", "É", "ß", "İ", "Σ", ".", ",", "!", ":", "1", "²", "́", "<|endoftext|>", "\x1c", "\x85", "　", " ", " ", "\n", "the", "LL'LL", "x.", "中", "_"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 8)))
        assert ids.encode(text.encode().split()) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_pack_is_whole_gapless_and_right(spark):
    rows = odd_documents()
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(doc, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = pack(frame(spark, rows).withColumnRenamed("lang", "piece"), PATH).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    spans = defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    for held in spans.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(spans) == best_fit_decreasing([r.length for r in got], 2048)


def test_hot_lengths_are_ranked_in_parts(spark):
    rows = [(k % 90, "one two three" if k % 3 else "one", "en", "s", 1) for k in range(300)]
    got = pack(frame(spark, rows), PATH, capacity=16).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 300
    assert len({r.sequence_id for r in got}) == (200 * 4 + 100 * 2) // 16 + 1


def test_parts_follow_the_share_of_a_length():
    assert part_counts({3: 10, 5: 990}, 100) == {3: 1, 5: 99}
    assert sum(part_counts({k: k for k in range(1, 2049)}, 64).values()) <= 2048 + 64
    assert part_counts({}, 100) == {}


def test_empty_table(spark):
    assert pack(frame(spark, []), PATH).collect() == []


def test_ids_on_request(spark):
    row = pack(frame(spark, [(1, "Hello", None, None, None)]), PATH, with_ids=True).first()
    assert row.ids == [*Tokenizer.from_file(PATH).encode("Hello", add_special_tokens=False).ids, 0]
