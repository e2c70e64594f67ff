from __future__ import annotations

import random

import public_tokenizers
import sentencepiece

from formicary.llm.pieces import PieceModel, combine, cuts_of, decode, encode, encode_chunked, prefixes
from tests.llm.helpers import frame, odd_documents, prose

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_chunks_of_any_size_give_the_librarys_ids():
    model = PieceModel(PATH)
    draw = random.Random(1)
    parts = ["the", "ing", " ", "  ", "   ", "\n", "é", "日本", "x", "▁", "😀", "http://", "aaaa", "<0x0A>", "er", "\t", " a"]
    texts = [prose(1, 200), "".join(draw.choice("abcdefgh") for _ in range(600)), *("".join(draw.choice(parts) for _ in range(draw.randint(1, 60))) for _ in range(80))]
    for text in texts:
        for chunk in (3, 11, 40, 250):
            assert encode_chunked(model, text, chunk) == model.library.encode(text), (text, chunk)


def test_runs_of_spaces_and_texts_that_come_to_nothing():
    model = PieceModel(PATH)
    for text in (" " * 3000, "a" + " " * 1500 + "b\n" + " " * 700):
        assert encode_chunked(model, text, 600) == model.library.encode(text)
    assert cuts_of("", 5) == [0, 0] and cuts_of("abcdef", 3) == [0, 3, 6] and cuts_of("abcdefg", 3) == [0, 3, 6, 7]
    assert encode_chunked(model, "", 5) == [] and model.transfer("", 0, 0).tolist() == [[0.0]]


def unigram_model(tmp_path):
    """The same pieces read as a unigram model: only the declared type differs."""
    proto = open(PATH, "rb").read()
    at = proto.rindex(b"\x18\x02", 0, proto.rindex(b"identity"))
    spots = [k for k in range(len(proto) - 2000, len(proto)) if proto[k : k + 2] == b"\x18\x02"]
    del at
    path = tmp_path / "unigram.model"
    for k in spots:
        path.write_bytes(proto[:k] + b"\x18\x01" + proto[k + 2 :])
        try:
            model = PieceModel(str(path))
        except RuntimeError:
            continue
        if not model.merges:
            return model
    return None


def test_unigram_scores_give_a_path_of_the_best_weight(tmp_path):
    model = unigram_model(tmp_path)
    assert model is not None
    for seed in range(3):
        text = prose(seed, 40)
        score = lambda ids: sum(model.library.get_score(k) for k in ids)
        whole = encode_chunked(model, text, 10**6)
        for chunk in (7, 50):
            assert abs(score(encode_chunked(model, text, chunk)) - score(whole)) < 1e-3


def test_prefixes_are_products():
    import numpy as np

    draw = np.random.default_rng(1)
    ms = [draw.random((1 if k == 0 else 3, 3)) for k in range(9)]
    now = ms[0]
    for k, got in enumerate(prefixes(ms)):
        now = now if k == 0 else combine(now, ms[k])
        assert np.allclose(got, now)


def test_texts_of_any_ids_are_the_librarys():
    model = PieceModel(PATH)
    draw = random.Random(4)
    for _ in range(500):
        ids = [draw.choice([0, 1, 2, draw.randrange(3, 259), draw.randrange(259, 32000), 259, 29871]) for _ in range(draw.randint(0, 6))]
        assert model.text_of(ids) == model.library.decode(ids), ids


def test_encode_and_decode_whole_tables(spark):
    rows = odd_documents() + [(20, "abc" * 3000, None, None, None)]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = decode(encode(frame(spark, rows).withColumnRenamed("lang", "ids"), PATH, chunk=500), PATH).collect()
    key = lambda x: (x[0] is None, x[0] or 0, len(x[1]))
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in out), key=key)
    want = sorted(((d, library.encode(t or ""), t or "") for d, t, *_ in rows), key=key)
    assert got == want
    assert max(r.n_chunks for r in out) > 100
    assert encode(frame(spark, []), PATH).collect() == []
