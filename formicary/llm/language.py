"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword; each bit is a binary classifier that tells the languages with a 1 from
those with a 0 by the n-grams of the text (a log-linear model with smoothed counts). Decoding compares
the vector of margins with every codeword, weighing each bit's loss by how well it did in training, and
takes the nearest codeword; a near tie is flagged as ambiguous.

Training needs only the n-gram counts per language, which are summed on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formicary.llm.shared import arrow_map, byte_rows, draw, draw_bound

#: Labelled rows that the model is fitted on, at most so many (a hash of id and text chooses them), or LEAST_ROWS a language.
SAMPLE_ROWS = 12_000
LEAST_ROWS = 50
#: So many times the wanted rows are drawn by their hash before the least hashes of them are taken.
SPARE = 2.0
BITS = 15
BINS = 1 << BITS
ORDERS = (2, 3)
UNKNOWN = "und"
SLICE = 1 << 19

#: ASCII letters are folded; other ASCII becomes a space; bytes of longer code points stay.
_TABLE = np.full(256, 0x20, np.uint8)
_TABLE[0x80:] = np.arange(0x80, 0x100)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)
_LATIN = bytes(range(65, 91)) + bytes(range(97, 123))


def has_letter(text: bytes) -> bool:
    if len(text.translate(None, _LATIN)) < len(text):
        return True
    return not text.isascii() and any(map(str.isalpha, text.decode()))


def gram_bins(data: np.ndarray) -> Iterator[np.ndarray]:
    """Bins of the n-grams of each order in already mapped bytes; runs of spaces count like one."""
    for n in ORDERS:
        if len(data) < n:
            continue
        size = len(data) - n + 1
        value = data[:size].astype(np.uint32)
        for k in range(1, n):
            value |= data[k : k + size].astype(np.uint32) << np.uint32(8 * k)
        value = (value * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
        yield value >> np.uint32(32 - BITS)


def mapped(text: bytes) -> np.ndarray:
    """The letters of a text, lower-cased, other characters as single spaces."""
    low = text if text.isascii() else text.decode().lower().encode()
    data = _TABLE[np.frombuffer(low, np.uint8)]
    space = data == 0x20
    keep = ~space
    keep[:1] = True
    keep[1:] |= ~space[:-1]
    return data[keep]


def slices(text: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut between code points."""
    at = 0
    while at < len(text):
        to = min(at + SLICE, len(text))
        while to < len(text) and text[to] & 0xC0 == 0x80:
            to += 1
        yield text[at:to]
        at = to


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # BINS x bits
    bit_weight: np.ndarray
    scale: np.ndarray
    ambiguous_below: float = 0.1

    def margins(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for part in slices(text):
            counts = np.zeros(BINS, np.int64)
            for bins in gram_bins(mapped(part)):
                counts += np.bincount(bins, minlength=BINS)
                n += len(bins)
            some = np.flatnonzero(counts)
            total += counts[some] @ self.weights[some]
        return total / max(n, 1)

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, whether the runner-up is about as near)."""
        loss = (self.bit_weight * np.exp(-np.clip(self.codes * (margins / self.scale), -4, 4))).sum(1)
        share = np.exp(-(loss - loss.min()) / self.bit_weight.sum() * 4)
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        gap = share[order[0]] - share[order[1]] if len(order) > 1 else 1.0
        return self.languages[order[0]], float(share[order[0]]), bool(gap < self.ambiguous_below)

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """`und` with score 0 for a null, a text without letters or a model without languages."""
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        return self.decode(self.margins(text))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n x bits of -1 and 1: every split of up to 6 classes, else random words far from each other."""
    if n <= 1:
        return np.ones((n, 1), int)
    if n <= 6:
        return np.array([[1 if (k >> c) & 1 else -1 for k in range(1, 1 << n) if k & 1 and k != (1 << n) - 1] for c in range(n)])
    bits, best = int(np.ceil(10 * np.log2(n))), (-1, None)
    for draw in range(64):
        words = np.where(np.random.default_rng(seed + draw).random((n, bits)) < 0.5, -1, 1)
        apart = (bits - words @ words.T) // 2
        np.fill_diagonal(apart, bits)
        split = (np.abs(words.sum(0)) < n).all()
        if split and apart.min() > best[0]:
            best = (int(apart.min()), words)
    return best[1]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        for lang, text, copies in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            if text is None or not has_letter(text):
                continue
            counts = held.setdefault(lang, np.zeros(BINS, np.int64))
            for part in slices(text):
                for bins in gram_bins(mapped(part)):
                    counts += np.bincount(bins, minlength=BINS)
            texts[lang] = texts.get(lang, 0) + copies
    for lang, counts in held.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(some) + 1)), pa.array(np.append(some, -1)), pa.array(np.append(counts[some], texts[lang]))], ["lang", "bin", "n"])


def build(languages: list[str], counts: np.ndarray, smoothing: float = 0.5) -> Model:
    """Model from the n-gram counts of each language."""
    codes = codewords(len(languages))
    share = (counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * BINS)
    weights = np.zeros((BINS, codes.shape[1]))
    bit_weight, scale = np.ones(codes.shape[1]), np.ones(codes.shape[1])
    for b in range(codes.shape[1]):
        one, zero = codes[:, b] > 0, codes[:, b] < 0
        if one.any() and zero.any():
            weights[:, b] = np.log(share[one].mean(0)) - np.log(share[zero].mean(0))
            each = (share * weights[:, b]).sum(1) * codes[:, b]  # each language's mean margin on its own n-grams
            scale[b] = max(1e-6, np.abs(each).mean() / 2)
            bit_weight[b] = max(0.05, each.min() / max(1e-6, each.max()))
    return Model(languages, codes, weights.astype(np.float32), bit_weight, scale)


def even_part(sizes: list[int], rows: int) -> int:
    """How many rows each of the rising `sizes` gives at most, so that they give `rows` in all; LEAST_ROWS at least."""
    left = rows
    for k, n in enumerate(sizes):
        if n * (len(sizes) - k) > left:
            return max(LEAST_ROWS, left // (len(sizes) - k))
        left -= n
    return max(LEAST_ROWS, rows)


def sampled(train: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int) -> tuple[DataFrame, dict[str, float]]:
    """(lang, text, copies) of at most sample_rows rows of `train`, and the share of each language's rows that this is.

    A language gives the rows with its least hashes of id and text, as many as each other one; one with fewer rows
    gives all. Rows that repeat id and text are one, however many there are, and null ids are told apart by
    their texts. A first pass counts each language's rows; the second keeps what may be among the least hashes.
    """
    known = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("_h")).filter("lang is not null")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    most = even_part(sorted(sizes.values()), sample_rows)
    bounds = {x: draw_bound(SPARE * most / n) for x, n in sizes.items() if n > SPARE * most}
    if bounds:
        bound = F.try_element_at(F.create_map(*(F.lit(v) for pair in bounds.items() for v in pair)), F.col("lang"))
        known = known.filter(bound.isNull() | (draw(F.col("_h")) < bound))
    once = known.groupBy("lang", "_h").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    least = once.withColumn("_place", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).filter(F.col("_place") <= most)
    return least.select("lang", "text", "copies"), {x: min(1.0, most / n) for x, n in sizes.items()}


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, min_texts: int = 5) -> Model:
    """Learn from `sampled` rows of `train`.

    Null languages are left out, and languages of fewer than min_texts texts in all of `train` unless none has more.
    Without any labelled text the model has no language and answers `und`.
    """
    chosen, share = sampled(train, id_col, text_col, lang_col, sample_rows)
    grams = arrow_map(chosen, _count_grams, "lang string, bin long, n long")
    rows = grams.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # languages x BINS at most
    texts = {r.lang: r.n for r in rows[rows["bin"] < 0].itertuples()}
    languages = sorted(x for x, n in texts.items() if n >= min_texts * share[x]) or sorted(texts)
    counts = np.zeros((len(languages), BINS))
    rows = rows[(rows["bin"] >= 0) & rows["lang"].isin(languages)]
    counts[rows["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(int), rows["bin"].to_numpy()] = rows["n"]
    return build(languages, counts)


def _predicted(shared, text_at: int, names: list[str], keep_known: bool) -> Callable:  # noqa: ANN001  a Spark broadcast
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            if keep_known and not model.languages:
                yield batch.filter(pa.array([x is not None and has_letter(x) for x in byte_rows(batch.column(text_at))], pa.bool_()))
                continue
            got = [model.predict(x) for x in byte_rows(batch.column(text_at))]
            if keep_known:
                yield batch.filter(pa.array([not (g[0] == UNKNOWN or g[2]) for g in got], pa.bool_()))
                continue
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*names, "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The `keep` columns of docs with lang_pred, score (0 to 1) and ambiguous for every whole text.

    Only the text is looked at. Null texts and texts without a letter are `und` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS x bits, whatever the corpus
    taken = docs.select(*keep, F.col(text_col).alias("_text"))
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    schema = StructType([*taken.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])
    return arrow_map(taken, _predicted(shared, len(keep), keep, False), schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a language and isn't ambiguous, with docs' columns as they are.

    A model without languages tells nothing of a text, and then every text with a letter stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_map(docs, _predicted(shared, docs.columns.index(text_col), docs.columns, True), docs.schema)
