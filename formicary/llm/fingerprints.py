"""MinHash fingerprints of documents.

A fingerprint holds, for each member of a family of universal hash functions, the lowest byte of the
least hash over the text's shingles. Two fingerprints agree on a share of their bytes that estimates the
Jaccard similarity of the shingle sets, after taking out the agreement by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formicary.llm.neardup import groups_of_bands, nodes_of, rows_of, shingle_sets
from formicary.llm.ranges import descending_with_next
from formicary.llm.shared import arrow_map, materialize, written
from formicary.llm.wordhash import minhash, mix, permutations

PERMUTATIONS = 128
SHINGLE = 5
CHANCE = 1 / 256
#: Bands of the signature that are joined, and rows in each: .8**4 finds 999,999 of a million at 0.8.
BANDS, ROWS = 32, 4


def fingerprints(column: pa.Array, seed: int = 2) -> np.ndarray:
    """rows x PERMUTATIONS bytes. Texts without words (and nulls) have all bytes 255."""
    a, b = permutations(PERMUTATIONS, seed)
    out = np.full((len(column), PERMUTATIONS), 255, np.uint8)
    for lo, hi, sets, offsets in shingle_sets(column, SHINGLE):
        out[lo:hi] = minhash(sets, offsets, a, b).astype(np.uint8)
    return out


def as_text(prints: np.ndarray) -> list[str]:
    whole = prints.tobytes().hex()
    return [whole[k : k + 2 * PERMUTATIONS] for k in range(0, len(whole), 2 * PERMUTATIONS)]


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity by row, from 0 to 1; equal fingerprints have 1."""
    return np.maximum((one == two).mean(1) - CHANCE, 0) / (1 - CHANCE)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _with_edited(single: bool) -> Callable:
    """single: there is one range, whose last row is followed by its own first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_next: str | None = None
        held: tuple[list, list] = ([], [])

        def out(ids: list, texts: list[str], after: str) -> pa.RecordBatch:
            changed = [edited(x, y) for x, y in zip(texts, [*texts[1:], after], strict=True)]
            own = fingerprints(pa.array([*texts, after], pa.string()))
            other = fingerprints(pa.array(changed, pa.string()))
            columns = [pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed])]
            columns += [pa.array(as_text(own[:-1])), pa.array(as_text(other)), pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:]))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, text, ghost in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("_ghost").to_pylist(), strict=True):
                    if ghost:
                        last_next = text if last_next is None else last_next
                        continue
                    if single and last_next is None:
                        last_next = text
                    held[0].append(doc)
                    held[1].append(text)
                if len(held[0]) > 1:
                    ids, texts = held[0][:-1], held[1][:-1]
                    after = held[1][-1]
                    held = ([held[0][-1]], [after])
                    yield out(ids, texts, after)
        if held[0]:
            yield out(*held, last_next or "")

    return run


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are; one row per row of docs.

    The next document is that with the next smaller id (after the last: the first); nulls come last,
    equal ids by text. Null texts are empty; a text without words is like any other without words (1)
    and unlike the rest (0). A single row follows itself. Other columns of docs are left out.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt, ranges = descending_with_next(narrow, "doc_id", "text")
    return arrow_map(dealt, _with_edited(ranges == 1), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _banded(seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(PERMUTATIONS, seed)
        for batch in batches:
            for lo, hi, sets, offsets in shingle_sets(batch.column(2), SHINGLE):
                mins = minhash(sets, offsets, a, b).astype(np.uint64)
                bands = np.empty((hi - lo, BANDS), np.uint64)
                for k in range(BANDS):
                    value = np.full(hi - lo, k + 1, np.uint64)
                    for r in range(ROWS):
                        value = mix(value ^ mins[:, k * ROWS + r]) + np.uint64(k)
                    bands[:, k] = value
                empty = np.diff(offsets) == 0
                listed = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(nodes_of(sets, offsets), mask=empty), listed], ["doc_id", "row", "n_shingles", "node", "bands"])

    return run


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = (80, 100), seed: int = 2) -> DataFrame:
    """Groups of documents by joining signature bands and verifying the Jaccard similarity.

    doc_id, n_shingles, component_id and kept, as `neardup.near_duplicates` has them.
    """
    since = written()
    narrow = rows_of(docs, id_col, text_col)
    found = materialize(arrow_map(narrow, _banded(seed), "doc_id long, row long, n_shingles long, node long, bands array<long>"), "bands")
    banded = found.filter("node is not null").select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).filter("_a < _b").select("key")
    live = banded.join(shared, "key", "left_semi").groupBy("node").agg(F.max("n").alias("n"), F.collect_set("key").alias("first"))
    bands = live.withColumn("second", F.array(F.lit(0).cast("long")))  # one band makes a key here
    return groups_of_bands(narrow, found.select("doc_id", "row", "n_shingles", "node"), bands, SHINGLE, similarity, since)
