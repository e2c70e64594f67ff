"""Best-fit packing of documents into token sequences, planned by linear grouping.

The planner sees only how many pieces there are of each length, at most `capacity` numbers, so its
work and memory don't grow with the corpus. Large lengths are sorted into groups of equal cardinality
and rounded up to their group's longest; the few sizes left are packed by a linear programme over
configurations (column generation, priced by a knapsack over the capacity); rounding the programme's
solution down gives whole bins, into which the actual lengths are put back. What the rounding left and
the small pieces then go, longest first, where they fit best. Bins stay run-length encoded throughout:
a run is (number of alike bins, their lengths), and a document finds its bin by its rank among the
pieces of its length.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formicary.functions.ordering import number_array
from formicary.llm.shared import arrow_map, byte_rows, materialize

#: Parts that all pieces are ranked in, for each partition that is set; a length of many pieces has many of them.
PARTS_A_PARTITION = 4
#: Words and lower-cased words that a worker remembers the ids of.
KNOWN_WORDS, KNOWN_CORES = 250_000, 400_000
#: Closing marks that are tokens of their own after a letter.
MARKS = frozenset((b".", b",", b"!", b"?", b";", b":"))
SEGMENT = 1 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- plan over the histogram of lengths -------------------------------------------------------


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth that fits, by an unbounded knapsack over the capacity."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    least = int(sizes.min())
    for room in range(least, capacity + 1):
        fits = sizes <= room
        gain = np.where(fits, best[np.maximum(room - sizes, 0)] + worth, -1.0)
        k = int(gain.argmax())
        best[room], took[room] = best[room - 1], -1
        if gain[k] > best[room] + 1e-12:
            best[room], took[room] = gain[k], k
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room >= least:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= int(sizes[took[room]])
    return float(best[capacity]), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """(configuration, how often) that cover the demand with least bins, fractions allowed.

    Revised simplex; each round prices the best configuration in the current duals.
    """
    width = np.array(sizes, np.int64)
    want = np.array(demand, float)
    basis = np.diag(capacity // width).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        amount = inverse @ want
        duals = np.ones(len(sizes)) @ inverse
        worth, pattern = _best_pattern(width, np.maximum(duals, 0), capacity)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ pattern
        up = step > 1e-10
        ratio = np.where(up, np.maximum(amount, 0) / np.where(up, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    amount = np.linalg.inv(basis) @ want
    return [(basis[:, k].astype(np.int64), float(x)) for k, x in enumerate(amount) if x > 1e-9]


def _grouped(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) runs, longest first, cut into groups of equal cardinality."""
    total = sum(n for _, n in lengths)
    bound = [total * (k + 1) // groups for k in range(groups)]
    out, now, seen, k = [], [], 0, 0
    for length, n in lengths:
        while n:
            while k < groups - 1 and seen >= bound[k]:
                k += 1
                if now:
                    out.append(now)
                    now = []
            take = min(n, bound[k] - seen) if k < groups - 1 else n
            now.append((length, take))
            seen, n = seen + take, n - take
    return [*out, now] if now else out


class _Supply:
    """The actual lengths of a group, handed out longest first in runs."""

    def __init__(self, runs: list[tuple[int, int]]) -> None:
        self.runs = [list(r) for r in runs]

    def take(self, n: int) -> list[tuple[int, int]]:
        out = []
        while n and self.runs:
            length, have = self.runs[0]
            got = min(n, have)
            out.append((length, got))
            n -= got
            if got == have:
                self.runs.pop(0)
            else:
                self.runs[0][1] -= got
        return out


def plan(histogram: dict[int, int], capacity: int, groups: int = 24, small: float = 0.125, loose: float = 1 / 256) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (number of bins, lengths in each) that hold every piece of the histogram.

    Lengths up to small * capacity are "small". A configuration that its actual lengths leave emptier
    than loose * capacity gives them back to the best-fit step. An empty histogram has no runs.
    """
    slack = int(loose * capacity)
    runs: list[tuple[int, tuple[int, ...]]] = []
    if histogram.get(capacity):
        runs.append((histogram[capacity], (capacity,)))
    small_limit = max(1, int(small * capacity))
    large = sorted(((x, n) for x, n in histogram.items() if small_limit < x < capacity and n), reverse=True)
    rest: defaultdict[int, int] = defaultdict(int, {x: n for x, n in histogram.items() if x <= small_limit and x < capacity})
    open_bins: defaultdict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    rooms: list[int] = []

    def put(count: int, held: tuple[int, ...]) -> None:
        room = capacity - sum(held)
        if room not in open_bins:
            insort(rooms, room)
        open_bins[room].append((count, held))

    if large:
        by_size: dict[int, list[tuple[int, int]]] = {}
        for group in _grouped(large, groups):
            by_size.setdefault(group[0][0], []).extend(group)
        sizes = list(by_size)
        supply = {s: _Supply(by_size[s]) for s in sizes}
        for pattern, amount in configurations(sizes, [sum(n for _, n in by_size[s]) for s in sizes], capacity):
            bins = int(amount + 1e-9)
            if not bins:
                continue
            slots = [supply[s].take(bins) for s, k in zip(sizes, pattern, strict=True) for _ in range(k)]
            edges = sorted({bins, *(int(x) for slot in slots for x in np.cumsum([n for _, n in slot]))})
            at = 0
            cursor = [[0, slot[0][1] if slot else 0] for slot in slots]
            for edge in edges:
                held = []
                for slot, c in zip(slots, cursor, strict=True):
                    while c[0] < len(slot) and c[1] <= at:
                        c[0] += 1
                        c[1] += slot[c[0]][1] if c[0] < len(slot) else 0
                    if c[0] < len(slot):
                        held.append(slot[c[0]][0])
                if capacity - sum(held) <= slack:
                    put(edge - at, tuple(held))
                else:
                    for length in held:
                        rest[length] += edge - at
                at = edge
        for s in supply.values():
            for length, n in s.runs:
                rest[length] += n
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n >= each:
                    put(n // each, (length,) * each)
                    n %= each
                if n:
                    put(1, (length,) * n)
                break
            room = rooms[at]
            count, held = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            each = min(room // length, max(1, n // count))
            filled = min(count, n // each)
            put(filled, held + (length,) * each)
            if count > filled:
                put(count - filled, held)
            n -= filled * each
    return runs + [run for room in sorted(open_bins) for run in open_bins[room]]


def seats(runs: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length sit: sorted by (length, first rank); `base` is the first's bin."""
    rows: list[tuple[int, int, int, int]] = []
    used: defaultdict[int, int] = defaultdict(int)
    base = 0
    for count, held in runs:
        offset = 0
        for length in held:
            rows.append((length, used[length], base, offset))
            used[length] += count
            offset += length
        base += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "base": table[:, 2], "offset": table[:, 3]}


# --- tokens -----------------------------------------------------------------------------------


class WordIds(dict):
    """Ids of white-space separated words as little-endian bytes, remembered up to a bound.

    The tokenizer drops ASCII white space and no token or added token crosses it, so the ids of a text
    are those of its words one after the other. It also lower-cases and never joins a letter with
    punctuation, so a word with a closing mark has the ids of its core, then those of the mark.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.cores: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def _of(self, text: bytes) -> bytes:
        found = self.cores.get(text)
        if found is None:
            if text.isalpha():  # lower-case ASCII letters are one unit for the model, with nothing to normalise
                ids = [t.id for t in self.model.tokenize(text.decode())]
            else:
                ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.cores) < KNOWN_CORES:
                self.cores[text] = found
        return found

    def __missing__(self, word: bytes) -> bytes:
        core, mark = (word[:-1], word[-1:]) if word[-1:] in MARKS else (word, b"")
        if core.isalpha():  # ASCII letters only
            found = self._of(core.lower())
        elif mark and core and "\xc0" <= (last := core.decode()[-1]) <= "\u024f" and last.lower().isalpha():
            found = self._of(core)
        else:
            core, mark = word, b""
            found = self._of(word)
        if mark:
            found += self._of(mark)
        if len(self) < KNOWN_WORDS:
            self[word] = found
        return found

    def encode(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, words))


_workers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


def _segments(text: bytes) -> Iterator[bytes]:
    """Parts of about SEGMENT bytes, cut at ASCII white space."""
    at = 0
    while at < len(text):
        to = min(at + SEGMENT, len(text))
        while to < len(text) and text[to] not in b" \t\n\r\x0b\x0c":
            to += 1
        yield text[at:to]
        at = to


def token_bytes(text: bytes, ids: WordIds) -> Iterator[bytes]:
    """The ids of a text, then id 0, part by part."""
    for part in _segments(text):
        yield ids.encode(part.split())
    yield b"\0\0\0\0"


def cut(parts: Iterator[bytes], capacity: int) -> Iterator[bytes]:
    """Pieces of capacity ids; only one piece is held at a time."""
    held = bytearray()
    for part in parts:
        held += part
        while len(held) >= 4 * capacity:
            yield bytes(held[: 4 * capacity])
            del held[: 4 * capacity]
    if held:
        yield bytes(held)


def _piece_batches(path: str, capacity: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), strict=True):
                for k, piece in enumerate(cut(token_bytes(text or b"", ids), capacity)):
                    for column, value in zip(out, (doc, k, k * capacity, len(piece) // 4, zlib.crc32(piece), np.frombuffer(piece, "<u4") if with_ids else None), strict=True):
                        column.append(value)
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int64) for x in out[5]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids and a closing 0, cut into pieces of at most `capacity`.

    A null text counts as empty (one piece, the 0 alone). Other columns of docs are left out, so
    their names can't clash.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(narrow, _piece_batches(tokenizer, capacity, with_ids), PIECES + (", ids array<long>" if with_ids else ""))


def _seated(table: dict[str, np.ndarray], bases: dict[int, np.ndarray], names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(table["length"], np.arange(int(table["length"].max()) + 2 if len(table["length"]) else 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            part, place = batch.column("_part").to_numpy(), batch.column("_place").to_numpy()
            rank, at = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for value in np.unique(length):
                rows = length == value
                rank[rows] = bases[int(value)][part[rows]] + place[rows] - 1
                lo, hi = first[value], first[value + 1]
                at[rows] = lo + np.searchsorted(table["rank"][lo:hi], rank[rows], side="right") - 1
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(table["base"][at] + rank - table["rank"][at]), pa.array(table["offset"][at])], [*names, "sequence_id", "offset"])

    return run


def part_counts(histogram: dict[int, int], parts: int) -> dict[int, int]:
    """In how many parts the pieces of each length are ranked: `parts` for all, in proportion, one at least."""
    total = sum(histogram.values())
    return {length: max(1, -(-n * parts // total)) for length, n in histogram.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, groups: int = 24, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens; one row per piece.

    doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset. Null texts are empty
    documents; a null id stays null; repeated rows are packed each for itself (their places are
    exchangeable); an empty table gives no rows. Nothing is dropped or shortened.

    A piece's rank among those of its length is its place in its part and the size of the parts before. The driver
    holds the size of each part: `capacity` numbers and PARTS_A_PARTITION for each partition, whatever the corpus.
    """
    cut_up = materialize(pieces(docs, tokenizer, capacity, id_col, text_col, with_ids), "pieces")
    histogram = {int(r["length"]): int(r["count"]) for r in cut_up.groupBy("length").count().collect()}  # at most `capacity` rows
    table = seats(plan(histogram, capacity, groups))
    parts = part_counts(histogram, PARTS_A_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_length = number_array([parts.get(k, 1) for k in range(capacity + 1)], "int")
    dealt = cut_up.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(by_length, F.col("length").cast("int"))).cast("int"))
    bases = {length: np.zeros(n, np.int64) for length, n in parts.items()}
    for r in dealt.groupBy("length", "_part").count().collect():  # at most the sum of `parts`
        bases[r["length"]][r["_part"]] = r["count"]
    bases = {length: np.cumsum(n) - n for length, n in bases.items()}
    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("_place", F.row_number().over(within))
    names = cut_up.columns
    schema = PIECES + (", ids array<long>" if with_ids else "") + ", sequence_id long, offset long"
    return arrow_map(ranked.select(*names, "_part", "_place"), _seated(table, bases, names), schema)
