"""Line dedup by a sharded minimal perfect hash.

Lines are keyed by 128 bits of their normal form. One aggregation finds the keys that occur in enough
documents; they are dealt to shards of bounded size, and each shard becomes a minimal perfect hash with
compact arrays: fingerprints of FINGER_BITS, saturated document counts, and keepers (the largest document id that
holds the line) as offsets of the least width. A line is dropped where its fingerprint is in its place, its count
is large enough and its keeper is another document; a line that isn't in the index passes for one that is with
probability 2**-FINGER_BITS.

Where all arrays fit in `broadcast_bytes`, documents probe them as they stream by: no line is joined and no
text is shuffled. Beyond that the keys of the documents' lines are dealt to the shards, probed there, and what
is to be dropped goes back to its document: one more pass, and one shuffle of the texts, whatever the index's size.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formicary.functions.ordering import MAX_RANGES
from formicary.llm.perfect_hash import PerfectHash
from formicary.llm.shared import HOT_KEYS, arrow_map, byte_rows, discard, join_spread, materialize, unused

SPACE = b" \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 50_000
FINGER_BITS = 48
_MIX = np.uint64(0x9FB21C651E98DF25)
NO_ID = -(1 << 63)


def _mixed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """64 bits of a key for the perfect hash: two lines may agree in their first 64."""
    return hi.view(np.uint64) ^ (lo.view(np.uint64) * _MIX)


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()))) if len(values) else values


@dataclass
class Shard:
    """Index of one shard: place by perfect hash, then fingerprint (in two parts), count and keeper."""

    places: PerfectHash
    low: np.ndarray
    high: np.ndarray
    counts: np.ndarray
    keepers: np.ndarray
    least_keeper: int

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, n_docs: np.ndarray, keeper: np.ndarray, enough: int) -> Shard:
        """Over distinct keys; counts are kept up to `enough`, so it may be asked for so many documents or fewer."""
        keys = _mixed(hi, lo)
        places = PerfectHash.build(keys)
        order = np.empty(len(keys), np.int64)
        order[places.index(keys)] = np.arange(len(keys))
        finger, least = lo.view(np.uint64)[order], int(keeper.min()) if len(keeper) else 0
        offsets = keeper[order].view(np.uint64) - np.array([least], np.int64).view(np.uint64)
        return cls(places, finger.astype(np.uint32), (finger >> np.uint64(32)).astype(np.uint16), _narrow(np.minimum(n_docs[order], enough)), _narrow(offsets), least)

    def dropped(self, hi: np.ndarray, lo: np.ndarray, doc_ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether each line is in the index, found in min_docs documents, and kept by another one than its own."""
        at = self.places.index(_mixed(hi, lo))
        finger = lo.view(np.uint64)
        known = (at >= 0) & (self.low[at] == finger.astype(np.uint32)) & (self.high[at] == (finger >> np.uint64(32)).astype(np.uint16)) & (self.counts[at] >= min_docs)
        keeper = (self.keepers[at].astype(np.uint64) + np.array([self.least_keeper], np.int64).view(np.uint64)).view(np.int64)
        return known & (keeper != doc_ids)


def line_key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """The 128-bit key of a line as two signed numbers; None if its normal form is too short."""
    line = line.strip(SPACE).lower()
    n = len(line)
    if n < min_chars or (n < 4 * min_chars and not line.isascii() and len(line.decode()) < min_chars):
        return None
    value = xxhash.xxh3_128_intdigest(line)
    hi, lo = value >> 64, value & 0xFFFFFFFFFFFFFFFF
    return hi - (1 << 64) if hi >> 63 else hi, lo - (1 << 64) if lo >> 63 else lo


def keys_in(text: bytes | None, min_chars: int) -> set[tuple[int, int]]:
    """The distinct keys of a text's lines."""
    if not text or len(text) < min_chars:
        return set()
    keys = {line_key(x, min_chars) for x in text.split(b"\n")}
    keys.discard(None)
    return keys


def _keys_of(min_chars: int) -> Callable:
    """(hi, lo, then the batch's columns but the last, which is the text) for each distinct key of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [keys_in(text, min_chars) for text in byte_rows(batch.column(batch.num_columns - 1))]
            keys = np.array([k for x in found for k in x], np.int64).reshape(-1, 2)
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            others = [c.take(rows) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), *others], ["hi", "lo", *batch.schema.names[:-1]])

    return run


def frequent_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(hi, lo, n_docs, keeper) of the line keys found in at least min_docs documents.

    Documents are told apart by id; rows without an id count as one document and never keep a line.
    """
    keys = arrow_map(docs, _keys_of(min_chars), "hi long, lo long, doc_id long")
    once = keys.groupBy("hi", "lo", "doc_id").agg(F.lit(1).alias("_one"))
    return once.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("keeper")).filter(F.col("n_docs") >= min_docs)


def _build_shard(enough: int) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.build(*(rows[c].to_numpy(np.int64) for c in ("hi", "lo", "n_docs", "keeper")), enough)
        content = pickle.dumps(shard)
        return pd.DataFrame({"shard": [int(rows["_shard"].iloc[0])], "content": [content], "bytes": [len(content)]})

    return run


def build_index(lines: DataFrame, n_shards: int, enough: int = 5) -> DataFrame:
    """One row per shard that has keys: (shard, content, bytes)."""
    dealt = lines.withColumn("_shard", F.pmod("hi", F.lit(n_shards)).cast("long"))
    return dealt.groupBy("_shard").applyInPandas(_build_shard(enough), "shard long, content binary, bytes long")


class Probe:
    """Shards that are at hand, asked for many lines at a time."""

    def __init__(self, n_shards: int, shards: dict[int, Shard], min_docs: int) -> None:
        self.n_shards, self.shards, self.min_docs = n_shards, shards, min_docs

    def dropped(self, keys: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
        """Whether each line (hi, lo) of a document is to be dropped."""
        out = np.zeros(len(keys), bool)
        if not self.shards or not len(keys):
            return out
        hi, lo = np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])
        shard_of = np.mod(hi, self.n_shards)
        for number in np.unique(shard_of):
            if (shard := self.shards.get(int(number))) is not None:
                rows = np.flatnonzero(shard_of == number)
                out[rows] = shard.dropped(hi[rows], lo[rows], doc_ids[rows], self.min_docs)
        return out


def _ids(column: pa.Array) -> np.ndarray:
    """Document ids; rows without one are a document that keeps no line."""
    return column.cast(pa.int64()).fill_null(NO_ID + 1).to_numpy()


def _without(columns: list, text_at: int, texts: list, lose: dict[int, set[int]]) -> list:
    """Batch columns, the last of which counts dropped lines, with the lines (by row: their places) taken out of the texts."""
    dropped = np.zeros(len(texts), np.int64)
    for row, drop in lose.items():
        dropped[row] = len(drop)
        texts[row] = b"\n".join([x for k, x in enumerate(texts[row].split(b"\n")) if k not in drop])
    columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
    columns[-1] = pa.array(dropped)
    return columns


def _drop_lines(shared, n_shards: int, min_chars: int, min_docs: int, id_at: int, text_at: int) -> Callable:  # noqa: ANN001  a Spark broadcast
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(n_shards, {k: pickle.loads(v) for k, v in shared.value.items()}, min_docs)
        for batch in batches:
            texts = list(byte_rows(batch.column(text_at)))
            keys, owners, spots = [], [], []
            for row, text in enumerate(texts):
                if not text or len(text) < min_chars:
                    continue
                for spot, line in enumerate(text.split(b"\n")):
                    if len(line) >= min_chars and (key := line_key(line, min_chars)):
                        keys.append(key)
                        owners.append(row)
                        spots.append(spot)
            gone = probe.dropped(np.array(keys, np.int64).reshape(-1, 2), _ids(batch.column(id_at))[np.array(owners, np.int64)])
            lose: dict[int, set[int]] = {}
            for k in np.flatnonzero(gone):
                lose.setdefault(owners[k], set()).add(spots[k])
            yield pa.RecordBatch.from_arrays(_without(list(batch.columns), text_at, texts, lose), batch.schema.names)

    return run


def _probe_shards(min_docs: int) -> Callable:
    """(row, key) of the probes that are to be dropped; each shard's content comes before its probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for batch in batches:
            at, kinds = batch.column("_shard").to_numpy(), batch.column("_kind").to_numpy()
            found = []
            for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1) if len(at) else []:
                if at[rows[0]] != number:
                    number, shard = at[rows[0]], None
                for k in rows[kinds[rows] == 0]:
                    shard = pickle.loads(batch.column("content")[int(k)].as_py())
                asked = rows[kinds[rows] == 1]
                if shard is not None and len(asked):
                    part = batch.take(pa.array(asked))
                    gone = shard.dropped(part.column("hi").to_numpy(), part.column("lo").to_numpy(), _ids(part.column("doc_id")), min_docs)
                    found.append(part.filter(pa.array(gone)).select(["row", "doc_id", "hi", "lo"]))
            yield from found

    return run


def _take_out(min_chars: int, id_at: int, text_at: int, gone: str) -> Callable:
    """The texts without the lines whose keys are listed for their document in the last column but one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = list(byte_rows(batch.column(text_at))), batch.column(id_at).cast(pa.int64()).to_pylist()
            lose = {}
            for row, listed in enumerate(batch.column(gone).to_pylist()):
                if listed:
                    keys = {(x["hi"], x["lo"]) for x in listed if x["doc_id"] == ids[row]}  # rows' hashes may agree by chance
                    lose[row] = {k for k, x in enumerate(texts[row].split(b"\n")) if line_key(x, min_chars) in keys}
            columns = _without([c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != gone], text_at, texts, lose)
            yield pa.RecordBatch.from_arrays(columns, [n for n in batch.schema.names if n != gone])

    return run


def _dealt(out: DataFrame, lines: DataFrame, index: DataFrame, n_shards: int, min_chars: int, min_docs: int, id_col: str, text_col: str) -> DataFrame:
    """`out` without repeated lines, by keys that are dealt to the shards.

    The HOT_KEYS lines of most documents have an index of their own, which is broadcast: their keys aren't dealt.
    """
    spark = out.sparkSession
    first = lines.orderBy(F.desc("n_docs"), "hi", "lo").limit(HOT_KEYS)
    hot = first.select("hi", "lo").collect()
    row, listed = unused("__row", out.columns), unused("__gone", out.columns)
    rows = out.withColumn(row, F.xxhash64(F.col(id_col).cast("long"), text_col))
    keys = arrow_map(rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _keys_of(min_chars), "hi long, lo long, row long, doc_id long")
    keeper = F.broadcast(first.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "keeper"))
    tagged = materialize(keys.join(keeper, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")), "left").drop("_hi", "_lo"), "line-keys") if hot else materialize(keys.withColumn("keeper", F.lit(None).cast("long")), "line-keys")
    at_once = tagged.filter(F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("doc_id"))).select("row", "doc_id", "hi", "lo")
    copies = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_shards))
    none = {"content": "binary", "row": "long", "doc_id": "long", "hi": "long", "lo": "long"}
    order = ["_shard", "_copy", "_kind", *none]
    probes = tagged.filter("keeper is null").select(F.pmod("hi", F.lit(n_shards)).alias("_shard"), F.pmod("row", F.lit(copies)).cast("int").alias("_copy"), F.lit(1).alias("_kind"), F.lit(None).cast("binary").alias("content"), "row", "doc_id", "hi", "lo")
    shards = index.select(F.col("shard").alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy"), F.lit(0).alias("_kind"), "content", *(F.lit(None).cast(t).alias(c) for c, t in none.items() if c != "content"))
    tasks = min(n_shards * copies, MAX_RANGES)
    dealt = probes.select(*order).union(shards.select(*order)).repartitionById(tasks, F.pmod(F.col("_shard") * copies + F.col("_copy"), F.lit(tasks)).cast("int")).sortWithinPartitions("_shard", "_copy", "_kind")
    gone = arrow_map(dealt, _probe_shards(min_docs), "row long, doc_id long, hi long, lo long").union(at_once)
    gone = materialize(gone.groupBy(F.col("row").alias(row)).agg(F.collect_set(F.struct("doc_id", "hi", "lo")).alias(listed)), "line-drops")
    joined = join_spread(rows, gone, row, [listed]).select(*out.columns[:-1], listed, out.columns[-1])
    return arrow_map(joined, _take_out(min_chars, out.columns.index(id_col), out.columns.index(text_col), listed), out.schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, broadcast_bytes: int = 64 << 20, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with the repeated lines taken out of its texts, and the columns n_lines and n_dropped.

    n_lines counts the lines before dropping; a null or empty text is one empty line and stays as it
    is. A line's key is stripped of ASCII white space at both ends, A-Z lower-cased; keys of at least
    min_chars code points in at least min_docs documents lose all lines but those of the largest
    document id (all of them there). Other columns pass unchanged, except that n_lines and n_dropped
    replace columns of these names. Rows with equal ids are one document; an empty table stays empty.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in (n_lines, n_dropped)]
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = materialize(frequent_lines(narrow, min_chars, min_docs), "lines")
    n_shards = max(1, -(-lines.count() // KEYS_PER_SHARD))
    index = materialize(build_index(lines, n_shards, min_docs), "line-index")
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(*kept, (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long").alias(n_lines), F.lit(0).cast("long").alias(n_dropped))
    if (index.agg(F.sum("bytes")).first()[0] or 0) > broadcast_bytes:
        return _dealt(out, lines, index, n_shards, min_chars, min_docs, id_col, text_col)
    content = {r["shard"]: bytes(r["content"]) for r in index.select("shard", "content").collect()}  # broadcast_bytes at most
    discard(lines, index)
    return arrow_map(out, _drop_lines(spark.sparkContext.broadcast(content), n_shards, min_chars, min_docs, kept.index(id_col), kept.index(text_col)), out.schema)
