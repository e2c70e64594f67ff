"""Near-duplicate groups by MinHash with tensored banding.

Two collections of m short bands are hashed per document, and a table key is a pair of one band from
each: m*m tables from 2*m bands. Two documents share a key if they agree on some band of either
collection, so the tables are met in two steps: rows are dealt by the band of the first collection, m of
them per document, and within such a bucket the key is completed by the bands of the second. Bands that no
other document has are left out before.

Documents with the same shingle set are one node. Within a bucket every member that shares a key with
the bucket's pivot is compared with it, on full sets; the links give components. Buckets whose other
members are still in several components are compared in full, but only across components, in blocks of bounded
weight that return spanning links; a bucket of more than a block is first split by its full keys. Within a block
two sets are looked at only if they share one of their rarest shingles, as sets that are similar enough must. So
every link between texts that share a key counts, and no step emits all pairs.

Rows meet nodes by joins that deal hot nodes and hot components at random.

A node is the 64-bit hash of its set: among n distinct sets two agree with probability n*n / 2**65.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from formicary.llm.components import components
from formicary.llm.shared import arrow_map, flat_bytes, join_spread, materialize, settle, unused, written
from formicary.llm.wordhash import distinct_sets, minhash, mix, permutations, windows, word_slices

#: Bands in each of the two collections, and minhashes in a band.
BANDS, ROWS = 12, 3
#: Shingles that one comparison block holds at most (unless one document alone has more).
BLOCK_SHINGLES = 2_000_000
#: Bits of the filter on candidate documents, at most: 1 MB, whatever the corpus.
FILTER_BITS = 1 << 23

SIGNATURE = "doc_id long, row long, n_shingles long, node long, halves array<long>"


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingle hashes, offsets by row) for runs of a batch's rows."""
    flat, offsets = flat_bytes(column)
    for lo, hi, words, counts in word_slices(flat, offsets):
        hashes, row, _ = windows(words, counts, size)
        yield lo, hi, *distinct_sets(hashes, row, hi - lo)


def nodes_of(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of each row's set (rows without shingles: 0)."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)])
    n = np.diff(offsets).astype(np.uint64)
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) + mix(n)).view(np.int64)


def halves_of(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """documents x 2*bands keys: the first `bands` belong to one collection, the rest to the other."""
    out = np.empty((len(mins), 2 * bands), np.uint64)
    for k in range(2 * bands):
        value = np.full(len(mins), (k + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for r in range(rows):
            value = mix(value ^ mins[:, k * rows + r].astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        # the lowest bit tells the collection
        out[:, k] = (value & np.uint64(0xFFFFFFFFFFFFFFFE)) | np.uint64(k >= bands)
    return out.view(np.int64)


def _signatures(size: int, bands: int, rows: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(2 * bands * rows, seed)
        for batch in batches:
            for lo, hi, sets, offsets in shingle_sets(batch.column(2), size):
                n = np.diff(offsets)
                halves = halves_of(minhash(sets, offsets, a, b), bands, rows)
                empty = n == 0
                listed = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * 2 * bands), pa.array(halves.ravel()))
                listed = pa.array([None if e else x for e, x in zip(empty, listed, strict=True)], pa.list_(pa.int64())) if empty.any() else listed
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(nodes_of(sets, offsets), mask=empty), listed], ["doc_id", "row", "n_shingles", "node", "halves"])

    return run


def _sets(size: int) -> Callable:
    """The sets of the texts whose set is the node's; two rows' hashes may agree by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets, offsets in shingle_sets(batch.column(2), size):
                part = batch.slice(lo, hi - lo)
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sets.view(np.int64)))], ["node", "second", "shingles"])
                yield out.filter(pa.array(part.column(0).to_numpy() == nodes_of(sets, offsets)))

    return run


def _candidate_sets(narrow: DataFrame, exemplars: DataFrame, size: int) -> DataFrame:
    """(node, second, shingles) of the nodes in exemplars (row, node, second), from a second look at one text of each.

    A bitmap over the hashed rows keeps most other texts from the shuffle, as long as it isn't too full for that;
    what it lets through meets the exemplars row by row, and only then are shingles hashed.
    """
    wanted = exemplars.count()
    likely = narrow
    if 2 * wanted <= FILTER_BITS:
        bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * wanted).bit_length()))
        slot = F.pmod("row", F.lit(bits))
        word, bit = F.expr("shiftright(_slot, 6)"), F.expr("shiftleft(1L, cast(_slot & 63 as int))")
        bitmap = exemplars.select(slot.alias("_slot")).groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))  # bits / 64 rows at most
        likely = narrow.withColumn("_slot", slot).join(F.broadcast(bitmap), word == F.col("_word")).filter(F.col("_bits").bitwiseAND(bit) != 0)
    texts = likely.select("row", "text").groupBy("row").agg(F.first("text").alias("text"))  # repeated rows are one
    return arrow_map(texts.join(exemplars, "row").select("node", "second", "text"), _sets(size), "node long, second array<long>, shingles array<long>")


class _Forest:
    def __init__(self, labels: np.ndarray) -> None:
        _, first, self.of = np.unique(labels, return_index=True, return_inverse=True)
        self.up = np.arange(len(first))

    def roots(self, rows: np.ndarray) -> np.ndarray:
        at = self.of[rows]
        while (self.up[at] != at).any():
            self.up[at] = self.up[self.up[at]]
            at = self.up[at]
        return at

    def root(self, k: int) -> int:
        return int(self.roots(np.array([k]))[0])

    def join(self, a: int, b: int) -> None:
        self.up[self.root(a)] = self.root(b)


class _Inverted:
    """Which rows hold each value of their lists."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray) -> None:
        self.n, self.offsets, self.values = len(offsets) - 1, offsets, values
        self.owner = np.repeat(np.arange(self.n), np.diff(offsets))
        order = np.argsort(values, kind="stable")
        sorted_, self.owners = values[order], self.owner[order]
        self.cut = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(values) else np.zeros(0, np.int64)
        self.width = np.diff(np.append(self.cut, len(sorted_)))
        self.which = np.empty(len(values), np.int64)
        self.which[order] = np.repeat(np.arange(len(self.cut)), self.width)

    def holders(self, y: int) -> np.ndarray:
        """The rows that hold a value of row y, once for each such value."""
        terms = self.which[self.offsets[y] : self.offsets[y + 1]]
        w = self.width[terms]
        return self.owners[np.repeat(self.cut[terms] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))]

    def common(self, y: int, rows: np.ndarray) -> np.ndarray:
        """How many values each of the rows has in common with row y."""
        if len(rows) > 32:
            return np.bincount(self.holders(y), minlength=self.n)[rows]
        own = self.values[self.offsets[y] : self.offsets[y + 1]]
        return np.array([np.isin(self.values[self.offsets[x] : self.offsets[x + 1]], own, assume_unique=True).sum() for x in rows], np.int64)

    def rarest(self, amount: np.ndarray) -> _Inverted:
        """The same of the `amount` rarest values of each row, in one order for all rows."""
        order = np.lexsort((self.which, self.width[self.which], self.owner))
        place = np.arange(len(order)) - self.offsets[self.owner]
        return _Inverted(self.values[order[place < amount[self.owner]]], np.concatenate([[0], np.cumsum(amount)]))


def spanning_links(nodes: np.ndarray, labels: np.ndarray, side: np.ndarray, seconds: _Inverted, sets: _Inverted, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the labels as all links between rows that share a key would.

    num/den is the least similarity. side: rows of different sides are compared, or all rows if there is
    one side only. Rows outside the most frequent label look for partners among the holders of their rarest
    shingles: of n shingles so similar sets share num/den*n at least, hence one of the n - that + 1 rarest of each.
    """
    n = np.diff(sets.offsets)
    heads = sets.rarest(np.where(n > 0, n + (-num * n) // den + 1, 0))
    forest = _Forest(labels)
    names, amount = np.unique(labels, return_counts=True)
    major = names[amount.argmax()]
    out = []
    one_side = side.min() == side.max()
    for y in np.flatnonzero(labels != major):
        rows = np.unique(heads.holders(y))
        rows = rows[(forest.roots(rows) != forest.root(y)) & (one_side | (side[rows] != side[y]))]
        if not len(rows):
            continue
        common = sets.common(y, rows)
        rows = rows[den * common >= num * (n[rows] + n[y] - common)]
        for x in rows[seconds.common(y, rows) > 0] if len(rows) else ():
            if forest.root(x) != forest.root(y):
                forest.join(x, y)
                out.append((int(nodes[y]), int(nodes[x])))
    return out


def _inverted(column: pa.ChunkedArray) -> _Inverted:
    lists = column.combine_chunks()
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return _Inverted(np.asarray(lists.values)[offsets[0] : offsets[-1]], offsets - offsets[0])


def _compare_blocks(num: int, den: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        links = spanning_links(*(table.column(c).to_numpy() for c in ("node", "label", "_side")), _inverted(table.column("second")), _inverted(table.column("shingles")), num, den)
        return pa.table({"u": pa.array([x[0] for x in links], pa.int64()), "v": pa.array([x[1] for x in links], pa.int64())})

    return run


def _open(members: DataFrame) -> DataFrame:
    """(bucket, _weight) of the buckets of members (bucket, node, n, label) with several labels; of those with the same members, one."""
    state = members.groupBy("bucket").agg(F.count("*").alias("_n"), F.min("label").alias("_a"), F.max("label").alias("_b"), F.min("node").alias("_c"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.sum("n").alias("_weight")).filter("_a < _b")
    return state.groupBy("_n", "_c", "_x").agg(F.min("bucket").alias("bucket"), F.max("_weight").alias("_weight")).select("bucket", "_weight")


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, bands: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) between non-pivot members of a bucket that are in different components so far."""
    labelled = members.filter("node <> pivot").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).select("bucket", "node", "n", "label")
    once = materialize(_open(labelled), "open")
    open_ = labelled.join(once.filter(F.col("_weight") <= BLOCK_SHINGLES), "bucket")
    wide = once.filter(F.col("_weight") > BLOCK_SHINGLES).select("bucket")
    if not wide.isEmpty():  # by their full keys
        keyed = labelled.join(wide, "bucket").join(bands.select("node", F.explode("second").alias("_second")), "node")
        keyed = materialize(keyed.select(F.xxhash64("bucket", "_second").alias("bucket"), "node", "n", "label"), "keyed")
        open_ = open_.union(keyed.join(_open(keyed), "bucket"))
    open_ = open_.withColumn("_blocks", F.ceil(F.col("_weight") / BLOCK_SHINGLES).cast("int"))
    dealt = open_.withColumn("_side", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumn("_lo", F.least("_side", "_other")).withColumn("_hi", F.greatest("_side", "_other")).select("bucket", "_lo", "_hi", "node", "label", "_side")
    return dealt.join(sets, "node").groupBy("bucket", "_lo", "_hi").applyInArrow(_compare_blocks(num, den), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (80, 100), bands: int = BANDS, rows: int = ROWS, seed: int = 1, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of docs.

    A document's set: its distinct shingles of lower-cased words, the whole sequence as one if it has
    fewer; documents are linked if den * |intersection| >= num * |union|, on full sets. component_id is
    the smallest id that is reachable by links, itself included. Nulls, empty texts and texts without words
    have no shingles and link with nothing. kept: doc_id = component_id; rows without an id take part,
    are kept only where no row of their group has one, and repeated ids share their verdict if their
    texts are equal. An empty table gives no rows; other columns of docs are left out. carried: more columns
    to return, of node (the set's hash) and _group (that of the component).
    """
    since = written()
    narrow = rows_of(docs, id_col, text_col)
    found = materialize(arrow_map(narrow, _signatures(shingle, bands, rows, seed), SIGNATURE), "signatures")
    some = found.filter("node is not null")

    halves = some.select("node", F.col("n_shingles").alias("n"), F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).filter("_a < _b").select("half")
    live = halves.join(shared, "half", "left_semi")
    bands = live.groupBy("node").agg(F.max("n").alias("n"), F.collect_set(F.when(F.col("half") % 2 == 0, F.col("half"))).alias("first"), F.collect_set(F.when(F.col("half") % 2 != 0, F.col("half"))).alias("second"))
    return groups_of_bands(narrow, found.select("doc_id", "row", "n_shingles", "node"), bands.filter("size(first) > 0 and size(second) > 0"), shingle, similarity, since, carried)


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, text): row is a hash of both, the same for rows that repeat."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def groups_of_bands(narrow: DataFrame, found: DataFrame, bands: DataFrame, shingle: int, similarity: tuple[int, int], since: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for the links between documents that share a table key.

    narrow (doc_id, row, text) has the texts; found (doc_id, row, n_shingles, node) a row for each of them; bands
    (node, n, first, second) the shared bands of each node: a key is one of `first` with one of `second`. Only the
    result stays of the tables written since `written()` was `since`.
    """
    num, den = similarity
    bands = materialize(bands, "bands")
    rows = bands.select("node", "n", F.explode("first").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("_n"), F.min("node").alias("pivot"), F.max("node").alias("_last"), F.bit_xor(F.xxhash64("node")).alias("_x")).filter("_n > 1")
    buckets = buckets.groupBy("pivot", "_last", "_n", "_x").agg(F.min("bucket").alias("bucket")).select("bucket", "pivot")  # of buckets with the same members, one
    members = materialize(rows.join(buckets, "bucket"), "members")

    nodes = materialize(found.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row")), "nodes")
    exemplars = nodes.select("node", "row").join(members.select("node").distinct(), "node", "left_semi").join(bands.select("node", "second"), "node")
    sets = materialize(_candidate_sets(narrow, materialize(exemplars, "exemplars"), shingle), "sets")

    pairs = members.filter("node <> pivot").select("pivot", "node").distinct()
    keyed = pairs.join(bands.select(F.col("node").alias("pivot"), F.col("second").alias("_k")), "pivot").join(bands.select("node", "second"), "node").filter(F.arrays_overlap("_k", "second")).select("pivot", "node")
    both = keyed.join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("_p")), "pivot").join(sets.select("node", F.col("shingles").alias("_s")), "node")
    common = F.size(F.array_intersect("_p", "_s"))
    linked = both.withColumn("_common", common).filter(den * F.col("_common") >= num * (F.size("_p") + F.size("_s") - F.col("_common")))
    links = materialize(linked.select(F.col("pivot").alias("u"), F.col("node").alias("v")), "links")
    more = materialize(_across(members, components(links), sets, bands, num, den), "links")
    labels = components(links.union(more))

    grouped = materialize(nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("_group")), "groups")
    least = grouped.groupBy("_group").agg(F.min("doc_id").alias("_least"))
    named = join_spread(found, join_spread(grouped.select("node", "_group"), least, "_group", ["_least"]), "node", ["_group", "_least"])
    named = settle(named.select("doc_id", "n_shingles", *dict.fromkeys([*carried, "node", "_group", "_least"])), "named", since)
    out = named.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("_least")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), *carried)


def _noded(text_at: int, size: int, name: str) -> Callable:
    """The rows with their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets, offsets in shingle_sets(batch.column(text_at), size):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nodes_of(sets, offsets), mask=np.diff(offsets) == 0)], [*batch.schema.names, name])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the documents that have a near-duplicate with a smaller id; columns as they are.

    Rows that repeat an id are told apart by their texts: of those that are near-duplicates one stays, the rest
    are documents of their own. Rows without an id can't be named and stay.
    """
    since = written()
    verdicts = settle(near_duplicates(docs, id_col, text_col, carried=("node", "_group"), **how), "verdicts", since).filter("doc_id is not null")
    key = F.col(id_col).cast("long")
    dropped = verdicts.filter("not kept").select(F.col("doc_id").alias("__dropped_id")).distinct()
    repeated = materialize(verdicts.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return docs.join(dropped, key == F.col("__dropped_id"), "left_anti")

    named = repeated.select(F.col("doc_id").alias("__repeated_id"))
    once = docs.join(named.union(dropped).distinct(), key == F.col("__repeated_id"), "left_anti")
    # a group's document is that with its least id and, of that id's texts, the least node
    chosen = verdicts.join(repeated, "doc_id", "left_semi").filter("kept and node is not null").groupBy("_group").agg(F.min("doc_id").alias("__chosen_id"), F.min("node").alias("__chosen_node"))
    size = how.get("shingle", inspect.signature(near_duplicates).parameters["shingle"].default)
    node = unused("__node", docs.columns)
    again = docs.join(named, key == F.col("__repeated_id"), "left_semi")
    again = arrow_map(again, _noded(docs.columns.index(text_col), size, node), StructType([*docs.schema.fields, StructField(node, LongType())]))
    again = materialize(again, "again")
    first = F.struct(F.col(text_col), F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind)))
    row = F.min_by(F.struct(*docs.columns), first).alias("_row")
    found = again.join(chosen, (key == F.col("__chosen_id")) & (F.col(node) == F.col("__chosen_node"))).groupBy("__chosen_id", "__chosen_node").agg(row).select("_row.*")
    return once.union(again.filter(F.col(node).isNull()).select(*docs.columns)).union(found)
