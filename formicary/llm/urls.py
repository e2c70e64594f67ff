"""URL filter lists as a sort-merge range join on reversed-host keys.

`www.example.net/en/x` has the key `net.example.www./en/x`, so a rule's host and all its subdomains are
one interval of keys. Rules and URLs are dealt to the same key ranges (a rule to every range that its
interval meets), sorted, and swept once: the sweep keeps a stack of the rule hosts that enclose the
present key, each inside the one below it, and asks them for their longest fitting path.

Range bounds are quantiles of a bounded sample of keys; they decide where rows go, not what comes out.
A key that fills several ranges is spread over them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from formicary.functions.ordering import range_count, range_number, sampled_quantiles
from formicary.llm.shared import arrow_map

#: Characters of a bound: the beginning of a long key is a bound, too.
BOUND_CHARS = 500
ROWS_PER_RANGE = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """`www.example.net` as `net.example.www.`: a prefix of it ends at a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class ActiveRules:
    """The rules that enclose the sweep's present key, innermost host on top."""

    def __init__(self) -> None:
        self.stack: list[tuple[bytes, dict[bytes, tuple[str, str]], list[int]]] = []

    def _leave(self, key: bytes) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def enter(self, host_key: bytes, path: bytes, rule: str, action: str) -> None:
        self._leave(host_key)
        if not self.stack or self.stack[-1][0] != host_key:
            self.stack.append((host_key, {}, []))
        _, paths, lengths = self.stack[-1]
        paths[path] = max(paths.get(path, ("", "")), (action, rule))
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def longest(self, key: bytes, path: bytes) -> tuple[str, str] | None:
        """(action, rule) of the longest host + path that fits; of equal ones, that of the longer host."""
        self._leave(key)
        best, size = None, -1
        for host_key, paths, lengths in reversed(self.stack):
            for n in lengths:
                if n <= len(path) and (found := paths.get(path[:n])):
                    if len(host_key) + n > size:
                        best, size = found, len(host_key) + n
                    break
        return best


def _sweep(kept: list[str], default: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = ActiveRules()
        for batch in batches:
            keys, kinds = batch.column("_key").cast(pa.binary()).to_pylist(), batch.column("_kind").to_pylist()
            paths, rules, actions = batch.column("path").cast(pa.binary()).to_pylist(), batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
            rows, found = [], []
            for k, (key, kind) in enumerate(zip(keys, kinds, strict=True)):
                if kind == 0:
                    active.enter(key, paths[k], rules[k], actions[k])
                else:
                    rows.append(k)
                    found.append(active.longest(key, paths[k]) or (default, None))
            out = batch.take(pa.array(rows, pa.int64()))
            columns = [*(out.column(c) for c in kept), out.column("host"), out.column("path"), pa.array([f[1] for f in found], pa.string()), pa.array([f[0] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "host", "path", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, keep: list[str], url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """The `keep` columns of pages with host, path, rule and verdict for every row.

    rules has (action, host, path) and may be of any size; rows of it with a null are left out. The
    rule that fits with the most characters wins, of equal ones that of the longer host, of the same host
    and path `block` before `allow`. A null URL, or one without `://`, has an empty host and path, which
    only a rule with both empty would fit. Without a rule: null and the default verdict. Columns named host, path,
    rule or verdict aren't kept. Repeated rows are judged each; an empty table gives none.
    """
    kept = [c for c in keep if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(*kept, host.alias("host"), path.alias("path")).withColumn("_key", F.concat(reversed_host(F.col("host")), F.col("path")))
    n = pages.count()
    ranges = ranges or range_count(pages, n, ROWS_PER_RANGE)
    bounds = [x for x in sampled_quantiles(urls.select(F.left("_key", F.lit(BOUND_CHARS))), n, ranges) if "\x1f" not in x]
    first, last = range_number(F.col("_key"), bounds), range_number(F.col("_key"), bounds, True)
    dealt = urls.withColumn("_first", first).withColumn("_last", last).withColumn("_range", F.col("_first") + F.pmod(F.xxhash64(*kept, "path"), F.col("_last") - F.col("_first") + 1).cast("int"))
    dealt = dealt.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), "_key", F.lit(1).alias("_kind"), "_range")
    given = rules.select(F.col("action"), F.translate("host", UPPER, LOWER).alias("host"), F.col("path")).dropna().withColumn("_key", reversed_host(F.col("host")))
    end = F.concat(F.expr("substring(_key, 1, length(_key) - 1)"), F.lit("/"))  # the character after the dot
    spread = given.withColumn("_range", F.explode(F.sequence(range_number(F.col("_key"), bounds), range_number(end, bounds))))
    types = {f.name: f.dataType for f in pages.schema.fields}
    spread = spread.select(*(F.lit(None).cast(types[c]).alias(c) for c in kept), "host", "path", F.concat("host", "path").alias("rule"), F.col("action").alias("verdict"), "_key", F.lit(0).alias("_kind"), "_range")
    sorted_ = dealt.unionByName(spread).repartitionById(len(bounds) + 1, F.col("_range")).sortWithinPartitions("_key", "_kind")
    schema = StructType([*(StructField(c, types[c]) for c in kept), *(StructField(c, StringType()) for c in ("host", "path", "rule", "verdict"))])
    return arrow_map(sorted_, _sweep(kept, default), schema)
