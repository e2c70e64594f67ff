"""Quality rules as a learned decision list over text statistics.

The statistics are computed for every text; the list is learned by sequential covering from labelled
ones. Each rule is a conjunction of thresholds, grown by information gain on part of the sample and
pruned on the rest; rules that don't hold there end the learning. The list becomes one ordered Spark
conditional expression, so applying it needs no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formicary.llm.shared import arrow_map, byte_rows, draw, draw_bound, flat_bytes, materialize, unused
from formicary.llm.wordhash import PLAIN, mix, windows, word_slices

#: Labelled rows that the list is fitted on, at most so many (a hash of id and label chooses them).
SAMPLE_ROWS = 20_000

WS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: counts that the statistics hold for each text
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "n_punct", "n_distinct_words", "longest_word")
#: what thresholds are learned on
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "digit_share", "upper_share", "punct_share", "distinct_share", "longest_word", "words_per_line")

_DROP = {name: bytes(x) for name, x in {"ws": WS, "symbols": SYMBOLS, "digits": b"0123456789", "upper": bytes(range(65, 91)), "punct": b".,;:!?\"'()-"}.items()}


def repeated_words(words: np.ndarray, counts: np.ndarray, size: int = 5) -> np.ndarray:
    """By row, how many words stand in a window of `size` words that the row holds twice or more."""
    n_rows = len(counts) - 1
    per_row = np.diff(counts)
    if not (per_row >= size).any():
        return np.zeros(n_rows, np.int64)
    hashes, row, n = windows(words, counts, size)
    key = hashes ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= per_row[row] >= size
    ends = np.cumsum(n)
    at = counts[:-1][row] + np.arange(len(row)) - (ends - n)[row]
    covered = np.zeros(len(words) + size + 1, np.int64)
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + size, -1)
    total = np.concatenate([[0], np.cumsum((np.cumsum(covered)[: len(words)] > 0))])
    return total[counts[1:]] - total[counts[:-1]]


def _distinct(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
    key = np.unique(words ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    return np.bincount(row[key], minlength=len(counts) - 1)


def _line_counts(text: bytes) -> tuple[int, int]:
    """(lines, lines with a word that equal an earlier line)."""
    lines = text.split(b"\n")
    if len(lines) == 1:
        return 1, 0
    worded = [x for x in lines if x.strip(WS)]
    return len(lines), len(worded) - len(set(worded))


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text of a batch; a null text has no words and one line."""
    n = len(column)
    out = {c: np.zeros(n, np.int64) for c in COUNTS}
    flat, offsets = flat_bytes(column)
    for lo, hi, words, counts in word_slices(flat, offsets, PLAIN):
        out["n_words"][lo:hi] = np.diff(counts)
        out["n_repeat_words"][lo:hi] = repeated_words(words, counts)
        out["n_distinct_words"][lo:hi] = _distinct(words, counts)
    for k, text in enumerate(byte_rows(column)):
        text = text or b""
        size = len(text)
        gone = {name: size - len(text.translate(None, x)) for name, x in _DROP.items()}
        chars = size if text.isascii() else len(text.decode())
        out["word_chars"][k] = chars - gone["ws"]
        out["n_symbols"][k], out["n_digits"][k], out["n_upper"][k], out["n_punct"][k] = gone["symbols"], gone["digits"], gone["upper"], gone["punct"]
        out["n_lines"][k], out["n_dup_lines"][k] = _line_counts(text)
        out["longest_word"][k] = max(map(len, text.split()), default=0)
    return out


def _counted(text_at: int, names: list[str], added: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = text_counts(batch.column(text_at))
            columns = [c for name, c in zip(names, batch.columns, strict=True) if name is not None]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[c]) for c in COUNTS)], [*(x for x in names if x is not None), *added])

    return run


def with_counts(docs: DataFrame, text_col: str = "text", prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns of docs (all of them by default) and COUNTS, named with the prefix.

    Columns of docs that already have such a name are replaced.
    """
    added = [prefix + c for c in COUNTS]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    taken = docs.select(*kept, F.col(text_col).alias("_text")) if text_col not in kept else docs.select(*kept)
    names = [*kept, None] if text_col not in kept else list(kept)
    fields = [*(f for f in docs.schema.fields if f.name in kept)]
    fields.sort(key=lambda f: kept.index(f.name))
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*fields, *(StructField(x, LongType()) for x in added)])
    at = kept.index(text_col) if text_col in kept else len(kept)
    return arrow_map(taken, _counted(at, names, added), schema)


def features(prefix: str = "") -> dict[str, Column]:
    """FEATURES as expressions over the counts; shares of nothing are 0."""
    c = {x: F.col(prefix + x).cast("double") for x in COUNTS}

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    chars = c["word_chars"]
    return {
        "n_words": c["n_words"], "mean_word": share(chars, c["n_words"]), "symbol_share": share(c["n_symbols"], chars), "dup_line_share": share(c["n_dup_lines"], c["n_lines"]),
        "repeat_share": share(c["n_repeat_words"], c["n_words"]), "digit_share": share(c["n_digits"], chars), "upper_share": share(c["n_upper"], chars), "punct_share": share(c["n_punct"], chars),
        "distinct_share": share(c["n_distinct_words"], c["n_words"]), "longest_word": c["longest_word"], "words_per_line": share(c["n_words"], c["n_lines"]),
    }


# --- learning ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """Reject if every (feature, above, threshold) holds: above means value >= threshold, else <=."""

    terms: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, at in self.terms:
            out &= x[name] >= at if above else x[name] <= at
        return out

    def condition(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, at in self.terms:
            out = out & (columns[name] >= F.lit(at) if above else columns[name] <= F.lit(at))
        return out


def _gain(bad: np.ndarray, all_: np.ndarray, bad0: float, all0: float) -> np.ndarray:
    """First-order information gain of narrowing (bad0 of all0) to (bad of all_)."""
    return bad * (np.log2((bad + 1e-9) / np.maximum(all_, 1e-9)) - np.log2(max(bad0, 1e-9) / max(all0, 1e-9)))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_terms: int) -> list[tuple[str, bool, float]]:
    terms: list[tuple[str, bool, float]] = []
    live = np.ones(len(bad), bool)
    while len(terms) < max_terms and bad[live].any() and not bad[live].all():
        best = (1e-6, None)
        for name in x:
            values, flags = x[name][live], bad[live]
            order = np.argsort(values, kind="stable")
            v, f = values[order], np.cumsum(flags[order])
            n, total = np.arange(1, len(v) + 1), f[-1]
            edge = np.flatnonzero(v[1:] != v[:-1])
            if not len(edge):
                continue
            middle = (v[edge] + v[edge + 1]) / 2
            for above, got, of in ((False, f[edge], n[edge]), (True, total - f[edge], len(v) - n[edge])):
                gain = _gain(got, of, total, len(v))
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (name, above, float(middle[k])))
        if best[1] is None:
            break
        terms.append(best[1])
        name, above, at = best[1]
        live &= x[name] >= at if above else x[name] <= at
    return terms


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.95, min_covered: int = 5, max_rules: int = 16, max_terms: int = 4, seed: int = 7) -> list[Rule]:
    """An ordered list of rejecting rules, none if nothing separates the labels.

    A third of the rows prunes: terms are cut from the end where that raises (bad - good) / covered, and
    a rule must be right on at least min_precision of min_covered or more rows there and overall.
    """
    rules: list[Rule] = []
    x = {k: np.asarray(v, float) for k, v in x.items()}
    bad = np.asarray(bad, bool)
    draw = np.random.default_rng(seed)
    live = np.arange(len(bad))
    while len(rules) < max_rules and bad[live].sum() >= min_covered:
        order = draw.permutation(live)
        grow, prune = order[: 2 * len(order) // 3], order[2 * len(order) // 3 :]
        terms = _grow({k: v[grow] for k, v in x.items()}, bad[grow], max_terms)
        best = (-2.0, 0)
        held = {k: v[prune] for k, v in x.items()}
        for n in range(1, len(terms) + 1):
            on = Rule(tuple(terms[:n]), 0, 0).holds(held)
            worth = (2 * bad[prune][on].sum() - on.sum()) / max(1, on.sum())
            if worth > best[0] + 1e-9:
                best = (worth, n)
        if not best[1]:
            break
        rule = Rule(tuple(terms[: best[1]]), 0, 0)
        on, every = rule.holds(held), rule.holds({k: v[live] for k, v in x.items()})
        precision = bad[live][every].mean() if every.any() else 0.0
        if every.sum() < min_covered or precision < min_precision or (on.any() and bad[prune][on].mean() < min_precision):
            break
        rules.append(Rule(rule.terms, float(precision), int(every.sum())))
        live = live[~every]
    return rules


def verdict(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """Number of the first rule that holds (from 1), 0 if none does, as one conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = (F.when if out is None else out.when)(rule.condition(columns), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed(prefix: str = "") -> Column:
    """The fixed minimum: ten words, and at most a fifth of the words in repeated windows."""
    n = F.col(prefix + "n_words")
    return (n < 10) | (100 * F.col(prefix + "n_repeat_words") > 20 * n)


def sampled_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(_label_id, _label): the distinct labels with the least hashes, at most sample_rows.

    Null ids and null labels are left out; an id with several labels gives a row for each. The bound holds for
    labels of any size and with any repeats, so its rows may be broadcast.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_label_id"), F.col(label_col).cast("int").alias("_label")).filter("_label_id is not null and _label is not null").withColumn("_h", F.xxhash64("_label_id", "_label"))
    distinct = known.agg(F.approx_count_distinct("_h")).first()[0]
    likely = known.filter(draw(F.col("_h")) <= draw_bound(1.5 * sample_rows / max(1, distinct)))
    return likely.distinct().orderBy("_h", "_label_id", "_label").limit(sample_rows).drop("_h")


def fit(counted: DataFrame, known: DataFrame, id_col: str = "doc_id", prefix: str = "", sample_rows: int = SAMPLE_ROWS, **how) -> list[Rule]:
    """Learn from the rows of `counted` with a label in `known` that pass the fixed minimum (label 0 is bad).

    Only their features come to the driver, of rows that are alike in id, label and features one, and of more than
    sample_rows (ids can repeat) those with the least hashes. Without labelled rows: no rule.
    """
    cols = features(prefix)
    rows = counted.join(F.broadcast(known), F.col(id_col) == F.col("_label_id")).filter(~base_failed(prefix)).select("_label", F.col(id_col).alias("_id"), *(c.alias(n) for n, c in cols.items())).distinct()
    names = ["_id", "_label", *FEATURES]
    found = rows.orderBy(F.xxhash64(*names), *names).limit(sample_rows).toPandas().sort_values(names)
    return learn({n: found[n].to_numpy() for n in FEATURES}, found["_label"].to_numpy() == 0, **how) if len(found) else []


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, COUNTS, base_failed, rule (number of the rule that rejects it, else 0) and kept.

    Null or empty texts have no words and fail the minimum. Repeated rows are judged alike; an empty
    table gives none; columns of docs other than the id and the text are left out.
    """
    counted = materialize(with_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", keep=["doc_id"]), "quality")
    rules = fit(counted, sampled_labels(labels, id_col), **how)
    failed = base_failed()
    rule = verdict(rules, features())
    return counted.select("doc_id", *COUNTS, failed.alias("base_failed"), rule.alias("rule")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that pass the minimum and the list, with docs' columns as they are."""
    prefix = unused("__quality_", docs.columns)
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = materialize(sampled_labels(labels, id_col), "labels")
    wanted = ids.join(F.broadcast(known.select(F.col("_label_id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    rules = fit(with_counts(wanted, "text", prefix, keep=["doc_id"]), known, prefix=prefix, **how)
    judged = with_counts(docs, text_col, prefix)
    return judged.filter(~base_failed(prefix) & (verdict(rules, features(prefix)) == 0)).select(*docs.columns)
