"""Small documents with every oddity, and rows as plain tuples."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(["an", "th", "er", "ou", "sh", "é", "ing", "ß"]) for _ in range(draw.randint(1, 4))) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    w = words(seed, n)
    return "\n".join(" ".join(w[k : k + 12]).capitalize() + "." for k in range(0, n, 12))


def odd_documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty, long, equal and near texts, repeated rows."""
    long = prose(1, 40_000)
    near = prose(2, 400)
    texts = [
        (1, prose(3, 80)), (2, near), (3, near.replace("an", "An", 1)), (4, " ".join([*near.split()[:-3], "zz", "yy"])), (5, None), (6, ""), (7, " \n\t "), (8, "One."), (9, long), (10, long), (11, prose(3, 80)),
        (12, "1234 5678"), (12, "1234 5678"), (13, "a b"), (14, "A  B\n"), (15, "#$% <<>> ||| &&&"), (None, prose(4, 30)), (16, prose(5, 30) + "\n" + prose(5, 30)),
    ]
    return [(i, t, None if i == 3 else "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in texts]


def frame(spark, rows, schema: str = SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows_of(df, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
