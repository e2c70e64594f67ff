"""A menu over the engine: `python -m formicary.cli EVENTS.parquet [REQUEST name=value ...]`.

EVENTS is a Parquet table of flat organism events, or the generic events table. Without a request the
menu asks for one until an empty line.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from formicary.plans.engine import Engine
from formicary.schema import organisms


def load(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return organisms(rows) if "props" in rows.columns else rows


def parse(words: list[str]) -> tuple[str, dict]:
    """`species species=ant limit=5` as a request and its parameters; whole numbers become int."""
    params = dict(w.split("=", 1) for w in words[1:])
    return words[0], {k: int(v) if v.lstrip("-").isdigit() else v for k, v in params.items()}


def answer(engine: Engine, line: str) -> DataFrame | str:
    """A table, or what is wrong with the request."""
    try:
        kind, params = parse(line.split())
        return engine.run(kind, **params)
    except (ValueError, TypeError) as e:
        return f"error: {e}"


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("formicary").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(load(spark, args[0]))
    print("requests:", ", ".join(sorted(engine.requests)))
    lines = iter([" ".join(args[1:])]) if args[1:] else iter(lambda: input("> ").strip(), "")
    for line in lines:
        found = answer(engine, line)
        print(found) if isinstance(found, str) else found.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
