from __future__ import annotations

from formicary.cli import answer, load, parse
from formicary.plans.engine import Engine
from formicary.sources.events import generated


def test_requests_are_parsed_and_errors_are_said(spark, tmp_path):
    assert parse(["species", "species=ant", "limit=5"]) == ("species", {"species": "ant", "limit": 5})
    generated(spark, 50).write.parquet(f"{tmp_path}/e")
    engine = Engine(load(spark, f"{tmp_path}/e"), seq="ts")
    assert answer(engine, "species species=ant limit=3").count() == 3
    for line in ("drop", "species", "species limit", "species species=ant limit=-1"):
        assert str(answer(engine, line)).startswith("error: ")
    assert "user_id" in load(spark, "/root/testdata/sf0.001/events.parquet").columns
