from __future__ import annotations

from types import SimpleNamespace

import pytest

from formicary.llm import shared


def session(master: str, folder: str | None = None):
    """As much of a session as `shared_dir` looks at."""
    conf = SimpleNamespace(get=lambda key, default=None: folder)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session(master))


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_local_master_has_one_of_its_own(master):
    assert shared.shared_dir(session(master)).startswith("file:///")


@pytest.mark.parametrize("hot", [None, [7]])
def test_hot_keys_join_like_others(spark, hot):
    left = spark.range(4000).selectExpr("case when id % 3 = 0 then 7 when id % 3 = 1 then null else id % 500 end as k", "id")
    right = spark.range(400).selectExpr("id as k", "if(id = 20, null, id * 10) as v")
    got = {r.id: (r.k, r.v) for r in shared.join_spread(left, right, "k", ["v"], hot).collect()}
    assert got == {r.id: (r.k, None if r.k is None or r.k == 20 or r.k >= 400 else r.k * 10) for r in left.collect()}
    assert shared.join_spread(left.limit(0), right, "k", ["v"], hot).collect() == []


def test_only_the_settled_table_stays(spark):
    from pathlib import Path

    at = shared.written()
    one = shared.materialize(spark.range(5), "one")
    two = shared.materialize(one.filter("id > 1"), "two")
    shared.discard(one)
    last = shared.settle(two.filter("id > 2"), "last", at)
    assert [Path(x._written_at.removeprefix("file:")).exists() for x in (one, two, last)] == [False, False, True]
    assert last.count() == 2
