"""The domain tables over test tables of several lengths."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from repeatlens.sources import sample

DAY = datetime(1998, 1, 1)


def _saved(spark, path, scripts):
    """Four lines a script; keys that are null, repeat or have no partner among them."""
    lines = [(k, 0, 0, n, 1.5 * n, DAY + timedelta(days=k % 50)) for k in range(scripts) for n in range(1, 5)]
    lines += [(None, 0, 0, 1, 1.0, DAY), (scripts + 5, 0, 0, 1, 1.0, DAY), (3, 0, 0, 1, 1.5, DAY + timedelta(days=3))]
    orders = [(k, k % 30, DAY) for k in range(scripts)] + [(None, 1, DAY), (5, 5, DAY)]
    parts = [(k, f"drug {k}", "B", "LARGE", 2.0) for k in range(7)] + [(None, "none", "B", "SMALL", 2.0), (2, "two", "C", "PROMO", 2.0)]
    for name, rows in (("lineitem", lines), ("orders", orders), ("part", parts)):
        spark.createDataFrame(rows, sample.TEST_SCHEMAS[name]).write.parquet(f"{path}/{name}.parquet")
    drugs = {}
    for key, name, *_ in parts:
        drugs.setdefault(key, []).append(name)
    return sorted(
        (order * 10 + line, name if order % 101 else None)
        for key, _, _, line, *_ in lines
        for order, *_ in orders
        if key is not None and order == key
        for name in drugs.get(order % len(parts), [])
    )


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_tasks_of_a_longer_table_are_not_larger(spark, conf, tmp_path, monkeypatch, broadcast):
    conf(autoBroadcastJoinThreshold=broadcast)
    monkeypatch.setattr(sample, "TASK_LINES", 50, raising=False)
    most = []
    for scripts in (200, 800):
        want = _saved(spark, f"{tmp_path}/{scripts}", scripts)
        lines = sample.sample_tables(spark, f"{tmp_path}/{scripts}").dispense
        got = lines.select("ScriptNo", "Drugname").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        # The number of tasks by plan: few keys of this small table share out unevenly.
        plan = lines._jdf.queryExecution().executedPlan().toString()
        dealt = [int(n) for n in re.findall(r"hashpartitioning\(l_orderkey#\d+L, (\d+)\)", plan)]
        assert dealt, plan
        most.append(4 * scripts / dealt[0])
    assert max(most) <= 50


def test_short_tables_are_left_to_spark(spark, tmp_path):
    want = _saved(spark, tmp_path, 60)
    lines = sample.sample_tables(spark, str(tmp_path)).dispense
    assert lines.count() == len(want)
    assert "REPARTITION" not in lines._jdf.queryExecution().executedPlan().toString()
    assert lines.where(F.col("DrugSchedule") == "").count() > 0
