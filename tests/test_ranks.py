"""Ranks and running sums of groups of any size: ranges and plain windows agree, with ties and nulls."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import bins, correlation, ranks


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(6)
    rows = [("hot" if k % 3 else f"g{k % 4}", rnd.choice([None, 1.0, 2.0, 2.0, float(k % 40)]), k % 5, f"u{k}", rnd.random()) for k in range(900)]
    rows += [(None, 1.0, 1, f"n{k}", 0.5) for k in range(9)]
    return ranks.written(spark.createDataFrame(rows, "dataset string, metric double, loc long, uid string, score double").repartition(5))


def test_ranges_give_what_windows_give(spark, table, monkeypatch):
    by = ["metric", "loc", "uid"]
    exact = ranks.written(table.withColumn("x", F.col("score").cast("decimal(30, 15)")))

    def both():
        numbered = ranks.placed(exact, ["dataset"], by, "n", sums={"s": "x"})
        return sorted(map(str, numbered.collect())), sorted(map(str, ranks.placed(exact, ["dataset"], ["metric"], mean="r").collect()))

    plain = both()
    monkeypatch.setattr(ranks, "ONE_TASK", 20)
    assert both() == plain
    numbered = ranks.placed(exact, ["dataset"], by, "n")
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "__part" in plan  # no window over a dataset alone
    tasks = numbered.where("dataset = 'hot'").groupBy("dataset").agg(F.max("n").alias("n"), F.count_distinct("n").alias("d")).first()
    assert tasks["n"] == tasks["d"] == 600


def test_statistics_do_not_change(spark, table, monkeypatch):
    known = table.where("metric is not null and dataset is not null")

    def all_of_them():
        b = correlation.buckets(known, ["dataset"], 7)
        found = [b, correlation.sweep(known, ["dataset"]), correlation.spearman(known, ["dataset"], "metric", "score"), bins.describe(known, ["dataset"], ["metric"], "score", "uid", ("metric", "loc"))]
        return [sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in f.collect()) for f in found]

    plain = all_of_them()
    monkeypatch.setattr(ranks, "ONE_TASK", 20)
    assert all_of_them() == plain and all(plain)
