"""Segmented rates and quantiles by selection."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arborlake.operators import quantiles
from arborlake.streaming import series

rng = random.Random(1)


@pytest.mark.parametrize("segment", [1, 7, 10_000])
def test_increases_over_segments(spark, segment):
    rows = [(k, t, rng.choice([None, float(rng.randrange(5)), float(rng.randrange(50))])) for k in ("a", "b", None) for t in sorted(rng.randrange(200) for _ in range(60))] + [("a", None, 3.0)]
    df = spark.createDataFrame(rows, "k string, s int, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(map(repr, (tuple(r) for r in series.increases(df, ["k"], "ts", "v", segment).select("k", "s", "v", "increase").collect())))
    want = []
    low = lambda x: (x is not None, x or 0)
    for k in ("a", "b", None):
        last = None
        for _, t, v in sorted((r for r in rows if r[0] == k), key=lambda r: (low(r[1]), low(r[2]))):
            want.append((k, t, v, 0.0 if last is None else v if v is None or v < last else v - last))
            last = v
    assert got == sorted(map(repr, want))
    plan = series.increases(df, ["k"], "ts", "v", segment)._jdf.queryExecution().toString()
    assert "windowspecdefinition(k" in plan and "seg_" in plan


def _plain(values, q):
    v = sorted(values)
    return v[max(1, math.ceil(round(q * len(v), 9))) - 1]


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_quantiles_by_selection(spark, q):
    groups = {
        "even": [float(i) for i in range(100)],
        "one": [4.25],
        "same": [7.0] * 500,
        "wide": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(300)],
        "ends": [-1.7e308, 1.7e308, 0.0, 5e-324],
        None: [rng.gauss(0, 1) for _ in range(200)] + [0.5] * 200,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: r.p for r in quantiles.nearest_rank(df, ["g"], "v", q, "p", bins=16).collect()}
    assert got == {g: _plain(vs, q) for g, vs in groups.items()}


def test_quantiles_of_nothing(spark):
    assert quantiles.nearest_rank(spark.createDataFrame([], "g string, v double"), ["g"], "v", 0.5).count() == 0
    with pytest.raises(ValueError):
        quantiles.nearest_rank(spark.createDataFrame([], "g string, v double"), ["g"], "v", 2)
