import math
import random

import numpy as np
import pytest

from tickloom.plans.recurrence import long_average
from tickloom.plans.selection import select_quantile
from pyspark.sql import functions as F


def groups(seed):
    rng = random.Random(seed)
    rows = [("hot", rng.lognormvariate(0, 8)) for _ in range(9000)]
    rows += [("atoms", float(rng.choice([1, 1, 1, 2, 2, 3]))) for _ in range(4000)]
    rows += [("edge", 0.0) for _ in range(2000)] + [("edge", 1 + rng.random()) for _ in range(2000)]
    rows += [(None, rng.gauss(0, 1)) for _ in range(700)] + [("two", -1.0), ("two", 4.0), ("one", 7.5)]
    return rows + [("hot", None), ("hot", float("nan")), ("none", None)]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.999, 1.0])
def test_quantile_by_narrowing_is_exact(spark, q):
    rows = groups(3)
    got = {r.k: r for r in select_quantile(spark.createDataFrame(rows, "k string, x double").repartition(6), "x", q, ["k"], small=40).collect()}
    assert set(got) == {"hot", "atoms", "edge", None, "two", "one"}
    for k, r in got.items():
        values = [x for g, x in rows if g == k and x is not None and x == x]
        assert r.n == len(values)
        assert r.quantile == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_quantile_without_groups_and_without_rows(spark):
    df = spark.range(100_001).select((F.col("id") * 7 % 100_001).alias("x"))
    got = select_quantile(df, "x", 0.5, small=10)
    assert got.first()["quantile"] == 50_000
    plan = got._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan
    empty = select_quantile(df.where("x < 0"), "x", 0.5).collect()
    assert [(r["quantile"], r["n"]) for r in empty] == [(None, 0)]
    assert select_quantile(df.where("x < 0").withColumn("k", F.lit(1)), "x", 0.5, ["k"]).count() == 0


def reference(xs, alpha, n, seed):
    out, y = [], None
    for i, x in enumerate(xs):
        if seed == "first":
            y = x if i == 0 else y + alpha * (x - y)
        elif i == n - 1:
            y = math.fsum(xs[:n]) / n
        elif i >= n:
            y = y + alpha * (x - y)
        out.append(y if i >= n - 1 else None)
    return out


@pytest.mark.parametrize("n,size,seed", [(50_000, 4096, "sma"), (3000, 64, "sma"), (400, 7, "first"), (3, 64, "sma"), (2, 5, "first")])
def test_scan_equals_the_step_by_step_average(spark, n, size, seed):
    rng = random.Random(n)
    long = 120_000 if n == 50_000 else 5_000
    xs = [100 + rng.gauss(0, 5) for _ in range(long)]
    rows = [("a", i, x) for i, x in enumerate(xs)] + [("b", i, float(i)) for i in range(n - 1)]
    df = spark.createDataFrame(rows, "ticker string, i long, x double").repartition(5)
    df = df.withColumn("bar_ts", F.timestamp_seconds(1_700_000_000 + F.col("i") * 300))
    alpha = 2 / (n + 1) if seed == "sma" else 1 / n
    done = long_average(df, "x", alpha, n, "y", seed, size=size)
    assert "Generate" not in done._jdf.queryExecution().toString()
    got = {(r.ticker, r.i): r.y for r in done.select("ticker", "i", "y").collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(reference(xs, alpha, n, seed)):
        assert got["a", i] is None if want is None else got["a", i] == pytest.approx(want, rel=1e-9)
    assert all(got["b", i] is None for i in range(n - 1))


def test_scan_sets_gaps_aside(spark):
    rows = [("a", i, None if i % 5 == 2 else float("nan") if i % 7 == 3 else float(i)) for i in range(300)] + [(None, 1, 2.0)]
    df = spark.createDataFrame(rows, "ticker string, i long, x double")
    df = df.withColumn("bar_ts", F.timestamp_seconds(1_700_000_000 + F.col("i") * 300))
    got = {(r.ticker, r.i): r for r in long_average(df, "x", 2 / 11, 10, "y", size=16).collect()}
    good = [(i, x) for k, i, x in rows if k and x is not None and x == x]
    for (i, _), want in zip(good, reference([x for _, x in good], 2 / 11, 10, "sma")):
        r = got["a", i]
        assert r.y is None if want is None else r.y == pytest.approx(want, rel=1e-12)
    assert got[None, 1].y is None and got["a", 2].series_idx is None and len(got) == 301
    with pytest.raises(ValueError):
        long_average(df, "x", 1.0, 1, "y")
