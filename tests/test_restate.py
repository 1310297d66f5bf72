import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F, types as T

from tickloom.operators import indicators as ind
from tickloom.schema import BAR, INDICATOR_COLUMNS
from tickloom.streaming import restate as R
from tickloom.streaming.state import KeyedState
from tests.conftest import walk


def shown(df):
    return df.select("ticker", "bar_ts", "volume", *[F.round(c, 7).alias(c) for c in INDICATOR_COLUMNS])


def run(spark, tmp_path, batches, **options):
    sink = R.RestatingIndicators(f"{tmp_path}/out", f"{tmp_path}/state", buckets=8, **options)
    for i, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, BAR), i)
    return sink


def same(spark, tmp_path, rows):
    got = shown(R.read_restated(spark, f"{tmp_path}/out"))
    want = shown(ind.compute_indicators(spark.createDataFrame(rows, BAR)))
    assert got.count() == len(rows)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def wrong(row, by=7.0):
    return (row[0], row[1], row[2], row[3] + by, row[4] - by, row[5] + by, row[6] + 100)


def test_late_and_revised_bars_end_equal_to_the_batch(spark, tmp_path):
    """Near the end, far behind the tail, at the very start, over the edge of a day, and in a young series."""
    long = walk("L", 4200)
    young, other = walk("Y", 45, start=dt.datetime(2024, 1, 3, 9, 25)), walk("O", 500)
    far = {3, 150, 151, 1900, 2600}
    near = {4050, 4120, 4121}
    first = [r if i % 300 else wrong(r) for i, r in enumerate(long[:4100]) if i not in far | near] + young[:10] + other[:200]
    second = [long[4050], *long[4100:4150], *[r for i, r in enumerate(long[:4100]) if i % 300 == 0 and i > 3900 and i not in far], *young[10:28], *other[200:]]
    second = [r for r in second if r not in (long[4120], long[4121])]
    third = [long[4120], long[4121], *[long[i] for i in sorted(far)], *long[4150:], *young[28:]]
    fourth = [r for i, r in enumerate(long[:4100]) if i % 300 == 0 and i not in far]
    run(spark, tmp_path, [first, second, third, fourth])
    same(spark, tmp_path, [*long, *young, *other])
    out = spark.read.parquet(f"{tmp_path}/out")
    # What the late bars far behind changed ends at the horizon: the rest of the series is not written again.
    again = out.filter("batch = 2 AND ticker = 'L' AND correction")
    assert 0 < again.count() < 3 * ind.INDICATOR_BACK + 2700
    assert out.filter("batch = 2 AND ticker = 'O'").count() == 0
    assert out.groupBy("batch", "ticker", "bar_ts").count().filter("count > 1").count() == 0


def test_random_order_of_arrival(spark, tmp_path):
    r = random.Random(7)
    rows = walk("A", 900) + walk("B", 400, seed=3) + walk("C", 31)
    when = {id(x): r.choice([0, 0, 1, 2, 3]) for x in rows}
    batches = [[x for x in rows if when[id(x)] == b] for b in range(4)]
    for b in (1, 2, 3):
        batches[b - 1] += [wrong(x, r.random()) for x in batches[b] if r.random() < 0.1]
        r.shuffle(batches[b])
    batches.insert(2, [])
    run(spark, tmp_path, batches)
    same(spark, tmp_path, rows)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = walk("A", 300)
    parts = [rows[:100] + rows[120:250], rows[100:120] + rows[250:]]
    sink = run(spark, tmp_path, parts)
    once = sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect()))
    sink(spark.createDataFrame(parts[1], BAR), 1)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == once
    same(spark, tmp_path, rows)


def test_unfit_bars_and_order_of_revisions(spark, tmp_path):
    rows = walk("A", 60)
    schema = T.StructType([*BAR.fields, T.StructField("seq", T.LongType())])
    sink = R.RestatingIndicators(f"{tmp_path}/out", f"{tmp_path}/state", version="seq", buckets=8)
    revised = [(*wrong(r, 50.0), 1) for r in rows[10:20]] + [(*r, 2) for r in rows]
    bad = [(None, *rows[0][1:], 3), ("A", rows[5][1], 1.0, 1.0, 1.0, None, 1, 9)]
    sink(spark.createDataFrame(revised + bad, schema), 0)
    same(spark, tmp_path, rows)
    assert spark.read.parquet(f"{tmp_path}/out-unfit").count() == 2


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_bytes_written_follow_the_batch(spark, tmp_path):
    """One ticker of many: only its bucket is written again, the others are referred to."""
    sink = R.RestatingIndicators(f"{tmp_path}/out", f"{tmp_path}/state", buckets=32)
    many = [row for k in range(64) for row in walk(f"T{k}", 40)]
    sink(spark.createDataFrame(many, BAR), 0)
    more = walk("T5", 45)[40:]
    for b in range(1, 6):
        sink(spark.createDataFrame([more[b - 1]], BAR), b)
    state = sink.state(spark)
    assert set(state.manifest(5).values()) == {0, 5}
    assert sum(v == 5 for v in state.manifest(5).values()) == 1
    full, part = size_of(f"{tmp_path}/state/tails/data/version=0"), size_of(f"{tmp_path}/state/tails/data/version=5")
    assert part * 8 < full
    # Older versions of the touched bucket are gone, those of the last batches are there.
    there = sorted(n for n in os.listdir(f"{tmp_path}/state/tails/manifest") if n.startswith("batch="))
    assert there == ["batch=3", "batch=4", "batch=5"]
    assert state.read(5).count() == 64 * 40 + 5
    same(spark, tmp_path, [r for r in many if r[0] != "T5"] + walk("T5", 45))


def test_missing_or_foreign_state_is_an_error(spark, tmp_path):
    state = KeyedState(spark, f"{tmp_path}/s", R.TAIL, buckets=4)
    assert state.read(-1).count() == 0
    rows = spark.createDataFrame([(*r, True) for r in walk("A", 5)], R.TAIL)
    state.write(rows, 0, state.touched(rows))
    state.write(rows, 1, state.touched(rows))
    with pytest.raises(ValueError):
        state.read(5)
    with pytest.raises(ValueError):
        state.read(-1)
