import datetime as dt
import hashlib
import random

import pytest

from tickloom.plans.asof import asof_forward
from tickloom.plans.quota import keep_quota
from tickloom.plans.ranking import number_rows


def test_numbering_with_one_group_holding_most_rows(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o int, id int").repartition(7)
    got = {r.id: (r.pos, r.n) for r in number_rows(df, ["k"], ["o", "id"], out="pos", total="n").collect()}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        assert [got[r[2]] for r in mine] == [(i, len(mine)) for i in range(len(mine))]


def test_numbering_without_key_and_with_null_keys(spark):
    rows = [(None if i % 3 else "a", i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, id int")
    assert sorted(r.p for r in number_rows(df, [], ["id"], out="p").collect()) == list(range(100))
    by_key = number_rows(df, ["k"], ["id"], out="p").collect()
    assert len(by_key) == 100
    assert sorted(r.p for r in by_key if r.k is None) == list(range(66))


@pytest.mark.parametrize("max_gap", [None, 900.0])
def test_asof_against_brute_force(spark, max_gap):
    rng = random.Random(2)
    t0 = dt.datetime(2024, 1, 2)
    moment = lambda: t0 + dt.timedelta(seconds=rng.randrange(0, 400_000), microseconds=rng.choice([0, 1, 999_999]))
    left = [(rng.choice("ab"), moment(), i) for i in range(300)]
    right = [(rng.choice("abc"), moment(), float(rng.randrange(1000))) for _ in range(400)]
    right += [(k, ts + dt.timedelta(seconds=300), 5.0) for k, ts, _ in left[:20]]  # exactly at the gap
    right += [(k, ts, v + 1) for k, ts, v in right[:30]]  # two prices at one time
    L = spark.createDataFrame(left, "k string, ts timestamp, id int")
    R = spark.createDataFrame(right, "k string, rts timestamp, v double")
    found = asof_forward(L, R, "k", "ts", "rts", "v", 300, max_gap, bucket_s=600).collect()
    assert len(found) == len(left)
    for r in found:
        due = r.ts + dt.timedelta(seconds=300)
        options = [(ts, v) for k, ts, v in right if k == r.k and ts >= due]
        if max_gap is not None:
            options = [o for o in options if o[0] <= r.ts + dt.timedelta(seconds=max_gap)]
        assert (r.matched_ts, r.matched_value) == (min(options) if options else (None, None))


def test_quota_is_exact_and_repeatable(spark):
    rows = [(f"id{i}", "A" if i % 3 else "B") for i in range(5000)]
    df = spark.createDataFrame(rows, "row_id string, g string")
    quotas = spark.createDataFrame([("A", 1234), ("B", 10_000), ("C", 5)], "g string, quota long")
    got = {(r.g, r.row_id) for r in keep_quota(df, "g", "row_id", 7, quotas).collect()}
    order = lambda i: (hashlib.md5(f"{i}|7".encode()).hexdigest(), i)
    a = sorted((i for i, g in rows if g == "A"), key=order)[:1234]
    b = [i for i, g in rows if g == "B"]
    assert got == {("A", i) for i in a} | {("B", i) for i in b}
    again = {(r.g, r.row_id) for r in keep_quota(df.repartition(13), "g", "row_id", 7, quotas).collect()}
    assert again == got


def test_quota_where_hashes_collide(spark):
    """Copies of one id share their hash; the cut still has the wanted size."""
    df = spark.createDataFrame([("same", "A")] * 50 + [("other", "A")] * 50, "row_id string, g string")
    quotas = spark.createDataFrame([("A", 60)], "g string, quota long")
    assert keep_quota(df, "g", "row_id", 1, quotas).count() == 60


def test_asof_keeps_rows_without_key_or_time(spark):
    t = dt.datetime(2024, 1, 2)
    left = spark.createDataFrame([(None, t, 1), ("a", None, 2), ("a", t, 3)], "k string, ts timestamp, id int")
    right = spark.createDataFrame([("a", t, 9.0), (None, t, 1.0)], "k string, rts timestamp, v double")
    got = {r.id: r.matched_value for r in asof_forward(left, right, "k", "ts", "rts", "v").collect()}
    assert got == {1: None, 2: None, 3: 9.0}
