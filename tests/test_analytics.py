import datetime as dt
import random

import numpy as np
import pytest

from tickloom.operators import analytics as an

T0 = dt.datetime(2024, 1, 2)


@pytest.fixture(scope="module")
def preds(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        hot = rng.random() < 0.6
        good = rng.random() < 0.4
        rows.append((
            f"{rng.random():.12f}", T0 + dt.timedelta(minutes=5 * rng.randrange(120)), "NSE:HOT" if hot else f"NSE:T{i % 4}",
            rng.choice(["HIGH", "MED", "LOW"]), good, rng.choice(["UP", "DOWN", "EXPIRED"]) if i % 9 else None,
            rng.gauss(0, 1), rng.gauss(0, 1), round(rng.random() * 1000, 1),
        ))
    schema = ("row_id string, timestamp timestamp, ticker string, prediction_confidence string, prediction_accuracy boolean, "
              "actual_direction string, prediction_return_pct double, actual_return_pct double, inference_latency_ms double")
    return spark.createDataFrame(rows, schema).repartition(6).cache()


@pytest.fixture(scope="module")
def ordered(preds):
    pdf = preds.toPandas()
    pdf = pdf[pdf.actual_direction.notna() & (pdf.actual_direction != "EXPIRED")]
    return pdf.sort_values(["timestamp", "row_id"]).reset_index(drop=True)


def column(df, name):
    got = df.select("series_idx", name).orderBy("series_idx").toPandas()
    assert (got.series_idx == range(len(got))).all()
    return got[name].astype(float).to_numpy()


@pytest.mark.parametrize("size", [None, 21])
def test_rolling_accuracy(preds, ordered, size):
    want = ordered.prediction_accuracy.astype(float).rolling(20, min_periods=1).mean() * 100
    np.testing.assert_allclose(column(an.rolling_accuracy(preds, size=size), "rolling_accuracy_pct"), want)


def test_rolling_accuracy_with_a_frame_that_grows(preds, ordered):
    n = max(20, len(ordered) // 15)
    want = ordered.prediction_accuracy.astype(float).rolling(n, min_periods=5).mean() * 100
    np.testing.assert_allclose(column(an.rolling_accuracy(preds, "auto", 5), "rolling_accuracy_pct"), want)


def test_cumulative_return_over_blocks(preds, ordered, monkeypatch):
    monkeypatch.setattr(an, "_TOTAL_BLOCK", 50)
    np.testing.assert_allclose(column(an.cumulative_return(preds), "cumulative_return_pct"), ordered.actual_return_pct.cumsum(), atol=1e-9)


@pytest.mark.parametrize("size", [5, 30])
def test_centered_average(preds, ordered, size):
    rows = an.cumulative_return(preds)
    got = column(an.centered_ma(rows, "actual_return_pct", size), "centered_ma")
    v = ordered.actual_return_pct.to_numpy()
    want = [v[max(0, i - size // 2):i + size - size // 2].mean() for i in range(len(v))]
    np.testing.assert_allclose(got, want)


def test_quantile_by_group(preds):
    pdf = preds.toPandas()
    got = {r.ticker: r.quantile for r in an.quantile(preds, "inference_latency_ms", 0.5, ["ticker"]).collect()}
    want = pdf.groupby("ticker").inference_latency_ms.median().to_dict()
    assert got == pytest.approx(want)
    q = an.quantile(preds, "inference_latency_ms", 0.9).first()["quantile"]
    assert q == pytest.approx(np.quantile(pdf.inference_latency_ms, 0.9))


def test_histogram_matches_numpy(spark, preds):
    pdf = preds.toPandas()
    counts, edges = np.histogram(pdf.inference_latency_ms, bins=30)
    got = an.histogram(preds, "inference_latency_ms").toPandas()
    assert got.n.tolist() == counts.tolist()
    np.testing.assert_allclose(got.lo, edges[:-1])
    same = an.histogram(spark.createDataFrame([(2.0,)] * 4, "x double"), "x").toPandas()
    assert same.n.tolist() == np.histogram([2.0] * 4, bins=30)[0].tolist()


def test_expired_rows_are_optional(preds):
    pdf = preds.toPandas()
    done = pdf[pdf.actual_direction.notna()]
    kept = done[done.actual_direction != "EXPIRED"]
    assert an.overall_accuracy(preds).first().accuracy_pct == pytest.approx(kept.prediction_accuracy.mean() * 100)
    assert an.overall_accuracy(preds, include_expired=True).first().n == len(done)


def test_order_of_confidence_levels_and_single_rows(spark):
    rows = [("LOW", True), ("LOW", False), ("HIGH", True), ("MED", False), ("MED", True), ("???", True)]
    df = spark.createDataFrame([(c, h, "UP") for c, h in rows], "prediction_confidence string, prediction_accuracy boolean, actual_direction string")
    assert [r[0] for r in an.accuracy_by_confidence(df).collect()] == ["HIGH", "MED", "LOW"]
    cal = an.calibration(df).collect()
    assert [r[0] for r in cal] == ["MED", "LOW"]
    assert cal[0].stderr_pct == pytest.approx(50.0)


def test_correlation_of_few_pairs(spark):
    df = spark.createDataFrame([(1.0, 1.0, "UP"), (2.0, 3.0, "UP"), (None, 1.0, "UP")], "prediction_return_pct double, actual_return_pct double, actual_direction string")
    assert an.return_correlation(df).first().r == 0.0


def test_summary_of_nothing(preds):
    r = an.run_summary(preds.limit(0)).first()
    assert (r.n_predictions, r.avg_latency_ms, r.predictions_per_min) == (0, 0.0, 0.0)
