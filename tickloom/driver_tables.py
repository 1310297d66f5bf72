"""The given tables seen as ticks, bars, predictions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.operators.bars import build_bars, universe_table
from tickloom.operators.ledger import backtest, empty_phase2
from tickloom.operators.prompts import ROLES
from tickloom.schema import SAMPLE_STEP
from tickloom.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as trades: series, time, price and a size taken from the properties."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("volume"),
        "event_id",
    )


def bars(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """Bars of the trades, written once because the series operators read them twice."""
    return stage(build_bars(ticks(spark, sf_dir), width), "bars")


def gappy_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades, some of them without a price (null or NaN) or ticker, by their number."""
    n = lambda m: F.pmod("event_id", F.lit(m))
    price = F.when(n(17) == 3, F.lit(None)).when(n(17) == 5, F.lit(float("nan"))).otherwise(F.col("price"))
    return ticks(spark, sf_dir).withColumns({"price": price, "ticker": F.when(n(29) != 4, F.col("ticker"))})


def gappy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly bars, some of them with a null or NaN close, by day and hour."""
    day, hour = F.dayofmonth("bar_ts"), F.hour("bar_ts")
    missing, broken = (day % 3 == 0) & (hour == 7), (day % 4 == 1) & (hour == 13)
    close = F.when(missing, F.lit(None)).when(broken, F.lit(float("nan"))).otherwise(F.col("close"))
    return stage(bars(spark, sf_dir).withColumn("close", close), "gappy-bars")


def supplier_ticker(number: str) -> Column:
    """S and the number in six digits or more; the formatter is called only for numbers that need it."""
    n = F.col(number)
    padded = F.concat(F.lit("S"), F.lpad(n.cast("string"), 6, "0"))
    return F.when(n.between(0, 999_999), padded).otherwise(F.format_string("S%06d", n))


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier from ``lineitem``: unit prices, and the previous close as open.

    Only order-free aggregates are used, as several lines share a day. Tickers are made of the grouped numbers.
    """
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    daily = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            "l_suppkey",
            F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("bar_ts"),
        )
        .agg(
            F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"),
            F.max(unit).alias("high"),
            F.min(unit).alias("low"),
            F.sum("l_quantity").cast("long").alias("volume"),
        )
        .select(supplier_ticker("l_suppkey").alias("ticker"), "bar_ts", "close", "high", "low", "volume", F.col("close").alias("open"))
    )
    return stage(daily, "supplier-bars")


def latency() -> Column:
    """A latency in milliseconds that follows from the bar, as no model is asked."""
    return F.pmod(F.col("volume"), F.lit(97)) * 12.5 + 3


ANALYST_COLUMNS = ("technical_direction", "score", "trend", "regime", "squeeze", "conviction", "divergence", "vote")


def predictions(spark: SparkSession, sf_dir: str, step: int = SAMPLE_STEP) -> DataFrame:
    """Resolved ledger rows from a backtest over the hourly bars, written once."""
    rows = backtest(bars(spark, sf_dir), step=step, latency=latency(), keep=ANALYST_COLUMNS)
    return stage(rows, "predictions")


def pending_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction at every bar after the warm-up, with its outcome still open."""
    return predictions(spark, sf_dir, step=1).withColumns(empty_phase2())


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers as tickers with their nation as sector, then the configured tickers."""
    suppliers = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    listed = suppliers.select(
        F.col("s_suppkey").cast("long").alias("ord"),
        F.format_string("S%06d", "s_suppkey").alias("ticker"),
        F.col("n_name").alias("sector"),
    )
    configured = universe_table(spark).withColumn("ord", F.col("ord") + F.lit(1_000_000_000).cast("long"))
    return listed.unionByName(configured)


def responses(preds: DataFrame) -> DataFrame:
    """Up to two texts per prediction as a model might answer, well formed or not.

    The form follows from a hash of the key: proper, in lower case, with an unknown label, broken,
    without keys, with the number as text, followed by other text, or no object at all.
    """
    body = lambda d, r, c: F.concat(
        F.lit('{"direction":"'), d, F.lit('","target_return_pct":'), r, F.lit(',"confidence":"'), c, F.lit('"}')
    )
    ret = F.round("actual_return_pct", 2).cast("string")
    d, c = F.col("prediction_direction"), F.col("prediction_confidence")
    proper = body(d, ret, c)
    attempts = F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt")
    rows = preds.select("*", attempts)
    kind = F.substring(F.md5(F.concat_ws("|", "row_id", F.col("attempt").cast("string"))), 1, 1)
    text = (
        F.when(kind.isin("0", "1", "2", "3"), proper)
        .when(kind.isin("4", "5"), body(F.lower(d), ret, F.lower(c)))
        .when(kind == "6", body(F.lit("INVALID"), ret, F.lit("SURE")))
        .when(kind.isin("7", "8", "9"), F.substring(proper, 1, 20))
        .when(kind == "a", F.lit("{}"))
        .when(kind == "b", body(d, F.concat(F.lit('"'), ret, F.lit('"')), c))
        .when(kind == "c", F.concat(proper, F.lit(" and so on")))
        .when(kind == "d", F.lit("[1, 2]"))
        .when(kind == "e", body(d, F.lit('"much"'), c))
        .otherwise(F.lit("no answer"))
    )
    return rows.select("row_id", "attempt", text.alias("response"))


def agent_answers(preds: DataFrame) -> DataFrame:
    """One answer per prediction and role, some of them failed, with their latency."""
    options = [
        F.struct(F.lit(r.key).alias("role"), F.lit(i).alias("role_ord"), F.col(c).cast("string").alias("said"))
        for i, (r, c) in enumerate(zip(ROLES, ("technical_direction", "regime", "conviction")))
    ]
    rows = preds.select("row_id", "inference_latency_ms", F.explode(F.array(*options)).alias("_a"))
    ok = F.substring(F.md5(F.concat_ws("|", "row_id", F.col("_a.role"))), 1, 1) > F.lit("2")
    return rows.select(
        "row_id",
        F.col("_a.role").alias("role"),
        F.lit(1).alias("attempt"),
        ok.alias("ok"),
        F.when(ok, F.col("_a.said")).otherwise(F.lit("timeout")).alias("text"),
        (F.col("inference_latency_ms") + F.col("_a.role_ord") * 10).alias("latency_ms"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as message rooms."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("room_id"),
        F.col("turn").cast("int").alias("turn"),
        F.col("role").alias("sender"),
        F.when(F.col("role") == "system", "system").otherwise("contribution").alias("type"),
        "text",
    )
