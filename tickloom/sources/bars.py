"""Bar files: one CSV per ticker, read as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.schema import BAR, BAR_FILE

EXCHANGE = "NSE"


def _shape(raw: DataFrame) -> DataFrame:
    """``NSE_X.csv``, ``X.csv`` and files in a folder ``ticker=X`` all hold the bars of ``NSE:X``."""
    # Paths come URI-encoded; in a partition's name Spark has encoded some characters before that.
    decode = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    file = F.regexp_replace(decode(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)), f"^{EXCHANGE}_", "")
    folder = decode(decode(F.regexp_extract(F.col("_metadata.file_path"), r"/ticker=([^/]+)/[^/]*$", 1)))
    price = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return raw.select(
        F.concat(F.lit(f"{EXCHANGE}:"), F.when(folder != "", folder).otherwise(file)).alias("ticker"),
        F.to_timestamp("timestamp").alias("bar_ts"),
        *[price(c) for c in ("open", "high", "low", "close")],
        "volume",
    ).select(*BAR.names)


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """All bar files of a folder and the folders in it as one table, with a fixed schema: no inference pass."""
    return _shape(spark.read.schema(BAR_FILE).option("header", True).option("recursiveFileLookup", True).csv(path))


def stream_bars(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """The same files as a stream of ``max_files`` files per trigger."""
    reader = spark.readStream.schema(BAR_FILE).option("header", True).option("recursiveFileLookup", True)
    return _shape(reader.option("maxFilesPerTrigger", max_files).csv(path))


def write_bars_csv(bars: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Bars as CSV files in a folder per ticker, in one write; a long series is split over tasks and files."""
    rows = bars.select("ticker", F.date_format("bar_ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "open", "high", "low", "close", "volume")
    dealt = rows.hint("rebalance", "ticker").sortWithinPartitions("ticker", "timestamp")
    dealt.write.option("header", True).option("maxRecordsPerFile", rows_per_file).partitionBy("ticker").csv(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Store bars by day, so that a range of days prunes to its folders.

    Rebalancing gives files of even size: large days are split, small ones share a task.
    """
    dated = bars.withColumn("day", F.to_date("bar_ts")).hint("rebalance", "day")
    dated.sortWithinPartitions("day", "ticker", "bar_ts").write.mode("append").partitionBy("day").parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*BAR.names, "day")


def write_prices(prices: DataFrame, path: str) -> None:
    """Store prices (ticker, ts, price) by day, sorted, so that a resolution reads the days of its windows only."""
    dated = prices.select("ticker", "ts", "price", F.to_date("ts").alias("day")).hint("rebalance", "day")
    dated.sortWithinPartitions("day", "ticker", "ts").write.mode("append").partitionBy("day").parquet(path)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ticker string, ts timestamp, price double, day date").parquet(path)
