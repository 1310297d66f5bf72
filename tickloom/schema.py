"""Schemas and fixed values of the bar, prediction and message tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Label sets used across the ledger.
DIRECTIONS = ("UP", "DOWN", "SIDEWAYS")
EXPIRED = "EXPIRED"
CONFIDENCES = ("HIGH", "MED", "LOW")
MESSAGE_TYPES = ("contribution", "synthesis", "system")

# The default ticker universe in its configured order, with sectors.
UNIVERSE = (
    ("NSE:RELIANCE", "Energy"),
    ("NSE:TCS", "IT Services"),
    ("NSE:HDFCBANK", "Banking"),
    ("NSE:INFY", "IT Services"),
    ("NSE:ICICIBANK", "Banking"),
    ("NSE:SBIN", "Banking"),
    ("NSE:BHARTIARTL", "Telecom"),
    ("NSE:ITC", "FMCG"),
    ("NSE:WIPRO", "IT Services"),
    ("NSE:AXISBANK", "Banking"),
)

# Defaults of the analytics.
BAR_SECONDS = 300
MIN_HISTORY_ROWS = 30
SIDEWAYS_THRESHOLD_PCT = 0.25
SAMPLE_START = 30
SAMPLE_STEP = 20
EXPIRY_SECONDS = 3600
REPLAY_DAYS = 45
MIN_TRAINING_ROWS = 20
VALIDATION_SHARE = 0.1
STATIC_SHARE = 0.3

BAR = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("bar_ts", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)

# Columns of a bar file on disk; the ticker comes from the file name.
BAR_FILE = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)

INDICATOR_COLUMNS = (
    "vwap", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_middle", "bb_lower",
    "atr_14", "sma_50", "sma_200",
)

# Indicator columns the ledger stores.
LEDGER_INDICATORS = (
    "vwap", "rsi_14", "macd", "macd_signal", "bb_upper", "bb_lower", "bb_middle", "atr_14",
)

MESSAGES = T.ArrayType(
    T.StructType(
        [
            T.StructField("sender", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("turn", T.IntegerType()),
        ]
    )
)

PHASE1 = T.StructType(
    [
        T.StructField("row_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("cycle_id", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        *[T.StructField(c, T.DoubleType()) for c in LEDGER_INDICATORS],
        T.StructField("prediction_direction", T.StringType()),
        T.StructField("prediction_return_pct", T.DoubleType()),
        T.StructField("prediction_confidence", T.StringType()),
        T.StructField("agent_contributions", T.StringType()),
        T.StructField("band_room_id", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("inference_latency_ms", T.DoubleType()),
        T.StructField("mode", T.StringType()),
        T.StructField("data_source", T.StringType()),
    ]
)

PHASE2 = T.StructType(
    [
        T.StructField("actual_direction", T.StringType()),
        T.StructField("actual_return_pct", T.DoubleType()),
        T.StructField("resolution_timestamp", T.TimestampType()),
        T.StructField("prediction_accuracy", T.BooleanType()),
        T.StructField("resolution_price", T.DoubleType()),
        T.StructField("reward", T.DoubleType()),
        T.StructField("used_in_training", T.BooleanType()),
    ]
)

LEDGER = T.StructType([*PHASE1.fields, *PHASE2.fields])
