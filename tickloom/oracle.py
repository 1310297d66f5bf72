"""The catalog's queries as SQL for DuckDB over the same tables.

Recursive averages are stepped row by row with a recursive CTE, unlike the engine's running sums.
"""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}


def r(expr: str, digits: int = 6) -> str:
    return f"(round(({expr}) + sign({expr}) * 1e-9::DOUBLE, {digits}) + 0.0::DOUBLE)"


def t(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def rounded(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in cols)


def two(expr: str, digits: int = 2) -> str:
    """Fixed-point text, half up, of a number free of rounding noise."""
    dec = f"round(CAST({expr} AS DECIMAL(38, 8)), {digits})"
    body = f"CAST(CAST({dec} AS DECIMAL(38, {digits})) AS VARCHAR)"
    return f"(CASE WHEN {expr} IS NULL THEN 'N/A' WHEN {expr} < 0 AND {dec} = 0 THEN '-' || {body} ELSE {body} END)"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


TICKS = """ticks AS (
  SELECT event_type AS ticker, ts, value AS price, event_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume FROM events)"""


def bars_cte(width: str = "1 hour") -> str:
    return f"""bars AS MATERIALIZED (
  SELECT ticker, time_bucket(INTERVAL '{width}', ts) AS bar_ts, arg_min(price, ts) AS open,
         max(price) AS high, min(price) AS low, arg_max(price, ts) AS close,
         CAST(sum(volume) AS BIGINT) AS volume
  FROM ticks GROUP BY 1, 2)"""


SUPPLIER_BARS = """bars AS MATERIALIZED (
  SELECT format('S{:06d}', l_suppkey) AS ticker, date_trunc('day', l_shipdate)::TIMESTAMP AS bar_ts,
         sum(l_extendedprice) / sum(l_quantity) AS close, max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low, CAST(sum(l_quantity) AS BIGINT) AS volume,
         sum(l_extendedprice) / sum(l_quantity) AS open
  FROM lineitem GROUP BY 1, 2)"""

BARS = (TICKS, bars_cte())

IX = """ix AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts) - 1 AS i,
         count(*) OVER (PARTITION BY ticker) AS n FROM bars)"""

WIN = """base AS MATERIALIZED (
  SELECT *, lag(close) OVER w AS pc,
    greatest(close - lag(close) OVER w, 0) AS gain, greatest(lag(close) OVER w - close, 0) AS loss,
    CASE WHEN i > 0 THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr,
    avg(close) OVER (PARTITION BY ticker ORDER BY i ROWS 11 PRECEDING) AS a12,
    avg(close) OVER (PARTITION BY ticker ORDER BY i ROWS 25 PRECEDING) AS a26,
    avg(close) OVER (PARTITION BY ticker ORDER BY i ROWS 19 PRECEDING) AS a20,
    stddev_samp(close) OVER (PARTITION BY ticker ORDER BY i ROWS 19 PRECEDING) AS s20,
    avg(close) OVER (PARTITION BY ticker ORDER BY i ROWS 49 PRECEDING) AS a50,
    avg(close) OVER (PARTITION BY ticker ORDER BY i ROWS 199 PRECEDING) AS a200,
    sum((high + low + close) / 3 * volume) OVER s / nullif(sum(volume) OVER s, 0) AS vwap
  FROM ix WINDOW w AS (PARTITION BY ticker ORDER BY i),
    s AS (PARTITION BY ticker, CAST(bar_ts AS DATE) ORDER BY bar_ts ROWS UNBOUNDED PRECEDING))"""

REC = """rec AS (
  SELECT ticker, i, NULL::DOUBLE AS e12, NULL::DOUBLE AS e26, NULL::DOUBLE AS g, NULL::DOUBLE AS l, NULL::DOUBLE AS a
  FROM base WHERE i = 0
  UNION ALL
  SELECT x.ticker, x.i,
    CASE WHEN x.i = 11 THEN x.a12 ELSE p.e12 + (x.close - p.e12) * 2 / 13.0::DOUBLE END,
    CASE WHEN x.i = 25 THEN x.a26 ELSE p.e26 + (x.close - p.e26) * 2 / 27.0::DOUBLE END,
    CASE WHEN x.i = 1 THEN x.gain ELSE p.g + (x.gain - p.g) / 14 END,
    CASE WHEN x.i = 1 THEN x.loss ELSE p.l + (x.loss - p.l) / 14 END,
    CASE WHEN x.i = 1 THEN x.tr ELSE p.a + (x.tr - p.a) / 14 END
  FROM rec p JOIN base x ON x.ticker = p.ticker AND x.i = p.i + 1)"""

MACD = """mac AS MATERIALIZED (
  SELECT ticker, i, e12 - e26 AS macd,
         avg(e12 - e26) OVER (PARTITION BY ticker ORDER BY i ROWS 8 PRECEDING) AS m9 FROM rec)"""

SIG = """sig AS (
  SELECT ticker, i, NULL::DOUBLE AS macd_signal FROM mac WHERE i = 0
  UNION ALL
  SELECT x.ticker, x.i, CASE WHEN x.i = 33 THEN x.m9 ELSE p.macd_signal + (x.macd - p.macd_signal) * 2 / 10.0::DOUBLE END
  FROM sig p JOIN mac x ON x.ticker = p.ticker AND x.i = p.i + 1)"""

IND = """ind AS MATERIALIZED (
  SELECT b.ticker, b.bar_ts, b.open, b.high, b.low, b.close, b.volume, b.i, b.n,
    CASE WHEN n >= 30 THEN vwap END AS vwap,
    CASE WHEN n >= 30 AND b.i >= 14 THEN g / nullif(g + l, 0) * 100 END AS rsi_14,
    CASE WHEN n >= 30 THEN m.macd END AS macd,
    CASE WHEN n >= 30 THEN s.macd_signal END AS macd_signal,
    CASE WHEN n >= 30 THEN m.macd - s.macd_signal END AS macd_hist,
    CASE WHEN n >= 30 AND b.i >= 19 THEN a20 + 2 * s20 END AS bb_upper,
    CASE WHEN n >= 30 AND b.i >= 19 THEN a20 END AS bb_middle,
    CASE WHEN n >= 30 AND b.i >= 19 THEN a20 - 2 * s20 END AS bb_lower,
    CASE WHEN n >= 30 AND b.i >= 14 THEN r.a END AS atr_14,
    CASE WHEN n >= 30 AND b.i >= 49 THEN a50 END AS sma_50,
    CASE WHEN n >= 30 AND b.i >= 199 THEN a200 END AS sma_200
  FROM base b JOIN rec r USING (ticker, i) JOIN mac m USING (ticker, i) JOIN sig s USING (ticker, i))"""

INDICATORS = (IX, WIN, REC, MACD, SIG, IND)
IND_COLS = ("open", "high", "low", "close", "vwap", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_upper",
            "bb_middle", "bb_lower", "atr_14", "sma_50", "sma_200")

ANALYSED = (
    """an1 AS MATERIALIZED (
  SELECT *, lag(macd_hist) OVER w AS prev_hist, (bb_upper - bb_lower) / nullif(bb_middle, 0) AS bb_width,
    atr_14 / nullif(close, 0) * 100 AS atr_pct,
    volume / nullif(avg(volume) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS volume_ratio
  FROM ind WINDOW w AS (PARTITION BY ticker ORDER BY i))""",
    """an2 AS MATERIALIZED (
  SELECT *, avg(atr_pct) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS usual,
    min(bb_width) OVER (PARTITION BY ticker ORDER BY i ROWS 19 PRECEDING) AS tight,
    coalesce(sign(round(close - vwap, 6)), 0)::BIGINT AS trend,
    sign(round(close - open, 6))::BIGINT AS body,
    CASE WHEN rsi_14 < 30 THEN 1 WHEN rsi_14 > 70 THEN -1 ELSE 0 END::BIGINT AS rsi_signal,
    CASE WHEN macd_hist > 0 AND prev_hist <= 0 THEN 1 WHEN macd_hist < 0 AND prev_hist >= 0 THEN -1 ELSE 0 END::BIGINT AS macd_cross
  FROM an1)""",
    """an3 AS MATERIALIZED (
  SELECT *, rsi_signal + macd_cross AS score,
    CASE WHEN atr_pct > 1.5 * usual THEN 'HIGH' WHEN atr_pct < 0.5 * usual THEN 'LOW' ELSE 'MED' END AS regime,
    coalesce(bb_width = tight, false) AS squeeze, coalesce(volume_ratio >= 2, false) AS spike,
    vwap IS NOT NULL AND body * trend = -1 AS divergence
  FROM an2)""",
    """an4 AS MATERIALIZED (
  SELECT *, CASE WHEN score > 0 THEN 'UP' WHEN score < 0 THEN 'DOWN' ELSE 'SIDEWAYS' END AS technical_direction,
    CASE WHEN spike AND NOT divergence THEN 'STRONG' WHEN divergence OR coalesce(volume_ratio < 0.5, false) THEN 'WEAK'
         ELSE 'NEUTRAL' END AS conviction
  FROM an3)""",
    """an5 AS MATERIALIZED (
  SELECT *, score + CASE WHEN conviction = 'STRONG' THEN trend ELSE 0 END AS vote FROM an4)""",
    """ens AS MATERIALIZED (
  SELECT *, CASE WHEN vote > 0 THEN 'UP' WHEN vote < 0 THEN 'DOWN' ELSE 'SIDEWAYS' END AS prediction_direction,
    sign(vote) * coalesce(atr_pct, 0.0) AS prediction_return_pct,
    CASE WHEN abs(vote) = 2 AND regime <> 'HIGH' THEN 'HIGH' WHEN abs(vote) >= 1 THEN 'MED' ELSE 'LOW' END AS prediction_confidence
  FROM an5)""",
)


def outcome(price: str, ret: str) -> str:
    return f"""CASE WHEN {ret} > 0.25 THEN 'UP' WHEN {ret} < -0.25 THEN 'DOWN' ELSE 'SIDEWAYS' END AS actual_direction,
    round({ret}, 4) AS actual_return_pct, round({price}, 2) AS resolution_price"""


RET = "CASE WHEN close > 0 THEN (later - close) / close * 100 ELSE 0.0 END"


def preds_ctes(step: int = 20) -> tuple[str, ...]:
    return (
        *BARS, *INDICATORS, *ANALYSED,
        f"""later AS MATERIALIZED (
  SELECT *, coalesce(lead(close, 20) OVER w, last_value(close) OVER (PARTITION BY ticker ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS later
  FROM ens WINDOW w AS (PARTITION BY ticker ORDER BY i))""",
        f"""preds AS MATERIALIZED (
  SELECT * EXCLUDE (vwap, rsi_14, macd, macd_signal, bb_upper, bb_lower, bb_middle, atr_14, volume),
    coalesce(vwap, 0) AS vwap, coalesce(rsi_14, 0) AS rsi_14, coalesce(macd, 0) AS macd,
    coalesce(macd_signal, 0) AS macd_signal, coalesce(bb_upper, 0) AS bb_upper, coalesce(bb_lower, 0) AS bb_lower,
    coalesce(bb_middle, 0) AS bb_middle, coalesce(atr_14, 0) AS atr_14, volume::DOUBLE AS volume,
    bar_ts AS "timestamp", 'backtest_' || i AS cycle_id,
    sha256(concat_ws(':', ticker, {t('bar_ts')}, 'backtest_' || i)) AS row_id,
    (volume % 97) * 12.5::DOUBLE + 3 AS inference_latency_ms, false AS used_in_training,
    {outcome('later', RET)}
  FROM later WHERE i >= 30 AND (i - 30) % {step} = 0 AND rsi_14 IS NOT NULL)""",
        """p AS MATERIALIZED (
  SELECT *, prediction_direction = actual_direction AS prediction_accuracy,
    CASE WHEN prediction_direction = actual_direction THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM preds)""",
    )


def bars_q(name: str, select: str) -> None:
    ORACLE_SQL[name] = with_(*BARS, IX, WIN) + select


def ind_q(name: str, select: str) -> None:
    ORACLE_SQL[name] = with_(*BARS, *INDICATORS) + select


def sig_q(name: str, select: str) -> None:
    ORACLE_SQL[name] = with_(*BARS, *INDICATORS, *ANALYSED) + select


def pred_q(name: str, select: str, step: int = 20, extra: tuple[str, ...] = ()) -> None:
    ORACLE_SQL[name] = with_(*preds_ctes(step), *extra) + select


# --- bars and indicators ---------------------------------------------------------------------------

BT = f"{t('bar_ts')} AS bar_ts"
OHLC = rounded("open", "high", "low", "close")
ORACLE_SQL["bars_hourly"] = with_(*BARS) + f"SELECT ticker, {BT}, {OHLC}, volume FROM bars"
ORACLE_SQL["stream_bars"] = ORACLE_SQL["bars_hourly"]
bars_q("vwap", f"SELECT ticker, {BT}, {rounded('vwap')} FROM base")
ORACLE_SQL["rsi"] = with_(*BARS, IX, WIN, REC) + (
    f"SELECT ticker, {BT}, {r('CASE WHEN i >= 14 THEN g / nullif(g + l, 0) * 100 END')} AS rsi_14 "
    "FROM base JOIN rec USING (ticker, i)"
)
ORACLE_SQL["atr"] = with_(*BARS, IX, WIN, REC) + (
    f"SELECT ticker, {BT}, {r('CASE WHEN i >= 14 THEN a END')} AS atr_14 FROM base JOIN rec USING (ticker, i)"
)
ORACLE_SQL["macd"] = with_(*BARS, IX, WIN, REC, MACD, SIG) + (
    f"SELECT ticker, {BT}, {rounded('macd', 'macd_signal')}, {r('macd - macd_signal')} AS macd_hist "
    "FROM base JOIN mac USING (ticker, i) JOIN sig USING (ticker, i)"
)
bars_q("bollinger", f"""SELECT ticker, {BT}, {r('CASE WHEN i >= 19 THEN a20 - 2 * s20 END')} AS bb_lower,
  {r('CASE WHEN i >= 19 THEN a20 END')} AS bb_middle, {r('CASE WHEN i >= 19 THEN a20 + 2 * s20 END')} AS bb_upper FROM base""")
bars_q("true_range", f"SELECT ticker, {BT}, {r('tr')} AS true_range FROM base")
bars_q("sma", f"""SELECT ticker, {BT}, {r('CASE WHEN i >= 49 THEN a50 END')} AS sma_50,
  {r('CASE WHEN i >= 199 THEN a200 END')} AS sma_200 FROM base""")
ORACLE_SQL["ema_generic"] = with_(*BARS, IX, WIN, """gen AS (
  SELECT ticker, i, NULL::DOUBLE AS e, close AS m FROM base WHERE i = 0
  UNION ALL
  SELECT x.ticker, x.i, CASE WHEN x.i = 19 THEN x.a20 ELSE p.e + (x.close - p.e) * 2 / 21.0::DOUBLE END,
    p.m + (x.close - p.m) / 10
  FROM gen p JOIN base x ON x.ticker = p.ticker AND x.i = p.i + 1)""") + (
    f"SELECT ticker, {BT}, {r('e')} AS ema_20, {r('CASE WHEN i >= 9 THEN m END')} AS rma_10 "
    "FROM base JOIN gen USING (ticker, i)"
)
ORACLE_SQL["ema_long"] = with_(TICKS, bars_cte("5 minutes"), IX, """start AS MATERIALIZED (
  SELECT ticker, avg(close) AS a FROM ix WHERE i < 400 GROUP BY 1),
gen AS (
  SELECT ticker, i, NULL::DOUBLE AS e, close AS m FROM ix WHERE i = 0
  UNION ALL
  SELECT x.ticker, x.i, CASE WHEN x.i = 399 THEN s.a ELSE p.e + (x.close - p.e) * 2 / 401.0::DOUBLE END, p.m + (x.close - p.m) / 300
  FROM gen p JOIN ix x ON x.ticker = p.ticker AND x.i = p.i + 1 JOIN start s ON s.ticker = p.ticker)""") + (
    f"SELECT ticker, {BT}, {r('e')} AS ema_400, {r('CASE WHEN i >= 299 THEN m END')} AS rma_300 FROM ix JOIN gen USING (ticker, i)"
)
bars_q("min_history_gate", f"SELECT ticker, {BT}, n AS series_len, {r('CASE WHEN n >= 680 THEN vwap END')} AS vwap FROM base")
ind_q("indicators_all", f"SELECT ticker, {BT}, {rounded(*IND_COLS)}, volume, i AS series_idx, n AS series_len FROM ind")
ORACLE_SQL["stream_indicators_late"] = with_(TICKS, bars_cte("5 minutes"), *INDICATORS) + (
    f"SELECT ticker, {BT}, {rounded(*IND_COLS)}, volume FROM ind")
ind_q("stream_indicators", f"SELECT ticker, {BT}, {rounded(*IND_COLS)}, volume, i AS series_idx FROM ind")
ORACLE_SQL["supplier_bars_indicators"] = with_(SUPPLIER_BARS, *INDICATORS) + (
    f"SELECT ticker, {BT}, " + rounded("close", "vwap", "rsi_14", "macd", "macd_signal", "bb_upper", "atr_14", "sma_50", digits=3)
    + " FROM ind"
)

# --- selections, checks, positions -------------------------------------------------------------------

LATEST = "QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) <= "
ORACLE_SQL["latest_per_ticker"] = with_(*BARS) + f"SELECT ticker, {BT}, {OHLC}, volume FROM bars b {LATEST} 1".replace("bar_ts DESC", "b.bar_ts DESC")
ORACLE_SQL["stream_latest"] = ORACLE_SQL["latest_per_ticker"]
ORACLE_SQL["last_n_bars"] = with_(*BARS) + f"SELECT ticker, {BT}, {OHLC}, volume FROM bars b {LATEST} 100".replace("bar_ts DESC", "b.bar_ts DESC")
ORACLE_SQL["bar_change"] = with_(*BARS) + f"""SELECT ticker AS symbol, {BT}, {r('close - open')} AS change,
  {r('(close - open) / nullif(close, 0) * 100')} AS change_pct,
  CASE WHEN close >= open THEN 'up' ELSE 'down' END AS side FROM bars"""
bars_q("bar_returns", f"SELECT ticker, {BT}, {r('pc')} AS prev_close, {r('(close - pc) / nullif(pc, 0)')} AS simple_return FROM base")
ORACLE_SQL["ohlc_violations"] = with_(SUPPLIER_BARS, IX, WIN) + f"""SELECT ticker, {BT}, {r('pc', 4)} AS open,
  {rounded('high', 'low', 'close', digits=4)} FROM base
  WHERE high < greatest(pc, close) OR low > least(pc, close)"""
bars_q("series_index", f"SELECT ticker, {BT}, i AS series_idx, n AS series_len FROM base")
bars_q("systematic_sample", f"SELECT ticker, {BT}, i AS series_idx, {r('close')} AS close FROM base WHERE i >= 30 AND (i - 30) % 20 = 0")
ORACLE_SQL["replay_cycles"] = with_(*BARS, IX) + f"""SELECT c AS cycle, ticker, {BT}, {r('close')} AS close
  FROM ix, (SELECT unnest(range(150)) AS c) WHERE i // 7 = c % CAST(ceil(n / 7.0) AS BIGINT)"""
ORACLE_SQL["replay_cycles_once"] = with_(*BARS, IX) + (
    f"SELECT i // 7 AS cycle, ticker, {BT}, {r('close')} AS close FROM ix WHERE i // 7 < 150"
)
ORACLE_SQL["session_grid_missing"] = with_(TICKS, bars_cte("5 minutes"), """days AS (
  SELECT DISTINCT ticker, CAST(bar_ts AS DATE) AS d FROM bars WHERE isodow(bar_ts) <= 5)""", """grid AS (
  SELECT ticker, d, d + INTERVAL '09:25' HOUR_MINUTE + k * INTERVAL 5 MINUTE AS g
  FROM days, (SELECT unnest(range(71)) AS k))""".replace("INTERVAL '09:25' HOUR_MINUTE", "INTERVAL 565 MINUTE")) + f"""
  SELECT ticker, strftime(d, '%Y-%m-%d') AS date, {t('g')} AS bar_ts FROM grid
  WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = grid.ticker AND b.bar_ts = grid.g)"""

HOLIDAY = "(month({0}), day({0})) IN ((1, 26), (8, 15), (10, 2), (12, 25))"


def _trading(ts: str) -> str:
    return f"(isodow({ts}) <= 5 AND NOT {HOLIDAY.format(ts)})"


def _session(ts: str) -> str:
    hm = f"strftime({ts}, '%H:%M')"
    return f"({_trading(ts)} AND {hm} >= '09:25' AND {hm} < CASE WHEN isodow({ts}) = 5 THEN '15:00' ELSE '15:15' END)"


ORACLE_SQL["market_calendar"] = f"""SELECT event_id, {_trading('ts')} AS trading_day, {_session('ts')} AS in_session,
  {_trading('ts')} AND strftime(ts, '%H:%M') >= '09:15' AND strftime(ts, '%H:%M') < '09:25' AS premarket,
  {_trading('ts')} AND strftime(ts, '%H:%M') >= '15:30' AS postmarket FROM events"""
_IST = "(ts + INTERVAL 330 MINUTE)"
ORACLE_SQL["market_zone"] = f"SELECT event_id, {t(_IST)} AS ist_ts, {_session(_IST)} AS in_session FROM events"
ORACLE_SQL["trading_day_bars"] = with_(*BARS) + f"SELECT ticker, {BT}, {r('close')} AS close FROM bars b WHERE {_trading('b.bar_ts')}"

CONFIGURED = """(VALUES (0, 'NSE:RELIANCE', 'Energy'), (1, 'NSE:TCS', 'IT Services'), (2, 'NSE:HDFCBANK', 'Banking'),
  (3, 'NSE:INFY', 'IT Services'), (4, 'NSE:ICICIBANK', 'Banking'), (5, 'NSE:SBIN', 'Banking'),
  (6, 'NSE:BHARTIARTL', 'Telecom'), (7, 'NSE:ITC', 'FMCG'), (8, 'NSE:WIPRO', 'IT Services'),
  (9, 'NSE:AXISBANK', 'Banking')) v(ord, ticker, sector)"""
ORACLE_SQL["universe_audit"] = f"""WITH u AS (
  SELECT s_suppkey::BIGINT AS ord, format('S{{:06d}}', s_suppkey) AS ticker, n_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT ord + 1000000000, ticker, sector FROM {CONFIGURED})
SELECT ord, ticker, sector FROM u WHERE ticker NOT IN (SELECT format('S{{:06d}}', l_suppkey) FROM lineitem)"""
ORACLE_SQL["active_universe"] = with_(SUPPLIER_BARS) + f"""SELECT ticker, {BT}, {r('close', 4)} AS close, volume FROM bars
  WHERE ticker IN (SELECT format('S{{:06d}}', s_suppkey) FROM supplier ORDER BY s_suppkey LIMIT 3)"""
TICK_ROW = f"ticker, {t('ts')} AS ts, {r('price')} AS price, volume, event_id"
ORACLE_SQL["dedupe_last"] = with_(TICKS) + f"""SELECT {TICK_ROW} FROM ticks k
  QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('second', k.ts) ORDER BY event_id DESC) = 1"""
ORACLE_SQL["stream_upsert"] = ORACLE_SQL["dedupe_last"]
ORACLE_SQL["distinct_last"] = f"""SELECT user_id, event_id, {r('value')} AS value FROM events e
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""
ORACLE_SQL["required_keys"] = with_(TICKS) + """SELECT CASE WHEN volume >= 10 THEN 'valid' ELSE 'quarantine' END AS part,
  count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM ticks GROUP BY 1"""

# --- signals and predictions -------------------------------------------------------------------------

sig_q("technical_signal", f"""SELECT ticker, {BT}, i AS series_idx, trend, rsi_signal, macd_cross, score, technical_direction FROM ens""")
sig_q("volatility_signal", f"SELECT ticker, {BT}, i AS series_idx, {rounded('bb_width', 'atr_pct')}, regime, squeeze FROM ens")
sig_q("volume_signal", f"SELECT ticker, {BT}, i AS series_idx, {rounded('volume_ratio')}, spike, divergence, conviction FROM ens")
sig_q("ensemble", f"""SELECT ticker, {BT}, vote, prediction_direction, {rounded('prediction_return_pct')},
  prediction_confidence FROM ens""")

AGENT_JSON = """'[{"sender":"Technical Analyst","text":"' || technical_direction || ' score=' || score ||
  '","type":"contribution","turn":0},{"sender":"Volatility Analyst","text":"' || regime || ' squeeze=' || squeeze ||
  '","type":"contribution","turn":1},{"sender":"Volume Analyst","text":"' || conviction || ' divergence=' || divergence ||
  '","type":"contribution","turn":2},{"sender":"Synthesizer","text":"' || prediction_direction || ' ' || prediction_confidence ||
  '","type":"synthesis","turn":3}]'"""
TS = f"""{t('"timestamp"')} AS "timestamp\""""
pred_q("backtest_ledger", f"""SELECT row_id, {TS}, ticker, cycle_id, {rounded('open', 'high', 'low', 'close', 'volume', 'vwap',
  'rsi_14', 'macd', 'macd_signal', 'bb_upper', 'bb_lower', 'bb_middle', 'atr_14')}, prediction_direction,
  {rounded('prediction_return_pct')}, prediction_confidence, {AGENT_JSON} AS agent_contributions,
  cycle_id || '_' || ticker AS band_room_id, 'rules' AS model_version, {rounded('inference_latency_ms')},
  'backtest' AS mode, 'bars' AS data_source, actual_direction, {rounded('actual_return_pct')}, prediction_accuracy,
  {rounded('resolution_price', 'reward')}, used_in_training FROM p""")

METHODS = """m AS (
  SELECT p.*, u.method, CASE u.method
    WHEN 'random' THEN CASE WHEN md5(row_id || '|42') < repeat('5', 32) THEN 'UP' WHEN md5(row_id || '|42') < repeat('a', 32)
      THEN 'DOWN' ELSE 'SIDEWAYS' END
    WHEN 'ensemble' THEN prediction_direction WHEN 'constant' THEN 'UP' WHEN 'rule' THEN technical_direction
    ELSE CASE WHEN trend > 0 THEN 'UP' WHEN trend < 0 THEN 'DOWN' WHEN trend = 0 THEN 'SIDEWAYS' END END AS d
  FROM p, (VALUES ('random'), ('rule'), ('single'), ('ensemble'), ('constant')) u(method))"""
pred_q("baseline_compare", f"""SELECT method, {r('acc')} AS accuracy_pct, n,
  {r("acc - max(CASE WHEN method = 'random' THEN acc END) OVER ()")} AS delta_pct
  FROM (SELECT method, avg((d = actual_direction)::INT) * 100 AS acc, count(*) AS n FROM m GROUP BY method)""", extra=(METHODS,))

MARKET_TEXT = f"""concat_ws(chr(10), 'Ticker: ' || ticker,
  'Price: O=' || {two('open')} || ' H=' || {two('high')} || ' L=' || {two('low')} || ' C=' || {two('close')},
  'Volume: ' || {two('volume', 0)}, 'VWAP: ' || {two('vwap')}, 'RSI(14): ' || {two('rsi_14')},
  'MACD: ' || {two('macd')} || ' (signal: ' || {two('macd_signal')} || ')',
  'Bollinger Bands: ' || {two('bb_lower')} || ' - ' || {two('bb_middle')} || ' - ' || {two('bb_upper')},
  'ATR(14): ' || {two('atr_14')})"""
pred_q("market_text", f"SELECT row_id, {MARKET_TEXT} AS market_text FROM p")

ROLE_ROWS = """roles(role_ord, role, instruction) AS (VALUES
  (0::BIGINT, 'technical_analyst', 'Judge the trend from price, VWAP, RSI and MACD. State a direction, an expected return in percent and a confidence.'),
  (1::BIGINT, 'volatility_analyst', 'Judge the risk from ATR and the width of the Bollinger bands. State the regime and any squeeze.'),
  (2::BIGINT, 'volume_analyst', 'Judge whether the volume supports the price move. State the conviction and any divergence.'))"""
pred_q("agent_prompts", f"""SELECT row_id, role_ord, role, instruction || chr(10) || chr(10) || {MARKET_TEXT} AS prompt
  FROM p, roles""", extra=(ROLE_ROWS,))

ANSWERS = """answers AS MATERIALIZED (
  SELECT row_id, role, role_ord, ok, CASE WHEN ok THEN said ELSE 'timeout' END AS text, inference_latency_ms + role_ord * 10 AS latency_ms
  FROM (SELECT row_id, inference_latency_ms, role, role_ord, substr(md5(row_id || '|' || role), 1, 1) > '2' AS ok,
      CASE role_ord WHEN 0 THEN technical_direction WHEN 1 THEN regime ELSE conviction END AS said
    FROM p, (VALUES ('technical_analyst', 0), ('volatility_analyst', 1), ('volume_analyst', 2)) v(role, role_ord)))"""
GATHERED = "gathered AS (SELECT row_id, " + ", ".join(
    f"max(CASE WHEN role = '{x}' THEN text END) AS {x}_text, bool_or(CASE WHEN role = '{x}' THEN ok END) AS {x}_ok"
    for x in ("technical_analyst", "volatility_analyst", "volume_analyst")
) + " FROM answers GROUP BY row_id)"
pred_q("gather_agents", "SELECT * FROM gathered", extra=(ANSWERS, GATHERED))


def _block(role: str, name: str) -> str:
    return (f"CASE WHEN {role}_ok THEN '--- {name} ---' || chr(10) || {role}_text "
            f"ELSE '--- {name} --- [FAILED: ' || {role}_text || ']' END")


pred_q("synthesis_prompt", f"""SELECT row_id, 'Combine these analyses of one ticker into a single prediction.' || chr(10) || chr(10) ||
  concat_ws(chr(10) || chr(10), {_block('technical_analyst', 'Technical Analyst')}, {_block('volatility_analyst', 'Volatility Analyst')},
  {_block('volume_analyst', 'Volume Analyst')}) || chr(10) || chr(10) ||
  'Answer with one JSON object with the keys direction, target_return_pct and confidence.' AS synthesis_prompt FROM gathered""",
       extra=(ANSWERS, GATHERED))
pred_q("prediction_latency", f"""SELECT row_id, {r('coalesce(sum(CASE WHEN ok THEN latency_ms END), 0)')} AS inference_latency_ms,
  {r('sum(latency_ms)')} AS with_failed_ms FROM answers GROUP BY row_id""", extra=(ANSWERS,))

HALF_UP_2 = "CAST(round(CAST({0} AS DECIMAL(18, 4)), 2) AS DOUBLE)"
_body = lambda d, x, c: f"""'{{"direction":"' || {d} || '","target_return_pct":' || {x} || ',"confidence":"' || {c} || '"}}'"""
_ret = f"CAST({HALF_UP_2.format('actual_return_pct')} AS VARCHAR)"
_d, _c = "prediction_direction", "prediction_confidence"
RESPONSES = f"""responses AS MATERIALIZED (
  SELECT row_id, attempt, CASE
    WHEN kind IN ('0', '1', '2', '3') THEN {_body(_d, _ret, _c)}
    WHEN kind IN ('4', '5') THEN {_body(f'lower({_d})', _ret, f'lower({_c})')}
    WHEN kind = '6' THEN {_body("'INVALID'", _ret, "'SURE'")}
    WHEN kind IN ('7', '8', '9') THEN substr({_body(_d, _ret, _c)}, 1, 20)
    WHEN kind = 'a' THEN '{{}}'
    WHEN kind = 'b' THEN {_body(_d, f"""'"' || {_ret} || '"'""", _c)}
    WHEN kind = 'c' THEN {_body(_d, _ret, _c)} || ' and so on'
    WHEN kind = 'd' THEN '[1, 2]'
    WHEN kind = 'e' THEN {_body(_d, "'" + '"much"' + "'", _c)}
    ELSE 'no answer' END AS response
  FROM (SELECT p.*, a AS attempt, substr(md5(row_id || '|' || a), 1, 1) AS kind FROM p, (VALUES (1), (2)) v(a)))"""
PARSED = """parsed AS MATERIALIZED (
  SELECT row_id, arg_min(response, attempt) AS response FROM responses WHERE json_valid(response) GROUP BY row_id)"""
FIELDS = """fields AS (
  SELECT p.row_id, json_type(response) = 'OBJECT' AS is_obj,
    CASE WHEN json_exists(response, '$.target_return_pct') THEN TRY_CAST(json_extract_string(response, '$.target_return_pct') AS DOUBLE)
      ELSE 0.0 END AS ret,
    upper(coalesce(json_extract_string(response, '$.direction'), 'SIDEWAYS')) AS dir,
    upper(coalesce(json_extract_string(response, '$.confidence'), 'LOW')) AS conf
  FROM p LEFT JOIN parsed USING (row_id))"""
pred_q("normalize_responses", f"""SELECT row_id,
  CASE WHEN is_obj AND ret IS NOT NULL AND dir IN ('UP', 'DOWN', 'SIDEWAYS') THEN dir ELSE 'SIDEWAYS' END AS direction,
  {r('CASE WHEN is_obj AND ret IS NOT NULL THEN ret ELSE 0.0 END')} AS target_return_pct,
  CASE WHEN is_obj AND ret IS NOT NULL AND conf IN ('HIGH', 'MED', 'LOW') THEN conf ELSE 'LOW' END AS confidence FROM fields""",
       extra=(RESPONSES, PARSED, FIELDS))

# --- outcomes ----------------------------------------------------------------------------------------

bars_q("return_label", f"""SELECT ticker, {BT}, {r('ret')} AS return_pct,
  CASE WHEN ret > 0.25 THEN 'UP' WHEN ret < -0.25 THEN 'DOWN' WHEN ret IS NOT NULL THEN 'SIDEWAYS' END AS direction
  FROM (SELECT *, CASE WHEN pc > 0 THEN (close - pc) / pc * 100 ELSE 0.0 END AS ret FROM base)""")
bars_q("resolve_offset", f"""SELECT ticker, {BT}, {r('close')} AS close,
  {r('''coalesce(lead(close, 20) OVER (PARTITION BY ticker ORDER BY i), last_value(close) OVER (PARTITION BY ticker ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))''')} AS resolution_price FROM base""")


def _asof(limit: str) -> str:
    return with_(TICKS) + f"""SELECT l.event_id, CASE WHEN {limit} THEN {t('q.ts')} END AS matched_ts,
  CASE WHEN {limit} THEN {r('q.price')} END AS matched_value
  FROM (SELECT *, ts + INTERVAL 300 SECOND AS due FROM ticks) l
  ASOF LEFT JOIN ticks q ON l.ticker = q.ticker AND l.due <= q.ts"""


ORACLE_SQL["resolve_forward"] = _asof("q.ts <= l.ts + INTERVAL 3600 SECOND")
ORACLE_SQL["resolve_forward_unbounded"] = _asof("true")

PHASE2 = f"""row_id, actual_direction, {rounded('actual_return_pct')}, {t('resolution_timestamp')} AS resolution_timestamp,
  prediction_accuracy::VARCHAR AS prediction_accuracy, {rounded('resolution_price', 'reward')},
  used_in_training::VARCHAR AS used_in_training"""


def _phase2(found: str, price: str, at: str, late: str, late_at: str) -> str:
    """Outcome columns of pending rows with a price, without one in time, or still waiting."""
    ret = f"(CASE WHEN close > 0 THEN ({price} - close) / close * 100 ELSE 0.0 END)"
    label = f"(CASE WHEN {ret} > 0.25 THEN 'UP' WHEN {ret} < -0.25 THEN 'DOWN' ELSE 'SIDEWAYS' END)"
    pick = lambda a, b: f"CASE WHEN {found} THEN {a} WHEN {late} THEN {b} END"
    return f"""SELECT row_id, {pick(label, "'EXPIRED'")} AS actual_direction, {pick(f'round({ret}, 4)', '0.0::DOUBLE')} AS actual_return_pct,
    {pick(at, late_at)} AS resolution_timestamp, {pick(f'prediction_direction = {label}', 'false')} AS prediction_accuracy,
    {pick(f'round({price}, 2)', '0.0::DOUBLE')} AS resolution_price,
    {pick(f'(prediction_direction = {label})::INT::DOUBLE', '0.0::DOUBLE')} AS reward,
    {pick('false', 'false')} AS used_in_training"""


def _waiting(prices: str, asof: str, later: int = 0) -> str:
    return f"""res AS ({_phase2('q.ts IS NOT NULL AND q.ts <= l.bar_ts + INTERVAL 3600 SECOND', 'q.price', 'q.ts',
        f"{asof} > l.bar_ts + INTERVAL 3600 SECOND", 'l.bar_ts + INTERVAL 3600 SECOND')}
  FROM (SELECT row_id, ticker, b.bar_ts, b.bar_ts + INTERVAL 300 SECOND AS due, close, prediction_direction
    FROM (SELECT * REPLACE (p0.bar_ts + INTERVAL {later} SECOND AS bar_ts) FROM p p0) b) l
  ASOF LEFT JOIN {prices} q ON l.ticker = q.ticker AND l.due <= q.ts)"""


pred_q("resolve_phase2", f"SELECT {PHASE2} FROM res", step=1, extra=(
    "known AS (SELECT ticker, ts, price FROM ticks WHERE ts <= TIMESTAMP '2024-01-25')",
    _waiting("known", "TIMESTAMP '2024-01-25'"),
))
pred_q("stream_resolve", f"SELECT {PHASE2} FROM res", step=1, extra=(
    """known AS MATERIALIZED (SELECT ticker, time_bucket(INTERVAL '5 minutes', ts) AS ts, arg_max(price, ts) AS price
      FROM ticks k GROUP BY ticker, time_bucket(INTERVAL '5 minutes', k.ts))""",
    _waiting("known", "TIMESTAMP '2100-01-01'"),
))
pred_q("stream_resolve_ticks", f"SELECT {PHASE2} FROM res", step=1, extra=(_waiting("ticks", "TIMESTAMP '2100-01-01'", 97),))
LAST_PRICES = """last_prices AS (
  SELECT ticker, arg_max(price, ts) AS price FROM ticks WHERE ticker <> 'error' GROUP BY ticker)"""
pred_q("attach_price", f"""SELECT row_id, ticker, {r('close')} AS close, {r('coalesce(price, close)')} AS current_price
  FROM p LEFT JOIN last_prices USING (ticker)""", extra=(LAST_PRICES,))
NOW = "TIMESTAMP '2024-01-20 12:30:00'"
pred_q("resolve_current", f"SELECT {PHASE2} FROM res", step=1, extra=(LAST_PRICES, f"""res AS ({_phase2(
    f"{NOW} >= bar_ts + INTERVAL 300 SECOND", 'coalesce(price, close)', NOW, 'false', NOW)}
  FROM (SELECT row_id, ticker, bar_ts, close, prediction_direction FROM p) LEFT JOIN last_prices USING (ticker))"""))
SWEPT = f"""res AS (SELECT row_id,
    CASE WHEN age > 3600 THEN 'EXPIRED' WHEN age > 300 THEN 'SIDEWAYS' END AS actual_direction,
    CASE WHEN age > 300 THEN 0.0::DOUBLE END AS actual_return_pct, CASE WHEN age > 300 THEN {NOW} END AS resolution_timestamp,
    CASE WHEN age > 300 THEN false END AS prediction_accuracy,
    CASE WHEN age > 3600 THEN 0.0::DOUBLE WHEN age > 300 THEN close END AS resolution_price,
    CASE WHEN age > 300 THEN 0.0::DOUBLE END AS reward, CASE WHEN age > 300 THEN false END AS used_in_training
  FROM (SELECT *, epoch({NOW}) - epoch(bar_ts) AS age FROM p))"""
pred_q("sweep_orphans", f"SELECT {PHASE2} FROM res", step=1, extra=(SWEPT,))
pred_q("overall_accuracy_expired", f"""SELECT {r('avg(prediction_accuracy::INT) * 100')} AS accuracy_pct, count(*) AS n
  FROM res WHERE actual_direction IS NOT NULL""", step=1, extra=(SWEPT,))

# --- replay and curation -----------------------------------------------------------------------------

OLD, NEW = "\"timestamp\" < TIMESTAMP '2024-01-20'", "\"timestamp\" >= TIMESTAMP '2024-01-10'"
CUT = "\"timestamp\" >= TIMESTAMP '2024-02-28' - INTERVAL 45 DAY"
pred_q("merge_replay", f"SELECT row_id, {TS}, actual_direction, p0.{OLD} AS used_in_training FROM p AS p0 WHERE p0.{CUT}")
pred_q("replay_roundtrip", f"SELECT row_id, {TS}, p0.{OLD} AS used_in_training FROM p AS p0 WHERE p0.{CUT}")
pred_q("merge_latest", f"SELECT row_id, {TS}, p0.\"timestamp\" < TIMESTAMP '2024-01-10' AS used_in_training FROM p AS p0")
pred_q("mark_trained", "SELECT row_id, prediction_direction = 'UP' AS used_in_training FROM p")
pred_q("mix_replay", f"""SELECT row_id, 'rolling' AS source FROM p WHERE NOT ({OLD}) UNION ALL
  SELECT row_id, source FROM (SELECT row_id, 'static' AS source, row_number() OVER (ORDER BY md5(row_id || '|42'), row_id) AS k
    FROM p WHERE {OLD}) WHERE k <= floor((SELECT count(*) FROM p WHERE NOT ({OLD})) * (0.3::DOUBLE / 0.7::DOUBLE) + 1e-9)""")
JSON_DONE = f"""'{{"direction":"' || actual_direction || '","target_return_pct":' || {_ret} || ',"confidence":"' ||
  prediction_confidence || '"}}'"""
PROMPT = f"{MARKET_TEXT} || chr(10) || chr(10) || 'Give the direction, the return in percent and the confidence.'"
pred_q("eligible_pairs", f"SELECT {PROMPT} AS prompt, {JSON_DONE} AS completion, row_id FROM p WHERE prediction_accuracy")
pred_q("class_counts", """SELECT actual_direction, count(*) AS n, min(count(*)) OVER () AS min_count FROM p GROUP BY actual_direction""")
pred_q("training_ready", "SELECT count(*) AS n, count(*) >= 20 AS ready FROM p")
BALANCE = """SELECT row_id, actual_direction FROM (SELECT *, row_number() OVER (PARTITION BY actual_direction
    ORDER BY md5(row_id || '|42'), row_id) AS k FROM {0})
  WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM {0} GROUP BY actual_direction))"""
pred_q("balance_classes", BALANCE.format("p"))
ORACLE_SQL["balance_events"] = """WITH c AS (SELECT event_id AS row_id,
  CASE WHEN value > 60 THEN 'UP' WHEN value > 20 THEN 'DOWN' ELSE 'SIDEWAYS' END AS actual_direction FROM events)
""" + BALANCE.format("c")
ORACLE_SQL["train_split"] = """SELECT event_id, CASE WHEN md5(event_id || '|42') < '1999999999999999' || repeat('0', 16)
  THEN 'validation' ELSE 'train' END AS part FROM events"""
pred_q("pair_text", f"""SELECT row_id, length(x) AS n_chars, substr(x, 1, 120) AS cut_text
  FROM (SELECT row_id, {PROMPT} || chr(10) || {JSON_DONE} AS x FROM p)""")

# --- statistics --------------------------------------------------------------------------------------

ACC = "avg(prediction_accuracy::INT) * 100"
pred_q("overall_accuracy", f"SELECT {r(ACC)} AS accuracy_pct, count(*) AS n FROM p")
pred_q("accuracy_by_confidence", f"SELECT prediction_confidence, {r(ACC)} AS accuracy_pct, count(*) AS n FROM p GROUP BY 1")
pred_q("calibration", f"""SELECT prediction_confidence, {r(ACC)} AS accuracy_pct, count(*) AS n,
  {r('stddev_samp(prediction_accuracy::INT)')} AS std, {r('stddev_samp(prediction_accuracy::INT) / sqrt(count(*)) * 100')} AS stderr_pct
  FROM p GROUP BY 1 HAVING count(*) > 1""")
pred_q("accuracy_by_ticker", f"SELECT ticker AS ticker_short, {r(ACC)} AS accuracy_pct, count(*) AS n FROM p GROUP BY 1")
pred_q("direction_distribution", "SELECT ticker, " + ", ".join(
    f"count(*) FILTER (prediction_direction = '{x}') AS n_{x.lower()}" for x in ("UP", "DOWN", "SIDEWAYS")
) + ", count(*) AS n FROM p GROUP BY ticker")
pred_q("sign_agreement", "SELECT row_id, sign(prediction_return_pct) = sign(actual_return_pct) AS agree FROM p")
pred_q("return_correlation", f"SELECT {r('corr(prediction_return_pct, actual_return_pct)')} AS r, count(*) AS n FROM p")
pred_q("latency_median", f"SELECT {r('median(inference_latency_ms)')} AS median_ms, count(*) AS n FROM p")
ORACLE_SQL["line_price_quartile"] = f"""SELECT l_returnflag AS ticker, {r('quantile_cont(l_extendedprice, 0.25)')} AS quantile, count(*) AS n
  FROM lineitem GROUP BY 1"""
ORACLE_SQL["value_median_by_ticker"] = f"SELECT event_type AS ticker, {r('median(value)')} AS quantile, count(*) AS n FROM events GROUP BY 1"
pred_q("latency_histogram", f"""SELECT b AS bin, {r('lo + w * b')} AS lo, {r('lo + w * (b + 1)')} AS hi,
  (SELECT count(*) FROM p WHERE least(floor((inference_latency_ms - lo) / (w * 30) * 30), 29) = b) AS n
  FROM (SELECT min(inference_latency_ms) AS lo, (max(inference_latency_ms) - min(inference_latency_ms)) / 30 AS w FROM p),
    (SELECT unnest(range(30)) AS b)""")
pred_q("run_summary", f"""SELECT count(*) AS n_predictions, count(actual_direction) AS n_resolved,
  {r('avg(inference_latency_ms)')} AS avg_latency_ms,
  {r('count(*) / greatest(sum(inference_latency_ms) / 1000, 1) * 60')} AS predictions_per_min FROM p""")
pred_q("cycle_latency", f"""SELECT cycle_id, {r('round(sum(inference_latency_ms) / 5, 1)')} AS inference_avg_ms,
  {r('sum(inference_latency_ms)')} AS inference_total_ms FROM p GROUP BY cycle_id""")
ORD = 'ORDER BY "timestamp", row_id'
NUMBERED = f"""o AS MATERIALIZED (
  SELECT *, row_number() OVER ({ORD}) - 1 AS k, count(*) OVER () AS total, row_number() OVER (PARTITION BY ticker {ORD}) - 1 AS kt
  FROM p)"""
pred_q("prediction_index", "SELECT row_id, k AS series_idx, total AS series_len FROM o", extra=(NUMBERED,))
ROLL = f"avg(prediction_accuracy::INT) OVER (ORDER BY k ROWS 19 PRECEDING) * 100"
pred_q("rolling_accuracy", f"SELECT row_id, k AS series_idx, {r(ROLL)} AS rolling_accuracy_pct FROM o", extra=(NUMBERED,))
ORACLE_SQL["stream_rolling_accuracy"] = ORACLE_SQL["rolling_accuracy"]
pred_q("rolling_accuracy_by_ticker", f"""SELECT row_id, kt AS series_idx,
  {r('avg(prediction_accuracy::INT) OVER (PARTITION BY ticker ORDER BY kt ROWS 19 PRECEDING) * 100')} AS rolling_accuracy_pct FROM o""",
       extra=(NUMBERED,))
pred_q("rolling_accuracy_auto", f"""SELECT o.row_id, o.k AS series_idx, w AS window_rows,
  {r('CASE WHEN least(k + 1, w) >= 5 THEN (c - coalesce(lag_c, 0)) / least(k + 1, w)::DOUBLE * 100 END')} AS rolling_accuracy_pct,
  {r('100 / 3.0::DOUBLE')} AS random_level_pct
  FROM (SELECT a.*, b.c AS lag_c FROM runs a LEFT JOIN runs b ON b.k = a.k - a.w) o""", step=2, extra=(NUMBERED, """runs AS MATERIALIZED (
  SELECT row_id, k, greatest(20, total // 15) AS w, sum(prediction_accuracy::INT) OVER (ORDER BY k) AS c FROM o)"""))
pred_q("cumulative_return", f"SELECT row_id, k AS series_idx, {r('sum(actual_return_pct) OVER (ORDER BY k)')} AS cumulative_return_pct FROM o",
       extra=(NUMBERED,))
pred_q("centered_ma", f"""SELECT row_id, {r('avg(x) OVER (ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS ma_5,
  {r('avg(x) OVER (ORDER BY k ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)')} AS centered_ma
  FROM (SELECT row_id, k, {ROLL} AS x FROM o)""", extra=(NUMBERED,))
pred_q("order_predictions", f"SELECT row_id, {TS}, ticker FROM p AS p0 ORDER BY p0.\"timestamp\", row_id")
pred_q("scatter_last_100", f"""SELECT row_id, prediction_accuracy, {rounded('prediction_return_pct', 'actual_return_pct')} FROM (
  SELECT *, row_number() OVER (PARTITION BY prediction_accuracy ORDER BY "timestamp" DESC, row_id DESC) AS k FROM p) WHERE k <= 100""",
       step=2)

# --- rooms, storage, snapshot ------------------------------------------------------------------------

MSGS = """msgs AS (SELECT conv_id AS room_id, turn, role AS sender,
  CASE WHEN role = 'system' THEN 'system' ELSE 'contribution' END AS type, text FROM conversations)"""
ORACLE_SQL["room_history"] = with_(MSGS) + "SELECT room_id, turn, sender, type, text FROM msgs"
ORACLE_SQL["room_transcript"] = with_(MSGS) + """SELECT room_id, n AS n_messages, length(x)::BIGINT AS n_chars,
  CASE WHEN length(x) > 3000 THEN substr(x, 1, 3000) || '...[truncated]' ELSE x END AS transcript
  FROM (SELECT room_id, count(*) AS n, string_agg('[' || sender || '] ' || text, chr(10) ORDER BY turn) AS x FROM msgs GROUP BY room_id)"""
ORACLE_SQL["keep_newest_rooms"] = with_(MSGS) + """SELECT room_id, turn, sender FROM msgs
  WHERE room_id IN (SELECT DISTINCT room_id FROM msgs ORDER BY room_id DESC LIMIT 10)"""
ORACLE_SQL["drop_orphans"] = with_(MSGS) + """SELECT room_id, turn, sender FROM msgs
  WHERE room_id IN (SELECT room_id FROM msgs WHERE turn = 0 AND sender = 'user')"""
ORACLE_SQL["assign_turns"] = """SELECT event_type AS room_id, event_id,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS turn FROM events"""
pred_q("contributions", """SELECT row_id, turn, sender, CASE WHEN turn = 3 THEN 'synthesis' ELSE 'contribution' END AS type,
  CASE turn WHEN 0 THEN technical_direction || ' score=' || score WHEN 1 THEN regime || ' squeeze=' || squeeze
    WHEN 2 THEN conviction || ' divergence=' || divergence ELSE prediction_direction || ' ' || prediction_confidence END AS text
  FROM p, (VALUES (0::BIGINT, 'Technical Analyst'), (1, 'Volatility Analyst'), (2, 'Volume Analyst'), (3, 'Synthesizer')) v(turn, sender)
  WHERE prediction_confidence <> 'LOW'""")
pred_q("ledger_roundtrip", f"""SELECT row_id, ticker, {TS}, {r('close')} AS close, prediction_direction, actual_direction
  FROM p WHERE ticker IN ('click', 'error')""")
pred_q("ledger_two_writers", f"SELECT row_id, ticker, {TS}, {r('close')} AS close, prediction_direction, actual_direction FROM p")
ORACLE_SQL["replay_merge_days"] = ORACLE_SQL["merge_replay"]
ORACLE_SQL["contributions_lookup"] = ORACLE_SQL["contributions"].replace(
    "WHERE prediction_confidence <> 'LOW'", "WHERE row_id IN (SELECT row_id FROM p ORDER BY row_id LIMIT 10)")
ORACLE_SQL["resolve_stored_prices"] = ORACLE_SQL["resolve_phase2"] + """
  WHERE row_id IN (SELECT row_id FROM p WHERE bar_ts >= TIMESTAMP '2024-01-10' AND bar_ts < TIMESTAMP '2024-01-13')"""
pred_q("snapshot_latest", """SELECT '{"market":{' || (
    SELECT string_agg('"' || ticker || '":{"open":' || open || ',"high":' || high || ',"low":' || low || ',"close":' || close ||
      ',"volume":' || volume || '}', ',' ORDER BY ticker)
    FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) = 1)) ||
  '},"predictions":{' || (
    SELECT string_agg('"' || ticker || '":{"direction":"' || prediction_direction || '","target_return_pct":' ||
      round(prediction_return_pct, 2) || ',"confidence":"' || prediction_confidence || '"}', ',' ORDER BY ticker)
    FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY "timestamp" DESC) = 1)) ||
  '},"status":{"mode":"INFERENCE_ONLY","data_source":"events"}}' AS snapshot""")
pred_q("stream_dedupe", f"SELECT row_id, {TS}, ticker, {r('close')} AS close FROM p")
pred_q("post_market", f"""SELECT row_id, {TS}, prediction_accuracy, row_id IN (SELECT row_id FROM trained) AS used_in_training
  FROM p AS p0 WHERE p0.{CUT}""", extra=(f"good AS (SELECT * FROM p WHERE {OLD} AND prediction_accuracy)",
                                      "trained AS (" + BALANCE.format("good") + ")"))


# --- gaps, files and stores ----------------------------------------------------------------------------

NO_PRICE, NO_TICKER = "event_id % 17 IN (3, 5)", "event_id % 29 = 4"
ORACLE_SQL["quarantine_ticks"] = with_(TICKS) + f"""SELECT event_id, CASE WHEN NOT {NO_TICKER} THEN ticker END AS ticker
  FROM ticks WHERE {NO_PRICE} OR {NO_TICKER}"""
ORACLE_SQL["bars_csv_roundtrip"] = with_(*BARS) + f"SELECT 'NSE:' || ticker AS ticker, {BT}, {OHLC}, volume FROM bars"
ORACLE_SQL["bars_csv_stream"] = ORACLE_SQL["bars_csv_roundtrip"]
ORACLE_SQL["normalize_columns"] = ORACLE_SQL["bars_hourly"]
ORACLE_SQL["row_keys"] = with_(*BARS) + f"SELECT ticker, {BT}, sha256(concat_ws(':', ticker, {t('bar_ts')}, 'cycle_1')) AS row_id FROM bars"
ORACLE_SQL["rounded_prices"] = with_(*BARS) + f"SELECT ticker, {BT}, {r('close', 1)} AS tenth, {r('close', 0)} AS whole FROM bars"
pred_q("id_numbers", "SELECT row_id, CAST(split_part(cycle_id, '_', 2) AS BIGINT) AS sample_idx FROM p")
ORACLE_SQL["indicator_registry"] = with_(*BARS, *INDICATORS) + " UNION ALL ".join(
    f"SELECT ticker, {BT}, '{name}' AS indicator, {r(column)} AS value FROM {source}"
    for name, column, source in (("vwap", "vwap", "ind"), ("rsi", "rsi_14", "ind"), ("sma", "sma_50", "ind"), ("true_range", "tr", "base"))
)
SAID = """(SELECT ticker, turn, sender, CASE turn WHEN 0 THEN technical_direction || ' score=' || score
    WHEN 1 THEN regime || ' squeeze=' || squeeze WHEN 2 THEN conviction || ' divergence=' || divergence
    ELSE prediction_direction || ' ' || prediction_confidence END AS text
  FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY "timestamp" DESC) = 1),
    (VALUES (0::BIGINT, 'Technical Analyst'), (1, 'Volatility Analyst'), (2, 'Volume Analyst'), (3, 'Synthesizer')) v(turn, sender))"""
GAP = "((day(bar_ts) % 3 = 0 AND hour(bar_ts) = 7) OR (day(bar_ts) % 4 = 1 AND hour(bar_ts) = 13))"
GAP_COLS = ("rsi_14", "macd", "macd_signal", "bb_upper", "atr_14", "sma_50")
ORACLE_SQL["indicators_with_gaps"] = with_(
    TICKS, bars_cte().replace("bars AS", "every_bar AS", 1), f"bars AS (SELECT * FROM every_bar WHERE NOT {GAP})", *INDICATORS
) + f"""SELECT ticker, {BT}, {rounded("close", *GAP_COLS)} FROM ind
  UNION ALL SELECT ticker, {BT}, NULL AS close, {", ".join(f"NULL AS {c}" for c in GAP_COLS)} FROM every_bar WHERE {GAP}"""
pred_q("snapshot_activity", f"""SELECT '{{"agent_activity":{{' || (
    SELECT string_agg('"' || ticker || '":[' || said || ']', ',' ORDER BY ticker) FROM (
      SELECT ticker, string_agg('{{"sender":"' || sender || '","text":"' || text || '"}}', ',' ORDER BY turn) AS said
      FROM {SAID} GROUP BY ticker)) ||
  '}},"latency":{{"inference_avg_ms":' || round(total / 5, 1) || ',"inference_total_ms":' || round(total, 1) || '}}}}' AS snapshot
  FROM (SELECT sum(inference_latency_ms) AS total FROM p WHERE cycle_id = (SELECT arg_max(cycle_id, ("timestamp", row_id)) FROM p))""")
ORACLE_SQL["room_transcript_gaps"] = ORACLE_SQL["room_transcript"]
ORACLE_SQL["ledger_lifecycle"] = ORACLE_SQL["resolve_phase2"]
ORACLE_SQL["stream_snapshot"] = ORACLE_SQL["snapshot_latest"]
ORACLE_SQL["stream_activity"] = ORACLE_SQL["snapshot_activity"]
