"""Texts made from indicator rows: market summary, role prompts and the synthesis prompt."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.text import fmt


@dataclass(frozen=True)
class Role:
    key: str
    name: str
    prefix: str
    instruction: str


# Role registry. The names and prefixes are fixed values, the instructions are ours.
ROLES = (
    Role(
        "technical_analyst", "Technical Analyst", "TECH",
        "Judge the trend from price, VWAP, RSI and MACD. State a direction, an expected return in "
        "percent and a confidence.",
    ),
    Role(
        "volatility_analyst", "Volatility Analyst", "VOL",
        "Judge the risk from ATR and the width of the Bollinger bands. State the regime and any "
        "squeeze.",
    ),
    Role(
        "volume_analyst", "Volume Analyst", "VOLM",
        "Judge whether the volume supports the price move. State the conviction and any divergence.",
    ),
)
SYNTHESIZER = "Synthesizer"

SYNTHESIS_HEAD = "Combine these analyses of one ticker into a single prediction.\n\n"
SYNTHESIS_TAIL = (
    "\n\nAnswer with one JSON object with the keys direction, target_return_pct and confidence."
)


def market_text_column(missing: str = "N/A") -> Column:
    """Eight labelled lines describing one bar and its indicators (fixed format)."""
    n = lambda c, d=2: fmt(c, d, missing)
    price = F.concat(
        F.lit("Price: O="), n("open"), F.lit(" H="), n("high"), F.lit(" L="), n("low"), F.lit(" C="), n("close")
    )
    bands = F.concat(
        F.lit("Bollinger Bands: "), n("bb_lower"), F.lit(" - "), n("bb_middle"), F.lit(" - "), n("bb_upper")
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Ticker: "), F.col("ticker")),
        price,
        F.concat(F.lit("Volume: "), n("volume", 0)),
        F.concat(F.lit("VWAP: "), n("vwap")),
        F.concat(F.lit("RSI(14): "), n("rsi_14")),
        F.concat(F.lit("MACD: "), n("macd"), F.lit(" (signal: "), n("macd_signal"), F.lit(")")),
        bands,
        F.concat(F.lit("ATR(14): "), n("atr_14")),
    )


def market_text(df: DataFrame) -> DataFrame:
    return df.withColumn("market_text", market_text_column())


def agent_prompts(df: DataFrame, roles: Sequence[Role] = ROLES, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """One prompt per row and role. The roles travel as literals: no join, no shuffle."""
    options = [
        F.struct(
            F.lit(i).alias("role_ord"), F.lit(r.key).alias("role"), F.lit(r.instruction).alias("_text")
        )
        for i, r in enumerate(roles)
    ]
    text = market_text_column()
    return (
        df.select(*keep, text.alias("_market"), F.explode(F.array(*options)).alias("_r"))
        .select(
            *keep,
            F.col("_r.role_ord").alias("role_ord"),
            F.col("_r.role").alias("role"),
            F.concat(F.col("_r._text"), F.lit("\n\n"), F.col("_market")).alias("prompt"),
        )
    )


def gather_agents(preds: DataFrame, responses: DataFrame, roles: Sequence[Role] = ROLES,
                  key: str = "row_id") -> DataFrame:
    """Bring the answers of all roles to their prediction: columns ``<role>_text`` and ``_ok``.

    Answers (key, role, text, ok) are folded per role while they are aggregated, so no list of
    answers is built and repeated answers cost nothing.
    """
    folded = []
    for r in roles:
        mine = F.col("role") == r.key
        folded += [
            F.max(F.when(mine, F.col("text"))).alias(f"{r.key}_text"),
            F.max(F.when(mine, F.col("ok"))).alias(f"{r.key}_ok"),
        ]
    return preds.join(responses.groupBy(key).agg(*folded), key, "left")


def analysis_block(r: Role) -> Column:
    """The part of one role in the synthesis prompt; roles that gave no answer are marked."""
    text, ok = F.col(f"{r.key}_text"), F.coalesce(F.col(f"{r.key}_ok"), F.lit(False))
    reason = F.coalesce(F.concat(F.lit(": "), text), F.lit(""))
    failed = F.concat(F.lit(f"--- {r.name} --- [FAILED"), reason, F.lit("]"))
    return F.when(ok, F.concat(F.lit(f"--- {r.name} ---\n"), text)).otherwise(failed)


def synthesis_prompt(gathered: DataFrame, roles: Sequence[Role] = ROLES) -> DataFrame:
    blocks = F.concat_ws("\n\n", *[analysis_block(r) for r in roles])
    return gathered.withColumn(
        "synthesis_prompt", F.concat(F.lit(SYNTHESIS_HEAD), blocks, F.lit(SYNTHESIS_TAIL))
    )
