"""Text, JSON and identifier expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tickloom.schema import MESSAGES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fmt(x: Column | str, decimals: int = 2, missing: str = "N/A") -> Column:
    """Fixed-point text of a number; ``missing`` for null.

    Rounded to 8 places first: sums differ in their last bits with the order of rows, and a text
    must not.
    """
    x = _col(x)
    text = F.format_string(f"%.{decimals}f", F.round(x.cast("double"), 8))
    return F.when(x.isNull(), F.lit(missing)).otherwise(text)


def truncate_text(text: Column | str, n: int, suffix: str = "") -> Column:
    text = _col(text)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(suffix))).otherwise(text)


def clamp_enum(x: Column | str, allowed: Sequence[str], default: str) -> Column:
    upper = F.upper(_col(x))
    return F.when(upper.isin(list(allowed)), upper).otherwise(F.lit(default))


# Ledger key made from the row itself, so that a retried task writes the same key.
ROW_KEY_SQL = "sha2(concat_ws(':', ticker, date_format(bar_ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), cycle_id), 256)"


def row_key() -> Column:
    return F.expr(ROW_KEY_SQL)


def sample_index(cycle_id: Column | str) -> Column:
    """The row number in a cycle id ``backtest_<n>``; null for any other id."""
    digits = F.regexp_extract(_col(cycle_id), r"^backtest_(-?\d+)$", 1)
    return digits.try_cast("bigint")


def encode_messages(messages: Column | str) -> Column:
    return F.to_json(_col(messages))


def decode_messages(text: Column | str) -> Column:
    return F.coalesce(F.from_json(_col(text), MESSAGES), F.array().cast(MESSAGES))


def json_document(text: Column | str) -> Column:
    """A text holding exactly one JSON value as VARIANT, else null.

    The parser stops after the first value; wrapping the text in brackets makes trailing text an
    error and a second value visible.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), _col(text), F.lit("]")))
    values = F.try_variant_get(wrapped, "$", "array<variant>")
    return F.when(F.size(values) == 1, F.try_variant_get(wrapped, "$[0]", "variant"))


def parse_prediction(text: Column | str) -> Column:
    """Struct of a model response: whether it is JSON, whether its fields can be used, and the
    fields with the defaults for missing keys.

    A number given as text is accepted; a field of the wrong kind spoils the response.
    """
    doc = json_document(text)
    kind = F.schema_of_variant(doc)

    def field(name: str, default: str) -> tuple[Column, Column]:
        value = F.try_variant_get(doc, f"$.{name}", "variant")
        is_text = F.schema_of_variant(value) == "STRING"
        ok = value.isNull() | is_text
        return ok, F.coalesce(F.try_variant_get(doc, f"$.{name}", "string"), F.lit(default))

    dir_ok, direction = field("direction", "SIDEWAYS")
    conf_ok, confidence = field("confidence", "LOW")
    ret_value = F.try_variant_get(doc, "$.target_return_pct", "variant")
    ret_text = F.trim(F.try_variant_get(doc, "$.target_return_pct", "string"))
    ret = F.when(ret_value.isNull(), F.lit(0.0)).otherwise(ret_text.try_cast("double"))
    usable = kind.startswith("OBJECT") & dir_ok & conf_ok & ret.isNotNull()
    return F.struct(
        doc.isNotNull().alias("is_json"),
        F.coalesce(usable, F.lit(False)).alias("usable"),
        F.upper(direction).alias("direction"),
        ret.alias("target_return_pct"),
        F.upper(confidence).alias("confidence"),
    )


def completion_json(direction: Column | str, ret: Column | str, confidence: Column | str) -> Column:
    """The answer of a training pair as JSON text."""
    return F.to_json(
        F.struct(
            F.coalesce(_col(direction), F.lit("SIDEWAYS")).alias("direction"),
            F.round(F.coalesce(_col(ret), F.lit(0.0)), 2).alias("target_return_pct"),
            F.coalesce(_col(confidence), F.lit("MED")).alias("confidence"),
        )
    )
