"""Odometer ("km") parsing and roundness features, as SQL expressions on a column name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The moduli of the round flags and of the distance features.
ROUND_STEPS = (1000, 500, 100, 50, 10)
MOD_STEPS = (1000, 100)


def parse_km(km: str, data_type: T.DataType, mode: str = "digits") -> str:
    """Odometer reading as a number.

    ``digits`` keeps only the digits of the text (sign, separators and units are
    lost), ``cast`` reads an integer, rounding a fraction, ``raw`` leaves the column alone.
    Text that does not fit a bigint becomes NULL in the first two modes.
    """
    if mode == "raw":
        return km
    if mode == "cast":
        if isinstance(data_type, T.FractionalType):
            km = f"round({km})"
        return f"try_cast({km} AS bigint)"
    if mode != "digits":
        raise ValueError(f"Unknown km mode: {mode}")
    if isinstance(data_type, T.IntegralType):
        # Same digits, without a regular expression per row.
        return f"CASE WHEN {km} > -9223372036854775807L - 1L THEN abs(cast({km} AS bigint)) END"
    text = f"cast({km} AS string)"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        # Whole numbers as text without the ".0" or exponent Spark would print.
        text = f"CASE WHEN {km} = floor({km}) THEN cast(cast({km} AS decimal(38, 0)) AS string) ELSE {text} END"
    return f"try_cast(nullif(regexp_replace({text}, '[^0-9]', ''), '') AS bigint)"


def trailing_zeros(km: str) -> Column:
    text = f"cast({km} AS string)"
    return F.expr(f"length({text}) - length(trim(TRAILING '0' FROM {text}))")


def is_round(km: str, step: int) -> Column:
    """1 when ``km`` is a multiple of ``step``; a missing reading is not round."""
    return F.expr(f"CASE WHEN {km} % {step} = 0 THEN 1 ELSE 0 END")


def mod_norm(km: str, step: int, mode: str = "circular") -> Column:
    """Distance of ``km`` to a multiple of ``step``, as a share of ``step``.

    ``circular`` measures to the nearest multiple, ``plain`` to the one below.
    """
    rest = f"{km} % {step}"
    if mode == "circular":
        rest = f"least({rest}, {step} - {rest})"
    elif mode != "plain":
        raise ValueError(f"Unknown modulo mode: {mode}")
    return F.expr(f"cast({rest} AS double) / {step}D")


def log_km(km: str) -> Column:
    """Base-10 logarithm of ``km + 1``; NULL below zero."""
    return F.expr(f"CASE WHEN {km} >= 0 THEN log10(cast({km} AS double) + 1D) END")


def km_columns(km: str, mode: str = "circular") -> dict[str, Column]:
    """The derived odometer columns by name, in dataset order."""
    columns = {
        "reg_km_log1p": log_km(km),
        "reg_km_trailing_zeros": trailing_zeros(km),
    }
    for step in ROUND_STEPS:
        columns[f"reg_km_is_round_{step}"] = is_round(km, step)
    for step in MOD_STEPS:
        columns[f"reg_km_mod{step}_norm"] = mod_norm(km, step, mode)
    return columns
