"""Scalar column functions (P1, P2, P5-P8, P11) as native Spark expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardflow.catalog import SENTINEL


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_minutes(col) -> Column:
    """Elapsed ``"HH:MM"`` -> minutes. Hours may exceed 24 (``48:00`` -> 2880)."""
    parts = F.split(F.trim(_c(col)), ":")
    return (parts.getItem(0).cast("int") * 60 + parts.getItem(1).cast("int")).cast("int")


def elapsed_hhmm(minutes) -> Column:
    """Inverse of :func:`to_minutes`: minutes -> zero-padded ``"HH:MM"``."""
    m = _c(minutes).cast("long")
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("long"), F.pmod(m, F.lit(60)))


def mask_sentinel(col, sentinel: float = SENTINEL) -> Column:
    """Sentinel -> NULL (never NaN)."""
    return F.nullif(_c(col), F.lit(float(sentinel)))


def safe_float(col) -> Column:
    """Decimal numeric text -> finite double, anything else -> NULL (ANSI-safe).

    Suffixed (``72f``), hexadecimal and non-finite texts (``NaN``) are no numbers here.
    """
    return _try_double(_c(col))


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _try_double(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    x = text.try_cast("double")
    return F.when(text.rlike(NUMBER) & (F.abs(x) < F.lit(float("inf"))), x)


def gender_code(col) -> Column:
    """Trimmed lower-case male -> 1, female -> 0, else a numeric cast truncated to int."""
    norm = F.lower(F.trim(_c(col)))
    num = _try_double(_c(col))
    return (
        F.when(norm == "male", F.lit(1))
        .when(norm == "female", F.lit(0))
        .otherwise(num.try_cast("int"))
    )


def apply_threshold(score, threshold: float, strict: bool = True) -> Column:
    """P5: score -> 0/1 with ``>`` (strict) or ``>=``."""
    s = _c(score)
    cond = s > F.lit(threshold) if strict else s >= F.lit(threshold)
    return F.when(s.isNull(), F.lit(None).cast("int")).when(cond, F.lit(1)).otherwise(F.lit(0))


def risk_band(score, threshold: float = 0.35) -> tuple[Column, Column]:
    """(label, score rounded to 3 places); RISK when score > threshold, NULL for a NULL score."""
    s = _c(score)
    label = F.when(s > F.lit(threshold), F.lit("RISK")).when(s.isNotNull(), F.lit("NO RISK"))
    return label, F.round(s, 3)


def one_hot(col, categories: Iterable, prefix: str, dummy_na: bool = True) -> list[Column]:
    """One 0/1 double column per declared category (+ ``<prefix>_nan``)."""
    c = _c(col)
    cols = []
    for k in categories:
        cols.append(F.when(c == F.lit(k), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{prefix}_{k}"))
    if dummy_na:
        cols.append(F.when(c.isNull(), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{prefix}_nan"))
    return cols


_MOD = 2147483647  # 2^31 - 1
_MUL = 48271


def required(condition: Column, message: Column | str) -> Column:
    """A filter that keeps every row and fails the job at the first row where ``condition`` is false or NULL."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def lehmer(col, seed: int = 0, rounds: int = 2) -> Column:
    """Deterministic integer hash in [0, 2^31-1) that DuckDB can reproduce.

    ``h = ((x mod p) * 48271 + seed) mod p`` applied ``rounds`` times; all
    intermediate values stay below 2^47, so no overflow in either engine.
    """
    h = F.pmod(_c(col).cast("long"), F.lit(_MOD))
    for _ in range(rounds):
        h = F.pmod(h * F.lit(_MUL) + F.lit(int(seed)), F.lit(_MOD))
    return h


def lehmer_sql(expr: str, seed: int = 0, rounds: int = 2) -> str:
    """DuckDB text of :func:`lehmer` (for oracles)."""
    h = f"((({expr})::BIGINT % {_MOD} + {_MOD}) % {_MOD})"
    for _ in range(rounds):
        h = f"(({h} * {_MUL} + {int(seed)}) % {_MOD})"
    return h
