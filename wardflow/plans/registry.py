"""Registry of named queries: each has a Spark callable and (when SQL can say it) a DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


DIGITS = 9


def stable(df: DataFrame) -> DataFrame:
    """Round every double column to 9 places.

    Sums in a different order differ in the last bits; at a decimal tie (a
    mean of 2-decimal readings over 16 values ends in ...5 at the 7th place)
    that flips a 6-place comparison. Rounding both engines to 9 places first
    makes the output independent of summation order.
    """
    from pyspark.sql import functions as F

    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.round(F.col(f"`{f.name}`"), DIGITS).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def rounded(sql: str, cols: list[str]) -> str:
    """Wrap an oracle text so the listed double columns are rounded like :func:`stable`."""
    repl = ", ".join(f'round("{c}", {DIGITS}) AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) AS q"


def load_all() -> None:
    """Import every module that registers queries."""
    from wardflow.plans import q_features, q_eval, q_intake, q_models, q_sources, q_streams  # noqa: F401
