"""Fixed schemas of the long tables, and the column checks made at every entry point."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

UNIVERSE = "universe_id"

PRICES = T.StructType(
    [
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("price", T.DoubleType()),
    ]
)
RETURNS = T.StructType(
    [
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("ret", T.DoubleType()),
    ]
)
WEIGHTS = T.StructType(
    [
        T.StructField("portfolio_id", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)
ASSET_META = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("sector", T.StringType()),
        T.StructField("country", T.StringType()),
    ]
)


def require(df: DataFrame, *columns: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def one_of(value: str, allowed: Iterable[str], what: str) -> str:
    allowed = tuple(allowed)
    if value not in allowed:
        raise ValueError(f"{what} must be one of {allowed}, got {value!r}")
    return value


def universe_keys(df: DataFrame) -> list[str]:
    """Grouping prefix: ``["universe_id"]`` when the table holds many universes, else nothing."""
    return [UNIVERSE] if UNIVERSE in df.columns else []


def attach(df: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Put the per-universe ``totals`` on every row.

    With a universe key this is an equi-join (AQE broadcasts the small side after seeing its size);
    without one ``totals`` is a single aggregate row, read as a scalar subquery, so no cross join appears.
    """
    if by:
        return df.join(totals, by)
    names = totals.columns
    row = totals.select(F.struct(*names).alias("_row")).scalar()
    out = df.withColumn("_row", row)
    for name in names:
        out = out.withColumn(name, F.col("_row")[name])
    return out.drop("_row")


def grouped(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
