"""Registry of runnable queries and the independent SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Comparable output: timestamps as text, doubles rounded (and no negative zero)."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def sql(
    ctes: Sequence[str],
    body: str,
    *,
    dates: Sequence[str] = (),
    floats: Sequence[str] = (),
    ints: Sequence[str] = (),
    plain: Sequence[str] = (),
    digits: int = DIGITS,
) -> str:
    """``WITH ctes SELECT tidied columns FROM (body)``, the SQL side of ``tidy``."""
    cols = [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in dates]
    cols += [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in floats]
    cols += [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
    cols += list(plain)
    head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    return f"{head}SELECT {', '.join(cols)} FROM (\n{body}\n) AS answer"
