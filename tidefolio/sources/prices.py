"""Price and metadata readers. Date filters are plain comparisons on stored columns, so they reach the file scan; names
are compared as normalised, so every stored spelling of a ticker is found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.panel import canonicalize, dedupe_keep_last, drop_nulls, long_to_wide
from ..schema import ASSET_META, one_of, require

FORMATS = ("parquet", "csv", "orc", "json")


def normalize_names(tickers) -> list[str]:
    """Trimmed, upper-case, distinct, sorted request list; an empty one is an error."""
    names = sorted({str(t).strip().upper() for t in tickers if str(t).strip()})
    if not names:
        raise ValueError("no tickers left after normalisation")
    return names


def load_prices_long(
    spark: SparkSession,
    path: str,
    *,
    tickers=None,
    start: str | None = None,
    end: str | None = None,
    fmt: str = "parquet",
    wide: bool = False,
    date: str = "date",
    ticker: str = "ticker",
    price: str = "price",
    seq: str | None = None,
) -> DataFrame:
    """Close prices as (date, ticker, price) for the period [start, end).

    ``wide`` reads one column per ticker. ``seq`` names the ingest order that settles repeated (date, ticker) rows;
    without one the stored rows are taken as unique.
    """
    one_of(fmt, FORMATS, "format")
    # Text columns stay text (no inference pass over the files); canonicalize casts what is kept.
    raw = spark.read.format(fmt).option("header", True).load(path)
    if wide:
        require(raw, date)
        ids, columns = [date], [c for c in raw.columns if c != date]
        if tickers is not None:
            wanted = set(normalize_names(tickers))
            columns = [c for c in columns if c.strip().upper() in wanted]
        numbers = raw.select(date, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in columns])
        raw = numbers.unpivot(ids, [f"`{c}`" for c in columns], ticker, price)
        tickers = None
    require(raw, date, ticker, price, *([seq] if seq else []))
    kind = raw.schema[date].dataType
    if isinstance(kind, T.StringType):
        raw, kind = raw.withColumn(date, F.col(date).try_cast("timestamp_ntz")), T.TimestampNTZType()
    if start is not None:
        raw = raw.where(F.col(date) >= F.lit(start).cast(kind))
    if end is not None:
        raw = raw.where(F.col(date) < F.lit(end).cast(kind))
    named = raw.select(
        F.col(date).alias("date"),
        F.upper(F.trim(F.col(ticker).cast("string"))).alias("ticker"),
        F.col(price).alias("price"),
        *([F.col(seq).cast("bigint").alias("seq")] if seq else []),
    )
    if tickers is not None:
        named = named.where(F.col("ticker").isin(normalize_names(tickers)))
    clean = drop_nulls(canonicalize(named))
    return dedupe_keep_last(clean).drop("seq") if seq else clean


def load_prices_wide(spark: SparkSession, path: str, *, tickers=None, **options) -> DataFrame:
    """Same prices with one column per requested ticker, or per ticker of the data, sorted by date."""
    names = None if tickers is None else normalize_names(tickers)
    return long_to_wide(load_prices_long(spark, path, tickers=tickers, **options), "price", tickers=names)


def load_asset_meta(spark: SparkSession, path: str) -> DataFrame:
    """CSV with columns ticker, sector, country."""
    return spark.read.option("header", True).schema(ASSET_META).csv(path)
