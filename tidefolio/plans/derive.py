"""Price panels, weights and metadata derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.returns import returns_from_prices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean unit price per part brand."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_shipdate", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price")
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return (
        items.join(parts, "l_partkey")
        .groupBy(F.col("l_shipdate").alias("date"), F.col("p_brand").alias("ticker"))
        .agg(F.avg("unit_price").alias("price"))
    )


def supplier_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean unit price per supplier."""
    items = table(spark, sf_dir, "lineitem")
    # Numbers travel, names are made of what is left.
    prices = items.groupBy(F.col("l_shipdate").alias("date"), "l_suppkey").agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    )
    return prices.select("date", F.col("l_suppkey").cast("string").alias("ticker"), "price")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as intraday ticks in ingest order."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("date"),
        F.col("event_type").alias("ticker"),
        F.col("value").alias("price"),
        F.col("event_id").alias("seq"),
    )


def brand_returns(spark: SparkSession, sf_dir: str, freq: str = "1mo", kind: str = "log") -> DataFrame:
    return returns_from_prices(brand_prices(spark, sf_dir), freq=freq, kind=kind)


def supplier_returns(spark: SparkSession, sf_dir: str, freq: str = "1mo", kind: str = "log") -> DataFrame:
    return returns_from_prices(supplier_prices(spark, sf_dir), freq=freq, kind=kind)


def asset_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    places = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return suppliers.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("country")
    )


def _holdings(spark: SparkSession, sf_dir: str, owner: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    owners = orders
    key = F.col("o_custkey")
    if owner != "o_custkey":
        customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), owner)
        owners, key = orders.join(customers, "o_custkey"), F.col(owner)
    amounts = (
        items.join(parts, "l_partkey")
        .join(owners, "l_orderkey")
        .groupBy(key.cast("string").alias("portfolio_id"), "ticker")
        .agg(F.sum("l_extendedprice").alias("amount"))
    )
    # At most one row per ticker and portfolio remains here, so the window holds one universe of tickers.
    whole = F.sum("amount").over(W.partitionBy("portfolio_id"))
    return amounts.select("portfolio_id", "ticker", (F.col("amount") / whole).alias("weight"))


def customer_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small portfolios: each customer's spending by brand."""
    return _holdings(spark, sf_dir, "o_custkey")


def segment_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few large portfolios: each market segment's spending by brand."""
    return _holdings(spark, sf_dir, "c_mktsegment")


def brand_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, weight): share of each brand in all spending."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    amounts = items.join(parts, "l_partkey").groupBy("ticker").agg(F.sum("l_extendedprice").alias("amount"))
    total = amounts.agg(F.sum("amount")).scalar()
    return amounts.select("ticker", (F.col("amount") / total).alias("weight"))


def segment_returns(spark: SparkSession, sf_dir: str, freq: str = "3mo", kind: str = "log") -> DataFrame:
    """Brand returns seen by each market segment: one universe per segment."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price")
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("universe_id")
    )
    prices = (
        items.join(parts, "l_partkey")
        .join(orders, "l_orderkey")
        .join(customers, "o_custkey")
        .groupBy("universe_id", F.col("l_shipdate").alias("date"), "ticker")
        .agg(F.avg("unit_price").alias("price"))
    )
    return returns_from_prices(prices, freq=freq, kind=kind)


def brand_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand labels split into two categories: maker digit as sector, line digit as country."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return brands.select(
        "ticker",
        F.concat(F.lit("m"), F.substring("ticker", 7, 1)).alias("sector"),
        F.concat(F.lit("s"), F.substring("ticker", 8, 1)).alias("country"),
    )


def customer_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views per customer from its holdings: an absolute one on the largest position, and largest over smallest."""
    ranked = customer_holdings(spark, sf_dir).groupBy("portfolio_id").agg(
        F.max(F.struct("weight", "ticker")).alias("_top"), F.min(F.struct("weight", "ticker")).alias("_low")
    )
    views = F.array(
        F.struct(
            F.lit(1).cast("bigint").alias("view_id"),
            F.col("_top.ticker").alias("long"),
            F.lit(None).cast("string").alias("short"),
            (F.col("_top.weight") / 10).alias("q"),
            F.lit(0.5).alias("conf"),
        ),
        F.struct(
            F.lit(2).cast("bigint").alias("view_id"),
            F.col("_top.ticker").alias("long"),
            F.col("_low.ticker").alias("short"),
            ((F.col("_top.weight") - F.col("_low.weight")) / 20).alias("q"),
            F.greatest(F.col("_low.weight"), F.lit(0.25)).alias("conf"),
        ),
    )
    rows = ranked.select("portfolio_id", F.inline(views))
    return rows.where(F.col("short").isNull() | (F.col("short") != F.col("long")))
