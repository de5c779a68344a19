"""The window-last resample on an unbounded price feed, with the same labels as the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import bucket_label
from ..schema import require


def resample_stream(prices: DataFrame, every: str = "1d", *, lateness: str) -> DataFrame:
    """Last price per ticker and window (left, right]; a window is final once later windows are ``lateness`` past it.

    ``lateness`` is the caller's promise: rows later than that are dropped. Among rows of one stamp the largest ``seq``
    wins where the feed has that column, as in the batch operator. State holds one price per open (ticker, window).
    """
    require(prices, "date", "ticker", "price")
    last = F.struct("date", "seq") if "seq" in prices.columns else F.col("date")
    labelled = prices.withColumn("label", bucket_label(F.col("date"), every).cast("timestamp"))
    return (
        labelled.withWatermark("label", lateness)
        .groupBy("ticker", "label")
        .agg(F.max_by("price", last).alias("price"))
        .select(F.col("label").alias("date"), "ticker", "price")
    )
