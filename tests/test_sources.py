"""Readers, artifacts and exports."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidefolio.session import CHECKPOINT_CONF, CLEANUP_CONF, hand_off, runs_here, shared_folder
from tidefolio.sources import artifacts as art, prices as src


def sample(spark):
    rows = [(dt.datetime(2024, 1, k), t, float(k), k) for k in (1, 2, 3) for t in ("aa", "BB")]
    rows += [(dt.datetime(2024, 1, 3), "aa", 99.0, 9), (dt.datetime(2024, 1, 2), "cc", None, 1)]
    return spark.createDataFrame(rows, "date timestamp_ntz, ticker string, price double, seq int")


def test_long_prices(spark, tmp_path):
    path = str(tmp_path / "p")
    sample(spark).write.parquet(path)
    df = src.load_prices_long(spark, path, tickers=[" aa ", "BB"], start="2024-01-02", seq="seq")
    got = {(r.ticker, r.date.day): r.price for r in df.collect()}
    assert got == {("AA", 2): 2.0, ("AA", 3): 99.0, ("BB", 2): 2.0, ("BB", 3): 3.0}


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    sample(spark).write.parquet(path)
    df = src.load_prices_long(spark, path, tickers=["BB"], start="2024-01-02", end="2024-01-03")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "GreaterThanOrEqual(date" in pushed and "LessThan(date" in pushed
    assert "seq" not in plan[plan.index("ReadSchema") :].split("\n")[0]


def test_every_spelling_of_a_name_is_found(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [(dt.datetime(2024, 1, k), t, float(k)) for k, t in ((1, "Aapl"), (2, " aapl"), (3, "AAPL "), (4, "msft"))]
    spark.createDataFrame(rows, "date timestamp_ntz, ticker string, price double").write.parquet(path)
    got = src.load_prices_long(spark, path, tickers=["aapl"]).collect()
    assert sorted((r.ticker, r.price) for r in got) == [("AAPL", 1.0), ("AAPL", 2.0), ("AAPL", 3.0)]


def test_a_cluster_without_a_shared_folder_is_an_error():
    assert runs_here("local[8]") and runs_here("local")
    assert not any(map(runs_here, ("local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://https://host")))


def test_wide_prices(spark, tmp_path):
    path = str(tmp_path / "w")
    wide = spark.createDataFrame([("2024-01-01", "1.5", "x"), ("2024-01-02", "2.5", "3")], "date string, AA string, BB string")
    wide.write.option("header", True).csv(path)
    long = src.load_prices_long(spark, path, fmt="csv", wide=True)
    assert sorted((r.ticker, r.price) for r in long.collect()) == [("AA", 1.5), ("AA", 2.5), ("BB", 3.0)]
    back = src.load_prices_wide(spark, path, tickers=["aa", "BB"], fmt="csv", wide=True)
    assert back.columns == ["date", "AA", "BB"] and back.count() == 2
    only = src.load_prices_long(spark, path, fmt="csv", wide=True, tickers=["bb"])
    assert {r.ticker for r in only.collect()} == {"BB"}


def test_empty_request():
    with pytest.raises(ValueError):
        src.normalize_names([" ", ""])
    assert src.normalize_names([" a", "A", "b"]) == ["A", "B"]


def test_keys_do_not_depend_on_order():
    assert art.config_key({"a": 1, "b": [1, 2]}) == art.config_key({"b": (1, 2), "a": 1})
    assert art.config_key({"a": 1}) != art.config_key({"a": 2})
    assert len(art.config_key({})) == 16


def test_artifacts(spark, tmp_path):
    root, cfg = str(tmp_path), {"x": 1}
    assert art.read_artifact(spark, root, "t", cfg) is None and art.read_metadata(spark, root, "m", cfg) is None
    sigma = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 2.0)], "i string, j string, value double")
    art.write_matrix(sigma, root, "t", cfg)
    assert art.read_matrix(spark, root, "t", cfg).count() == 4
    path = art.export_matrix_wide(sigma, str(tmp_path / "wide"), ["a", "b"])
    assert spark.read.option("header", True).csv(path).columns == ["i", "a", "b"]
    with pytest.raises(ValueError):
        art.export(sigma, path, "xlsx")


def test_fingerprint_ignores_the_clock(spark):
    one = spark.range(1).select(F.lit(3).alias("n"), F.current_timestamp().alias("generated_at"))
    two = spark.range(1).select(F.lit("2020").alias("generated_at"), F.lit(3).alias("n"))
    other = spark.range(1).select(F.lit(4).alias("n"), F.lit("x").alias("generated_at"))
    prints = [art.with_fingerprint(df, 12).first().fingerprint for df in (one, two, other)]
    assert prints[0] == prints[1] != prints[2] and len(prints[0]) == 12


def test_asset_meta(spark, tmp_path):
    path = tmp_path / "meta.csv"
    path.write_text("ticker,sector,country\nA,Tech,US\n")
    assert src.load_asset_meta(spark, str(path)).first().asDict() == {"ticker": "A", "sector": "Tech", "country": "US"}


def test_hand_off_uses_the_named_folder(spark):
    named = spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    assert shared_folder(spark) == named
    stored = hand_off(spark.range(3), "numbers")
    assert stored.count() == 3 and named in stored.inputFiles()[0] and "/tidefolio/numbers-" in stored.inputFiles()[0]


def test_hand_off_leaves_no_shuffle_files(spark):
    """What it has stored is read from there: the shuffles that made it would only fill the disk."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in (str(b) for b in blocks.getAllBlocks().mkString(" ").split()) if f.startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(CLEANUP_CONF, None)
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    stored = hand_off(sums, "sums")
    for _ in range(50):  # they are dropped in the background
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert stored.count() == 7 and spark.conf.get(CLEANUP_CONF, None) == setting


def test_csv_dates_are_filtered_as_dates(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("date,ticker,price\n2024-01-01,a,1\n2024-01-02,a,2\n2024-01-03,a,x\nnever,a,4\n")
    got = src.load_prices_long(spark, str(path), fmt="csv", start="2024-01-02").collect()
    assert [(r.ticker, r.price, r.date.day) for r in got] == [("A", 2.0, 2)]


def test_top_moves_trim_before_the_shuffle(spark):
    from tidefolio.operators.quality import top_abs_moves

    returns = sample(spark).select("date", "ticker", F.col("price").alias("ret"))
    plan = top_abs_moves(returns, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
