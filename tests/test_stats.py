"""Quantiles, winsorising and rolling measures against NumPy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidefolio.operators import quantiles, stats
from tidefolio.session import hand_off

START = dt.datetime(2020, 1, 1)


def panel(spark, table, drop=()):
    rows = [
        (START + dt.timedelta(days=int(t)), name, float(v))
        for name, series in table.items()
        for t, v in enumerate(series)
        if (name, t) not in drop
    ]
    return spark.createDataFrame(rows, "date timestamp_ntz, ticker string, ret double")


@pytest.mark.parametrize("small", [10**9, 22_000, 0])
@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_exact_quantiles(spark, monkeypatch, small, method):
    """Sorted small groups, bracketed large ones and a mix of both are exact, ties included."""
    monkeypatch.setattr(quantiles, "WHOLE", small)
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=30_000), "b": np.round(rng.normal(size=25_001), 1), "c": np.zeros(20_000)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"g": k, "x": v}) for k, v in data.items()]))
    probs = {"q0": 0.0, "q1": 0.01, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    got = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], "x", probs, method).collect()}
    for g, x in data.items():
        s = np.sort(x)
        for name, p in probs.items():
            want = np.quantile(x, p) if method == "linear" else s[int(np.floor(p * (len(s) - 1) + 0.5))]
            assert abs(got[g][name] - want) < 1e-12, (g, name)


def test_quantiles_without_groups_and_with_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (2.0,)], "x double")
    assert quantiles.exact_quantiles(df, [], "x", {"m": 0.5}).first().m == 2.0


def test_winsorize_keeps_nulls(spark):
    df = panel(spark, {"A": range(101)}).unionByName(
        spark.createDataFrame([(START - dt.timedelta(days=1), "A", None)], "date timestamp_ntz, ticker string, ret double")
    )
    got = [r.ret_w for r in stats.winsorize(df, 0.05).orderBy("date").collect()]
    assert got[0] is None and got[1:7] == [5.0] * 6 and got[-1] == 95.0


def test_winsorize_approximate_is_close(spark):
    x = np.random.default_rng(0).normal(size=2000)
    a = stats.winsorize_linear(panel(spark, {"A": x}), 0.05).agg(F.max("ret_w"), F.min("ret_w")).first()
    b = stats.winsorize_linear(panel(spark, {"A": x}), 0.05, exact=False).agg(F.max("ret_w"), F.min("ret_w")).first()
    assert abs(a[0] - b[0]) < 0.02 and abs(a[1] - b[1]) < 0.02


@pytest.mark.parametrize("chunk", [4096, 10])
def test_rolling_vol_across_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(stats, "ROLL_CHUNK", chunk)
    x = np.random.default_rng(1).normal(size=60)
    df = panel(spark, {"A": x, "B": x[::-1]}, drop={("B", 30)})
    got = stats.rolling_vol(df, 7).toPandas().pivot(index="date", columns="ticker", values="vol")
    want_a = pd.Series(x).rolling(7).std()
    b = pd.Series(x[::-1].copy())
    b[30] = np.nan
    assert np.allclose(got["A"].to_numpy(), want_a.to_numpy(), equal_nan=True)
    assert np.allclose(got["B"].to_numpy(), b.rolling(7).std().to_numpy(), equal_nan=True)


@pytest.mark.parametrize("chunk", [4096, 12])
def test_rolling_corr_across_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(stats, "ROLL_CHUNK", chunk)
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=50), rng.normal(size=50)
    df = panel(spark, {"A": a, "B": b})
    sa, sb = pd.Series(a), pd.Series(b)
    plain = stats.rolling_corr(df, "A", "B", 6).orderBy("date").toPandas()["corr"]
    assert np.allclose(plain, sa.rolling(6).corr(sb), equal_nan=True)
    two_pass = stats.rolling_corr_ref(df, "A", "B", 6).orderBy("date").toPandas()["corr"]
    res = (sa - sa.rolling(6).mean()) * (sb - sb.rolling(6).mean())
    want = res.rolling(6).mean() / (sa.rolling(6).std() * sb.rolling(6).std())
    assert np.allclose(two_pass, want, equal_nan=True)


def test_drawdown_of_non_positive_equity(spark):
    rows = [("r", START + dt.timedelta(days=k), v) for k, v in enumerate([-1.0, 2.0, 1.0, 4.0])]
    df = spark.createDataFrame(rows, "run_id string, date timestamp_ntz, equity double")
    assert [r.drawdown for r in stats.drawdown(df).orderBy("date").collect()] == [0.0, 0.0, -0.5, 0.0]


def test_var_es(spark):
    x = np.random.default_rng(4).normal(size=999)
    df = spark.createDataFrame([(float(v),) for v in x], "loss double")
    for row in stats.loss_var_es(df).collect():
        q = np.quantile(x, row.alpha)
        assert abs(row["var"] - q) < 1e-12 and abs(row.es - x[x >= q].mean()) < 1e-12


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "loss double")
    got = stats.loss_histogram(df, 4).collect()
    assert sorted((r.bin, r.n, r.probability) for r in got) == [(0, 5, 1.0), (1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0)]


@pytest.mark.parametrize("small", [10**9, 500])
def test_tails_of_few_large_groups_move_no_rows(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "WHOLE", small)
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=3_000), "b": np.round(rng.normal(size=2_001), 1), "c": rng.normal(size=7)}
    rows = pd.concat([pd.DataFrame({"g": k, "loss": v}) for k, v in data.items()])
    df = hand_off(spark.createDataFrame(rows).unionByName(spark.createDataFrame([("a", None), (None, 1.0)], "g string, loss double")))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stats.loss_var_es(df, (0.9, 0.99), by=["g"])
        got = {(r.g, r.alpha): (r["var"], r.es) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and len(got) == 6
    low = {r.g: (r["var"], r.cvar) for r in stats.cvar_estimate(df, 0.9, value="loss", by=["g"]).collect()}
    for g, x in data.items():
        for alpha in (0.9, 0.99):
            var = np.quantile(x, alpha)
            assert np.allclose(got[g, alpha], (var, x[x >= var - 1e-12].mean()), atol=1e-9)
        var = np.quantile(x, 0.1)
        assert np.allclose(low[g], (var, x[x <= var + 1e-12].mean()), atol=1e-9)
    whole = {r.alpha: r["var"] for r in stats.loss_var_es(df.where("g is not null")).collect()}
    assert abs(whole[0.95] - np.quantile(np.concatenate([*data.values()]), 0.95)) < 1e-12
    assert [(r["var"], r.es) for r in stats.loss_var_es(df.limit(0)).collect()] == [(None, None)] * 2
