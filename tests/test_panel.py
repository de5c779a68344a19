"""Hand-made edge cases of cleaning, calendars and data quality."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidefolio.functions.calendar import bucket_label, period_end
from tidefolio.operators import panel, quality, returns as R

TS = "timestamp_ntz"


def day(text):
    return dt.datetime.fromisoformat(text)


def prices(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"date {TS}, ticker string, price double{extra}")


def rets(spark, rows):
    return spark.createDataFrame(rows, f"date {TS}, ticker string, ret double")


@pytest.mark.parametrize(
    "stamp, every, label",
    [
        ("2024-01-01 00:00:00", "1w", "2024-01-01"),  # Monday midnight closes the week before
        ("2024-01-01 00:00:01", "1w", "2024-01-08"),
        ("2024-02-01 00:00:00", "1mo", "2024-02-01"),
        ("2024-02-01 00:00:00.000001", "1mo", "2024-03-01"),
        ("2024-03-31 12:00:00", "3mo", "2024-04-01"),
        ("2024-01-05 10:00:00", "1d", "2024-01-06"),
        ("2024-06-01 00:00:00", "1y", "2025-01-01"),
        ("2024-01-17 00:00:00", "2w", "2024-01-22"),
    ],
)
def test_bucket_label(spark, stamp, every, label):
    df = spark.createDataFrame([(day(stamp),)], f"t {TS}")
    assert df.select(bucket_label(F.col("t"), every)).first()[0] == day(label)


def test_period_end_is_calendar_end(spark):
    df = spark.createDataFrame([(day("2024-02-01"),), (day("2024-02-29"),)], f"t {TS}")
    ends = [r[0] for r in df.select(period_end(F.col("t"), "1mo")).collect()]
    assert ends == [day("2024-02-29")] * 2


def test_bad_frequency():
    with pytest.raises(ValueError):
        bucket_label(F.lit(None), "fortnight")


def test_canonicalize_makes_bad_values_null(spark):
    df = spark.createDataFrame([("2024-01-01", "A", "1.5"), ("nope", "B", "x")], "date string, ticker string, price string")
    rows = {r.ticker: r for r in panel.canonicalize(df).collect()}
    assert rows["A"].price == 1.5 and rows["A"].date == day("2024-01-01")
    assert rows["B"].price is None and rows["B"].date is None


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="missing columns"):
        panel.canonicalize(spark.range(1))


def test_dedupe_keeps_last(spark):
    rows = [(day("2024-01-01"), "A", p, s) for s, p in enumerate([1.0, 3.0, 2.0])]
    got = panel.dedupe_keep_last(prices(spark, rows, ", seq bigint")).collect()
    assert [(r.price, r.seq) for r in got] == [(2.0, 2)]


def test_finite_or_null(spark):
    rows = [(day("2024-01-01"), t, v) for t, v in [("A", math.inf), ("B", -math.inf), ("C", math.nan), ("D", 1.0)]]
    got = {r.ticker: r.ret for r in panel.finite_or_null(rets(spark, rows)).collect()}
    assert got == {"A": None, "B": None, "C": None, "D": 1.0}


def test_empty_and_constant_series_go(spark):
    days = [day(f"2024-01-0{k}") for k in range(1, 4)]
    rows = [(d, "flat", 0.5) for d in days] + [(d, "none", None) for d in days]
    rows += [(d, "live", float(k)) for k, d in enumerate(days)] + [(days[0], "once", 1.0)]
    df = rets(spark, rows)
    assert {r.ticker for r in panel.drop_empty_series(df).collect()} == {"flat", "live", "once"}
    assert {r.ticker for r in panel.drop_constant_series(df).collect()} == {"live"}


def holey(spark):
    d = [day(f"2024-01-0{k}") for k in range(1, 5)]
    return rets(spark, [(d[0], "A", 1.0), (d[1], "A", 2.0), (d[2], "A", 3.0), (d[0], "B", 4.0), (d[2], "B", 8.0), (d[3], "B", 6.0)])


def test_fill_policies(spark):
    df = holey(spark)
    assert panel.apply_fill_policy(df, "drop").count() == 4
    mean = {(r.date.day, r.ticker): r.ret for r in panel.apply_fill_policy(df, "mean").collect()}
    assert len(mean) == 8 and mean[(4, "A")] == 2.0 and mean[(2, "B")] == 6.0
    with pytest.raises(Exception, match="missing cells"):
        panel.apply_fill_policy(df, "none").collect()
    with pytest.raises(ValueError):
        panel.apply_fill_policy(df, "guess")


def test_fill_reports(spark):
    df = holey(spark)
    drop = panel.fill_policy_report(df, "drop").collect()
    assert {r.rows_dropped for r in drop} == {2}
    mean = panel.fill_policy_report(df, "mean").collect()
    assert {r.imputed_pct for r in mean} == {25.0} and {r.total_imputed_pct for r in mean} == {25.0}
    none = panel.fill_policy_report(df, "none").collect()
    assert {(r.n_na, r.n_na_total, r.warning) for r in none} == {(1, 2, True)}


def test_fill_policy_per_universe(spark):
    df = holey(spark)
    both = df.withColumn("universe_id", F.lit("x")).unionByName(
        df.where("ticker = 'A'").withColumn("universe_id", F.lit("y"))
    )
    kept = panel.apply_fill_policy(both, "drop").groupBy("universe_id").count().collect()
    assert {r.universe_id: r["count"] for r in kept} == {"x": 4, "y": 3}
    assert panel.apply_fill_policy(both, "mean").where("universe_id = 'x'").count() == 8


def test_wide_and_back(spark):
    wide = panel.long_to_wide(holey(spark), "ret", tickers=["A", "B"])
    assert [tuple(r)[1:] for r in wide.collect()] == [(1.0, 4.0), (2.0, None), (3.0, 8.0), (None, 6.0)]
    back = panel.wide_to_long(wide, "ret")
    assert back.count() == 8 and back.where("ret is null").count() == 2


def test_onehot_ignores_case_and_unknown_names(spark):
    universe = spark.createDataFrame([("a",), ("b",), ("zz",)], "ticker string")
    meta = spark.createDataFrame(
        [("A", "Tech", "us"), ("B", None, "US"), ("C", "Oil", "FR")], "ticker string, sector string, country string"
    )
    got = {(r.factor, r.ticker) for r in panel.onehot_exposure(universe, meta).collect()}
    assert got == {("sector:TECH", "a"), ("country:US", "a"), ("country:US", "b")}


def test_price_validation_sees_backward_steps_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(quality, "SEQ_CHUNKS", 4)
    order = [3, 4, 2, 5, 6, 1]
    rows = [(day(f"2024-01-0{k}"), "A", float(k), s) for s, k in enumerate(order)]
    rows += [(day("2024-01-01"), "B", 0.0, 6), (day("2024-01-01"), "B", 0.0, 7)]
    got = quality.price_validation(prices(spark, rows, ", seq bigint")).first()
    assert (got.n_rows, got.n_duplicates, got.n_nonpositive, got.backward_steps) == (8, 1, 2, 2)


def test_gaps_do_not_cross_tickers(spark):
    rows = [(day("2024-01-01"), "A", 1.0), (day("2024-01-03 23:00:00"), "A", 1.0), (day("2024-01-09"), "A", 1.0)]
    rows += [(day("2024-03-01"), "B", 1.0)]
    got = {r.ticker: r for r in quality.gaps_report(prices(spark, rows), 3).collect()}
    assert got["A"].max_gap_days == 5 and got["A"].n_gaps_gt_thr == 1 and got["A"].first_gap == day("2024-01-09")
    assert got["B"].max_gap_days == 0 and got["B"].first_gap is None


def test_top_moves_keep_ties(spark):
    rows = [(day(f"2024-01-0{k}"), "A", v) for k, v in enumerate([0.1, -0.3, 0.3, 0.2, 0.05], 1)]
    got = quality.top_abs_moves(rets(spark, rows), 2).collect()
    assert sorted((r.ret, r["rank"]) for r in got) == [(-0.3, 1), (0.2, 2), (0.3, 1)]


@pytest.mark.parametrize(
    "values, kind",
    [([0.1, 0.2, -0.1], "simple"), ([0.1, -1.0, 0.1], "log"), ([0.5, 0.6, 0.1], "log"), ([0.2, 0.5], "log"), ([0.1, 0.4], "simple")],
)
def test_return_kind(spark, values, kind):
    rows = [(day(f"2024-01-0{k}"), "A", v) for k, v in enumerate(values, 1)]
    assert quality.infer_return_kind(rets(spark, rows)).first().kind == kind


def test_return_kind_reads_all_names_unless_told(spark):
    rows = [(day("2024-01-01"), f"T{k}", 0.1) for k in range(5)] + [(day("2024-01-01"), "U", -2.0)]
    assert quality.infer_return_kind(rets(spark, rows)).first().kind == "log"
    assert quality.infer_return_kind(rets(spark, rows), sample_tickers=5).first().kind == "simple"
    assert quality.infer_return_kind_by_series(rets(spark, rows)).first().kind == "log"


@pytest.mark.parametrize("step, expected", [(1, 252), (3, 252), (7, 52), (9, 52), (30, 12)])
def test_periodicity(spark, step, expected):
    start = day("2024-01-01")
    rows = [(start + dt.timedelta(days=step * k), "A", 0.1) for k in range(5)]
    assert quality.infer_periodicity(rets(spark, rows)).first().per_year == expected


def test_periodicity_of_one_date(spark):
    assert quality.infer_periodicity(rets(spark, [(day("2024-01-01"), "A", 0.1)])).first().per_year == 252


def test_one_percent_a_day_compounds_to_the_month(spark):
    """22 business days of +1 % from 2020-01-01 give one month of 1.01^21 - 1."""
    days, d = [], day("2020-01-01")
    while len(days) < 22:
        if d.weekday() < 5:
            days.append(d)
        d += dt.timedelta(days=1)
    px = prices(spark, [(d, "A", 100 * 1.01**k) for k, d in enumerate(days)])
    month = R.returns_to_frequency_null(R.returns_on_grid(px, "simple"), "1mo").collect()
    assert len(month) == 1 and abs(month[0].ret - (1.01**21 - 1)) < 1e-9
    assert month[0].date == day("2020-01-31")


def test_non_positive_prices_give_no_return(spark):
    rows = [(day(f"2024-01-0{k}"), "A", p) for k, p in enumerate([1.0, 0.0, 2.0, -1.0, 4.0], 1)]
    assert R.returns_from_prices(prices(spark, rows), freq="1d", kind="log").count() == 0
    simple = R.returns_from_prices(prices(spark, rows), freq="1d", kind="simple").orderBy("date").collect()
    assert [r.ret for r in simple] == [-1.0, -1.5, -5.0]


def test_grid_returns_need_both_neighbours(spark):
    d = [day(f"2024-01-0{k}") for k in range(1, 4)]
    px = prices(spark, [(d[0], "A", 1.0), (d[1], "A", 2.0), (d[2], "A", 4.0), (d[0], "B", 1.0), (d[2], "B", 3.0)])
    got = R.returns_on_grid(px, "simple").collect()
    assert {(r.ticker, r.date.day) for r in got} == {("A", 2), ("A", 3)}


def test_empty_windows_compound_to_zero(spark):
    rows = [(day("2024-01-10"), "A", 0.1), (day("2024-02-10"), "A", 0.2), (day("2024-02-20"), "B", 0.5)]
    got = {(r.ticker, r.date.month): r.ret for r in R.returns_to_frequency(rets(spark, rows), freq="1mo", kind="simple").collect()}
    assert got[("B", 2)] == 0.0 and abs(got[("A", 3)] - 0.2) < 1e-12 and len(got) == 4


def test_last_price_follows_stamp_then_arrival(spark):
    d = [day("2024-01-02 10:00:00"), day("2024-01-02 10:00:00.000001")]
    rows = [(d[1], "A", 1.0, -5), (d[1], "A", 2.0, -4), (d[0], "A", 3.0, 2**62), (d[0], "B", 4.0, 1), (d[0], "B", 5.0, 0)]
    got = {r.ticker: r.price for r in R.resample_last(prices(spark, rows, ", seq bigint"), "1d").collect()}
    assert got == {"A": 2.0, "B": 4.0}


def test_calendar_positions_across_days(spark):
    stamps = [day("2024-01-01 09:00:00"), day("2024-01-01 10:00:00"), day("2024-01-03"), day("2023-12-31 23:59:59")]
    df = rets(spark, [(s, t, 0.0) for s in stamps for t in "AB"])
    got = {r.date: (r.idx, r.n_dates) for r in panel.calendar(df).collect()}
    assert [got[s] for s in sorted(stamps)] == [(1, 4), (2, 4), (3, 4), (4, 4)]
