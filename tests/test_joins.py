import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import clean as cl
from riskloom.operators import joins as jn


@pytest.fixture(scope="module")
def sides():
    rng = np.random.default_rng(8)
    days = pd.date_range("2020-01-01", periods=200)
    left = pd.DataFrame([(s, d) for s in "AB" for d in days if rng.random() < 0.7], columns=["Symbol", "Date"])
    right = pd.DataFrame([(s, d, i) for s in "AC" for i, d in enumerate(days) if rng.random() < 0.06], columns=["Symbol", "Date", "v"])
    return left, right


def frame(spark, pdf):
    return spark.createDataFrame(pdf.assign(Date=pdf["Date"].dt.date))


@pytest.mark.parametrize("direction", ["backward", "nearest"])
def test_asof_with_key(spark, sides, direction):
    left, right = sides
    fn = jn.asof_backward if direction == "backward" else lambda a, b, c: jn.asof_nearest(a, b, c, tolerance_days=9)
    got = fn(frame(spark, left), frame(spark, right), ["v"]).toPandas().sort_values(["Date", "Symbol"])
    kw = {} if direction == "backward" else {"tolerance": pd.Timedelta(days=9)}
    want = pd.merge_asof(left.sort_values("Date"), right.sort_values("Date"), on="Date", by="Symbol", direction=direction, **kw).sort_values(["Date", "Symbol"])
    assert len(got) == len(left)
    assert np.allclose(got["v"].to_numpy(dtype=float), want["v"].to_numpy(dtype=float), equal_nan=True)


def test_asof_nearest_without_key(spark, sides):
    left, right = sides
    one = right[right["Symbol"] == "A"].drop(columns="Symbol")
    got = jn.asof_nearest(frame(spark, left), frame(spark, one), ["v"], by=(), tolerance_days=5).toPandas().sort_values(["Date", "Symbol"])
    want = pd.merge_asof(left.sort_values("Date"), one.sort_values("Date"), on="Date", direction="nearest", tolerance=pd.Timedelta(days=5)).sort_values(["Date", "Symbol"])
    assert np.allclose(got["v"].to_numpy(dtype=float), want["v"].to_numpy(dtype=float), equal_nan=True)


def test_asof_takes_last_row_of_a_day_and_nothing_before_the_first(spark):
    d = dt.date
    left = spark.createDataFrame([("A", d(2020, 1, 1)), ("A", d(2020, 1, 3))], "Symbol string, Date date")
    right = spark.createDataFrame([("A", d(2020, 1, 2), 1, 5.0), ("A", d(2020, 1, 2), 2, 6.0), ("A", d(2020, 1, 9), 3, 7.0)], "Symbol string, Date date, id int, v double")
    got = {r["Date"]: r["v"] for r in jn.asof_backward(left, right, ["v"], tie=["id"]).collect()}
    assert got == {d(2020, 1, 1): None, d(2020, 1, 3): 6.0}


def test_interval_join_is_closed_and_spans_months(spark):
    d = dt.date
    rows = spark.createDataFrame([(d(2020, 1, 30),), (d(2020, 1, 31),), (d(2020, 3, 1),), (d(2020, 3, 2),)], "Date date")
    w = spark.createDataFrame([("w", d(2020, 1, 31), d(2020, 3, 1)), ("x", d(2020, 3, 1), d(2020, 3, 1))], "name string, start_date date, end_date date")
    got = sorted((r["name"], r["Date"]) for r in jn.interval_join(rows, w).collect())
    assert got == [("w", d(2020, 1, 31)), ("w", d(2020, 3, 1)), ("x", d(2020, 3, 1))]
    before = jn.pre_event(w, 30).where("name = 'w'").first()
    assert (before["start_date"], before["end_date"]) == (d(2020, 1, 1), d(2020, 1, 30))


def test_full_by_key_and_collisions(spark):
    a = spark.createDataFrame([("A", 1, 1.0), ("B", 1, None)], "Symbol string, Date int, v double")
    b = spark.createDataFrame([("B", 1, 2.0), ("C", 1, 3.0)], "Symbol string, Date int, v double")
    got = {r["Symbol"]: (r["a_v"], r["b_v"]) for r in jn.full_by_key({"a": a, "b": b}, ["Symbol", "Date"]).collect()}
    assert got == {"A": (1.0, None), "B": (None, 2.0), "C": (None, 3.0)}
    merged = {r["Symbol"]: r["v"] for r in jn.resolve_collisions(a, b, ["Symbol", "Date"]).collect()}
    assert merged == {"A": 1.0, "B": 2.0}


def test_fills_stay_inside_a_symbol(spark):
    rows = [("A", 1, None), ("A", 2, 4.0), ("A", 3, None), ("A", 4, 8.0), ("A", 5, None), ("B", 1, None), ("B", 2, None)]
    df = spark.createDataFrame(rows, "Symbol string, Date int, v double")
    filled = {(r["Symbol"], r["Date"]): r["v"] for r in cl.fill_both_ways(df, ["v"]).collect()}
    assert [filled["A", i] for i in range(1, 6)] == [4.0, 4.0, 4.0, 8.0, 8.0] and filled["B", 1] is None
    line = {(r["Symbol"], r["Date"]): r["v"] for r in cl.interpolate(df, ["v"]).collect()}
    assert [line["A", i] for i in range(1, 6)] == [None, 4.0, 6.0, 8.0, 8.0] and line["B", 2] is None


def test_only_symbols_falls_back_to_all(spark):
    df = spark.createDataFrame([("A",), ("B",)], "Symbol string")
    assert cl.only_symbols(df, ["A", "Z"]).count() == 1
    assert cl.only_symbols(df, ["Z"]).count() == 2


def test_drop_sparse_and_median_and_groups(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (None, None, 6.0), (3.0, 1.0, 9.0)], "close double, empty double, misc double")
    kept = cl.drop_sparse_columns(df, 0.5)
    assert kept.columns == ["close", "misc"]
    assert sorted(r["close"] for r in cl.median_fill(kept, ["close"]).collect()) == [1.0, 2.0, 3.0]
    names = ["Close", "Volume_Ratio", "RSI", "PE_Ratio", "sec_sentiment", "news_sentiment_mean", "mda_words", "market_x", "x_lag_1", "crisis_period", "month"]
    got = [r["g"] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", cl.group_of(F.col("n")).alias("g")).orderBy("i").collect()]
    assert got == ["price_features", "volume_features", "technical_indicators", "fundamental_ratios", "sentiment_features", "news_features", "sec_features", "market_features",
                   "lag_features", "derived_features", "date_features"]


def test_required_columns(spark):
    with pytest.raises(ValueError):
        cl.align_features(spark.range(2), ["nope"], strict=True)
