"""Rolling indicators against pandas, symbol by symbol."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import indicators as ind
from riskloom.operators import labels as lab


def same(df, pdf, column, expected, tol=1e-9):
    got = df.select("Symbol", "Date", column).toPandas().sort_values(["Symbol", "Date"])[column].to_numpy(dtype=float)
    want = pdf.sort_values(["Symbol", "Date"]).assign(_x=expected)["_x"].to_numpy(dtype=float)
    assert np.allclose(got, want, rtol=tol, atol=tol, equal_nan=True)


def by(pdf):
    return pdf.sort_values(["Symbol", "Date"]).groupby("Symbol")


def test_returns_volatility_and_averages(walk):
    pdf, df = walk
    ret = by(pdf)["Close"].pct_change()
    out = ind.moving_averages(ind.volatility(ind.returns(df), spans=(20,)), spans=(50, 200))
    same(out, pdf, "Returns", ret)
    same(out, pdf, "Volatility_20d", ret.groupby(pdf["Symbol"]).transform(lambda x: x.rolling(20).std() * np.sqrt(252)))
    same(out, pdf, "MA_50", by(pdf)["Close"].transform(lambda x: x.rolling(50).mean()))


def test_ewm_crosses_blocks(walk):
    pdf, df = walk
    out = ind.macd(df)
    line = by(pdf)["Close"].transform(lambda x: x.ewm(span=12).mean() - x.ewm(span=26).mean())
    same(out, pdf, "MACD", line, 1e-8)
    same(out, pdf, "MACD_Signal", line.groupby(pdf["Symbol"]).transform(lambda x: x.ewm(span=9).mean()), 1e-8)


def test_ewm_with_gaps_and_small_blocks(walk):
    pdf, df = walk
    gap = F.when(F.dayofyear("Date") % 5 != 0, F.col("Close"))
    out = ind.ewm_mean(df.withColumn("g", gap), {"e": ("g", 10)}, block=16)
    day = pd.to_datetime(pdf["Date"]).dt.dayofyear
    want = by(pdf.assign(g=pdf["Close"].where(day % 5 != 0)))["g"].transform(lambda x: x.ewm(span=10).mean())
    same(out, pdf, "e", want, 1e-8)


def test_rsi_bands_and_obv(walk):
    pdf, df = walk

    def rsi(x):
        d = x.diff()
        g, l = d.where(d > 0, 0).rolling(14).mean(), (-d.where(d < 0, 0)).rolling(14).mean()
        return 100 - 100 / (1 + g / l)

    same(ind.rsi(df), pdf, "RSI", by(pdf)["Close"].transform(rsi), 1e-7)
    mid, dev = by(pdf)["Close"].transform(lambda x: x.rolling(20).mean()), by(pdf)["Close"].transform(lambda x: x.rolling(20).std())
    same(ind.bollinger(df), pdf, "BB_Upper", mid + 2 * dev)
    change = by(pdf)["Close"].pct_change()
    signed = pd.Series(np.where(change > 0, pdf["Volume"], -pdf["Volume"]), index=pdf.index)
    same(ind.on_balance_volume(df), pdf, "obv", signed.groupby(pdf["Symbol"]).cumsum())


def test_rank_quantile_slope_corr(walk):
    pdf, df = walk
    ret = by(pdf)["Close"].pct_change()
    g = ret.groupby(pdf["Symbol"])
    vol = g.transform(lambda x: x.rolling(20).std())
    same(ind.volatility_rank(df), pdf, "volatility_regime", vol.groupby(pdf["Symbol"]).transform(lambda x: x.rolling(60).rank(pct=True)))
    out = ind.rolling_slope(df, "Close", 30, "s")
    same(out, pdf, "s", by(pdf)["Close"].transform(lambda x: x.rolling(30).apply(lambda v: np.polyfit(range(len(v)), v, 1)[0])), 1e-6)
    both = pdf.assign(r=ret)
    want = pd.concat([g["Volume"].rolling(20).corr(g["r"]) for _, g in both.groupby("Symbol")])
    same(ind.rolling_corr(ind.returns(df), "Volume", "Returns"), pdf, "rolling_corr", want, 1e-7)


def test_constant_series_and_zero_prices(spark):
    rows = [("C", f"2020-01-{i:02d}", 5.0, 0.0) for i in range(1, 29)]
    df = spark.createDataFrame(rows, "Symbol string, Date string, Close double, Volume double").withColumn("Date", F.to_date("Date"))
    out = ind.rolling_corr(ind.rsi(ind.bollinger(ind.volume_ratio(ind.returns(df)))), "Close", "Returns", 5).orderBy("Date").toPandas()
    assert out["RSI"].isna().all() and out["Volume_Ratio"].isna().all() and out["rolling_corr"].isna().all()
    scaled = ind.z_scores(ind.min_max_scaled(df, ["Close"]), ["Close"]).toPandas()
    assert (scaled["Close_Normalized"] == 0).all() and (scaled["Close_zscore"] == 0).all()


def test_no_value_crosses_symbols(walk):
    """Changing every price of B leaves every feature of A as it was."""
    _, df = walk
    other = df.withColumn("Close", F.when(F.col("Symbol") == "B", F.col("Close") * 1000).otherwise(F.col("Close")))

    def features(x):
        x = lab.forward_drawdown(lab.forward_returns(lab.label_mean_step(ind.returns(x))))
        x = ind.delayed(ind.sma_stack(ind.macd(x)), ["Volume"], 2)
        return x.where("Symbol = 'A'").orderBy("Date").toPandas()

    pd.testing.assert_frame_equal(features(df), features(other))


def test_labels_against_pandas(walk):
    pdf, df = walk
    ret = by(pdf)["Close"].pct_change()
    g = ret.groupby(pdf["Symbol"])
    out = lab.label_mean_step(ind.returns(df))
    same(out, pdf, "Future_Return", g.transform(lambda x: x.rolling(5).mean().shift(-5)))
    same(out, pdf, "Future_Volatility", g.transform(lambda x: x.rolling(5).std().shift(-5)))
    tail = lab.label_mean_step(ind.returns(df), tail="null").where("Risk_Label IS NULL").count()
    assert tail == 5 + 5 + 1
    assert lab.label_mean_step(ind.returns(df)).where("Risk_Label IS NULL").count() == 0


def test_regime_names_and_bins(walk):
    pdf, df = walk
    regimes = {r["regime"] for r in lab.volatility_regime(ind.returns(df)).select("regime").distinct().collect()}
    assert regimes == {"low_volatility", "moderate_volatility", "high_volatility"}
    got = lab.quantile_bins(df, "Volume").toPandas().sort_values(["Symbol", "Date"])
    want = pd.qcut(got["Volume"], 10, labels=False, duplicates="drop")
    assert (got["bin"].to_numpy() == want.to_numpy()).all()


def test_missing_return_column_is_refused(spark):
    with pytest.raises(ValueError):
        lab.ensure_returns(spark.range(3))
