"""Section E: windowed indicators, labels and regimes over the brand-day panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.series import SYMBOL_DAY, Series
from riskloom.operators import indicators as ind
from riskloom.operators import labels as lab
from riskloom.plans.fixtures import W, change, event_bars, full, fundamentals, last, panel, panel_returns, predictions, r, rnd, sql, win
from riskloom.plans.registry import query

KEY = ["Symbol", "Date"]
SQRT252 = "sqrt(252.0::DOUBLE)"


def keep(df, *cols: str, ints: tuple[str, ...] = (), digits: int = 6):
    return df.select(*KEY, *[rnd(c, digits).alias(c) for c in cols], *ints)


@query("e1_price_changes", sql(
    f"SELECT Symbol, Date, {r(change('Close'))} AS Returns, {r(change('Close'))} AS Price_Change_1d, {r(change('Close', 5))} AS Price_Change_5d,"
    f" {r(change('Close', 20))} AS Price_Change_20d FROM panel", "panel"))
def e1(spark, d):
    return keep(ind.price_changes(panel(spark, d)), "Returns", "Price_Change_1d", "Price_Change_5d", "Price_Change_20d")


@query("e2_volatility", sql("SELECT Symbol, Date, " + ", ".join(
    f"{r(full('stddev_samp(Returns)', 'Returns', k) + ' * ' + SQRT252)} AS Volatility_{k}d" for k in (5, 10, 20, 30)) + " FROM ret", "ret"))
def e2(spark, d):
    return keep(ind.volatility(panel_returns(spark, d)), *[f"Volatility_{k}d" for k in (5, 10, 20, 30)])


_ma = ", ".join(f"{full('avg(Close)', 'Close', k)} AS MA_{k}" for k in (5, 10, 20, 50, 100, 200))


@query("e3_moving_averages", sql(
    "SELECT Symbol, Date, " + ", ".join(f"{r(f'MA_{k}', 2)} AS MA_{k}" for k in (5, 10, 20, 50, 100, 200))
    + ", CASE WHEN MA_50 > MA_200 THEN 1 ELSE 0 END AS golden_cross FROM m", "panel", m=f"SELECT *, {_ma} FROM panel"))
def e3(spark, d):
    return keep(ind.moving_averages(panel(spark, d)), *[f"MA_{k}" for k in (5, 10, 20, 50, 100, 200)], ints=("golden_cross",), digits=2)


@query("e4_rsi", sql(
    f"SELECT Symbol, Date, {r('CASE WHEN ls > 0 THEN 100.0 - 100.0 / (1.0 + g / ls) WHEN g > 0 THEN 100.0 END', 4)} AS RSI FROM gl", "panel",
    m=f"SELECT *, coalesce(Close - lag(Close) OVER ({W}), 0.0) AS mv FROM panel",
    gl0="SELECT *, greatest(mv, 0.0) AS gain, greatest(-mv, 0.0) AS loss FROM m",
    gl=f"SELECT *, {full('avg(gain)', 'gain', 14)} AS g, {full('avg(loss)', 'loss', 14)} AS ls FROM gl0"))
def e4(spark, d):
    return keep(ind.rsi(panel(spark, d)), "RSI", digits=4)


def ewm_sql(x: str, span: int, i: str = "i") -> str:
    b = f"(1 - 2.0::DOUBLE / ({span} + 1))"
    f = win("UNBOUNDED PRECEDING")
    return f"(sum({x} * pow({b}, -{i})) OVER {f} / sum(pow({b}, -{i})) OVER {f})"


@query("e5_macd", sql(
    f"SELECT Symbol, Date, {r('f - s', 5)} AS MACD, {r('sig', 5)} AS MACD_Signal, {r('f - s - sig', 5)} AS MACD_Histogram FROM c", "panel",
    a=f"SELECT *, row_number() OVER ({W}) - 1 AS i FROM panel",
    b=f"SELECT *, {ewm_sql('Close', 12)} AS f, {ewm_sql('Close', 26)} AS s FROM a",
    c=f"SELECT *, {ewm_sql('(f - s)', 9)} AS sig FROM b"))
def e5(spark, d):
    return keep(ind.macd(panel(spark, d)), "MACD", "MACD_Signal", "MACD_Histogram", digits=5)


@query("e6_bollinger", sql(
    f"SELECT Symbol, Date, {r('u', 4)} AS BB_Upper, {r('l', 4)} AS BB_Lower, {r('(Close - l) / nullif(u - l, 0)')} AS BB_Position FROM b", "panel",
    m=f"SELECT *, {full('avg(Close)', 'Close', 20)} AS mid, {full('stddev_samp(Close)', 'Close', 20)} AS dev FROM panel",
    b="SELECT *, mid + 2 * dev AS u, mid - 2 * dev AS l FROM m"))
def e6(spark, d):
    return ind.bollinger(panel(spark, d)).select(*KEY, rnd("BB_Upper", 4).alias("BB_Upper"), rnd("BB_Lower", 4).alias("BB_Lower"), rnd("BB_Position").alias("BB_Position"))


@query("e7_volume_ratio", sql(
    f"SELECT Symbol, Date, {r('m')} AS Volume_MA_20, {r('Volume / nullif(m, 0)')} AS Volume_Ratio FROM v", "panel",
    v=f"SELECT *, {full('avg(Volume)', 'Volume', 20)} AS m FROM panel"))
def e7(spark, d):
    return keep(ind.volume_ratio(panel(spark, d)), "Volume_MA_20", "Volume_Ratio")


def _minmax(c: str) -> str:
    lo, hi = f"min({c}) OVER (PARTITION BY Symbol)", f"max({c}) OVER (PARTITION BY Symbol)"
    return f"CASE WHEN {hi} > {lo} THEN ({c} - {lo}) / ({hi} - {lo}) ELSE 0.0 END"


@query("e8_min_max_scaled", sql(
    f"SELECT Symbol, Date, {r(_minmax('Close'))} AS Close_Normalized, {r(_minmax('Volume'))} AS Volume_Normalized FROM panel", "panel"))
def e8(spark, d):
    return keep(ind.min_max_scaled(panel(spark, d), ["Close", "Volume"]), "Close_Normalized", "Volume_Normalized")


def _z(c: str) -> str:
    sd = f"stddev_samp({c}) OVER (PARTITION BY Symbol)"
    return f"CASE WHEN {sd} > 0 THEN ({c} - avg({c}) OVER (PARTITION BY Symbol)) / {sd} ELSE 0.0 END"


@query("e9_z_scores", sql(f"SELECT Symbol, Date, {r(_z('Close'))} AS Close_zscore, {r(_z('Volume'))} AS Volume_zscore FROM panel", "panel"))
def e9(spark, d):
    return keep(ind.z_scores(panel(spark, d), ["Close", "Volume"]), "Close_zscore", "Volume_zscore")


@query("e10_lags", sql("SELECT Symbol, Date, " + ", ".join(
    f"{r(f'lag({c}, {k}) OVER ({W})')} AS {c}_lag_{k}" for c in ("Returns", "Volume") for k in (1, 3, 7, 14)) + " FROM ret", "ret"))
def e10(spark, d):
    return keep(ind.lags(panel_returns(spark, d), ["Returns", "Volume"]), *[f"{c}_lag_{k}" for c in ("Returns", "Volume") for k in (1, 3, 7, 14)])


@query("e11_rolling_means", sql("SELECT Symbol, Date, " + ", ".join(
    f"{r(f'avg({c}) OVER {last(k)}')} AS {c}_rolling_mean_{k}" for c in ("Returns", "Volume") for k in (7, 14, 30)) + " FROM ret", "ret"))
def e11(spark, d):
    return keep(ind.rolling_means(panel_returns(spark, d), ["Returns", "Volume"]), *[f"{c}_rolling_mean_{k}" for c in ("Returns", "Volume") for k in (7, 14, 30)])


@query("e12_rolling_corr", sql(
    f"SELECT Symbol, Date, {r(full('corr(Volume, Returns)', 'Volume + Returns', 20))} AS rolling_corr FROM ret", "ret"))
def e12(spark, d):
    return keep(ind.rolling_corr(panel_returns(spark, d), "Volume", "Returns"), "rolling_corr")


MARKET = "SELECT Date, stddev_samp(Returns) AS mv, avg(Returns) AS mr, sum(Volume) AS vol FROM ret GROUP BY 1"


@query("e13_market_regimes", sql(
    f"SELECT Date, {r('mv')} AS Market_Volatility, {r('mr')} AS Market_Return, {r('ma')} AS market_return_ma200,"
    " CASE WHEN mr > ma THEN 1 ELSE 0 END AS market_bull, CASE WHEN mv > vm * 1.5 THEN 1 ELSE 0 END AS market_high_volatility,"
    " CASE WHEN (CASE WHEN mv > vt THEN 1 ELSE 0 END + CASE WHEN mr < rl THEN 1 ELSE 0 END + CASE WHEN vol > nt THEN 1 ELSE 0 END) >= 2"
    " THEN 1 ELSE 0 END AS crisis_period FROM m, q", "ret", d=MARKET,
    m="SELECT *, CASE WHEN count(mr) OVER w >= 200 THEN avg(mr) OVER w END AS ma FROM d WINDOW w AS (ORDER BY Date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)",
    q="SELECT quantile_cont(mv, 0.5) vm, quantile_cont(mv, 0.95) vt, quantile_cont(mr, 0.05) rl, quantile_cont(vol, 0.95) nt FROM d"))
def e13(spark, d):
    daily = lab.market_daily(panel_returns(spark, d), extra={"volume_sum": F.sum("Volume")})
    out = lab.market_regimes(daily, news="volume_sum")
    return out.select("Date", *[rnd(c).alias(c) for c in ("Market_Volatility", "Market_Return", "market_return_ma200")],
                      "market_bull", "market_high_volatility", "crisis_period")


_ahead5 = win("1 FOLLOWING", "5 FOLLOWING")


@query("e14_label_single_step", sql(
    f"SELECT Symbol, Date, {r('CASE WHEN fr IS NOT NULL AND fv IS NOT NULL THEN fr ELSE 0 END')} AS Forward_Return,"
    f" {r('CASE WHEN fr IS NOT NULL AND fv IS NOT NULL THEN fv ELSE 0 END')} AS Forward_Volatility,"
    " CASE WHEN fr IS NOT NULL AND fv IS NOT NULL AND (fv > 0.3 OR fr < -0.1) THEN 1 ELSE 0 END AS Risk_Label,"
    f" {r('CASE WHEN fr IS NOT NULL AND fv IS NOT NULL THEN least(1.0, (least(2.0, fv / 0.3) / 2 + least(2.0, greatest(0.0, fr / -0.1)) / 2) / 2) ELSE 0 END')} AS Risk_Score FROM f",
    "ret", f=f"SELECT *, lead(Returns, 5) OVER ({W}) AS fr, {full('stddev_samp(Returns)', 'Returns', 5, _ahead5)} AS fv FROM ret"))
def e14(spark, d):
    return keep(lab.label_single_step(panel_returns(spark, d)), "Forward_Return", "Forward_Volatility", "Risk_Score", ints=("Risk_Label",))


@query("e15_label_mean_step", sql(
    f"SELECT Symbol, Date, {r('Future_Return')} AS Future_Return, {r('Future_Volatility')} AS Future_Volatility, Risk_Label, {r('Risk_Score')} AS Risk_Score FROM labelled", "labelled"))
def e15(spark, d):
    return keep(lab.label_mean_step(panel_returns(spark, d)), "Future_Return", "Future_Volatility", "Risk_Score", ints=("Risk_Label",))


@query("e20_tone_spread", sql("SELECT Symbol, Date, " + ", ".join(
    f"{r(full('stddev_samp(Close)', 'Close', k), 3)} AS sentiment_volatility_{k}d" for k in (7, 30)) + " FROM panel", "panel"))
def e20(spark, d):
    return keep(ind.tone_spread(panel(spark, d), "Close"), "sentiment_volatility_7d", "sentiment_volatility_30d", digits=3)


@query("e21_tone_extremes", sql(
    "SELECT Symbol, Date, CASE WHEN Returns > hi THEN 1 ELSE 0 END AS sentiment_extreme_positive, CASE WHEN Returns < lo THEN 1 ELSE 0 END AS sentiment_extreme_negative FROM q",
    "ret", q=f"SELECT *, {full('quantile_cont(Returns, 0.9)', 'Returns', 30)} AS hi, {full('quantile_cont(Returns, 0.1)', 'Returns', 30)} AS lo FROM ret"))
def e21(spark, d):
    return ind.tone_extremes(panel_returns(spark, d), "Returns").select(*KEY, "sentiment_extreme_positive", "sentiment_extreme_negative")


_slope = "SELECT *, row_number() OVER (" + W + ")::DOUBLE AS t FROM {}"


@query("e22_rolling_slope", sql(
    f"SELECT Symbol, Date, {r(full('regr_slope(Returns, t)', 'Returns', 30))} AS slope_30 FROM a", "ret", a=_slope.format("ret")))
def e22(spark, d):
    return keep(ind.rolling_slope(panel_returns(spark, d), "Returns", 30, "slope_30"), "slope_30")


@query("e23_parkinson", sql(
    f"SELECT Symbol, Date, {r('sqrt(252 * m)')} AS parkinson_volatility FROM b", "panel",
    a="SELECT *, pow(ln(High / nullif(Low, 0)), 2) AS sq FROM panel", b=f"SELECT *, {full('avg(sq)', 'sq', 20)} AS m FROM a"))
def e23(spark, d):
    return keep(ind.parkinson(panel(spark, d)), "parkinson_volatility")


@query("e24_acceleration", sql(f"SELECT Symbol, Date, {r(change('Returns'), 4)} AS price_acceleration FROM ret", "ret"))
def e24(spark, d):
    return keep(ind.acceleration(panel(spark, d)), "price_acceleration", digits=4)


@query("e25_support_resistance", sql(
    f"SELECT Symbol, Date, {r('hi')} AS resistance_level, {r('lo')} AS support_level, CASE WHEN Close / nullif(hi, 0) > 0.98 THEN 1 ELSE 0 END AS price_near_resistance,"
    " CASE WHEN Close / nullif(lo, 0) < 1.02 THEN 1 ELSE 0 END AS price_near_support FROM b", "panel",
    b=f"SELECT *, {full('max(High)', 'High', 20)} AS hi, {full('min(Low)', 'Low', 20)} AS lo FROM panel"))
def e25(spark, d):
    return keep(ind.support_resistance(panel(spark, d)), "resistance_level", "support_level", ints=("price_near_resistance", "price_near_support"))


@query("e26_on_balance_volume", sql(
    f"SELECT Symbol, Date, {r('sum(sv) OVER ' + win('UNBOUNDED PRECEDING'))} AS obv FROM a", "ret",
    a="SELECT *, CASE WHEN Returns > 0 THEN Volume ELSE -Volume END AS sv FROM ret"))
def e26(spark, d):
    return keep(ind.on_balance_volume(panel(spark, d)), "obv")


@query("e27_vwap", sql(
    f"SELECT Symbol, Date, {r('v', 4)} AS vwap, {r('(Close - v) / nullif(v, 0)')} AS price_vwap_deviation FROM a", "panel",
    a0="SELECT *, Close * Volume AS pv FROM panel",
    a=f"SELECT *, {full('sum(pv)', 'pv', 20)} / nullif({full('sum(Volume)', 'Volume', 20)}, 0) AS v FROM a0"))
def e27(spark, d):
    return ind.vwap(panel(spark, d)).select(*KEY, rnd("vwap", 4).alias("vwap"), rnd("price_vwap_deviation").alias("price_vwap_deviation"))


@query("e28_trend_strength", sql(
    f"SELECT Symbol, Date, {r('abs(' + full('regr_slope(Close, t)', 'Close', 20) + ')', 4)} AS trend_strength FROM a", "panel", a=_slope.format("panel")))
def e28(spark, d):
    return keep(ind.trend_strength(panel(spark, d)), "trend_strength", digits=4)


@query("e29_sma_stack", sql(
    "SELECT Symbol, Date, CASE WHEN a > b AND b > c THEN 1 ELSE 0 END AS sma_bull, CASE WHEN a < b AND b < c THEN 1 ELSE 0 END AS sma_bear FROM m", "panel",
    m="SELECT *, " + ", ".join(f"{full('avg(Close)', 'Close', k)} AS {n}" for n, k in (("a", 20), ("b", 50), ("c", 200))) + " FROM panel"))
def e29(spark, d):
    return ind.sma_stack(panel(spark, d)).select(*KEY, "sma_bull", "sma_bear")


@query("e30_volatility_rank", sql(
    f"SELECT Symbol, Date, {r('rk')} AS volatility_regime, CASE WHEN rk > 0.8 THEN 1 ELSE 0 END AS high_volatility_rank, CASE WHEN rk < 0.2 THEN 1 ELSE 0 END AS low_volatility_rank FROM c",
    "ret", a=f"SELECT *, {full('stddev_samp(Returns)', 'Returns', 20)} AS v FROM ret",
    b=f"SELECT *, CASE WHEN count(v) OVER {last(60)} >= 60 THEN list(v) OVER {last(60)} END AS vs FROM a",
    c="SELECT *, (len(list_filter(vs, lambda x: x < v)) + (len(list_filter(vs, lambda x: x = v)) + 1) / 2.0::DOUBLE) / 60 AS rk FROM b"))
def e30(spark, d):
    return keep(ind.volatility_rank(panel(spark, d)), "volatility_regime", ints=("high_volatility_rank", "low_volatility_rank"))


@query("e31_relative_tone", sql(
    f"SELECT Symbol, Date, {r('m')} AS market_sentiment_avg, {r('Returns - m')} AS relative_sentiment FROM ret JOIN md USING (Date)", "ret",
    md="SELECT Date, avg(Returns) AS m FROM ret GROUP BY 1"))
def e31(spark, d):
    return keep(ind.relative_tone(panel_returns(spark, d), "Returns"), "market_sentiment_avg", "relative_sentiment")


_edges = ", ".join(f"quantile_cont(v, {i / 10})" for i in range(11))


@query("e32_quantile_bins", sql(
    "SELECT Symbol, Date, CAST(CASE WHEN v IS NOT NULL THEN greatest(len(list_filter(list_distinct(e), lambda x: x < v)) - 1, 0) END AS INTEGER) AS bin FROM a, q", "panel",
    a="SELECT Symbol, Date, Volume AS v FROM panel", q=f"SELECT [{_edges}] AS e FROM a"))
def e32(spark, d):
    return lab.quantile_bins(panel(spark, d), "Volume").select(*KEY, "bin")


@query("e33_drawdown", sql(
    f"SELECT Symbol, Date, {r('coalesce(Close / nullif(max(Close) OVER ' + win('UNBOUNDED PRECEDING') + ', 0) - 1, 0)')} AS Drawdown,"
    f" {r('coalesce(sum(coalesce(Returns, 0)) OVER ' + win('UNBOUNDED PRECEDING') + ', 0)', 4)} AS Cumulative_Return FROM ret", "ret"))
def e33(spark, d):
    out = ind.cumulative_return(ind.drawdown(panel_returns(spark, d)))
    return out.select(*KEY, rnd("Drawdown").alias("Drawdown"), rnd("Cumulative_Return", 4).alias("Cumulative_Return"))


@query("e34_forward_returns", sql("SELECT Symbol, Date, " + ", ".join(
    f"{r(f'lead(Close, {k}) OVER ({W}) / nullif(Close, 0) - 1')} AS Forward_Return_{k}d" for k in (1, 5, 20)) + " FROM panel", "panel"))
def e34(spark, d):
    return keep(lab.forward_returns(panel(spark, d)), *[f"Forward_Return_{k}d" for k in (1, 5, 20)])


@query("e35_forward_drawdown", sql("SELECT Symbol, Date, " + ", ".join(
    f"{r(full('min(Close)', 'Close', k, win('1 FOLLOWING', f'{k} FOLLOWING')) + f' / nullif(lead(Close) OVER ({W}), 0) - 1')} AS Max_Drawdown_{k}d" for k in (5, 10, 20)) + " FROM panel", "panel"))
def e35(spark, d):
    return keep(lab.forward_drawdown(panel(spark, d)), *[f"Max_Drawdown_{k}d" for k in (5, 10, 20)])


REGIME = dict(
    rv=f"SELECT *, {full('stddev_samp(Returns)', 'Returns', 30, at_least=10)} AS v FROM ret",
    rq="SELECT quantile_cont(v, 0.33) lo, quantile_cont(v, 0.66) hi FROM rv",
    regimes="SELECT rv.*, CASE WHEN v >= hi THEN 'high_volatility' WHEN v <= lo THEN 'low_volatility' ELSE 'moderate_volatility' END AS regime FROM rv, rq",
)


@query("e36_volatility_regime", sql(f"SELECT Symbol, Date, {r('v')} AS regime_volatility, regime FROM regimes", "ret", **REGIME))
def e36(spark, d):
    return keep(lab.volatility_regime(panel_returns(spark, d)), "regime_volatility", ints=("regime",))


@query("e37_ensure_returns", sql(f"SELECT Symbol, Date, {r('coalesce(Returns, 0)')} AS Returns FROM ret", "ret"))
def e37(spark, d):
    return keep(lab.ensure_returns(panel(spark, d)), "Returns")


@query("e38_delayed", sql(
    f"SELECT Symbol, Date, {r('first_value(x IGNORE NULLS) OVER ' + win('CURRENT ROW', 'UNBOUNDED FOLLOWING'))} AS Volume FROM a", "panel",
    a=f"SELECT *, lag(Volume, 3) OVER ({W}) AS x FROM panel"))
def e38(spark, d):
    return keep(ind.delayed(panel(spark, d), ["Volume"], 3), "Volume")


@query("e41_smoothed_label", sql(f"SELECT Symbol, Date, {r('avg(Risk_Label) OVER ' + last(3))} AS Risk_Probability FROM labelled", "labelled"))
def e41(spark, d):
    df = lab.label_mean_step(panel_returns(spark, d))
    return keep(df.withColumn("Risk_Probability", F.avg("Risk_Label").over(SYMBOL_DAY.last(3))), "Risk_Probability")


@query("e42_sequences", sql(
    f"SELECT Symbol, Date, CAST(len(s) AS INTEGER) AS steps, {r('list_aggregate(list_transform(s, lambda x: x[1]), ' + chr(39) + 'sum' + chr(39) + ')', 4)} AS sum_returns,"
    " s[1][2] AS first_volume, s[30][2] AS last_volume, target FROM a WHERE len(s) = 30", "labelled",
    a=f"SELECT Symbol, Date, Risk_Label AS target, list([coalesce(Returns, 0), Volume]) OVER {win('30 PRECEDING', '1 PRECEDING')} AS s FROM labelled"))
def e42(spark, d):
    seq = ind.sequences(lab.label_mean_step(panel_returns(spark, d)), ["Returns", "Volume"], "Risk_Label")
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, x: acc + x[0])
    return seq.select(*KEY, F.size("sequence").alias("steps"), rnd(total, 4).alias("sum_returns"), F.col("sequence")[0][1].alias("first_volume"),
                      F.col("sequence")[29][1].alias("last_volume"), "target")


@query("e43_regime_spans", sql(
    "SELECT Date AS span_start, nx AS span_end FROM s WHERE mr > 0.02 AND nx IS NOT NULL", "ret", d=MARKET,
    s="SELECT *, lead(Date) OVER (ORDER BY Date) AS nx FROM d"))
def e43(spark, d):
    daily = lab.market_daily(panel_returns(spark, d)).withColumn("bull", lab.flag(F.col("Market_Return") > 0.02))
    return lab.regime_spans(daily, "bull")


@query("e_event_bars", """SELECT event_type AS Symbol, CAST(ts AS DATE) AS Date, arg_min(value, (ts, event_id)) AS Open, max(value) AS High, min(value) AS Low,
    arg_max(value, (ts, event_id)) AS Close, count(*) AS Volume FROM events GROUP BY 1, 2""")
def e_bars(spark, d):
    return event_bars(spark, d).select(*KEY, "Open", "High", "Low", "Close", "Volume")
