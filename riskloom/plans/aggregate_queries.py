"""Section D: aggregates, profiles and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import tone
from riskloom.operators import aggregates as ag
from riskloom.operators import indicators as ind
from riskloom.operators import joins as jn
from riskloom.operators import labels as lab
from riskloom.plans.fixtures import (
    W, events_catalogue, fundamentals, full, gappy_panel, labelled, last, news, plain_round, panel, panel_returns, predictions, r, rnd, scored_filings, scored_news, sql, table,
    vectors, filing_sections, win,
)
from riskloom.plans.join_queries import NEWS_JOIN, news_panel
from riskloom.plans.registry import query

KEY = ["Symbol", "Date"]


def rounded(df, *cols: str, digits: int = 6):
    return df.withColumns({c: rnd(c, digits) for c in cols})


@query("d4_market_indicators", sql(f"SELECT Date, {r('stddev_samp(Returns)')} AS Market_Volatility, {r('avg(Returns)')} AS Market_Return, {r('avg(CASE WHEN Close > m THEN 1 ELSE 0 END)')} AS Market_Trend FROM a GROUP BY 1", "ret",
                                   a=f"SELECT *, {full('avg(Close)', 'Close', 50)} AS m FROM ret"))
def d4(spark, d):
    return rounded(ag.market_breadth(ind.moving_averages(panel_returns(spark, d), spans=(50,))), "Market_Volatility", "Market_Return", "Market_Trend")


@query("d5_news_statistics", sql(f"""SELECT api_source, count(*) AS articles, count(DISTINCT Symbol) AS companies, min(published_date) AS earliest, max(published_date) AS latest,
    {r('avg(length(title))')} AS avg_title_length, {r('avg(length(description))')} AS avg_description_length FROM news GROUP BY ROLLUP (api_source)""", "news"))
def d5(spark, d):
    return rounded(ag.news_statistics(news(spark, d)), "avg_title_length", "avg_description_length")


@query("d6_filing_statistics", sql(f"""SELECT form_type, count(*) AS filings, count(DISTINCT Symbol) AS companies, {r('avg(CASE WHEN length(mda_text) > 900 THEN 1 ELSE 0 END)')} AS success_rate,
    {r('avg(length(mda_text))')} AS avg_mda_length, {r('avg(length(risk_factors_text))')} AS avg_risk_factors_length, min(filing_date) AS earliest, max(filing_date) AS latest FROM sections GROUP BY ROLLUP (form_type)""", "sections"))
def d6(spark, d):
    f = filing_sections(spark, d).withColumns({"mda_length": F.length("mda_text"), "risk_factors_length": F.length("risk_factors_text"), "extraction_success": F.length("mda_text") > 900})
    return rounded(ag.filing_statistics(f), "success_rate", "avg_mda_length", "avg_risk_factors_length")


@query("d7_dataset_profile", sql(f"""SELECT count(*) AS total_observations, CAST(5 AS INTEGER) AS columns, count(DISTINCT Symbol) AS unique_symbols, min(Date) AS start, max(Date) AS "end",
    {r('(1 - (count(Symbol) + count(Date) + count(Close) + count(Volume) + count(Risk_Label))::DOUBLE / (count(*) * 5)) * 100')} AS missing_pct,
    CAST(sum(Risk_Label) AS BIGINT) AS high_risk_periods, {r('avg(Risk_Label)')} AS risk_rate FROM (SELECT g.Symbol, g.Date, g.Close, g.Volume, l.Risk_Label FROM gappy g JOIN labelled l USING (Symbol, Date))""", "gappy", "labelled"))
def d7(spark, d):
    g = gappy_panel(spark, d).select(*KEY, "Close", "Volume").join(labelled(spark, d).select(*KEY, "Risk_Label"), KEY)
    return rounded(ag.dataset_profile(g), "missing_pct", "risk_rate")


@query("d8_risk_timeline", sql(f"SELECT Date, {r('avg(Risk_Label)')} AS Risk_Level, {r('stddev_samp(Risk_Label)')} AS Risk_Volatility, count(Risk_Label) AS Sample_Count, count(DISTINCT Symbol) AS Symbols_Count FROM labelled GROUP BY 1", "labelled"))
def d8(spark, d):
    return rounded(ag.risk_timeline(labelled(spark, d)), "Risk_Level", "Risk_Volatility")


ZONED = dict(z0="SELECT Date, avg(Risk_Probability) AS risk_level, stddev_samp(Risk_Probability) AS sd, count(*) AS n, avg(Close) AS p FROM pred GROUP BY 1",
             z="""SELECT *, CASE WHEN risk_level <= 0.3 THEN 'Low Risk' WHEN risk_level <= 0.7 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_zone,
      avg(risk_level) OVER (ORDER BY Date ROWS 6 PRECEDING) AS m7, avg(risk_level) OVER (ORDER BY Date ROWS 29 PRECEDING) AS m30 FROM z0""")


@query("d9_zoned_timeline", sql(f"SELECT Date, {r('risk_level')} AS risk_level, {r('sd')} AS risk_volatility, n AS sample_count, {r('p', 3)} AS avg_price, risk_zone, {r('m7', 5)} AS risk_ma_7, {r('m30', 5)} AS risk_ma_30 FROM z", "pred", **ZONED))
def d9(spark, d):
    out = ag.zoned_timeline(predictions(spark, d))
    return rounded(rounded(rounded(out, "risk_level", "risk_volatility"), "avg_price", digits=3), "risk_ma_7", "risk_ma_30", digits=5)


@query("d9_zone_summary", sql(f"""SELECT risk_zone, count(*) AS days, {r('count(*) * 100.0::DOUBLE / any_value(k)')} AS pct, {r('any_value(c)')} AS recent_change,
    CASE WHEN any_value(c) > 0.05 THEN 'increasing' WHEN any_value(c) < -0.05 THEN 'decreasing' ELSE 'stable' END AS trend
    FROM z, (SELECT count(*) AS k, avg(risk_level) FILTER (Date > cut) - avg(risk_level) AS c FROM z0, (SELECT Date AS cut FROM z0 ORDER BY Date DESC LIMIT 1 OFFSET 30)) GROUP BY 1""", "pred", **ZONED))
def d9s(spark, d):
    return rounded(ag.zone_summary(ag.zoned_timeline(predictions(spark, d))), "pct", "recent_change")


@query("d10_count_pivot", sql("SELECT Symbol, count(*) FILTER (Risk_Label = 0) AS \"0\", count(*) FILTER (Risk_Label = 1) AS \"1\" FROM labelled GROUP BY 1", "labelled"))
def d10(spark, d):
    return ag.count_pivot(labelled(spark, d), "Symbol", "Risk_Label", [0, 1])


@query("d11_symbol_means", sql(f"""SELECT 'symbol' AS kind, Symbol, CAST(NULL AS DATE) AS Date, {r('avg(cc)')} AS tone, count(*) AS n FROM scored GROUP BY Symbol
    UNION ALL SELECT 'label', sl, NULL, {r('avg(cc)')}, count(*) FROM (SELECT *, Symbol || ':' || CASE WHEN cc >= 0.05 THEN 'positive' WHEN cc <= -0.05 THEN 'negative' ELSE 'neutral' END AS sl FROM scored) GROUP BY sl
    UNION ALL SELECT 'day', Symbol, published_date, {r('avg(cc)')}, count(*) FROM scored GROUP BY Symbol, published_date""", "scored"))
def d11(spark, d):
    n = scored_news(spark, d)
    aggs = [rnd(F.avg("combined_sentiment_compound")).alias("tone"), F.count(F.lit(1)).alias("n")]
    label = F.concat_ws(":", "Symbol", "sentiment_label")
    parts = [("symbol", F.col("Symbol"), F.lit(None).cast("date")), ("label", label, F.lit(None).cast("date")), ("day", F.col("Symbol"), F.col("published_date"))]
    out = None
    for kind, key, day in parts:
        one = n.groupBy(key.alias("Symbol"), day.alias("Date")).agg(*aggs).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


_score = "SELECT Symbol, cc AS c, greatest(cc, 0) AS p, greatest(-cc, 0) AS n FROM scored"


@query("d12_tone_scorecard", sql(f"""SELECT *, {r('compound_mean * ln(1 + compound_count) * 0.1')} AS weighted_sentiment, CASE WHEN compound_mean < -0.1 THEN 1.0::DOUBLE WHEN compound_mean < 0.1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS sentiment_risk,
    coalesce(compound_std, 0) AS sentiment_volatility, {r('0.6 * compound_mean + 0.2 * pos_mean - 0.2 * neg_mean')} AS composite_sentiment FROM g""", "scored", a=_score,
    g=f"""SELECT Symbol, {plain_round('avg(c)', 4)} AS compound_mean, {plain_round('stddev_samp(c)', 4)} AS compound_std, {plain_round('min(c)', 4)} AS compound_min, {plain_round('max(c)', 4)} AS compound_max, count(c) AS compound_count,
    {plain_round('avg(p)', 4)} AS pos_mean, {plain_round('sum(p)', 4)} AS pos_sum, {plain_round('avg(n)', 4)} AS neg_mean, {plain_round('sum(n)', 4)} AS neg_sum FROM a GROUP BY 1"""))
def d12(spark, d):
    out = ag.tone_scorecard(scored_news(spark, d).withColumnRenamed("combined_sentiment_compound", "compound"))
    return rounded(out, "weighted_sentiment", "composite_sentiment")


@query("d13_symbol_breakdown", sql(f"""SELECT *, CASE WHEN Avg_Sentiment > 0.2 THEN 'Very Positive' WHEN Avg_Sentiment > 0.05 THEN 'Positive' WHEN Avg_Sentiment < -0.2 THEN 'Very Negative' WHEN Avg_Sentiment < -0.05 THEN 'Negative' ELSE 'Neutral' END AS Interpretation
    FROM g""", "scored", a=_score, g=f"SELECT Symbol, {r('avg(c)', 3)} AS Avg_Sentiment, {r('stddev_samp(c)', 3)} AS Volatility, count(*) AS Article_Count, {r('avg(p)', 3)} AS Positive_Score, {r('avg(n)', 3)} AS Negative_Score FROM a GROUP BY 1"))
def d13(spark, d):
    from riskloom.operators.scoring import verbal_level

    c = F.col("combined_sentiment_compound")
    aggs = {"Avg_Sentiment": F.avg(c), "Volatility": F.stddev_samp(c), "Positive_Score": F.avg(F.greatest(c, F.lit(0.0))), "Negative_Score": F.avg(F.greatest(-c, F.lit(0.0)))}
    out = ag.summarise(scored_news(spark, d), {**{k: rnd(v, 3) for k, v in aggs.items()}, "Article_Count": F.count(F.lit(1))}, ["Symbol"])
    return out.withColumn("Interpretation", verbal_level(F.col("Avg_Sentiment")))


@query("d14_scenario_timeline", sql(f"SELECT Date, {r('avg(Risk_Probability)')} AS Risk_Probability, {r('avg(dd)')} AS Drawdown, {r('avg(Risk_Label)')} AS Warning_Rate, {r('least(avg(dd), 0)')} AS Drawdown_pct FROM a GROUP BY 1", "pred",
    a=f"SELECT *, Close / nullif(max(Close) OVER {win('UNBOUNDED PRECEDING')}, 0) - 1 AS dd FROM pred WHERE Date BETWEEN DATE '1998-08-01' AND DATE '1999-10-31'"))
def d14(spark, d):
    p = predictions(spark, d).where(F.col("Date").between("1998-08-01", "1999-10-31"))
    return rounded(ag.scenario_timeline(ind.drawdown(p)), "Risk_Probability", "Drawdown", "Warning_Rate", "Drawdown_pct")


@query("d15_daily_regime_table", sql(f"SELECT Date, {r('avg(Returns)')} AS Market_Return, {r('stddev_samp(Returns)')} AS Market_Volatility, {r('avg(Risk_Label)')} AS risk_share, {r('avg(nm)')} AS tone FROM labelled LEFT JOIN dailynews USING (Symbol, Date) GROUP BY 1", "labelled", "dailynews"))
def d15(spark, d):
    p = labelled(spark, d).join(tone.daily_news(scored_news(spark, d)).select(*KEY, "news_sentiment_mean"), KEY, "left")
    out = lab.market_daily(p, extra={"risk_share": F.avg("Risk_Label"), "tone": F.avg("news_sentiment_mean")})
    return rounded(out, "Market_Return", "Market_Volatility", "risk_share", "tone")


@query("d16_window_statistics", sql(f"SELECT Symbol, Date, {r('avg(Returns) OVER ' + last(20))} AS return_mean, {r('coalesce(stddev_samp(Returns) OVER ' + last(20) + ', 0)')} AS return_std, {r('min(Returns) OVER ' + last(20))} AS return_min, {r('max(Returns) OVER ' + last(20))} AS return_max FROM ret", "ret"))
def d16(spark, d):
    return rounded(ind.window_statistics(panel_returns(spark, d)), "return_mean", "return_std", "return_min", "return_max").select(*KEY, "return_mean", "return_std", "return_min", "return_max")


@query("d17_missing_ranking", sql("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS total, {r(f'(count(*) - count({c}))::DOUBLE / count(*)')} AS missing_rate FROM g" for c in ("Symbol", "Date", "Close", "Volume", "Returns")) + ")",
    "gappy", g=f"SELECT Symbol, Date, Close, Volume, Close / nullif(lag(Close) OVER ({W}), 0) - 1 AS Returns FROM gappy"))
def d17(spark, d):
    g = ind.returns(gappy_panel(spark, d).select(*KEY, "Close", "Volume"))
    return rounded(ag.missing_ranking(g), "missing_rate")


@query("d17_describe", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, {r(f'avg({c})', 5)} AS mean, {r(f'stddev_samp({c})', 5)} AS std, {r(f'min({c})')} AS min, {r(f'max({c})')} AS max FROM gappy" for c in ("Close", "Volume")), "gappy"))
def d17b(spark, d):
    out = ag.describe_numeric(gappy_panel(spark, d).select(*KEY, "Close", "Volume"))
    return rounded(rounded(out, "mean", "std", digits=5), "min", "max")


@query("d18_completeness", sql(f"""SELECT count(*) AS records, {r('100 - (count(Close) + count(Returns) + count(Risk_Label) + count(Risk_Probability)) * 100.0::DOUBLE / (count(*) * 4)')} AS missing_pct,
    {r('count(*) FILTER (Close IS NOT NULL AND Returns IS NOT NULL) * 100.0::DOUBLE / count(*)')} AS complete_pct, count(*) FILTER (Risk_Probability > 0.8) AS high_confidence,
    count(*) FILTER (Risk_Probability BETWEEN 0.4 AND 0.8) AS medium_confidence, count(*) FILTER (Risk_Probability < 0.4) AS low_confidence, {r('avg(Risk_Label) * 100')} AS high_risk_pct, {r('avg(Risk_Probability)')} AS avg_probability FROM pred""", "pred"))
def d18(spark, d):
    out = ag.completeness(predictions(spark, d).select("Close", "Returns", "Risk_Label", "Risk_Probability"), "Risk_Label", "Risk_Probability")
    return rounded(out, "missing_pct", "complete_pct", "high_risk_pct", "avg_probability")


@query("d19_label_distribution", sql(f"SELECT Risk_Label, count(*) AS days, {r('count(*)::DOUBLE / (SELECT count(*) FROM labelled)')} AS share FROM labelled GROUP BY 1", "labelled"))
def d19(spark, d):
    return rounded(ag.label_distribution(labelled(spark, d)), "share")


@query("d19_recent_versus_all", sql(f"SELECT {r('avg(Risk_Label)')} AS recent_risk, count(*) FILTER (Risk_Label = 1) AS recent_risky_rows, {r('any_value(o)')} AS overall_risk FROM (SELECT *, (SELECT avg(Risk_Label) FROM labelled) AS o FROM labelled ORDER BY Date DESC, Symbol DESC LIMIT 30)", "labelled"))
def d19b(spark, d):
    return rounded(ag.recent_versus_all(labelled(spark, d)), "recent_risk", "overall_risk")


@query("d20_numeric_means", sql(f"SELECT Symbol, published_date AS Date, {r('avg(tc)')} AS title_sentiment_compound, {r('avg(dc)')} AS description_sentiment_compound, {r('avg(cc)')} AS combined_sentiment_compound FROM scored GROUP BY 1, 2", "scored"))
def d20(spark, d):
    cols = [f"{n}_sentiment_compound" for n in ("title", "description", "combined")]
    return rounded(ag.numeric_means(scored_news(spark, d).withColumnRenamed("published_date", "Date"), cols=cols), *cols)


_pairs = [("Close", "Volume"), ("Close", "Returns"), ("Volume", "Returns")]


@query("d21_correlation_pairs", sql(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS corr FROM ret" for a, b in _pairs), "ret"))
def d21(spark, d):
    return rounded(ag.correlation_pairs(panel_returns(spark, d), ["Close", "Volume", "Returns"]), "corr")


@query("d22_label_correlations", sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'abs(corr({c}, Risk_Label))')} AS importance FROM labelled" for c in ("Open", "High", "Low", "Close", "Volume", "Returns")), "labelled"))
def d22(spark, d):
    return rounded(ag.label_correlations(labelled(spark, d), ["Open", "High", "Low", "Close", "Volume", "Returns"]), "importance")


@query("d23_histogram", sql("SELECT CAST(least(floor((cc + 1) / ((1.0::DOUBLE + 1) / 50)), 49) AS INTEGER) AS bin, count(*) AS n FROM scored WHERE cc BETWEEN -1 AND 1 GROUP BY 1", "scored"))
def d23(spark, d):
    return ag.histogram(scored_news(spark, d), "combined_sentiment_compound", -1.0, 1.0, 50)


@query("d23_quartiles_and_trend", sql(f"SELECT {r('quantile_cont(nm, 0.25)')} AS q1, {r('quantile_cont(nm, 0.5)')} AS median, {r('quantile_cont(nm, 0.75)')} AS q3, {r('regr_slope(Returns, nm)')} AS slope, {r('regr_intercept(Returns, nm)')} AS intercept FROM newspanel", "ret", "dailynews", **NEWS_JOIN))
def d23b(spark, d):
    p = news_panel(spark, d)
    q = ag.quartiles(p, "news_sentiment_mean")
    line = ag.trend_line(p, "news_sentiment_mean", "Returns")
    out = q.withColumn("l", line.select(F.struct("slope", "intercept")).scalar()).select("q1", "median", "q3", "l.slope", "l.intercept")
    return rounded(out, *out.columns)


@query("d24_monitor_summary", sql(f"""SELECT s.Symbol, {plain_round('coalesce(m, 0)', 3)} AS average_sentiment, coalesce(n, 0) AS article_count,
    CASE WHEN m IS NULL THEN 'No Data' WHEN m > 0.05 THEN 'Positive' WHEN m < -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment_label,
    CASE WHEN m IS NULL THEN 'Unknown' WHEN m < -0.2 THEN 'High' WHEN m > 0.2 THEN 'Low' ELSE 'Medium' END AS risk_indicator
    FROM (SELECT DISTINCT p_brand AS Symbol FROM part UNION ALL SELECT 'Nobody') s LEFT JOIN (SELECT Symbol, avg(cc) AS m, count(cc) AS n FROM scored GROUP BY 1) USING (Symbol)""", "scored"))
def d24(spark, d):
    wanted = table(spark, d, "part").select(F.col("p_brand").alias("Symbol")).distinct().unionByName(spark.createDataFrame([("Nobody",)], "Symbol string"))
    return ag.monitor_summary(scored_news(spark, d), wanted, "combined_sentiment_compound")


@query("d25_mean_vectors", sql(f"SELECT Symbol, Date, any_value(k) AS article_count, {r('sum(m)', 5)} AS vector_sum, {r('max(m)', 5)} AS vector_max FROM g GROUP BY 1, 2", "vectors",
    u="SELECT Symbol, Date, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM vectors", g="SELECT Symbol, Date, i, avg(x) AS m, count(*) AS k FROM u GROUP BY 1, 2, 3"))
def d25(spark, d):
    v = ag.mean_vectors(vectors(spark, d))
    total = F.aggregate("mean_vector", F.lit(0.0), lambda a, x: a + x)
    return v.select(*KEY, "article_count", rnd(total, 5).alias("vector_sum"), rnd(F.array_max("mean_vector"), 5).alias("vector_max"))


@query("d26_run_comparison", sql(f"""SELECT metric, arg_max(model, (value, model)) AS best_model, {r('max(value)')} AS best_value, {r('avg(value)')} AS mean_value FROM u GROUP BY 1""", "pred",
    u=" UNION ALL ".join(f"SELECT '{m}' AS model, 'brier' AS metric, avg(pow({c} - Risk_Label, 2)) AS value FROM pred UNION ALL SELECT '{m}', 'mean', avg({c}) FROM pred" for m, c in (("a", "Risk_Probability"), ("b", "prob_b"), ("c", "prob_c")))))
def d26(spark, d):
    p = predictions(spark, d)
    one = p.agg(*[F.struct(F.lit(m).alias("model"), F.avg(F.pow(F.col(c) - F.col("Risk_Label"), 2)).alias("brier"), F.avg(c).alias("mean")).alias(m) for m, c in (("a", "Risk_Probability"), ("b", "prob_b"), ("c", "prob_c"))])
    runs = one.select(F.inline(F.array("a", "b", "c")))
    long, best = ag.run_comparison(runs, ["brier", "mean"])
    means = long.groupBy("metric").agg(F.avg("value").alias("mean_value"))
    return rounded(best.join(means, "metric"), "best_value", "mean_value")
