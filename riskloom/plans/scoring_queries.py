"""Section G (rules part): calendar, cross-source flags, composite score and fusion; and the enhanced chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import tone
from riskloom.operators import aggregates as ag
from riskloom.operators import indicators as ind
from riskloom.operators import joins as jn
from riskloom.operators import scoring as sc
from riskloom.plans.aggregate_queries import _score
from riskloom.plans.fixtures import (
    ELEMENTS, VECTOR_MEANS, change, full, fundamentals, labelled, last, panel, panel_returns, plain_round, predictions, r, rnd, scored_filings, scored_news, sql, table, vector_means, win,
)
from riskloom.plans.join_queries import LATEST_FILING, NEWS_JOIN, news_panel
from riskloom.plans.registry import query
from riskloom.session import checkpoint

KEY = ["Symbol", "Date"]


@query("a5_fundamentals", sql("SELECT Symbol, Date, Close, CASE WHEN Symbol <> 'Brand#3' THEN PE_Ratio END AS PE_Ratio, Beta, Market_Cap FROM panel LEFT JOIN fund USING (Symbol)", "panel", "fund"))
def a5(spark, d):
    raw = fundamentals(spark, d).withColumn("PE_Ratio", F.when(F.col("Symbol") == "Brand#3", "n/a").otherwise(F.col("PE_Ratio").cast("string")))
    dim = raw.withColumn("PE_Ratio", F.expr("try_cast(PE_Ratio as double)"))
    return panel(spark, d).select(*KEY, "Close").join(dim, "Symbol", "left")


@query("g15_date_parts", sql("""SELECT Symbol, Date, CAST(year(Date) AS INTEGER) AS year, CAST(month(Date) AS INTEGER) AS month, CAST(quarter(Date) AS INTEGER) AS quarter, CAST(dayofyear(Date) AS INTEGER) AS day_of_year,
    CAST(weekofyear(Date) AS INTEGER) AS week_of_year, CAST(isodow(Date) - 1 AS INTEGER) AS day_of_week, CASE WHEN Date = last_day(Date) THEN 1 ELSE 0 END AS is_month_end,
    CASE WHEN Date = last_day(Date) AND month(Date) % 3 = 0 THEN 1 ELSE 0 END AS is_quarter_end FROM panel""", "panel"))
def g15(spark, d):
    return sc.date_parts(panel(spark, d).select(*KEY))


@query("g16_calendar_flags", sql("""SELECT Symbol, Date, CASE WHEN isodow(Date) = 1 THEN 1 ELSE 0 END AS is_monday, CASE WHEN isodow(Date) = 5 THEN 1 ELSE 0 END AS is_friday, CASE WHEN month(Date) = 1 THEN 1 ELSE 0 END AS is_january,
    CASE WHEN month(Date) = 12 THEN 1 ELSE 0 END AS is_december, CASE WHEN month(Date) IN (1, 4, 7, 10) THEN 1 ELSE 0 END AS earnings_season, CAST(last_day(Date) - Date AS INTEGER) AS days_to_month_end,
    CASE WHEN last_day(Date) - Date <= 3 THEN 1 ELSE 0 END AS end_of_month FROM panel""", "panel"))
def g16(spark, d):
    return sc.calendar_flags(panel(spark, d).select(*KEY))


CROSS = dict(
    lf=LATEST_FILING,
    cs=f"""SELECT n.*, {full('stddev_samp(Returns)', 'Returns', 20)} * sqrt(252.0::DOUBLE) AS vol20, f.m AS mda FROM newspanel n ASOF LEFT JOIN lf f ON n.Symbol = f.Symbol AND n.Date >= f.Date""".replace("PARTITION BY Symbol ORDER BY Date", "PARTITION BY n.Symbol ORDER BY n.Date"),
    cp="SELECT cs.*, PE_Ratio FROM cs LEFT JOIN fund USING (Symbol)",
    pm="SELECT quantile_cont(PE_Ratio, 0.5) AS pm FROM cp",
)


def cross_panel(spark, d):
    f = scored_filings(spark, d).select("Symbol", F.col("filing_date").alias("Date"), "page_id", "mda_sentiment")
    p = ind.volatility(news_panel(spark, d), spans=(20,))
    p = jn.asof_backward(p, f, ["page_id", "mda_sentiment"], tie=["page_id"])
    return p.join(fundamentals(spark, d), "Symbol", "left")


@query("g17_cross_source_flags", sql(f"""SELECT Symbol, Date, CASE WHEN nm > 0 AND Returns < 0 THEN 1 ELSE 0 END + CASE WHEN nm < 0 AND Returns > 0 THEN 1 ELSE 0 END AS sentiment_price_divergence,
    {r('nc / (vol20 + 1e-6)')} AS news_volatility_ratio, CASE WHEN PE_Ratio > pm AND nm < -0.1 THEN 1 ELSE 0 END AS pe_sentiment_risk, {r('abs(mda - nm)')} AS sec_news_sentiment_diff,
    CASE WHEN abs(mda - nm) < 0.2 THEN 1 ELSE 0 END AS sentiment_alignment FROM cp, pm""", "ret", "dailynews", "secscored", "fund", **NEWS_JOIN, **CROSS))
def g17(spark, d):
    out = sc.cross_source_flags(cross_panel(spark, d).withColumn("Price_Change_1d", F.col("Returns")))
    return out.select(*KEY, "sentiment_price_divergence", rnd("news_volatility_ratio").alias("news_volatility_ratio"), "pe_sentiment_risk", rnd("sec_news_sentiment_diff").alias("sec_news_sentiment_diff"), "sentiment_alignment")


@query("g18_price_ratios", sql("SELECT Symbol, Date, High / nullif(Low, 0) AS High_Low_Ratio, Close / nullif(High, 0) AS Close_to_High, Close / nullif(Volume, 0) AS PB_Ratio FROM panel", "panel"))
def g18(spark, d):
    return sc.price_ratios(panel(spark, d), book="Volume").select(*KEY, "High_Low_Ratio", "Close_to_High", "PB_Ratio")


@query("g19_weighted_tone", sql(f"SELECT Symbol, Date, {r('0.7 * nm + 0.3 * mda')} AS combined_sentiment_weighted, {r('abs(nm - mda)')} AS sentiment_divergence FROM cs", "ret", "dailynews", "secscored", **NEWS_JOIN, lf=CROSS["lf"], cs=CROSS["cs"]))
def g19(spark, d):
    out = sc.weighted_tone(cross_panel(spark, d), "news_sentiment_mean", "mda_sentiment")
    return out.select(*KEY, rnd("combined_sentiment_weighted").alias("combined_sentiment_weighted"), rnd("sentiment_divergence").alias("sentiment_divergence"))


def enhanced_chain(spark, d):
    """The full enhanced feature chain: tone, technical, regime and market features, then the score.

    The joined panel is stored before the chain, which reads it twice (rows and day means): trades and texts are read once. Series are
    dealt to tasks by hand, as their bytes are few and their windows costly: left to the planner they are merged to one task.
    """
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    p = checkpoint(cross_panel(spark, d)).repartition(tasks, "Symbol")
    p = sc.weighted_tone(p, "news_sentiment_mean", "mda_sentiment")
    p = ind.tone_momentum(p, "news_sentiment_mean")
    p = ind.tone_spread(p, "news_sentiment_mean")
    p = ind.tone_extremes(p, "news_sentiment_mean")
    p = ind.parkinson(p)
    p = ind.acceleration(p)
    p = ind.support_resistance(p)
    p = ind.on_balance_volume(p)
    p = ind.vwap(p)
    p = ind.trend_strength(p)
    p = ind.sma_stack(p)
    p = ind.volatility_rank(p)
    p = ind.relative_tone(p, "news_sentiment_mean")
    return sc.composite_risk(sc.calendar_flags(p))


_pk = "(CASE WHEN count(sq) OVER {w} >= 20 THEN avg(sq) OVER {w} END)".format(w=last(20))
ENHANCED = dict(
    x1=f"""SELECT *, abs(nm - mda) AS dv, {change('nm')} AS mo, {full('quantile_cont(nm, 0.1)', 'nm', 30)} AS qlo, pow(ln(High / nullif(Low, 0)), 2) AS sq, {change('Returns')} AS pa,
      {full('min(Low)', 'Low', 20)} AS lo20, {full('avg(Close)', 'Close', 20)} AS s20, {full('avg(Close)', 'Close', 50)} AS s50, {full('avg(Close)', 'Close', 200)} AS s200,
      {full('stddev_samp(Returns)', 'Returns', 20)} AS v, Close * Volume AS pv, avg(nm) OVER (PARTITION BY Date) AS mt FROM cs""",
    x2=f"""SELECT *, sqrt(252 * {_pk}) AS park, {full('sum(pv)', 'pv', 20)} / nullif({full('sum(Volume)', 'Volume', 20)}, 0) AS vw,
      CASE WHEN count(v) OVER {last(60)} >= 60 THEN list(v) OVER {last(60)} END AS vs FROM x1""",
    x3="SELECT *, (len(list_filter(vs, lambda x: x < v)) + (len(list_filter(vs, lambda x: x = v)) + 1) / 2.0::DOUBLE) / 60 AS rk FROM x2",
    xq="SELECT quantile_cont(dv, 0.8) AS q80, quantile_cont(park, 0.9) AS q90 FROM x3",
    xs="""SELECT *, 0.3::DOUBLE * (CASE WHEN nm < qlo THEN 1 ELSE 0 END) + 0.2::DOUBLE * (CASE WHEN dv > q80 THEN 1 ELSE 0 END) + 0.3::DOUBLE * (CASE WHEN mo < -0.1 THEN 1 ELSE 0 END) + 0.2::DOUBLE * (CASE WHEN nm - mt < -0.2 THEN 1 ELSE 0 END) AS rs,
      0.3::DOUBLE * (CASE WHEN Close / nullif(lo20, 0) < 1.02 THEN 1 ELSE 0 END) + 0.4::DOUBLE * (CASE WHEN s20 < s50 AND s50 < s200 THEN 1 ELSE 0 END) + 0.3::DOUBLE * (CASE WHEN pa < -0.01 THEN 1 ELSE 0 END) AS rt,
      0.5::DOUBLE * (CASE WHEN rk > 0.8 THEN 1 ELSE 0 END) + 0.5::DOUBLE * (CASE WHEN park > q90 THEN 1 ELSE 0 END) AS rv,
      0.5::DOUBLE * (CASE WHEN abs((Close - vw) / nullif(vw, 0)) > 0.05 THEN 1 ELSE 0 END) AS ru FROM x3, xq""",
    enhanced="SELECT *, least(greatest(0.3 * rs + 0.3 * rt + 0.25 * rv + 0.15 * ru, 0), 1) AS composite FROM xs",
)


def enhanced_sql(body: str) -> str:
    return sql(body, "ret", "dailynews", "secscored", **NEWS_JOIN, lf=CROSS["lf"], cs=CROSS["cs"], **ENHANCED)


@query("g20_composite_risk", enhanced_sql(f"SELECT Symbol, Date, {r('rs', 4)} AS sentiment_risk_score, {r('rt', 4)} AS technical_risk_score, {r('rv', 4)} AS volatility_risk_score, {r('ru', 4)} AS volume_risk_score, {r('composite', 4)} AS composite_risk_score FROM enhanced"))
def g20(spark, d):
    cols = [f"{p}_risk_score" for p in ("sentiment", "technical", "volatility", "volume", "composite")]
    return enhanced_chain(spark, d).select(*KEY, *[rnd(c, 4).alias(c) for c in cols])


@query("g21_sigmoid_risk", sql(f"SELECT Symbol, Date, {r('coalesce((sm + nm) / 2, sm, nm)')} AS Combined_Sentiment, {r('1 / (1 + exp(3.5 * least(greatest(coalesce((sm + nm) / 2, sm, nm), -1), 1)))', 3)} AS Risk_Probability FROM dailynews FULL JOIN dailysec USING (Symbol, Date)", "dailynews", "dailysec"))
def g21(spark, d):
    n, f = tone.daily_news(scored_news(spark, d)), tone.daily_filings(scored_filings(spark, d))
    j = n.join(f, KEY, "full").withColumn("c", sc.combined_tone(F.col("sec_mda_sentiment"), F.col("news_sentiment_mean")))
    return j.select(*KEY, rnd("c").alias("Combined_Sentiment"), rnd(sc.sigmoid_risk(F.col("c")), 3).alias("Risk_Probability"))


@query("g22_bucket_rules", sql("""SELECT Symbol, Date, CASE WHEN p > 0.8 THEN 'Very High' WHEN p > 0.6 THEN 'High' WHEN p > 0.4 THEN 'Medium' WHEN p > 0.2 THEN 'Low' ELSE 'Very Low' END AS risk_level,
    CASE WHEN t > 0.2 THEN 'Positive' WHEN t > 0.05 THEN 'Slightly Positive' WHEN t > -0.05 THEN 'Neutral' WHEN t > -0.2 THEN 'Slightly Negative' ELSE 'Negative' END AS tone_level,
    CASE WHEN t > 0.3 THEN 'Strongly Positive' WHEN t > 0.1 THEN 'Moderately Positive' WHEN t > -0.1 THEN 'Neutral' WHEN t > -0.3 THEN 'Moderately Negative' ELSE 'Strongly Negative' END AS user_level
    FROM (SELECT Symbol, Date, Risk_Probability AS p, prob_b - prob_c AS t FROM pred)""", "pred"))
def g22(spark, d):
    t, p = F.col("prob_b") - F.col("prob_c"), F.col("Risk_Probability")
    return predictions(spark, d).select(*KEY, sc.risk_level(p).alias("risk_level"), sc.tone_level(t).alias("tone_level"), sc.user_level(t).alias("user_level"))


@query("g23_model_tone_features", sql(f"""SELECT Symbol, Date, {r('compound_mean')} AS sentiment_compound, {r('abs(compound_mean)')} AS sentiment_strength, {r('pos_mean - neg_mean')} AS sentiment_bias, {r('ln(1 + n)')} AS news_coverage,
    CASE WHEN compound_mean < -0.1 THEN 1 ELSE 0 END AS sentiment_risk_binary, CASE WHEN compound_mean > 0.2 THEN 1 ELSE 0 END AS sentiment_opportunity, {r('compound_mean * n')} AS sentiment_momentum,
    {r('compound_mean * Close')} AS sentiment_price_interaction, {r('compound_mean * Volume')} AS sentiment_volume_interaction FROM panel JOIN g USING (Symbol)""", "panel", "scored", a=_score,
    g=f"SELECT Symbol, {plain_round('avg(c)', 4)} AS compound_mean, count(c) AS n, {plain_round('avg(p)', 4)} AS pos_mean, {plain_round('avg(n)', 4)} AS neg_mean FROM a GROUP BY 1"))
def g23(spark, d):
    score = ag.tone_scorecard(scored_news(spark, d).withColumnRenamed("combined_sentiment_compound", "compound"))
    out = sc.interactions(jn.attach_by_symbol(panel(spark, d).select(*KEY, "Close", "Volume"), sc.model_tone_features(score)))
    floats = ["sentiment_compound", "sentiment_strength", "sentiment_bias", "news_coverage", "sentiment_momentum", "sentiment_price_interaction", "sentiment_volume_interaction"]
    return out.select(*KEY, *[rnd(c).alias(c) for c in floats], "sentiment_risk_binary", "sentiment_opportunity")


@query("g24_concat_fusion", sql("SELECT Symbol, Date, " + ", ".join(f"coalesce({r(e)}, 0) AS {e}" for e in ELEMENTS) + " FROM panel LEFT JOIN v USING (Symbol, Date)", "panel", "vectors", v=VECTOR_MEANS))
def g24(spark, d):
    text = vector_means(spark, d).withColumn("Volume", F.lit(1.0))
    out = sc.concat_fusion(panel(spark, d).select(*KEY, "Close", "Volume"), text)
    return out.select(*KEY, *[rnd(e).alias(e) for e in ELEMENTS])


@query("g25_gated_fusion", sql(f"""SELECT Symbol, Date, {r('g')} AS fusion_gate, {r('rt * g')} AS gated_tab_Returns, {r('vl * g', 4)} AS gated_tab_Volume, {', '.join(f"{r(f'{e} * (1 - g)')} AS gated_text_{e}" for e in ELEMENTS)} FROM b""", "ret", "vectors", v=VECTOR_MEANS,
    a="SELECT Symbol, Date, coalesce(Returns, 0) AS rt, coalesce(Volume, 0) AS vl, " + ", ".join(f"coalesce({e}, 0) AS {e}" for e in ELEMENTS) + " FROM ret LEFT JOIN v USING (Symbol, Date)",
    b="SELECT *, sqrt(rt * rt + vl * vl) / (sqrt(rt * rt + vl * vl) + sqrt(" + " + ".join(f"{e} * {e}" for e in ELEMENTS) + ") + 1e-6) AS g FROM a"))
def g25(spark, d):
    out = sc.gated_fusion(panel_returns(spark, d).select(*KEY, "Returns", "Volume"), vector_means(spark, d))
    return out.select(*KEY, rnd("gated_tab_Volume", 4).alias("gated_tab_Volume"), *[rnd(c).alias(c) for c in ("fusion_gate", "gated_tab_Returns", *(f"gated_text_{e}" for e in ELEMENTS))])


@query("g26_binary_entropy", sql(f"SELECT Symbol, Date, {r('-(q * ln(q) + (1 - q) * ln(1 - q))')} AS entropy FROM (SELECT *, least(greatest(Risk_Probability, 1e-6), 1 - 1e-6) AS q FROM pred)", "pred"))
def g26(spark, d):
    return predictions(spark, d).select(*KEY, rnd(sc.binary_entropy(F.col("Risk_Probability"))).alias("entropy"))


@query("h24_risk_summary", enhanced_sql(f"""SELECT Symbol, Date, Close, {r('composite', 4)} AS composite_risk_score, {r('rs', 4)} AS sentiment_risk_score, {r('rt', 4)} AS technical_risk_score, {r('nm')} AS news_sentiment_mean
    FROM enhanced QUALIFY row_number() OVER (PARTITION BY Symbol ORDER BY Date DESC) = 1"""))
def h24(spark, d):
    from riskloom.operators.clean import latest_per_group

    e = enhanced_chain(spark, d).select(*KEY, "Close", rnd("composite_risk_score", 4).alias("composite_risk_score"), rnd("sentiment_risk_score", 4).alias("sentiment_risk_score"),
                                        rnd("technical_risk_score", 4).alias("technical_risk_score"), rnd("news_sentiment_mean").alias("news_sentiment_mean"))
    return latest_per_group(e, "Symbol", "Date")
