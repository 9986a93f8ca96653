"""Sections B and F: filters, null handling, projections, sorts and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.series import SYMBOL_DAY
from riskloom.operators import clean as cl
from riskloom.operators import indicators as ind
from riskloom.operators import labels as lab
from riskloom.plans.fixtures import W, full, fundamentals, gappy_panel, labelled, news, panel, panel_returns, predictions, r, rnd, scored_news, sql, table, win
from riskloom.plans.registry import query

KEY = ["Symbol", "Date"]


@query("b1_normalise_datetime", """SELECT event_id, date_trunc('second', ts) - CASE WHEN event_id % 4 = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS ts
    FROM events WHERE event_id % 4 <> 3""")
def b1(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    n = F.col("event_id") % 4
    raw = F.when(n == 0, text).when(n == 1, F.concat(text, F.lit("+02:00"))).when(n == 2, F.concat(text, F.lit("Z"))).otherwise("not a date")
    return cl.normalise_datetime(table(spark, d, "events").select("event_id", raw.alias("ts")), "ts")


@query("b2_date_range", sql("SELECT Symbol, Date, Close FROM panel WHERE Date BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'", "panel"))
def b2(spark, d):
    return cl.date_range(panel(spark, d), "1996-03-01", "1997-02-28").select(*KEY, "Close")


@query("b3_only_symbols", sql("SELECT 'hit' AS kind, Symbol, Date FROM panel WHERE Symbol IN ('Brand#1', 'Brand#7') UNION ALL SELECT 'fallback', Symbol, Date FROM panel", "panel"))
def b3(spark, d):
    p = panel(spark, d)
    hit, none = cl.only_symbols(p, ["Brand#1", "Brand#7", "Nobody"]), cl.only_symbols(p, ["Nobody"])
    return hit.select(F.lit("hit").alias("kind"), *KEY).unionByName(none.select(F.lit("fallback").alias("kind"), *KEY))


def _sparse(df):
    n = F.dayofmonth("Date")
    return df.withColumns({"mostly_null": F.when(n % 3 == 0, F.col("Close")), "mostly_set": F.when(n % 3 != 0, F.col("Close"))})


@query("b4_drop_sparse", sql("SELECT Symbol, Date, Close, CASE WHEN day(Date) % 3 <> 0 THEN Close END AS mostly_set FROM panel", "panel"))
def b4(spark, d):
    return cl.drop_sparse_columns(_sparse(panel(spark, d).select(*KEY, "Close")), 0.5)


@query("b5_infinities_and_zero_fill", sql(f"""SELECT Symbol, Date, Close, coalesce(CASE WHEN Volume % 10 <> 0 THEN Close / Volume END, 0) AS close_ratio,
    CASE WHEN Volume % 10 <> 0 THEN Close END AS other FROM panel""", "panel"))
def b5(spark, d):
    odd = F.col("Volume") % 10 == 0
    p = panel(spark, d).select(*KEY, "Close", F.when(odd, float("inf")).otherwise(F.col("Close") / F.col("Volume")).alias("close_ratio"),
                               F.when(odd, float("-inf")).otherwise(F.col("Close")).alias("other"))
    return cl.zero_fill_by_name(cl.clear_infinities(p))


@query("b6_median_fill", sql("SELECT Symbol, Date, coalesce(Close, m) AS Close, coalesce(Volume, v) AS Volume FROM gappy, q", "gappy",
                             q="SELECT quantile_cont(Close, 0.5) m, quantile_cont(Volume, 0.5) v FROM gappy"))
def b6(spark, d):
    return cl.median_fill(gappy_panel(spark, d), ["Close", "Volume"]).select(*KEY, "Close", "Volume")


@query("b7_neutral_fill", sql(f"SELECT Symbol, Date, coalesce(nc, 0) AS news_count, coalesce({r('nm')}, 0) AS news_sentiment_mean FROM panel LEFT JOIN dailynews USING (Symbol, Date)", "panel", "dailynews"))
def b7(spark, d):
    from riskloom.functions.tone import daily_news

    n = daily_news(scored_news(spark, d)).select(*KEY, "news_count", rnd("news_sentiment_mean").alias("news_sentiment_mean"))
    return cl.neutral_fill(panel(spark, d).select(*KEY).join(n, KEY, "left"))


FF = "last_value({c} IGNORE NULLS) OVER " + win("UNBOUNDED PRECEDING")
BF = "first_value({c} IGNORE NULLS) OVER " + win("CURRENT ROW", "UNBOUNDED FOLLOWING")


@query("b8_fill_both_ways", sql(f"SELECT Symbol, Date, coalesce({FF.format(c='Close')}, {BF.format(c='Close')}) AS Close, coalesce({FF.format(c='Volume')}, {BF.format(c='Volume')}) AS Volume FROM gappy", "gappy"))
def b8(spark, d):
    return cl.fill_both_ways(gappy_panel(spark, d), ["Close", "Volume"]).select(*KEY, "Close", "Volume")


@query("b9_interpolate", sql(f"SELECT Symbol, Date, {r('coalesce(Close, p.v + (q.v - p.v) * ((n - p.n)::DOUBLE / nullif(q.n - p.n, 0)), p.v)', 8)} AS Close FROM b", "gappy",
    a=f"SELECT *, row_number() OVER ({W}) AS n FROM gappy",
    a2="SELECT *, CASE WHEN Close IS NOT NULL THEN {'n': n, 'v': Close} END AS k FROM a",
    b=f"SELECT *, {FF.format(c='k')} AS p, {BF.format(c='k')} AS q FROM a2"))
def b9(spark, d):
    return cl.interpolate(gappy_panel(spark, d), ["Close"]).select(*KEY, rnd("Close", 8).alias("Close"))


@query("b10_winsorise", sql("SELECT Symbol, Date, least(greatest(Close, lo), hi) AS Close FROM panel, q", "panel",
                            q="SELECT quantile_cont(Close, 0.01) lo, quantile_cont(Close, 0.99) hi FROM panel"))
def b10(spark, d):
    return cl.winsorise(panel(spark, d), ["Close"]).select(*KEY, "Close")


@query("b11_select_features", sql("SELECT Open, High, Low, Close, Volume FROM labelled", "labelled"))
def b11(spark, d):
    df = labelled(spark, d).drop("Future_Return", "Future_Volatility", "Returns")
    return df.select(*cl.select_features(df))


@query("b12_ablate", sql("SELECT Symbol, Date, Close FROM panel WHERE Symbol IN ('Brand#2', 'Brand#3')", "panel"))
def b12(spark, d):
    return cl.ablate(panel(spark, d), drop=["Volume"], keep=["Symbol", "Date", "Close", "Volume"], where={"Symbol": ["Brand#2", "Brand#3"]})


@query("b14_choose_probability", sql(f"""SELECT 'score' AS kind, Symbol, Date, Risk_Probability FROM pred
    UNION ALL SELECT 'label', Symbol, Date, {r('avg(Risk_Label) OVER ' + win('2 PRECEDING'))} FROM pred""", "pred"))
def b14(spark, d):
    p = predictions(spark, d)
    scored = cl.choose_probability(p.withColumnRenamed("Risk_Probability", "Risk_Probability_x").drop("Risk_Score"))
    smooth = cl.choose_probability(p.drop("Risk_Probability", "Risk_Score"))
    return scored.select(F.lit("score").alias("kind"), *KEY, "Risk_Probability").unionByName(
        smooth.select(F.lit("label").alias("kind"), *KEY, rnd("Risk_Probability").alias("Risk_Probability")))


@query("b15_align_features", sql("SELECT Close, Volume, 0.0::DOUBLE AS unknown_feature FROM panel", "panel"))
def b15(spark, d):
    return cl.align_features(panel(spark, d), ["Close", "Volume", "unknown_feature"])


@query("b16_bounded_sample", sql("SELECT Symbol, Date, Close FROM panel ORDER BY md5(Symbol || '|' || CAST(Date AS VARCHAR) || '|42'), Symbol, Date LIMIT 300", "panel"))
def b16(spark, d):
    return cl.bounded_sample(panel(spark, d), KEY, 300).select(*KEY, "Close")


@query("b17_canonical_keys", sql("SELECT doc_id, Symbol, published_date AS Date FROM news", "news"))
def b17(spark, d):
    raw = news(spark, d).select("doc_id", F.col("Symbol").alias("symbol"), F.col("published_date").cast("timestamp").alias("published_date"))
    return cl.canonical_keys(raw)


_profile = [("Open", "price_features"), ("High", "price_features"), ("Low", "price_features"), ("Close", "price_features"), ("Returns", "price_features"),
            ("Volume", "volume_features"), ("Volatility_20d", "technical_indicators"), ("news_count", "news_features"), ("year", "date_features"), ("Risk_Label", "other")]


@query("b18_feature_profile", sql("SELECT feature_group, count(*) AS features, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(n) AS BIGINT) AS cells, "
    + r("avg(m)", 5) + " AS mean_level FROM u GROUP BY 1", "labelled",
    p=f"SELECT *, {full('stddev_samp(Returns)', 'Returns', 20)} * sqrt(252.0::DOUBLE) AS Volatility_20d, CASE WHEN Volume > 30 THEN 1 END AS news_count, year(Date) AS year FROM labelled",
    u=" UNION ALL ".join(f"SELECT '{g}' AS feature_group, count(*) AS n, count(*) - count({c}) AS missing, avg({c})::DOUBLE AS m FROM p" for c, g in _profile)))
def b18(spark, d):
    df = ind.volatility(labelled(spark, d).drop("Future_Return", "Future_Volatility", "Risk_Score"), spans=(20,))
    df = df.withColumns({"news_count": F.when(F.col("Volume") > 30, 1), "year": F.year("Date")})
    return cl.feature_profile(df).withColumn("mean_level", rnd("mean_level", 5))


@query("b19_valid_targets", sql("SELECT Symbol, Date, Close, Risk_Label FROM (SELECT *, CASE WHEN Future_Return IS NOT NULL THEN Risk_Label END AS ok FROM labelled) WHERE ok IS NOT NULL", "labelled"))
def b19(spark, d):
    df = lab.label_mean_step(panel_returns(spark, d), tail="null")
    return cl.valid_targets(df.select(*KEY, "Close", "Risk_Label"), "Risk_Label")


@query("e39_latest_row", sql(f"SELECT Symbol, Date, Close, Volume FROM panel QUALIFY row_number() OVER (PARTITION BY Symbol ORDER BY Date DESC) = 1", "panel"))
def e39(spark, d):
    return cl.latest_per_group(panel(spark, d).select(*KEY, "Close", "Volume"), "Symbol", "Date")


@query("e40_densify_days", sql(f"SELECT Symbol, Date, coalesce({FF.format(c='Close')}, {BF.format(c='Close')}) AS Close FROM b", "panel",
    a="SELECT Symbol, CAST(unnest(generate_series(min(Date), max(Date), INTERVAL 1 DAY)) AS DATE) AS Date FROM panel GROUP BY Symbol",
    b="SELECT a.Symbol, a.Date, Close FROM a LEFT JOIN panel USING (Symbol, Date)"))
def e40(spark, d):
    return cl.densify_days(panel(spark, d), ["Close"]).select(*KEY, "Close")


@query("f1_multi_key_sort", sql("SELECT Symbol, Date, Close FROM panel ORDER BY Symbol, Date DESC", "panel"))
def f1(spark, d):
    return panel(spark, d).select(*KEY, "Close").orderBy("Symbol", F.desc("Date"))


@query("f2_top_rows", sql("SELECT Symbol, Date, Close FROM panel ORDER BY Close DESC, Symbol, Date LIMIT 25", "panel"))
def f2(spark, d):
    return cl.head(panel(spark, d).select(*KEY, "Close"), [F.desc("Close"), F.col("Symbol"), F.col("Date")], 25)


@query("f3_dedupe_articles", sql("""SELECT 'title_url' AS kind, min(doc_id) AS doc_id FROM news GROUP BY title, md5(content)
    UNION ALL SELECT 'title_symbol', min(doc_id) FROM news GROUP BY title, Symbol""", "news"))
def f3(spark, d):
    n = news(spark, d).select("doc_id", "title", "Symbol", F.md5(F.col("content").cast("binary")).alias("url"))
    by_url, by_symbol = cl.keep_one(n, ["title", "url"], ["doc_id"]), cl.keep_one(n, ["title", "Symbol"], ["doc_id"])
    return by_url.select(F.lit("title_url").alias("kind"), "doc_id").unionByName(by_symbol.select(F.lit("title_symbol").alias("kind"), "doc_id"))


@query("f4_dedupe_predictions", """SELECT event_type AS Symbol, CAST(ts AS DATE) AS Date, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def f4(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("Symbol"), F.col("ts").cast("date").alias("Date"), "ts", "event_id", "value")
    return cl.keep_one(e, KEY, ["ts", "event_id"], keep="last").select(*KEY, "value")


@query("f8_most_frequent", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 2")
def f8(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(2)


@query("f9_union", sql("SELECT Symbol, Date, Close, Volume FROM panel UNION ALL SELECT Symbol, Date, Close, NULL FROM nations", "panel", "nations"))
def f9(spark, d):
    from riskloom.plans.fixtures import nation_panel

    return panel(spark, d).select(*KEY, "Close", "Volume").unionByName(nation_panel(spark, d), allowMissingColumns=True)


@query("f10_head_and_tail", sql("""SELECT * FROM (SELECT 'head' AS kind, Symbol, Date, Close FROM panel ORDER BY Date, Symbol LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'tail', Symbol, Date, Close FROM panel ORDER BY Date DESC, Symbol DESC LIMIT 10)""", "panel"))
def f10(spark, d):
    p = panel(spark, d).select(*KEY, "Close")
    a = cl.head(p, [F.col("Date"), F.col("Symbol")], 10).select(F.lit("head").alias("kind"), *KEY, "Close")
    z = cl.head(p, [F.desc("Date"), F.desc("Symbol")], 10).select(F.lit("tail").alias("kind"), *KEY, "Close")
    return a.unionByName(z)
