"""Section C: keyed, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import tone
from riskloom.operators import indicators as ind
from riskloom.operators import joins as jn
from riskloom.operators import labels as lab
from riskloom.plans.fixtures import (
    ELEMENTS, VECTOR_MEANS, W, events_catalogue, fundamentals, nation_panel, panel, panel_returns, predictions, r, rnd, scored_filings, scored_news, sql, vector_means, win,
)
from riskloom.plans.registry import query

KEY = ["Symbol", "Date"]
FF = "last_value({c} IGNORE NULLS) OVER " + win("UNBOUNDED PRECEDING")
BF = "first_value({c} IGNORE NULLS) OVER " + win("CURRENT ROW", "UNBOUNDED FOLLOWING")


@query("c1_tone_join", sql(f"SELECT Symbol, Date, {r(FF.format(c='nm'))} AS news_sentiment_mean, {r(FF.format(c='nt'))} AS news_title_sentiment FROM j", "panel", "dailynews",
                           j="SELECT panel.Symbol, panel.Date, nm, nt FROM panel LEFT JOIN dailynews USING (Symbol, Date)"))
def c1(spark, d):
    out = jn.left_then_fill(panel(spark, d).select(*KEY), tone.daily_news(scored_news(spark, d)), ["news_sentiment_mean", "news_title_sentiment"])
    return out.select(*KEY, rnd("news_sentiment_mean").alias("news_sentiment_mean"), rnd("news_title_sentiment").alias("news_title_sentiment"))


NEWS_JOIN = dict(
    nj="SELECT ret.*, nm, ns, nc, ni FROM ret LEFT JOIN dailynews USING (Symbol, Date)",
    newspanel=f"SELECT * EXCLUDE (nm, ns, nc, ni), coalesce(nc, 0) AS nc, coalesce({FF.format(c='nm')}, 0) AS nm, coalesce({FF.format(c='ns')}, 0) AS ns, coalesce({FF.format(c='ni')}, 0) AS ni FROM nj",
)


def news_panel(spark, d):
    return jn.news_features(panel_returns(spark, d), tone.daily_news(scored_news(spark, d)))


@query("c2_news_features", sql(f"SELECT Symbol, Date, nc AS news_count, {r('nm')} AS news_sentiment_mean, {r('ns')} AS news_sentiment_std, {r('ni')} AS news_sentiment_intensity FROM newspanel", "ret", "dailynews", **NEWS_JOIN))
def c2(spark, d):
    return news_panel(spark, d).select(*KEY, "news_count", *[rnd(c).alias(c) for c in ("news_sentiment_mean", "news_sentiment_std", "news_sentiment_intensity")])


LATEST_FILING = "SELECT Symbol, filing_date AS Date, page_id, m, k FROM secscored QUALIFY row_number() OVER (PARTITION BY Symbol, filing_date ORDER BY page_id DESC) = 1"


@query("c3_asof_filing", sql(f"SELECT p.Symbol, p.Date, f.Date AS matched_date, f.page_id, {r('f.m')} AS mda_sentiment FROM panel p ASOF LEFT JOIN f ON p.Symbol = f.Symbol AND p.Date >= f.Date",
                             "panel", "secscored", f=LATEST_FILING))
def c3(spark, d):
    f = scored_filings(spark, d).select("Symbol", F.col("filing_date").alias("Date"), "page_id", "mda_sentiment")
    out = jn.asof_backward(panel(spark, d).select(*KEY), f, ["page_id", "mda_sentiment"], tie=["page_id"])
    return out.select(*KEY, "matched_date", "page_id", rnd("mda_sentiment").alias("mda_sentiment"))


def _nearest(left: str, right: str, days: int, eq: str) -> str:
    return f"""SELECT l.*, CASE WHEN least(coalesce(l.Date - b.Date, 99999), coalesce(a.Date - l.Date, 99999)) <= {days} THEN
      CASE WHEN b.Date IS NOT NULL AND (a.Date IS NULL OR l.Date - b.Date <= a.Date - l.Date) THEN b.v ELSE a.v END END AS v
      FROM {left} l ASOF LEFT JOIN {right} b ON {eq.format(x='b')} AND l.Date >= b.Date ASOF LEFT JOIN {right} a ON {eq.format(x='a')} AND l.Date <= a.Date"""


@query("c4_asof_nearest", sql(f"SELECT Symbol, Date, {r('own')} AS own, {r('coalesce(coalesce(' + FF.format(c='t') + ', ' + BF.format(c='t') + '), 0)')} AS tone FROM t", "panel", "secscored", "dailynews",
    f="SELECT Symbol, filing_date AS Date, avg(m) AS v, 1 AS one FROM secscored GROUP BY 1, 2",
    p="SELECT Symbol, Date, 1 AS one FROM panel",
    g="SELECT Date, avg(nm) AS v, 1 AS one FROM dailynews GROUP BY 1",
    o="SELECT * EXCLUDE (v), v AS own FROM (" + _nearest("p", "f", 200, "l.Symbol = {x}.Symbol") + ")",
    mk="SELECT * FROM (" + _nearest("o", "g", 3, "l.one = {x}.one") + ")",
    t="SELECT *, coalesce(own, v) AS t FROM mk"))
def c4(spark, d):
    f = tone.daily_filings(scored_filings(spark, d)).select("Symbol", "Date", F.col("sec_mda_sentiment").alias("tone"))
    market = tone.daily_news(scored_news(spark, d)).groupBy("Date").agg(F.avg("news_sentiment_mean").alias("tone"))
    left = panel(spark, d).select(*KEY)
    own = jn.asof_nearest(left, f, ["tone"], tolerance_days=200).withColumnRenamed("tone", "own").drop("matched_date")
    mkt = jn.asof_nearest(own, market, ["tone"], by=(), tolerance_days=3).drop("matched_date")
    both = mkt.withColumn("tone", F.coalesce("own", "tone"))
    from riskloom.operators.clean import fill_both_ways

    out = fill_both_ways(both, ["tone"])
    return out.select(*KEY, rnd("own").alias("own"), rnd(F.coalesce("tone", F.lit(0.0))).alias("tone"))


@query("c5_full_outer_tone", sql(f"SELECT coalesce(n.Symbol, s.Symbol) AS Symbol, coalesce(n.Date, s.Date) AS Date, {r('nm')} AS news_tone, {r('sm')} AS sec_tone FROM dailynews n FULL JOIN dailysec s ON n.Symbol = s.Symbol AND n.Date = s.Date", "dailynews", "dailysec"))
def c5(spark, d):
    n = tone.daily_news(scored_news(spark, d)).select(*KEY, rnd("news_sentiment_mean").alias("news_tone"))
    f = tone.daily_filings(scored_filings(spark, d)).select(*KEY, rnd("sec_mda_sentiment").alias("sec_tone"))
    return n.join(f, KEY, "full")


@query("c6_labels_and_predictions", sql("SELECT Symbol, Date, l.Risk_Label, p.Risk_Probability FROM labelled l JOIN pred p USING (Symbol, Date)", "labelled", "pred"))
def c6(spark, d):
    labels = lab.label_mean_step(panel_returns(spark, d)).select(*KEY, "Risk_Label")
    return labels.join(predictions(spark, d).select(*KEY, "Risk_Probability"), KEY)


@query("c7_resolve_collisions", sql("""SELECT p.Symbol, p.Date, coalesce(CASE WHEN p.Volume > 20 THEN p.Close END, q.Close) AS Close, p.Volume, q.Risk_Probability
    FROM panel p LEFT JOIN (SELECT * FROM pred WHERE day(Date) > 5) q USING (Symbol, Date)""", "panel", "pred"))
def c7(spark, d):
    left = panel(spark, d).select(*KEY, F.when(F.col("Volume") > 20, F.col("Close")).alias("Close"), "Volume")
    right = predictions(spark, d).where(F.dayofmonth("Date") > 5).select(*KEY, "Close", "Risk_Probability")
    return jn.resolve_collisions(left, right, KEY)


@query("c8_full_by_key", sql("""SELECT coalesce(a.Symbol, b.Symbol, c.Symbol) AS Symbol, coalesce(a.Date, b.Date, c.Date) AS Date, a.Close AS a_Close, b.Close AS b_Close, c.Volume AS c_Volume
    FROM (SELECT * FROM panel WHERE day(Date) <= 20) a FULL JOIN (SELECT * FROM nations) b ON a.Symbol = b.Symbol AND a.Date = b.Date
    FULL JOIN (SELECT * FROM panel WHERE day(Date) >= 10) c ON coalesce(a.Symbol, b.Symbol) = c.Symbol AND coalesce(a.Date, b.Date) = c.Date""", "panel", "nations"))
def c8(spark, d):
    p, day = panel(spark, d), F.dayofmonth("Date")
    return jn.full_by_key({"a": p.where(day <= 20).select(*KEY, "Close"), "b": nation_panel(spark, d), "c": p.where(day >= 10).select(*KEY, "Volume")}, KEY)


@query("c9_attach_by_symbol", sql(f"SELECT Symbol, Date, coalesce({r('t')}, 0) AS tone, coalesce(n, 0) AS articles FROM panel LEFT JOIN g USING (Symbol)", "panel", "scored",
                                  g="SELECT Symbol, avg(cc) AS t, count(*) AS n FROM scored WHERE Symbol <> 'Brand#5' GROUP BY 1"))
def c9(spark, d):
    g = scored_news(spark, d).where("Symbol <> 'Brand#5'").groupBy("Symbol").agg(rnd(F.avg("combined_sentiment_compound")).alias("tone"), F.count(F.lit(1)).alias("articles"))
    return jn.attach_by_symbol(panel(spark, d).select(*KEY), g)


@query("c10_market_back_to_panel", sql(f"SELECT Symbol, Date, {r('mv')} AS Market_Volatility, {r('mr')} AS Market_Return FROM ret JOIN m USING (Date)", "ret",
                                       m="SELECT Date, stddev_samp(Returns) AS mv, avg(Returns) AS mr FROM ret GROUP BY 1"))
def c10(spark, d):
    p = panel_returns(spark, d)
    return p.select(*KEY).join(lab.market_daily(p), "Date").select(*KEY, rnd("Market_Volatility").alias("Market_Volatility"), rnd("Market_Return").alias("Market_Return"))


@query("c11_interval_join", sql("""SELECT name, 'event' AS kind, Symbol, Date, Close FROM panel JOIN windows ON Date BETWEEN start_date AND end_date
    UNION ALL SELECT name, 'before', Symbol, Date, Close FROM panel JOIN windows ON Date >= start_date - 30 AND Date < start_date""", "panel", "windows"))
def c11(spark, d):
    p, w = panel(spark, d).select(*KEY, "Close"), events_catalogue(spark)
    inside, before = jn.interval_join(p, w), jn.interval_join(p, jn.pre_event(w))
    return inside.select("name", F.lit("event").alias("kind"), *KEY, "Close").unionByName(before.select("name", F.lit("before").alias("kind"), *KEY, "Close"))


@query("c12_clip_windows", sql("""SELECT name, type, CASE WHEN s > e THEN a ELSE s END AS start_date, CASE WHEN s > e THEN b ELSE e END AS end_date, s > e AS window_adjusted
    FROM (SELECT *, greatest(start_date, a) AS s, least(end_date, b) AS e FROM windows, (SELECT min(Date) AS a, max(Date) AS b FROM panel))""", "panel", "windows"))
def c12(spark, d):
    return jn.clip_windows(events_catalogue(spark), panel(spark, d))


@query("c14_vector_fill", sql("SELECT Symbol, Date, " + ", ".join(f"{r(FF.format(c=e))} AS {e}" for e in ELEMENTS) + " FROM j", "panel", "vectors",
                              v=VECTOR_MEANS, j="SELECT panel.Symbol, panel.Date, " + ", ".join(ELEMENTS) + " FROM panel LEFT JOIN v USING (Symbol, Date)"))
def c14(spark, d):
    out = jn.left_then_fill(panel(spark, d).select(*KEY), vector_means(spark, d), ELEMENTS)
    return out.select(*KEY, *[rnd(e).alias(e) for e in ELEMENTS])


@query("c15_align_text_frame", sql(f"SELECT Symbol, Date, coalesce({r('nm')}, 0) AS tone, coalesce({r('ni')}, 0) AS intensity FROM panel LEFT JOIN dailynews USING (Symbol, Date)", "panel", "dailynews"))
def c15(spark, d):
    text = tone.daily_news(scored_news(spark, d)).select(*KEY, rnd("news_sentiment_mean").alias("tone"), rnd("news_sentiment_intensity").alias("intensity"))
    return jn.align_text_frame(panel(spark, d), text)
