"""Sections A (sources and sinks), L (streams) and M (user-defined rolling aggregate)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from riskloom.functions import tone
from riskloom.functions.hooks import rolling_apply
from riskloom.operators import aggregates as ag
from riskloom.operators import clean as cl
from riskloom.plans.fixtures import event_bars, filing_sections, filings, full, labelled, nation_panel, news, panel, panel_returns, predictions, r, rnd, scored_filings, scored_news, sql, table
from riskloom.plans.registry import query
from riskloom.session import new_folder
from riskloom.sources import landed as ld
from riskloom.sources import tables as tb
from riskloom.streaming import monitors as mo

KEY = ["Symbol", "Date"]


@query("a1_scan_stored_tables", sql("SELECT Symbol, Date, Open, High, Low, Close, Volume FROM panel", "panel"))
def a1(spark, d):
    folder = new_folder(spark, "stored")
    panel(spark, d).select(*KEY, "Open", "High", "Low", "Close", "Volume").write.csv(folder, header=True)
    return tb.read_csv(spark, folder, tb.PRICE_SCHEMA)


@query("a2_load_dataset", "SELECT 'parquet' AS kind, n_nationkey, n_name FROM nation UNION ALL SELECT 'csv', r_regionkey, r_name FROM region")
def a2(spark, d):
    folder = new_folder(spark, "dataset") + ".csv"
    table(spark, d, "region").write.csv(folder, header=True)
    p = tb.load_dataset(spark, f"{d}/nation.parquet").select(F.lit("parquet").alias("kind"), "n_nationkey", "n_name")
    c = tb.load_dataset(spark, folder, "n_nationkey int, n_name string")
    return p.unionByName(c.select(F.lit("csv").alias("kind"), "n_nationkey", "n_name"))


def landed_bodies(spark, d):
    """The given documents as the JSON bodies the four services would land."""
    n = news(spark, d).withColumn("company_name", F.concat(F.lit("Company "), "Symbol")).withColumnRenamed("Symbol", "symbol").withColumn("query", F.concat(F.lit("q "), "symbol"))
    t, s, c = F.col("title"), F.col("description"), F.col("content")
    when, secs = F.date_format(F.col("published_date").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.datediff("published_date", F.lit("1970-01-01")).cast("bigint") * 86400
    search = F.to_json(F.struct(F.array(F.struct(t.alias("title"), s.alias("description"), c.alias("content"), F.col("url"), when.alias("publishedAt"), F.struct(F.col("api_source").alias("name")).alias("source"))).alias("articles")))
    finance = F.to_json(F.array(F.struct(t.alias("title"), s.alias("summary"), F.col("url").alias("link"), F.col("api_source").alias("publisher"), secs.alias("providerPublishTime"))))
    forum = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(t.alias("title"), s.alias("selftext"), F.col("url").alias("permalink"), secs.alias("created_utc"), F.lit(7).alias("score"), F.lit(3).alias("num_comments")).alias("data"))).alias("children")).alias("data")))
    k = n.doc_id % 4
    return [n.where(k == i).select("symbol", "company_name", "query", body.alias("body")) for i, body in enumerate((search, search, finance, forum))]


@query("a3_landed_articles", sql("""SELECT symbol AS symbol, 'Company ' || Symbol AS company_name, title, description, CASE WHEN k < 2 THEN content ELSE '' END AS content, CASE WHEN k = 3 THEN 'https://reddit.com' || url ELSE url END AS url,
    published_date AS published_day, CASE WHEN k = 3 THEN 'r/stocks' ELSE api_source END AS source, CASE k WHEN 2 THEN Symbol WHEN 3 THEN Symbol || ' OR Company ' || Symbol ELSE 'q ' || Symbol END AS query_used,
    CASE k WHEN 0 THEN 'gnews' WHEN 1 THEN 'newsapi' WHEN 2 THEN 'yahoo' ELSE 'reddit' END AS api_source, CASE WHEN k = 3 THEN 7 END AS score, CASE WHEN k = 3 THEN 3 END AS num_comments FROM (SELECT *, doc_id % 4 AS k FROM news)""".replace("SELECT symbol AS symbol", "SELECT Symbol AS symbol"), "news"))
def a3(spark, d):
    a, b, c, e = landed_bodies(spark, d)
    out = ld.all_articles(ld.search_articles(a, "gnews"), ld.search_articles(b, "newsapi"), ld.finance_articles(c), ld.forum_posts(e, "stocks"))
    return out.withColumn("published_day", F.to_date("published_date")).drop("published_date")


@query("a4_earnings", """SELECT o_orderpriority AS Symbol, CAST(CAST(o_orderdate AS DATE) + k * 91 AS DATE) AS "fiscalDateEnding", CASE WHEN k = 0 THEN o_totalprice END AS "reportedEPS" FROM orders, (VALUES (0), (1)) v(k)""")
def a4(spark, d):
    day = F.col("o_orderdate").cast("date")
    entry = [F.struct(F.date_format(F.date_add(day, 91 * k), "yyyy-MM-dd").alias("fiscalDateEnding"), (F.col("o_totalprice").cast("string") if k == 0 else F.lit("None")).alias("reportedEPS")) for k in (0, 1)]
    bodies = table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.to_json(F.struct(F.array(*entry).alias("quarterlyEarnings"))).alias("body"))
    return ld.earnings(bodies)


@query("a6_combine_tables", sql("SELECT Symbol, Date, Close, Volume FROM panel UNION ALL SELECT 'ORDERS', CAST(o_orderdate AS DATE), avg(o_totalprice), NULL FROM orders GROUP BY 2", "panel").replace("avg(o_totalprice)", r("avg(o_totalprice)")))
def a6(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("Date")).agg(rnd(F.avg("o_totalprice")).alias("Close"))
    return tb.combine({"PANEL": panel(spark, d).select(*KEY, "Close", "Volume"), "ORDERS": orders}).select(*KEY, "Close", "Volume")


@query("a7_recent_filings", sql("""SELECT cik, form_type, accession_number, filing_date FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession_number DESC) AS n FROM (
    SELECT 'C' || page_id AS cik, CASE k WHEN 0 THEN '10-K' WHEN 1 THEN '8-K' ELSE '10-Q' END AS form_type, 'A' || page_id || '-' || k AS accession_number, CAST(filing_date + k * 30 AS DATE) AS filing_date FROM filings, (VALUES (0), (1), (2), (3)) v(k)) WHERE form_type IN ('10-K', '10-Q')) WHERE n <= 2""", "filings"))
def a7(spark, d):
    f = filings(spark, d)
    ids = F.col("page_id").cast("string")
    companies = f.select(
        F.concat(F.lit("C"), ids).alias("cik"), F.array(*[F.concat(F.lit("A"), ids, F.lit(f"-{k}")) for k in range(4)]).alias("accession_numbers"),
        F.array(*[F.date_format(F.date_add("filing_date", 30 * k), "yyyy-MM-dd") for k in range(4)]).alias("filing_dates"), F.array(*[F.lit(x) for x in ("10-K", "8-K", "10-Q", "10-Q")]).alias("forms"))
    return ld.recent_filings(companies, 2)


@query("a8_company_ids", "SELECT lower(c_name) AS symbol, CASE WHEN s_suppkey IS NOT NULL THEN lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS cik FROM customer LEFT JOIN supplier ON upper(c_name) = upper(replace(s_name, 'Supplier', 'Customer'))")
def a8(spark, d):
    names = table(spark, d, "supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("ticker"), F.col("s_suppkey").alias("cik"))
    return ld.company_ids(table(spark, d, "customer").select(F.lower("c_name").alias("symbol")), names)


@query("a9_save_prices", sql("SELECT Symbol, count(*) AS n FROM panel GROUP BY 1", "panel"))
def a9(spark, d):
    folder = tb.save_prices(panel(spark, d), new_folder(spark, "prices"))
    return spark.read.parquet(folder).groupBy("Symbol").agg(F.count(F.lit(1)).alias("n"))


@query("a10_save_news", sql("SELECT api_source, count(*) AS n FROM news GROUP BY 1", "news"))
def a10(spark, d):
    folder = tb.save_news(news(spark, d), new_folder(spark, "news"))
    return spark.read.parquet(folder).groupBy("api_source").agg(F.count(F.lit(1)).alias("n"))


@query("a11_long_sections", sql("SELECT Symbol, filing_date, form_type, 'mda' AS section_type, mda_text AS text FROM sections WHERE mda_text <> '' AND page_id % 5 <> 0 UNION ALL SELECT Symbol, filing_date, form_type, 'risk_factors', risk_factors_text FROM sections WHERE risk_factors_text <> ''", "sections"))
def a11(spark, d):
    f = filing_sections(spark, d).withColumn("mda_text", F.when(F.col("page_id") % 5 != 0, F.col("mda_text")).otherwise(""))
    return ld.long_sections(f)


@query("a12_save_integrated", sql("SELECT count(*) AS n, count(DISTINCT Symbol) AS symbols FROM labelled", "labelled"))
def a12(spark, d):
    p = labelled(spark, d)
    folder = tb.save_integrated(p, {"feature_groups": cl.feature_profile(p), "profile": ag.dataset_profile(p), "missing": ag.missing_ranking(p)}, new_folder(spark, "integrated"))
    return spark.read.parquet(f"{folder}/integrated").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("Symbol").alias("symbols"))


@query("a13_save_tone", sql("SELECT count(*) AS n FROM dailynews", "dailynews"))
def a13(spark, d):
    n = scored_news(spark, d).drop("content")
    folder = tb.save_tone(n, scored_filings(spark, d).drop("mda_text", "risk_factors_text"), tone.daily_news(n), new_folder(spark, "tone"))
    return spark.read.parquet(f"{folder}/daily_sentiment").agg(F.count(F.lit(1)).alias("n"))


@query("a14_save_predictions", sql("SELECT Date, Symbol, CASE WHEN Risk_Probability >= 0.5 THEN 1 ELSE 0 END AS Risk_Prediction, Risk_Probability, Risk_Label AS Actual_Risk_Label FROM pred", "pred"))
def a14(spark, d):
    p = predictions(spark, d).select("Date", "Symbol", (F.col("Risk_Probability") >= 0.5).cast("int").alias("Risk_Prediction"), "Risk_Probability", F.col("Risk_Label").alias("Actual_Risk_Label"))
    return spark.read.schema(tb.PREDICTION_SCHEMA).parquet(tb.save_predictions(p, new_folder(spark, "pred")) + "/predictions")


@query("a15_save_runs", sql("SELECT 'full' AS run, 'b' AS baseline, count(*) AS n FROM pred UNION ALL SELECT 'full', 'c', count(*) FROM pred", "pred"))
def a15(spark, d):
    p = predictions(spark, d)
    runs = p.select(*KEY, F.col("prob_b").alias("p"), F.lit("full").alias("run"), F.lit("b").alias("baseline")).unionByName(p.select(*KEY, F.col("prob_c").alias("p"), F.lit("full").alias("run"), F.lit("c").alias("baseline")))
    return spark.read.parquet(tb.save_runs(runs, new_folder(spark, "runs"))).groupBy("run", "baseline").agg(F.count(F.lit(1)).alias("n"))


def tone_stream(spark, d):
    schema = table(spark, d, "events").schema
    s = mo.event_stream(spark, d, "events.parquet", schema)
    return s.withColumnRenamed("event_type", "Symbol").withColumn("tone", F.least(F.col("value") / 100.0, F.lit(2.0)) - 1.0)


def finished(spark, stream, folder):
    q = mo.run_to_files(stream, folder)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def ended_stream(spark, d, folder):
    """The events with a closing row a month behind the last one."""
    last = table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return mo.with_end(tone_stream(spark, d), str(last + timedelta(days=30)), folder)


TONE = "least(value / 100.0, 2.0) - 1.0"


@query("l1_tone_monitor", f"""SELECT s AS window_start, s + INTERVAL 24 HOUR AS window_end, Symbol, {r('m')} AS average_sentiment, n AS article_count, CASE WHEN m IS NULL THEN 'No Data' WHEN m > 0.05 THEN 'Positive' WHEN m < -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment_label,
    CASE WHEN m IS NULL THEN 'Unknown' WHEN m < -0.2 THEN 'High' WHEN m > 0.2 THEN 'Low' ELSE 'Medium' END AS risk_indicator
    FROM (SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS s, event_type AS Symbol, avg({TONE}) AS m, count({TONE}) AS n FROM events, range(24) t(k) GROUP BY 1, 2)""")
def l1(spark, d):
    folder = new_folder(spark, "monitor")
    out = finished(spark, mo.tone_monitor(ended_stream(spark, d, folder), "tone"), folder)
    return out.select(F.col("window_start").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz"), "Symbol", rnd("average_sentiment").alias("average_sentiment"), "article_count", "sentiment_label", "risk_indicator")


@query("l2_stream_dedupe", "SELECT count(*) AS kept, count(DISTINCT (user_id, event_type)) AS pairs FROM (SELECT DISTINCT user_id, event_type FROM events)")
def l2(spark, d):
    out = finished(spark, mo.deduplicated(tone_stream(spark, d), ["user_id", "Symbol"], late="60 days"), new_folder(spark, "dedupe"))
    return out.agg(F.count(F.lit(1)).alias("kept"), F.count_distinct("user_id", "Symbol").alias("pairs"))


@query("l3_alert_stream", "SELECT event_type AS Symbol, count(*) AS alerts FROM events WHERE 1 / (1 + exp(3.5 * (least(value / 100.0, 2.0) - 1.0))) >= CASE event_type WHEN 'error' THEN 0.9 ELSE 0.7 END GROUP BY 1")
def l3(spark, d):
    from riskloom.operators.scoring import sigmoid_risk

    cuts = table(spark, d, "events").select(F.col("event_type").alias("Symbol")).distinct().withColumn("threshold", F.when(F.col("Symbol") == "error", 0.9).otherwise(0.7))
    folder = new_folder(spark, "alerts")
    found = mo.alerts(tone_stream(spark, d), cuts, sigmoid_risk(F.col("tone")))
    mo.run_batches(found, folder, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("Symbol").agg(F.count(F.lit(1)).alias("alerts"))


@query("l4_warning_episodes", f"""SELECT min(ts) AS episode_start, max(ts) + INTERVAL 30 MINUTE AS episode_end, Symbol, count(*) AS warnings FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY Symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT event_type AS Symbol, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE {TONE} > 0.2)) GROUP BY Symbol, g""")
def l4(spark, d):
    folder = new_folder(spark, "episodes")
    out = finished(spark, mo.warning_episodes(ended_stream(spark, d, folder), F.col("tone") > 0.2), folder)
    return out.select(F.col("episode_start").cast("timestamp_ntz"), F.col("episode_end").cast("timestamp_ntz"), "Symbol", "warnings")


@query("m3_rolling_hook", sql(f"SELECT Symbol, Date, {r(full('quantile_cont(Returns, 0.5)', 'Returns', 20))} AS rolling_median FROM ret", "ret"))
def m3(spark, d):
    out = rolling_apply(panel_returns(spark, d), "Returns", 20, lambda x: x.median(), "rolling_median")
    return out.select(*KEY, rnd("rolling_median").alias("rolling_median"))
