"""Landed JSON of articles, earnings and filing indexes as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shapes of the landed records, kept forms.
ARTICLES = ("struct<articles:array<struct<title:string,description:string,content:string,url:string,publishedAt:string,source:struct<name:string>>>>")
FINANCE = "array<struct<title:string,summary:string,link:string,publisher:string,providerPublishTime:bigint>>"
FORUM = ("struct<data:struct<children:array<struct<data:struct<title:string,selftext:string,permalink:string,created_utc:bigint,score:int,num_comments:int>>>>>")
EARNINGS = "struct<quarterlyEarnings:array<struct<fiscalDateEnding:string,reportedEPS:string>>>"
WANTED_FORMS = ("10-K", "10-Q")
ARTICLE_COLUMNS = ["symbol", "company_name", "title", "description", "content", "url", "published_date", "source", "query_used", "api_source"]


def _text(c: str):
    return F.coalesce(F.col(c), F.lit(""))


def search_articles(df: DataFrame, api: str, body: str = "body") -> DataFrame:
    """Search services answer with an ``articles`` array and a nested source."""
    a = df.withColumn("a", F.explode(F.from_json(body, ARTICLES)["articles"]))
    return a.select("symbol", "company_name", _text("a.title").alias("title"), _text("a.description").alias("description"), _text("a.content").alias("content"), _text("a.url").alias("url"),
                    F.try_to_timestamp("a.publishedAt").cast("timestamp").alias("published_date"), _text("a.source.name").alias("source"), F.col("query").alias("query_used"), F.lit(api).alias("api_source"))


def finance_articles(df: DataFrame, body: str = "body") -> DataFrame:
    a = df.withColumn("a", F.explode(F.from_json(body, FINANCE)))
    return a.select("symbol", "company_name", _text("a.title").alias("title"), _text("a.summary").alias("description"), F.lit("").alias("content"), _text("a.link").alias("url"),
                    F.timestamp_seconds("a.providerPublishTime").alias("published_date"), _text("a.publisher").alias("source"), F.col("symbol").alias("query_used"), F.lit("yahoo").alias("api_source"))


def forum_posts(df: DataFrame, board: str, body: str = "body") -> DataFrame:
    a = df.withColumn("p", F.explode(F.from_json(body, FORUM)["data"]["children"]["data"]))
    return a.select("symbol", "company_name", _text("p.title").alias("title"), _text("p.selftext").alias("description"), F.lit("").alias("content"),
                    F.concat(F.lit("https://reddit.com"), _text("p.permalink")).alias("url"), F.timestamp_seconds("p.created_utc").alias("published_date"), F.lit(f"r/{board}").alias("source"),
                    F.concat_ws(" OR ", "symbol", "company_name").alias("query_used"), F.lit("reddit").alias("api_source"), F.col("p.score").alias("score"), F.col("p.num_comments").alias("num_comments"))


def all_articles(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def earnings(df: DataFrame, body: str = "body") -> DataFrame:
    e = df.withColumn("e", F.explode(F.from_json(body, EARNINGS)["quarterlyEarnings"]))
    return e.select(F.col("symbol").alias("Symbol"), F.to_date("e.fiscalDateEnding").alias("fiscalDateEnding"), F.expr("try_cast(e.reportedEPS as double)").alias("reportedEPS"))


def recent_filings(df: DataFrame, per_company: int, forms: Sequence[str] = WANTED_FORMS) -> DataFrame:
    """Newest filings of the wanted forms from the parallel arrays of one company record.

    Filtering, ordering and cutting happen inside the record, so there is no shuffle.
    """
    zipped = F.arrays_zip(F.col("filing_dates").alias("filing_date"), F.col("accession_numbers").alias("accession_number"), F.col("forms").alias("form_type"))
    kept = F.filter(zipped, lambda f: f["form_type"].isin(list(forms)) & f["filing_date"].isNotNull() & f["accession_number"].isNotNull())
    newest = F.slice(F.reverse(F.array_sort(kept)), 1, per_company)
    return df.select("cik", F.explode(newest).alias("f")).select("cik", "f.form_type", "f.accession_number", F.to_date("f.filing_date").alias("filing_date"))


def company_ids(symbols: DataFrame, directory: DataFrame) -> DataFrame:
    """Zero-padded company id per ticker, any case; null when unknown."""
    d = directory.select(F.upper("ticker").alias("_t"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"))
    return symbols.withColumn("_t", F.upper("symbol")).join(d, "_t", "left").drop("_t")


def long_sections(df: DataFrame, sections: Sequence[str] = ("mda", "risk_factors"), keys: Sequence[str] = ("Symbol", "filing_date", "form_type")) -> DataFrame:
    """One row per non-empty section."""
    long = df.select(*keys, *[F.col(f"{s}_text").alias(s) for s in sections]).unpivot(list(keys), list(sections), "section_type", "text")
    return long.where("text != ''")
