"""Lexicon tone scoring and the tables built from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.functions.series import Series, chunked, positions
from riskloom.operators.indicators import tone_volatility

# Default stems and label cut.
POSITIVE_STEMS = "great excellent good up gain bullish strong positive surge growth improve optimistic".split()
NEGATIVE_STEMS = "bad terrible loss crash down bearish weak negative drop decline risk volatile".split()
LABEL_CUT = 0.05


def stem_hits(text: Column, stems: Sequence[str]) -> Column:
    """Tokens (runs of letters and apostrophes) that start with a stem.

    A token starts where no token character precedes, so one counted regex does the work
    of a token-by-stem loop.
    """
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![a-z'])(?:{'|'.join(stems)})"))


def compound(text: Column, positive: Sequence[str] = POSITIVE_STEMS, negative: Sequence[str] = NEGATIVE_STEMS) -> Column:
    t = F.coalesce(text, F.lit(""))
    p, n = stem_hits(t, positive), stem_hits(t, negative)
    return (p - n) / F.greatest(p + n, F.lit(1))


def parts(c: Column) -> dict[str, Column]:
    """neg / neu / pos shares of a compound score."""
    return {"neg": F.greatest(-c, F.lit(0.0)), "neu": F.greatest(1.0 - F.abs(c), F.lit(0.0)), "pos": F.greatest(c, F.lit(0.0))}


def label(c: Column, cut: float = LABEL_CUT) -> Column:
    return F.when(c >= cut, "positive").when(c <= -cut, "negative").otherwise("neutral")


def row_mean(*cols: Column) -> Column:
    """Mean of the values that are present."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    seen = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return F.try_divide(total, seen)


def score_news(df: DataFrame, positive: Sequence[str] = POSITIVE_STEMS, negative: Sequence[str] = NEGATIVE_STEMS) -> DataFrame:
    df = df.withColumn("combined_text", tx.combined(F.col("title"), F.col("description"), F.col("content")))
    for field, name in (("title", "title"), ("description", "description"), ("combined_text", "combined")):
        df = df.withColumn(f"{name}_sentiment_compound", compound(F.col(field), positive, negative))
    c = F.col("combined_sentiment_compound")
    return df.withColumns({
        "sentiment_label": label(c),
        "sentiment_intensity": F.abs(c),
        "sentiment_consistency": 1 - F.abs(F.col("title_sentiment_compound") - F.col("description_sentiment_compound")),
        "title_word_count": tx.word_count(F.col("title")),
        "description_word_count": tx.word_count(F.col("description")),
    }).drop("combined_text")


def score_filings(df: DataFrame, sections: Sequence[str] = ("mda", "risk_factors"), positive: Sequence[str] = POSITIVE_STEMS,
                  negative: Sequence[str] = NEGATIVE_STEMS) -> DataFrame:
    """Tone and label per section; an empty section scores 0 and neutral."""
    df = df.withColumns({f"{s}_sentiment": compound(F.col(f"{s}_text"), positive, negative) for s in sections})
    df = df.withColumns({f"{s}_sentiment_label": label(F.col(f"{s}_sentiment")) for s in sections})
    df = df.withColumns({f"{s}_sentiment_intensity": F.abs(f"{s}_sentiment") for s in sections})
    df = df.withColumn("combined_sec_sentiment", row_mean(*[F.col(f"{s}_sentiment") for s in sections]))
    return df.withColumn("combined_sec_sentiment_label", label(F.col("combined_sec_sentiment")))


def daily_news(df: DataFrame, key: str = "Symbol", day: str = "published_date", name: str = "Date") -> DataFrame:
    c = F.col("combined_sentiment_compound")
    return df.groupBy(key, F.col(day).cast("date").alias(name)).agg(
        F.avg(c).alias("news_sentiment_mean"),
        F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("news_sentiment_std"),
        F.count(c).alias("news_count"),
        F.avg("sentiment_intensity").alias("news_sentiment_intensity"),
        F.avg("title_word_count").alias("news_title_length_avg"),
        F.avg("description_word_count").alias("news_desc_length_avg"),
        F.avg("title_sentiment_compound").alias("news_title_sentiment"),
        F.avg("description_sentiment_compound").alias("news_description_sentiment"),
    )


def daily_filings(df: DataFrame, key: str = "Symbol", day: str = "filing_date", name: str = "Date") -> DataFrame:
    return df.groupBy(key, F.col(day).cast("date").alias(name)).agg(
        F.avg("mda_sentiment").alias("sec_mda_sentiment"),
        F.avg("risk_factors_sentiment").alias("sec_risk_sentiment"),
        F.avg("combined_sec_sentiment").alias("sec_combined_sentiment"),
    )


def daily_tone_attached(df: DataFrame, key: str = "Symbol", day: str = "published_date") -> DataFrame:
    """Mean tone of the article's symbol-day: aggregated first, so a hot day is one row when joined."""
    daily = df.groupBy(key, day).agg(F.avg("combined_sentiment_compound").alias("daily_avg_sentiment"))
    return df.join(daily, [key, day], "left")


def article_tone_volatility(df: DataFrame, order: Sequence[str], key: str = "Symbol", tone: str = "combined_sentiment_compound", span: int = 7) -> DataFrame:
    """Rolling spread over the last articles of a symbol; a symbol may hold any share of all rows."""
    placed = positions(df, [key], order)

    def build(rows: DataFrame, s: Series) -> DataFrame:
        return tone_volatility(rows, tone, span, s)

    return chunked(placed, [key], build, before=span).drop("_pos")


def change_since_previous_filing(df: DataFrame, order: Sequence[str], key: str = "Symbol", tone: str = "risk_factors_sentiment") -> DataFrame:
    placed = positions(df, [key], order)

    def build(rows: DataFrame, s: Series) -> DataFrame:
        return rows.withColumn("risk_sentiment_change", F.col(tone) - s.lag(tone))

    return chunked(placed, [key], build, before=1).drop("_pos")
