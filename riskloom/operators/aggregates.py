"""Profiles, timelines, scorecards and correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.quantiles import exact_quantiles, one_row
from riskloom.functions.series import Series, correlation, slope
from riskloom.operators.clean import null_shares, numeric_columns
from riskloom.operators.labels import flag

# Zone and confidence cuts.
ZONE_CUTS = (0.3, 0.7)
CONFIDENCE_CUTS = (0.4, 0.8)
TREND_CUT = 0.05


def longform(one: DataFrame, keys: Sequence[str] = (), name: str = "metric", value: str = "value") -> DataFrame:
    """A one-pass wide aggregate as (keys, metric, value) rows."""
    cols = [c for c in one.columns if c not in keys]
    return one.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(keys), cols, name, value)


def news_statistics(df: DataFrame, source: str = "api_source") -> DataFrame:
    """Totals, distinct companies, date range and mean lengths for each source and for all of them.

    One rollup: totals come out of the same shuffle as the per-source counts.
    """
    return df.rollup(source).agg(
        F.count(F.lit(1)).alias("articles"), F.count_distinct("Symbol").alias("companies"), F.min("published_date").alias("earliest"),
        F.max("published_date").alias("latest"), F.avg(F.length("title")).alias("avg_title_length"), F.avg(F.length("description")).alias("avg_description_length"))


def filing_statistics(df: DataFrame, form: str = "form_type") -> DataFrame:
    return df.rollup(form).agg(
        F.count(F.lit(1)).alias("filings"), F.count_distinct("Symbol").alias("companies"), F.avg(F.col("extraction_success").cast("int")).alias("success_rate"),
        F.avg("mda_length").alias("avg_mda_length"), F.avg("risk_factors_length").alias("avg_risk_factors_length"),
        F.min("filing_date").alias("earliest"), F.max("filing_date").alias("latest"))


def dataset_profile(df: DataFrame, label: str = "Risk_Label") -> DataFrame:
    cells = sum(F.count(c) for c in df.columns[1:]) + F.count(df.columns[0])
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("total_observations"), F.lit(len(df.columns)).alias("columns"), F.count_distinct("Symbol").alias("unique_symbols"), F.min("Date").alias("start"),
        F.max("Date").alias("end"), ((1 - cells / (n * len(df.columns))) * 100).alias("missing_pct"), F.sum(label).cast("bigint").alias("high_risk_periods"),
        F.avg(label).alias("risk_rate"))


def risk_timeline(df: DataFrame, label: str = "Risk_Label") -> DataFrame:
    return df.groupBy("Date").agg(F.avg(label).alias("Risk_Level"), F.stddev_samp(label).alias("Risk_Volatility"), F.count(label).alias("Sample_Count"),
                                  F.count_distinct("Symbol").alias("Symbols_Count"))


def zone(c: Column) -> Column:
    """Right-closed zones."""
    return F.when(c <= ZONE_CUTS[0], "Low Risk").when(c <= ZONE_CUTS[1], "Medium Risk").when(c.isNotNull(), "High Risk")


def zoned_timeline(df: DataFrame, prob: str = "Risk_Probability") -> DataFrame:
    daily = df.groupBy("Date").agg(F.avg(prob).alias("risk_level"), F.stddev_samp(prob).alias("risk_volatility"), F.count(prob).alias("sample_count"), F.avg("Close").alias("avg_price"))
    s = Series((), ("Date",))
    return daily.withColumns({"risk_zone": zone(F.col("risk_level")), "risk_ma_7": F.avg("risk_level").over(s.last(7)), "risk_ma_30": F.avg("risk_level").over(s.last(30))})


def zone_summary(daily: DataFrame) -> DataFrame:
    """Share of days per zone, and the trend of the last 30 days against all."""
    overall = daily.agg(F.avg("risk_level").alias("all_mean"), F.count(F.lit(1)).alias("days"))
    recent = daily.orderBy(F.desc("Date")).limit(30).agg(F.avg("risk_level").alias("recent_mean"))
    out = daily.groupBy("risk_zone").agg(F.count(F.lit(1)).alias("days"))
    out = out.withColumns({"_o": one_row(overall), "_r": one_row(recent)})
    change = F.col("_r.recent_mean") - F.col("_o.all_mean")
    return out.select("risk_zone", "days", (F.col("days") * 100 / F.col("_o.days")).alias("pct"), change.alias("recent_change"),
                      F.when(change > TREND_CUT, "increasing").when(change < -TREND_CUT, "decreasing").otherwise("stable").alias("trend"))


def count_pivot(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(col, list(values)).count().na.fill(0)


def tone_scorecard(df: DataFrame, tone: str = "compound", key: str = "Symbol") -> DataFrame:
    c = F.col(tone)
    pos, neg = F.greatest(c, F.lit(0.0)), F.greatest(-c, F.lit(0.0))
    out = df.groupBy(key).agg(
        F.round(F.avg(c), 4).alias("compound_mean"), F.round(F.stddev_samp(c), 4).alias("compound_std"), F.round(F.min(c), 4).alias("compound_min"),
        F.round(F.max(c), 4).alias("compound_max"), F.count(c).alias("compound_count"), F.round(F.avg(pos), 4).alias("pos_mean"), F.round(F.sum(pos), 4).alias("pos_sum"),
        F.round(F.avg(neg), 4).alias("neg_mean"), F.round(F.sum(neg), 4).alias("neg_sum"))
    m = F.col("compound_mean")
    return out.withColumns({
        "weighted_sentiment": m * F.log1p("compound_count") * 0.1,
        "sentiment_risk": F.when(m < -0.1, 1.0).when(m < 0.1, 0.5).otherwise(0.0),
        "sentiment_volatility": F.coalesce("compound_std", F.lit(0.0)),
        "composite_sentiment": 0.6 * m + 0.2 * F.col("pos_mean") - 0.2 * F.col("neg_mean"),
    })


def scenario_timeline(df: DataFrame) -> DataFrame:
    out = df.groupBy("Date").agg(F.coalesce(F.avg("Risk_Probability"), F.lit(0.0)).alias("Risk_Probability"),
                                 F.coalesce(F.avg("Drawdown"), F.lit(0.0)).alias("Drawdown"), F.avg("Risk_Label").alias("Warning_Rate"))
    return out.withColumn("Drawdown_pct", F.least("Drawdown", F.lit(0.0)))


def completeness(df: DataFrame, label: str, prob: str) -> DataFrame:
    """Cell and row completeness, confidence buckets and prediction shares in one pass."""
    n = F.count(F.lit(1))
    whole = F.lit(True)
    for c in df.columns:
        whole = whole & F.col(c).isNotNull()
    cells = sum(F.count(c) for c in df.columns[1:]) + F.count(df.columns[0])
    p = F.col(prob)
    return df.agg(
        n.alias("records"), (100 - cells * 100 / (n * len(df.columns))).alias("missing_pct"), (F.count_if(whole) * 100 / n).alias("complete_pct"),
        F.count_if(p > CONFIDENCE_CUTS[1]).alias("high_confidence"), F.count_if(p.between(*CONFIDENCE_CUTS)).alias("medium_confidence"),
        F.count_if(p < CONFIDENCE_CUTS[0]).alias("low_confidence"), (F.avg(label) * 100).alias("high_risk_pct"), F.avg(p).alias("avg_probability"))


def grade(auc: Column) -> Column:
    return F.when(auc > 0.9, "Excellent").when(auc > 0.8, "Good").when(auc > 0.7, "Fair").otherwise("Poor")


def missing_ranking(df: DataFrame, top: int = 15) -> DataFrame:
    shares = null_shares(df).withColumn("missing_rate", F.col("missing") / F.col("total"))
    return shares.orderBy(F.desc("missing_rate"), "column").limit(top)


def describe_numeric(df: DataFrame) -> DataFrame:
    cols = numeric_columns(df)
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).cast("double").alias("mean"), F.stddev_samp(c).alias("std"),
                            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(f"_{i}") for i, c in enumerate(cols)])
    return one.select(F.inline(F.array(*[f"_{i}" for i in range(len(cols))])))


def label_distribution(df: DataFrame, label: str = "Risk_Label") -> DataFrame:
    total = df.agg(F.count(label).alias("n")).scalar()
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("days")).withColumn("share", F.col("days") / total)


def recent_versus_all(df: DataFrame, label: str = "Risk_Label", n: int = 30, order: Sequence[str] = ("Date", "Symbol")) -> DataFrame:
    recent = df.orderBy(*[F.desc(c) for c in order]).limit(n).agg(F.avg(label).alias("recent_risk"), F.count_if(F.col(label) == 1).alias("recent_risky_rows"))
    return recent.withColumn("overall_risk", df.agg(F.avg(label)).scalar())


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation of every pair of columns over the rows where both are set, in one aggregation."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(a, b).alias("corr")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[f"_{i}" for i in range(len(pairs))])))


def label_correlations(df: DataFrame, cols: Sequence[str], label: str = "Risk_Label", top: int = 15) -> DataFrame:
    one = df.agg(*[F.struct(F.lit(c).alias("feature"), F.abs(correlation(c, label)).alias("importance")).alias(f"_{i}") for i, c in enumerate(cols)])
    out = one.select(F.inline(F.array(*[f"_{i}" for i in range(len(cols))])))
    return out.where(F.col("importance").isNotNull()).orderBy(F.desc("importance"), "feature").limit(top)


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width counts; the last bin includes the upper end, values outside are left out.

    They are left out after counting: a filter on the values would be pushed below what computes them and compute them again.
    """
    b = F.least(F.floor((F.col(col) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counted = df.select(F.when(F.col(col).between(low, high), b).alias("bin")).groupBy("bin").agg(F.count("bin").alias("n"))
    return counted.where("n > 0")


def quartiles(df: DataFrame, col: str) -> DataFrame:
    return exact_quantiles(df, {"q1": (col, 0.25), "median": (col, 0.5), "q3": (col, 0.75)})


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.agg(slope(y, x).alias("slope"), (F.avg(y) - slope(y, x) * F.avg(x)).alias("intercept"))


def monitor_summary(df: DataFrame, symbols: DataFrame, tone: str, key: str = "Symbol") -> DataFrame:
    """One row per requested symbol, also for those without articles."""
    from riskloom.operators.scoring import indicator, monitor_label

    agg = df.groupBy(key).agg(F.avg(tone).alias("m"), F.count(tone).alias("article_count"))
    out = symbols.join(agg, key, "left")
    m = F.col("m")
    return out.select(key, F.round(F.coalesce(m, F.lit(0.0)), 3).alias("average_sentiment"), F.coalesce("article_count", F.lit(0)).alias("article_count"),
                      monitor_label(m).alias("sentiment_label"), indicator(m).alias("risk_indicator"))


def mean_vectors(df: DataFrame, vec: str = "embedding", keys: Sequence[str] = ("Symbol", "Date")) -> DataFrame:
    """Mean vector per key, of any length. Element sums combine map-side. Vectors of one key that differ in length
    are an error; rows without a vector count as articles only."""
    long = df.select(*keys, F.posexplode_outer(vec).alias("_i", "_v"))
    per = long.groupBy(*keys, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    first = F.max(F.when(F.col("_i") == 0, F.col("_n")))
    even = F.max(F.when(F.col("_i").isNotNull(), F.col("_n"))) == F.min(F.when(F.col("_i").isNotNull(), F.col("_n")))
    cells = F.sort_array(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "_m"))))
    out = per.groupBy(*keys).agg(cells.alias("_cells"), even.alias("_even"), (F.coalesce(first, F.lit(0)) + F.coalesce(F.max(F.when(F.col("_i").isNull(), F.col("_n"))), F.lit(0))).alias("article_count"))
    means = F.transform("_cells", lambda c: c["_m"])
    vector = F.when(F.coalesce("_even", F.lit(True)), means).otherwise(F.raise_error(F.lit("vectors of one key differ in length")).cast("array<double>"))
    return out.select(*keys, F.when(F.size("_cells") > 0, vector).alias("mean_vector"), "article_count")


def run_comparison(runs: DataFrame, metrics: Sequence[str], name: str = "model") -> tuple[DataFrame, DataFrame]:
    """Metrics in long form, and the best model per metric."""
    long = runs.unpivot([name], list(metrics), "metric", "value")
    best = long.groupBy("metric").agg(F.max_by(name, F.struct("value", name)).alias("best_model"), F.max("value").alias("best_value"))
    return long, best


def market_breadth(df: DataFrame, price: str = "Close", average: str = "MA_50", ret: str = "Returns") -> DataFrame:
    above = flag(F.col(price) > F.col(average))
    return df.groupBy("Date").agg(F.stddev_samp(ret).alias("Market_Volatility"), F.avg(ret).alias("Market_Return"), F.avg(above).alias("Market_Trend"))


def numeric_means(df: DataFrame, keys: Sequence[str] = ("Symbol", "Date"), cols: Sequence[str] | None = None) -> DataFrame:
    cols = cols or [c for c in numeric_columns(df) if c not in keys]
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def summarise(df: DataFrame, aggs: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
