"""Rule scores, calendar flags, cross-source flags and fusion of feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.quantiles import exact_quantiles, one_row
from riskloom.functions.tone import row_mean
from riskloom.operators.clean import numeric_columns
from riskloom.operators.joins import align_text_frame
from riskloom.operators.labels import clip, flag
from riskloom.session import checkpoint

# Rule tables (first lower bound exceeded wins) and weights.
RISK_LEVELS = [(0.8, "Very High"), (0.6, "High"), (0.4, "Medium"), (0.2, "Low")]
TONE_LEVELS = [(0.2, "Positive"), (0.05, "Slightly Positive"), (-0.05, "Neutral"), (-0.2, "Slightly Negative")]
USER_LEVELS = [(0.3, "Strongly Positive"), (0.1, "Moderately Positive"), (-0.1, "Neutral"), (-0.3, "Moderately Negative")]
EARNINGS_MONTHS = [1, 4, 7, 10]
SIGMOID_SLOPE = 3.5
COMPOSITE_WEIGHTS = {"sentiment": 0.3, "technical": 0.3, "volatility": 0.25, "volume": 0.15}
SEC_SHARE = 0.3


def first_over(c: Column, rules: Sequence[tuple[float, str]], otherwise: str) -> Column:
    rule = F.when(c > rules[0][0], rules[0][1])
    for cut, name in rules[1:]:
        rule = rule.when(c > cut, name)
    return rule.when(c.isNotNull(), otherwise)


def risk_level(c: Column) -> Column:
    return first_over(c, RISK_LEVELS, "Very Low")


def tone_level(c: Column) -> Column:
    return first_over(c, TONE_LEVELS, "Negative")


def user_level(c: Column) -> Column:
    return first_over(c, USER_LEVELS, "Strongly Negative")


def verbal_level(c: Column) -> Column:
    return F.when(c > 0.2, "Very Positive").when(c > 0.05, "Positive").when(c < -0.2, "Very Negative").when(c < -0.05, "Negative").otherwise("Neutral")


def monitor_label(c: Column) -> Column:
    return F.when(c.isNull(), "No Data").when(c > 0.05, "Positive").when(c < -0.05, "Negative").otherwise("Neutral")


def indicator(c: Column) -> Column:
    return F.when(c.isNull(), "Unknown").when(c < -0.2, "High").when(c > 0.2, "Low").otherwise("Medium")


def date_parts(df: DataFrame, date: str = "Date") -> DataFrame:
    d = F.col(date)
    end = d == F.last_day(d)
    return df.withColumns({
        "year": F.year(d), "month": F.month(d), "quarter": F.quarter(d), "day_of_year": F.dayofyear(d), "week_of_year": F.weekofyear(d), "day_of_week": F.weekday(d),
        "is_month_end": end.cast("int"), "is_quarter_end": (end & (F.month(d) % 3 == 0)).cast("int"),
    })


def calendar_flags(df: DataFrame, date: str = "Date") -> DataFrame:
    d = F.col(date)
    left = F.datediff(F.last_day(d), d)
    return df.withColumns({
        "is_monday": (F.weekday(d) == 0).cast("int"), "is_friday": (F.weekday(d) == 4).cast("int"), "is_january": (F.month(d) == 1).cast("int"),
        "is_december": (F.month(d) == 12).cast("int"), "earnings_season": F.month(d).isin(EARNINGS_MONTHS).cast("int"), "days_to_month_end": left,
        "end_of_month": (left <= 3).cast("int"),
    })


def cross_source_flags(df: DataFrame, tone: str = "news_sentiment_mean", change: str = "Price_Change_1d", count: str = "news_count", vol: str = "Volatility_20d",
                       pe: str = "PE_Ratio", filing: str = "mda_sentiment") -> DataFrame:
    """Flags that compare news tone with price, volatility, valuation and filings."""
    df = checkpoint(df)
    t = F.col(tone)
    mid = exact_quantiles(df, {"m": (pe, 0.5)}).scalar()
    gap = F.abs(F.col(filing) - t)
    return df.withColumns({
        "sentiment_price_divergence": flag((t > 0) & (F.col(change) < 0)) + flag((t < 0) & (F.col(change) > 0)),
        "news_volatility_ratio": F.col(count) / (F.col(vol) + 1e-6),
        "pe_sentiment_risk": flag((F.col(pe) > mid) & (t < -0.1)),
        "sec_news_sentiment_diff": gap,
        "sentiment_alignment": flag(gap < 0.2),
    })


def price_ratios(df: DataFrame, book: str | None = None) -> DataFrame:
    cols = {"High_Low_Ratio": F.try_divide("High", "Low"), "Close_to_High": F.try_divide("Close", "High")}
    if book:
        cols["PB_Ratio"] = F.try_divide("Close", book)
    return df.withColumns(cols)


def weighted_tone(df: DataFrame, news: str, filing: str) -> DataFrame:
    n, f = F.col(news), F.col(filing)
    return df.withColumns({"combined_sentiment_weighted": (1 - SEC_SHARE) * n + SEC_SHARE * f, "sentiment_divergence": F.abs(n - f)})


def composite_risk(df: DataFrame) -> DataFrame:
    """Four additive rule parts blended and clipped to 0..1; a part uses the columns present."""
    cuts = {n: (c, p) for n, c, p in (("div", "sentiment_divergence", 0.8), ("park", "parkinson_volatility", 0.9)) if c in df.columns}
    if cuts:
        df = checkpoint(df)
        df = df.withColumn("_cut", one_row(exact_quantiles(df, cuts)))
    rules = {
        "sentiment": [
            ("sentiment_extreme_negative", lambda c: c * 0.3),
            ("sentiment_divergence", lambda c: flag(c > F.col("_cut.div")) * 0.2),
            ("sentiment_momentum_1d", lambda c: flag(c < -0.1) * 0.3),
            ("relative_sentiment", lambda c: flag(c < -0.2) * 0.2),
        ],
        "technical": [
            ("price_near_support", lambda c: c * 0.3),
            ("sma_bear", lambda c: c * 0.4),
            ("price_acceleration", lambda c: flag(c < -0.01) * 0.3),
        ],
        "volatility": [
            ("high_volatility_rank", lambda c: c * 0.5),
            ("parkinson_volatility", lambda c: flag(c > F.col("_cut.park")) * 0.5),
        ],
        "volume": [("price_vwap_deviation", lambda c: flag(F.abs(c) > 0.05) * 0.5)],
    }
    parts = {}
    for part, terms in rules.items():
        total = F.lit(0.0)
        for c, term in terms:
            if c in df.columns:
                total = total + F.coalesce(term(F.col(c)), F.lit(0.0))
        parts[f"{part}_risk_score"] = total
    df = df.withColumns(parts)
    blend = F.lit(0.0)
    for part, weight in COMPOSITE_WEIGHTS.items():
        blend = blend + F.col(f"{part}_risk_score") * weight
    return df.withColumn("composite_risk_score", clip(blend, 0.0, 1.0)).drop("_cut")


def sigmoid_risk(tone: Column) -> Column:
    return 1 / (1 + F.exp(SIGMOID_SLOPE * clip(tone, -1.0, 1.0)))


def combined_tone(filing: Column, news: Column) -> Column:
    return F.coalesce(row_mean(filing, news), news)


def model_tone_features(score: DataFrame, key: str = "Symbol") -> DataFrame:
    """Model inputs from a tone scorecard."""
    m, n = F.col("compound_mean"), F.col("compound_count")
    return score.select(
        key, m.alias("sentiment_compound"), F.col("sentiment_volatility"), F.col("pos_mean").alias("sentiment_positive"), F.col("neg_mean").alias("sentiment_negative"),
        F.abs(m).alias("sentiment_strength"), (F.col("pos_mean") - F.col("neg_mean")).alias("sentiment_bias"), F.log1p(n).alias("news_coverage"),
        flag(m < -0.1).alias("sentiment_risk_binary"), flag(m > 0.2).alias("sentiment_opportunity"), (m * n).alias("sentiment_momentum"))


def interactions(df: DataFrame, tone: str = "sentiment_compound") -> DataFrame:
    return df.withColumns({f"sentiment_{n}_interaction": F.col(tone) * F.col(c) for n, c in (("price", "Close"), ("volume", "Volume")) if c in df.columns})


def concat_fusion(tabular: DataFrame, text: DataFrame, keys: Sequence[str] = ("Symbol", "Date")) -> DataFrame:
    """Text features for the tabular rows, without columns the tabular side already has."""
    aligned = align_text_frame(tabular, text, keys)
    return aligned.drop(*[c for c in aligned.columns if c in tabular.columns and c not in keys])


def gated_fusion(tabular: DataFrame, text: DataFrame, keys: Sequence[str] = ("Symbol", "Date")) -> DataFrame:
    """Scale both sides by how strong the tabular signal is against the text signal."""
    tab = [c for c in numeric_columns(tabular) if c not in keys]
    txt = [c for c in numeric_columns(text) if c not in keys]
    both = tabular.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"t_{c}") for c in tab]).join(
        text.select(*keys, *[F.col(c).cast("double").alias(f"x_{c}") for c in txt]), list(keys), "left").na.fill(0.0)

    def norm(cols: list[str]) -> Column:
        return F.sqrt(sum((F.col(c) * F.col(c) for c in cols[1:]), F.col(cols[0]) * F.col(cols[0])))

    gate = norm([f"t_{c}" for c in tab]) / (norm([f"t_{c}" for c in tab]) + norm([f"x_{c}" for c in txt]) + 1e-6)
    both = both.withColumn("fusion_gate", clip(gate, 0.0, 1.0))
    g = F.col("fusion_gate")
    return both.select(*keys, "fusion_gate", *[(F.col(f"t_{c}") * g).alias(f"gated_tab_{c}") for c in tab], *[(F.col(f"x_{c}") * (1 - g)).alias(f"gated_text_{c}") for c in txt])


def binary_entropy(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(q * F.ln(q) + (1 - q) * F.ln(1 - q))
