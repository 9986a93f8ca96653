"""Filters, null handling and schema-driven projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.quantiles import exact_quantiles, one_row
from riskloom.functions.series import SYMBOL_DAY, Series
from riskloom.session import checkpoint

# Neutral fills, keyword lists and group rules.
NEUTRAL_NEWS = {"news_count": 0, "news_sentiment_mean": 0.0, "news_sentiment_std": 0.0, "news_sentiment_intensity": 0.0}
ZERO_FILL_WORDS = ("sentiment", "news", "count", "ratio", "volume")
IDENTIFIERS = ("Symbol", "Date", "symbol", "date", "Risk_Label", "Risk_Score")
GROUP_RULES = [
    ("price_features", "close|open|high|low|price|return"),
    ("volume_features", "volume"),
    ("technical_indicators", "rsi|macd|ma_|bb_|volatility"),
    ("fundamental_ratios", "pe_ratio|roe|debt|beta|pb_ratio"),
    ("sentiment_features", "sentiment"),
    ("news_features", "news"),
    ("sec_features", "mda|sec|risk_factors"),
    ("market_features", "market"),
    ("lag_features", "lag_|rolling_mean"),
    ("derived_features", "divergence|alignment|regime|crisis"),
    ("date_features", "year|month|quarter|day|week"),
]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def require(df: DataFrame, *cols: str) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present: {df.columns}")
    return df


def parse_utc(c: Column) -> Column:
    """Text to a zone-free UTC timestamp; null when it cannot be read. No zone means UTC."""
    has_zone = c.rlike(r"(Z|[+-]\d{2}(:?\d{2})?)$") & c.rlike(r":")
    instant = F.try_to_timestamp(F.when(has_zone, c).otherwise(F.concat(c, F.lit("+00:00"))))
    since = F.make_dt_interval(secs=(F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(18,6)"))
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + since


def normalise_datetime(df: DataFrame, col: str, drop_bad: bool = True) -> DataFrame:
    out = require(df, col).withColumn(col, parse_utc(F.col(col)))
    return out.where(F.col(col).isNotNull()) if drop_bad else out


def date_range(df: DataFrame, start: str, end: str, date: str = "Date") -> DataFrame:
    return df.where(F.col(date).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def only_symbols(df: DataFrame, symbols: Sequence[str], key: str = "Symbol") -> DataFrame:
    """Rows of the listed symbols; everything when none of them occurs."""
    if not symbols:
        return df
    hit = F.col(key).isin(list(symbols))
    none = F.coalesce(df.agg((F.max(hit.cast("int")) == 0).alias("none")).scalar(), F.lit(True))
    return df.where(hit | none)


def null_shares(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, total) in one pass."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), (F.col("total") - F.col(f"n_{i}")).alias("missing"), F.col("total")) for i, c in enumerate(cols)])
    return one.select(F.inline(pairs))


def drop_sparse_columns(df: DataFrame, limit: float = 0.5, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose missing share exceeds ``limit`` (one row per column reaches the driver)."""
    sparse = [r["column"] for r in null_shares(df).where(F.col("missing") > F.col("total") * limit).collect()]
    return df.drop(*[c for c in sparse if c not in keep])


def clear_infinities(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    doubles = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    bad = [float("inf"), float("-inf")]
    return df.withColumns({c: F.when(~F.col(c).isin(bad) & ~F.isnan(c), F.col(c)) for c in doubles})


def zero_fill_by_name(df: DataFrame, words: Sequence[str] = ZERO_FILL_WORDS) -> DataFrame:
    hit = [c for c in numeric_columns(df) if any(w in c.lower() for w in words)]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in hit})


def median_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    df = checkpoint(df)
    mid = one_row(exact_quantiles(df, {f"m{i}": (c, 0.5) for i, c in enumerate(cols)}))
    return df.withColumn("_mid", mid).withColumns({c: F.coalesce(F.col(c), F.col(f"_mid.m{i}")) for i, c in enumerate(cols)}).drop("_mid")


def neutral_fill(df: DataFrame, values: Mapping[str, float] = NEUTRAL_NEWS) -> DataFrame:
    return df.na.fill({k: v for k, v in values.items() if k in df.columns})


def fill_both_ways(df: DataFrame, cols: Sequence[str], s: Series = SYMBOL_DAY) -> DataFrame:
    """Last known value, else the next known one, inside the series."""
    return df.withColumns({c: F.coalesce(s.fill_forward(c), s.fill_back(c)) for c in cols})


def interpolate(df: DataFrame, cols: Sequence[str], s: Series = SYMBOL_DAY) -> DataFrame:
    """Linear by row position; a trailing gap keeps the last value, a leading gap stays null."""
    df = df.withColumn("_n", F.row_number().over(s.w))
    staged = {}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.struct(F.col("_n").alias("n"), F.col(c).cast("double").alias("v")))
        staged[f"_p_{c}"] = F.last(at, ignorenulls=True).over(s.so_far)
        staged[f"_q_{c}"] = F.last(at, ignorenulls=True).over(s.backwards)
    df = df.withColumns(staged)

    def blend(c: str) -> Column:
        p, q = F.col(f"_p_{c}"), F.col(f"_q_{c}")
        step = F.try_divide(F.col("_n") - p["n"], q["n"] - p["n"])
        between = p["v"] + (q["v"] - p["v"]) * step
        return F.coalesce(F.col(c).cast("double"), between, p["v"])

    return df.withColumns({c: blend(c) for c in cols}).drop("_n", *staged)


def winsorise(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    wanted = {f"{side}{i}": (c, p) for i, c in enumerate(cols) for side, p in (("lo", low), ("hi", high))}
    df = checkpoint(df)
    df = df.withColumn("_cut", one_row(exact_quantiles(df, wanted)))
    return df.withColumns({
        c: F.when(F.col(c) > F.col(f"_cut.hi{i}"), F.col(f"_cut.hi{i}")).when(F.col(c) < F.col(f"_cut.lo{i}"), F.col(f"_cut.lo{i}")).otherwise(F.col(c))
        for i, c in enumerate(cols)
    }).drop("_cut")


def select_features(df: DataFrame, groups: Mapping[str, Sequence[str]] | None = None, exclude: Sequence[str] = IDENTIFIERS) -> list[str]:
    """Numeric model inputs: from feature groups without the date group, else every numeric column."""
    numeric = numeric_columns(df)
    if groups:
        listed = [c for g, cs in groups.items() if g != "date_features" for c in cs]
        numeric = [c for c in listed if c in numeric]
    return [c for c in dict.fromkeys(numeric) if c not in exclude]


def ablate(df: DataFrame, drop: Sequence[str] = (), keep: Sequence[str] = (), where: Mapping[str, Sequence] | None = None) -> DataFrame:
    for c, allowed in (where or {}).items():
        df = df.where(F.col(c).isin(list(allowed)))
    if keep:
        df = df.select(*[c for c in df.columns if c in keep])
    return df.drop(*drop)


def choose_probability(df: DataFrame, candidates: Sequence[str] = ("Risk_Probability", "Risk_Score"), label: str = "Risk_Label", s: Series = SYMBOL_DAY) -> DataFrame:
    """First present candidate (coalesced over suffixed twins), else the label smoothed over three rows."""
    found = [c for base in candidates for c in (base, f"{base}_x", f"{base}_y", f"{base}_pred") if c in df.columns]
    if found:
        return df.withColumn("Risk_Probability", F.coalesce(*[F.col(c).cast("double") for c in found]))
    return require(df, label).withColumn("Risk_Probability", F.avg(label).over(s.last(3)))


def align_features(df: DataFrame, order: Sequence[str], strict: bool = False) -> DataFrame:
    if strict:
        require(df, *order)
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in order])


def bounded_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest keyed hash: the same rows on every run and layout."""
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))).cast("binary"))
    return df.orderBy(h, *key).limit(n)


def canonical_keys(df: DataFrame) -> DataFrame:
    names = {"symbol": "Symbol", "ticker": "Symbol"}
    df = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns and v not in df.columns})
    for c in ("Date", "date", "published_date", "filing_date"):
        if c in df.columns:
            return df.withColumn("Date", F.to_date(c)).drop(*[x for x in (c,) if x != "Date"])
    return df


def group_of(name: Column) -> Column:
    """Feature group by the first rule whose keywords occur in the name."""
    low, rule = F.lower(name), None
    for group, pattern in GROUP_RULES:
        hit = low.rlike(pattern)
        if group == "sentiment_features":
            hit = hit & ~low.contains("news")
        rule = F.when(hit, group) if rule is None else rule.when(hit, group)
    return rule.otherwise("other")


def feature_profile(df: DataFrame) -> DataFrame:
    """Columns, missing values and mean level per feature group, from one aggregation."""
    cols = numeric_columns(df)
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)], *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("rows"), (F.col("rows") - F.col(f"n_{i}")).alias("missing"), F.col(f"m_{i}").cast("double").alias("mean")) for i, c in enumerate(cols)])
    return one.select(F.inline(each)).groupBy(group_of(F.col("feature")).alias("feature_group")).agg(
        F.count(F.lit(1)).alias("features"), F.sum("missing").alias("missing"), F.sum("rows").alias("cells"), F.avg("mean").alias("mean_level"))


def valid_targets(df: DataFrame, target: str, carry: Sequence[str] = ("Symbol", "Date")) -> DataFrame:
    rest = [c for c in df.columns if c not in carry and c != target]
    return df.where(F.col(target).isNotNull()).select(*carry, *rest, target)


def latest_per_group(df: DataFrame, key: str, date: str, tie: Sequence[str] = ()) -> DataFrame:
    """Latest row of each group by partial aggregation, so a hot group shrinks before the shuffle."""
    order = F.struct(date, *tie)
    row = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(row, order).alias("_r")).select(key, "_r.*")


def keep_one(df: DataFrame, by: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per ``by``: the first or last by a unique order. Aggregates map-side, so copies of
    one row never meet in a single task."""
    rest = F.struct(*[c for c in df.columns if c not in by])
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(*by).agg(pick(rest, F.struct(*order)).alias("_r")).select(*by, "_r.*").select(*df.columns)


def densify_days(df: DataFrame, cols: Sequence[str], s: Series = SYMBOL_DAY) -> DataFrame:
    """Every calendar day between the first and last day of a series, filled forward then back."""
    key, date = s.keys[0], s.order[0]
    days = df.groupBy(key).agg(F.min(date).alias("a"), F.max(date).alias("b")).select(key, F.explode(F.sequence("a", "b")).alias(date))
    return fill_both_ways(days.join(df.select(key, date, *cols), [key, date], "left"), cols, s)


def head(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def unpivot_values(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(keys), list(cols), name, value)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """Top ``n`` per group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
