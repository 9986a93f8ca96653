"""Forward-looking labels and regimes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.quantiles import exact_quantiles, one_row
from riskloom.functions.series import SYMBOL_DAY, Series
from riskloom.session import checkpoint


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null (``least`` and ``greatest`` would skip it)."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def label_single_step(df: DataFrame, ret: str = "Returns", vol_cut: float = 0.3, ret_cut: float = -0.1, span: int = 5,
                      s: Series = SYMBOL_DAY) -> DataFrame:
    """Risk from the return ``span`` rows ahead and the volatility of the next ``span`` rows."""
    ahead = s.rows(1, span)
    df = df.withColumns(
        {"Forward_Return": s.lead(ret, span), "Forward_Volatility": s.full(span, F.stddev_samp, ret, frame=ahead)}
    )
    known = F.col("Forward_Return").isNotNull() & F.col("Forward_Volatility").isNotNull()
    risky = known & ((F.col("Forward_Volatility") > vol_cut) | (F.col("Forward_Return") < ret_cut))
    vol_part = clip(F.col("Forward_Volatility") / vol_cut, 0.0, 2.0) / 2
    ret_part = clip(F.col("Forward_Return") / ret_cut, 0.0, 2.0) / 2
    df = df.withColumns(
        {
            "Risk_Label": flag(risky),
            "Risk_Score": F.when(known, clip((vol_part + ret_part) / 2, 0.0, 1.0)).otherwise(F.lit(0.0)),
        }
    )
    return df.withColumns({c: F.when(known, F.col(c)).otherwise(F.lit(0.0)) for c in ("Forward_Return", "Forward_Volatility")})


def label_mean_step(df: DataFrame, ret: str = "Returns", vol_cut: float = 0.02, ret_cut: float = -0.05, span: int = 5,
                    tail: str = "zero", s: Series = SYMBOL_DAY) -> DataFrame:
    """Risk from mean and spread of the next ``span`` returns.

    ``tail`` decides rows without a full future: label 0, or null.
    """
    ahead = s.rows(1, span)
    df = df.withColumns(
        {
            "Future_Return": s.full(span, F.avg, ret, frame=ahead),
            "Future_Volatility": s.full(span, F.stddev_samp, ret, frame=ahead),
        }
    )
    risky = (F.col("Future_Volatility") > vol_cut) | (F.col("Future_Return") < ret_cut)
    label = flag(risky)
    if tail == "null":
        label = F.when(F.col("Future_Return").isNotNull(), label)
    vol_part = clip(F.col("Future_Volatility") / vol_cut, 0.0, 2.0) / 2
    ret_part = clip(F.col("Future_Return") / ret_cut, 0.0, 2.0) / 2
    score = clip((vol_part + ret_part) / 2, 0.0, 1.0)
    return df.withColumns({"Risk_Label": label, "Risk_Score": score if tail == "null" else F.coalesce(score, F.lit(0.0))})


def forward_returns(df: DataFrame, price: str = "Close", steps: Sequence[int] = (1, 5, 20), s: Series = SYMBOL_DAY) -> DataFrame:
    return df.withColumns({f"Forward_Return_{k}d": F.try_divide(s.lead(price, k), F.col(price)) - 1 for k in steps})


def forward_drawdown(df: DataFrame, price: str = "Close", spans: Sequence[int] = (5, 10, 20), s: Series = SYMBOL_DAY) -> DataFrame:
    """Deepest fall of the next k rows, measured from the first of them."""
    first = s.lead(price, 1)
    return df.withColumns(
        {f"Max_Drawdown_{k}d": F.try_divide(s.full(k, F.min, price, frame=s.rows(1, k)) - first, first) for k in spans}
    )


def volatility_regime(df: DataFrame, ret: str = "Returns", span: int = 30, low: float = 0.33, high: float = 0.66,
                      s: Series = SYMBOL_DAY) -> DataFrame:
    """low / moderate / high volatility by global quantile cuts; unknown counts as moderate."""
    df = checkpoint(df.withColumn("regime_volatility", s.std(ret, span, at_least=max(5, span // 3))))
    cuts = one_row(exact_quantiles(df, {"lo": ("regime_volatility", low), "hi": ("regime_volatility", high)}))
    v = F.col("regime_volatility")
    regime = (
        F.when(v >= F.col("_cuts.hi"), "high_volatility").when(v <= F.col("_cuts.lo"), "low_volatility").otherwise("moderate_volatility")
    )
    return df.withColumn("_cuts", cuts).withColumn("regime", regime).drop("_cuts")


def ensure_returns(df: DataFrame, ret: str = "Returns", s: Series = SYMBOL_DAY) -> DataFrame:
    """Derive returns from the first price column present; the first row of a series gets 0."""
    if ret in df.columns:
        return df
    for price in ("Close", "Adj Close", "close", "adj_close", "price"):
        if price in df.columns:
            return df.withColumn(ret, F.coalesce(s.change(price), F.lit(0.0)))
    raise ValueError(f"no {ret} column and no price column to derive it from")


def quantile_bins(df: DataFrame, col: str, bins: int = 10, name: str = "bin") -> DataFrame:
    """Right-closed bins between value quantiles; equal edges collapse into one bin."""
    df = checkpoint(df)
    cuts = one_row(exact_quantiles(df, {f"q{i}": (col, i / bins) for i in range(bins + 1)}))
    staged = df.withColumn("_e", cuts).withColumn("_edges", F.array_distinct(F.array(*[F.col(f"_e.q{i}") for i in range(bins + 1)])))
    below = F.size(F.filter("_edges", lambda e: e < F.col(col)))
    return staged.withColumn(name, F.when(F.col(col).isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("_e", "_edges")


def market_daily(df: DataFrame, ret: str = "Returns", date: str = "Date", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per day: cross-sectional spread and mean of returns, and more if asked."""
    aggs = {"Market_Volatility": F.stddev_samp(ret), "Market_Return": F.avg(ret), **(extra or {})}
    return df.groupBy(date).agg(*[e.alias(n) for n, e in aggs.items()])


def market_regimes(daily: DataFrame, news: str | None = None, span: int = 200, date: str = "Date") -> DataFrame:
    """Bull, high-volatility and crisis flags on the daily market table (a calendar of rows)."""
    s = Series((), (date,))
    daily = daily.withColumn("market_return_ma200", s.mean("Market_Return", span))
    wanted = [F.percentile("Market_Volatility", F.lit(0.5)).alias("vol_mid"), F.percentile("Market_Volatility", F.lit(0.95)).alias("vol_top"),
              F.percentile("Market_Return", F.lit(0.05)).alias("ret_low")]
    if news:
        wanted.append(F.percentile(news, F.lit(0.95)).alias("news_top"))
    cuts = one_row(daily.agg(*wanted))
    hits = flag(F.col("Market_Volatility") > F.col("_c.vol_top")) + flag(F.col("Market_Return") < F.col("_c.ret_low"))
    if news:
        hits = hits + flag(F.col(news) > F.col("_c.news_top"))
    return (
        daily.withColumn("_c", cuts)
        .withColumns(
            {
                "market_bull": flag(F.col("Market_Return") > F.col("market_return_ma200")),
                "market_high_volatility": flag(F.col("Market_Volatility") > F.col("_c.vol_mid") * 1.5),
                "crisis_period": flag(hits >= 2),
            }
        )
        .drop("_c")
    )


def regime_spans(daily: DataFrame, flag_col: str, date: str = "Date") -> DataFrame:
    """Day intervals [d, next day with data) on which the flag is set."""
    w = Window.orderBy(date)
    return (
        daily.withColumn("span_end", F.lead(date).over(w))
        .where((F.col(flag_col) == 1) & F.col("span_end").isNotNull())
        .select(F.col(date).alias("span_start"), "span_end")
    )
