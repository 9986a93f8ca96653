"""Windowed price, volume and tone indicators on a calendar series.

Every function takes a panel and returns it with added columns. All windows of one
series share a single exchange and sort, so chaining these costs one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.series import SYMBOL_DAY, Series

YEAR = math.sqrt(252.0)


def price_changes(df: DataFrame, price: str = "Close", steps: Sequence[int] = (1, 5, 20), s: Series = SYMBOL_DAY) -> DataFrame:
    return df.withColumns({"Returns": s.change(price), **{f"Price_Change_{k}d": s.change(price, k) for k in steps}})


def returns(df: DataFrame, price: str = "Close", s: Series = SYMBOL_DAY) -> DataFrame:
    return df.withColumn("Returns", s.change(price))


def volatility(df: DataFrame, col: str = "Returns", spans: Sequence[int] = (5, 10, 20, 30), s: Series = SYMBOL_DAY) -> DataFrame:
    return df.withColumns({f"Volatility_{k}d": s.std(col, k) * YEAR for k in spans})


def moving_averages(df: DataFrame, price: str = "Close", spans: Sequence[int] = (5, 10, 20, 50, 100, 200), s: Series = SYMBOL_DAY) -> DataFrame:
    df = df.withColumns({f"MA_{k}": s.mean(price, k) for k in spans})
    if {50, 200} <= set(spans):
        df = df.withColumn("golden_cross", F.coalesce((F.col("MA_50") > F.col("MA_200")).cast("int"), F.lit(0)))
    return df


def rsi(df: DataFrame, price: str = "Close", span: int = 14, s: Series = SYMBOL_DAY) -> DataFrame:
    """Simple-mean RSI: 100 when there is no loss, null when there is no movement."""
    move = F.coalesce(F.col(price) - s.lag(price), F.lit(0.0))
    staged = df.withColumns({"_gain": F.greatest(move, F.lit(0.0)), "_loss": F.greatest(-move, F.lit(0.0))})
    gain, loss = s.mean("_gain", span), s.mean("_loss", span)
    value = F.when(loss > 0, 100.0 - 100.0 / (1.0 + gain / loss)).when(gain > 0, F.lit(100.0))
    return staged.withColumn("RSI", value).drop("_gain", "_loss")


def ewm_mean(df: DataFrame, values: dict[str, tuple[str, int]], s: Series = SYMBOL_DAY, block: int = 256) -> DataFrame:
    """Bias-adjusted exponential means, ``name -> (column, span)``.

    The decayed sum is a running sum of ``x * decay**-i`` inside blocks of rows, plus what the
    earlier blocks carry in. Blocks nest in the series, so it all runs on one exchange.
    """
    decay = {n: 1.0 - 2.0 / (span + 1.0) for n, (_, span) in values.items()}
    staged = df.withColumn("_i", F.row_number().over(s.w) - 1).withColumns({"_blk": F.floor(F.col("_i") / block), "_j": F.col("_i") % block})
    inner = Window.partitionBy(*s.keys, "_blk").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*s.keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("_j") == block - 1
    sums, carried = {}, {}
    for n, (c, _) in values.items():
        up = F.pow(F.lit(decay[n]), -F.col("_j"))
        sums[f"_{n}_x"] = F.sum(F.coalesce(F.col(c), F.lit(0.0)) * up).over(inner)
        sums[f"_{n}_d"] = F.sum(F.when(F.col(c).isNotNull(), up).otherwise(0.0)).over(inner)
        for part in ("x", "d"):
            done = F.when(last, F.col(f"_{n}_{part}") * decay[n] ** (block - 1))
            carried[f"_{n}_{part}_c"] = _decayed_total(F.collect_list(done).over(earlier), decay[n] ** block)
    out = staged.withColumns(sums).withColumns(carried)

    def decayed(n: str, part: str) -> Column:
        d = F.lit(decay[n])
        return F.pow(d, F.col("_j")) * (F.col(f"_{n}_{part}") + d * F.col(f"_{n}_{part}_c"))

    out = out.withColumns({n: F.try_divide(decayed(n, "x"), decayed(n, "d")) for n in values})
    return out.select(*df.columns, *values)


def _decayed_total(blocks: Column, step: float) -> Column:
    return F.aggregate(blocks, F.lit(0.0), lambda acc, x: acc * step + x)


def macd(df: DataFrame, price: str = "Close", fast: int = 12, slow: int = 26, signal: int = 9, s: Series = SYMBOL_DAY) -> DataFrame:
    out = ewm_mean(df, {"ema_fast": (price, fast), "ema_slow": (price, slow)}, s)
    out = out.withColumn("MACD", F.col("ema_fast") - F.col("ema_slow"))
    out = ewm_mean(out, {"MACD_Signal": ("MACD", signal)}, s)
    return out.withColumn("MACD_Histogram", F.col("MACD") - F.col("MACD_Signal"))


def bollinger(df: DataFrame, price: str = "Close", span: int = 20, width: float = 2.0, s: Series = SYMBOL_DAY) -> DataFrame:
    mid, dev = s.mean(price, span), s.std(price, span)
    df = df.withColumns({"BB_Upper": mid + dev * width, "BB_Lower": mid - dev * width})
    return df.withColumn("BB_Position", F.try_divide(F.col(price) - F.col("BB_Lower"), F.col("BB_Upper") - F.col("BB_Lower")))


def volume_ratio(df: DataFrame, volume: str = "Volume", span: int = 20, s: Series = SYMBOL_DAY) -> DataFrame:
    df = df.withColumn("Volume_MA_20", s.mean(volume, span))
    return df.withColumn("Volume_Ratio", F.try_divide(F.col(volume), F.col("Volume_MA_20")))


def min_max_scaled(df: DataFrame, cols: Sequence[str], s: Series = SYMBOL_DAY) -> DataFrame:
    def scaled(c: str) -> Column:
        low, high = F.min(c).over(s.whole), F.max(c).over(s.whole)
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(0.0))

    return df.withColumns({f"{c}_Normalized": scaled(c) for c in cols})


def z_scores(df: DataFrame, cols: Sequence[str], s: Series = SYMBOL_DAY) -> DataFrame:
    def z(c: str) -> Column:
        dev = F.stddev_samp(c).over(s.whole)
        return F.when(dev > 0, (F.col(c) - F.avg(c).over(s.whole)) / dev).otherwise(F.lit(0.0))

    return df.withColumns({f"{c}_zscore": z(c) for c in cols})


def lags(df: DataFrame, cols: Sequence[str], steps: Sequence[int] = (1, 3, 7, 14), s: Series = SYMBOL_DAY) -> DataFrame:
    return df.withColumns({f"{c}_lag_{k}": s.lag(c, k) for c in cols for k in steps})


def rolling_means(df: DataFrame, cols: Sequence[str], spans: Sequence[int] = (7, 14, 30), s: Series = SYMBOL_DAY) -> DataFrame:
    return df.withColumns({f"{c}_rolling_mean_{k}": F.avg(c).over(s.last(k)) for c in cols for k in spans})


def rolling_corr(df: DataFrame, a: str, b: str, span: int = 20, name: str = "rolling_corr", s: Series = SYMBOL_DAY) -> DataFrame:
    return df.withColumn(name, s.corr(a, b, span))


def tone_volatility(df: DataFrame, tone: str, span: int = 7, s: Series = SYMBOL_DAY) -> DataFrame:
    return df.withColumn("sentiment_volatility", F.stddev_samp(tone).over(s.last(span)))


def tone_indicators(df: DataFrame, tone: str = "news_sentiment_mean", dev: str = "news_sentiment_std", count: str = "news_count",
                    s: Series = SYMBOL_DAY) -> DataFrame:
    base = tone.removesuffix("_mean")
    df = df.withColumns({f"{base}_ma{k}": F.avg(tone).over(s.last(k)) for k in (7, 30)})
    return df.withColumns(
        {
            f"{base}_trend": F.col(f"{base}_ma7") - F.col(f"{base}_ma30"),
            "sentiment_volatility_ma7": F.avg(dev).over(s.last(7)),
            "news_volume_ma7": F.avg(count).over(s.last(7)),
            "high_news_volume": F.coalesce((F.col(count) > F.avg(count).over(s.whole) * 2).cast("int"), F.lit(0)),
        }
    )


def change_since_previous(df: DataFrame, col: str, name: str, s: Series) -> DataFrame:
    return df.withColumn(name, F.col(col) - s.lag(col))


def tone_momentum(df: DataFrame, tone: str, steps: Sequence[int] = (1, 3, 7), s: Series = SYMBOL_DAY) -> DataFrame:
    return df.withColumns({f"sentiment_momentum_{k}d": s.change(tone, k) for k in steps})


def tone_spread(df: DataFrame, tone: str, spans: Sequence[int] = (7, 30), s: Series = SYMBOL_DAY) -> DataFrame:
    return df.withColumns({f"sentiment_volatility_{k}d": s.std(tone, k) for k in spans})


def tone_extremes(df: DataFrame, tone: str, span: int = 30, low: float = 0.1, high: float = 0.9, s: Series = SYMBOL_DAY) -> DataFrame:
    def at(p: float) -> Column:
        return s.full(span, lambda c: F.percentile(c, F.lit(p)), tone)

    df = df.withColumns({"_q_hi": at(high), "_q_lo": at(low)})
    return df.withColumns(
        {
            "sentiment_extreme_positive": F.coalesce((F.col(tone) > F.col("_q_hi")).cast("int"), F.lit(0)),
            "sentiment_extreme_negative": F.coalesce((F.col(tone) < F.col("_q_lo")).cast("int"), F.lit(0)),
        }
    ).drop("_q_hi", "_q_lo")


def rolling_slope(df: DataFrame, col: str, span: int, name: str, s: Series = SYMBOL_DAY) -> DataFrame:
    """Least-squares slope per row over the last ``span`` rows."""
    return (
        df.withColumn("_t", F.row_number().over(s.w).cast("double"))
        .withColumn(name, s.full(span, F.regr_slope, col, "_t"))
        .drop("_t")
    )


def parkinson(df: DataFrame, high: str = "High", low: str = "Low", span: int = 20, s: Series = SYMBOL_DAY) -> DataFrame:
    spread = F.ln(F.try_divide(F.col(high), F.col(low)))
    return df.withColumn("_sq", spread * spread).withColumn("parkinson_volatility", F.sqrt(252.0 * s.mean("_sq", span))).drop("_sq")


def acceleration(df: DataFrame, price: str = "Close", s: Series = SYMBOL_DAY) -> DataFrame:
    return df.withColumn("_r", s.change(price)).withColumn("price_acceleration", s.change("_r")).drop("_r")


def support_resistance(df: DataFrame, price: str = "Close", high: str = "High", low: str = "Low", span: int = 20,
                       s: Series = SYMBOL_DAY) -> DataFrame:
    df = df.withColumns({"resistance_level": s.full(span, F.max, high), "support_level": s.full(span, F.min, low)})
    return df.withColumns(
        {
            "price_near_resistance": F.coalesce((F.try_divide(F.col(price), F.col("resistance_level")) > 0.98).cast("int"), F.lit(0)),
            "price_near_support": F.coalesce((F.try_divide(F.col(price), F.col("support_level")) < 1.02).cast("int"), F.lit(0)),
        }
    )


def on_balance_volume(df: DataFrame, price: str = "Close", volume: str = "Volume", s: Series = SYMBOL_DAY) -> DataFrame:
    signed = F.when(s.change(price) > 0, F.col(volume)).otherwise(-F.col(volume))
    return df.withColumn("_signed", signed).withColumn("obv", F.sum("_signed").over(s.so_far)).drop("_signed")


def vwap(df: DataFrame, price: str = "Close", volume: str = "Volume", span: int = 20, s: Series = SYMBOL_DAY) -> DataFrame:
    df = df.withColumn("_pv", F.col(price) * F.col(volume))
    df = df.withColumn("vwap", F.try_divide(s.full(span, F.sum, "_pv"), s.full(span, F.sum, volume)))
    return df.withColumn("price_vwap_deviation", F.try_divide(F.col(price) - F.col("vwap"), F.col("vwap"))).drop("_pv")


def trend_strength(df: DataFrame, price: str = "Close", span: int = 20, s: Series = SYMBOL_DAY) -> DataFrame:
    df = rolling_slope(df, price, span, "trend_strength", s)
    return df.withColumn("trend_strength", F.abs("trend_strength"))


def sma_stack(df: DataFrame, price: str = "Close", spans: tuple[int, int, int] = (20, 50, 200), s: Series = SYMBOL_DAY) -> DataFrame:
    fast, mid, slow = (f"sma_{k}" for k in spans)
    df = df.withColumns({f"sma_{k}": s.mean(price, k) for k in spans})
    bull = (F.col(fast) > F.col(mid)) & (F.col(mid) > F.col(slow))
    bear = (F.col(fast) < F.col(mid)) & (F.col(mid) < F.col(slow))
    return df.withColumns({"sma_bull": F.coalesce(bull.cast("int"), F.lit(0)), "sma_bear": F.coalesce(bear.cast("int"), F.lit(0))})


def volatility_rank(df: DataFrame, price: str = "Close", span: int = 20, rank_span: int = 60, s: Series = SYMBOL_DAY) -> DataFrame:
    """Share of the trailing volatilities at or below the current one (ties count half)."""
    df = df.withColumn("_r", s.change(price)).withColumn("volatility_20d", s.std("_r", span)).drop("_r")
    frame = s.last(rank_span)
    df = df.withColumn("_vols", F.when(F.count("volatility_20d").over(frame) >= rank_span, F.collect_list("volatility_20d").over(frame)))
    below = F.size(F.filter("_vols", lambda v: v < F.col("volatility_20d")))
    equal = F.size(F.filter("_vols", lambda v: v == F.col("volatility_20d")))
    rank = F.when(F.col("_vols").isNotNull(), (below + (equal + 1) / 2.0) / rank_span)
    df = df.withColumn("volatility_regime", rank).drop("_vols")
    return df.withColumns(
        {
            "high_volatility_rank": F.coalesce((F.col("volatility_regime") > 0.8).cast("int"), F.lit(0)),
            "low_volatility_rank": F.coalesce((F.col("volatility_regime") < 0.2).cast("int"), F.lit(0)),
        }
    )


def relative_tone(df: DataFrame, tone: str, date: str = "Date") -> DataFrame:
    """Tone against the market mean of the day; the day means are aggregated, then joined back."""
    market = df.groupBy(date).agg(F.avg(tone).alias("market_sentiment_avg"))
    return df.join(market, date).withColumn("relative_sentiment", F.col(tone) - F.col("market_sentiment_avg"))


def drawdown(df: DataFrame, price: str = "Close", s: Series = SYMBOL_DAY) -> DataFrame:
    return df.withColumn("Drawdown", F.coalesce(F.try_divide(F.col(price), F.max(price).over(s.so_far)) - 1, F.lit(0.0)))


def cumulative_return(df: DataFrame, ret: str = "Returns", s: Series = SYMBOL_DAY) -> DataFrame:
    """Stand-in for a drawdown when there is no price column."""
    return df.withColumn("Cumulative_Return", F.coalesce(F.sum(F.coalesce(F.col(ret), F.lit(0.0))).over(s.so_far), F.lit(0.0)))


def window_statistics(df: DataFrame, ret: str = "Returns", span: int = 20, s: Series = SYMBOL_DAY) -> DataFrame:
    f = s.last(span)
    return df.withColumns(
        {
            "return_mean": F.avg(ret).over(f),
            "return_std": F.coalesce(F.stddev_samp(ret).over(f), F.lit(0.0)),
            "return_min": F.min(ret).over(f),
            "return_max": F.max(ret).over(f),
        }
    )


def sequences(df: DataFrame, features: Sequence[str], label: str, length: int = 30, s: Series = SYMBOL_DAY) -> DataFrame:
    """The previous ``length`` rows of features as one array per row, with the label of the row."""
    frame = s.rows(-length, -1)
    row = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    out = df.withColumn("sequence", F.collect_list(row).over(frame)).where(F.size("sequence") == length)
    return out.select(*s.keys, *s.order, "sequence", F.col(label).alias("target"))


def delayed(df: DataFrame, cols: Sequence[str], step: int = 1, s: Series = SYMBOL_DAY) -> DataFrame:
    """Values become known ``step`` rows late; the head takes the next known value."""
    shifted = df.withColumns({f"_d_{c}": s.lag(c, step) for c in cols})
    return shifted.withColumns({c: s.fill_back(f"_d_{c}") for c in cols}).drop(*[f"_d_{c}" for c in cols])
