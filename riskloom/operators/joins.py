"""As-of, interval and keyed joins of feature tables onto a panel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.series import SYMBOL_DAY, Series
from riskloom.operators.clean import NEUTRAL_NEWS, fill_both_ways, neutral_fill


def left_then_fill(left: DataFrame, right: DataFrame, cols: Sequence[str], s: Series = SYMBOL_DAY) -> DataFrame:
    """Left join on the series keys, then carry the joined values forward."""
    on = [*s.keys, *s.order]
    joined = left.join(right.select(*on, *cols), on, "left")
    return joined.withColumns({c: s.fill_forward(c) for c in cols})


def news_features(panel: DataFrame, daily: DataFrame, s: Series = SYMBOL_DAY) -> DataFrame:
    """Daily news onto the panel: tone carried forward, counts zero where there was no news."""
    on = [*s.keys, *s.order]
    carried = ["news_sentiment_mean", "news_sentiment_std", "news_sentiment_intensity"]
    joined = panel.join(daily.select(*on, "news_count", *carried), on, "left")
    return neutral_fill(joined.withColumns({c: s.fill_forward(c) for c in carried}), NEUTRAL_NEWS)


def latest_of_day(right: DataFrame, by: Sequence[str], on: str, cols: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """At most one right row per (by, day): a series bounded by the calendar."""
    return right.groupBy(*by, on).agg(F.max_by(F.struct(*cols), F.struct(*(tie or cols))).alias("_v"))


def asof_backward(left: DataFrame, right: DataFrame, cols: Sequence[str], by: Sequence[str] = ("Symbol",), on: str = "Date",
                  tie: Sequence[str] = ()) -> DataFrame:
    """Latest right row on or before each left row, by key: one union, one shuffle, one window.

    ``left`` has one row per (by, on), so a window partition is a calendar of rows.
    """
    s = Series(tuple(by), (on, "_side"))
    r = latest_of_day(right, by, on, cols, tie).withColumn("_side", F.lit(0)).withColumn("_seen", F.col(on))
    both = left.withColumn("_side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    found = F.last(F.when(F.col("_side") == 0, F.struct(F.col("_seen").alias("matched"), F.col("_v").alias("v"))), ignorenulls=True).over(s.so_far)
    out = both.withColumn("_m", found).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_m.v.{c}").alias(c) for c in cols], F.col("_m.matched").alias("matched_date"))


def asof_nearest(left: DataFrame, right: DataFrame, cols: Sequence[str], by: Sequence[str] = ("Symbol",), on: str = "Date",
                 tolerance_days: int = 5 * 365, tie: Sequence[str] = ()) -> DataFrame:
    """Right row with the smallest day gap within the tolerance; a tie goes to the earlier one.

    With a key, ``left`` has one row per (by, on) and both sides share one window per series.
    Without a key, every day within reach of the right side is matched once, a calendar of
    rows, and left rows look their day up.
    """
    s = Series(tuple(by), (on, "_side"))
    r = latest_of_day(right, by, on, cols, tie).withColumn("_side", F.lit(0))
    if by:
        rows = left.withColumn("_side", F.lit(1))
    else:
        reach = r.agg(F.date_sub(F.min(on), tolerance_days).alias("a"), F.date_add(F.max(on), tolerance_days).alias("b"))
        rows = reach.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias(on)).withColumn("_side", F.lit(1))
    both = rows.unionByName(r, allowMissingColumns=True)
    hit = F.when(F.col("_side") == 0, F.struct(F.col(on).alias("day"), F.col("_v").alias("v")))
    both = both.withColumns({"_b": F.last(hit, ignorenulls=True).over(s.so_far), "_f": F.last(hit, ignorenulls=True).over(s.backwards)})
    # a right row of the same day sorts before the left row, so it is the backward candidate
    back, ahead = F.datediff(F.col(on), F.col("_b.day")), F.datediff(F.col("_f.day"), F.col(on))
    near = F.when(ahead.isNull() | (back <= ahead), F.col("_b")).otherwise(F.col("_f"))
    matched = both.where("_side = 1").withColumn("_m", near)
    ok = F.abs(F.datediff(F.col(on), F.col("_m.day"))) <= tolerance_days
    kept = left.columns if by else [on]
    matched = matched.select(*kept, F.when(ok, F.col("_m.day")).alias("matched_date"), *[F.when(ok, F.col(f"_m.v.{c}")).alias(c) for c in cols])
    return matched if by else left.join(matched, on, "left")


def attach_external_tone(left: DataFrame, keyed: DataFrame, market: DataFrame, col: str, s: Series = SYMBOL_DAY, tolerance_days: int = 5 * 365) -> DataFrame:
    """Nearest tone of the symbol, else of the market, then filled along the series."""
    own = asof_nearest(left, keyed, [col], s.keys, s.order[0], tolerance_days).withColumnRenamed(col, "_own").drop("matched_date")
    both = asof_nearest(own, market, [col], (), s.order[0], tolerance_days).withColumnRenamed(col, "_mkt").drop("matched_date")
    out = both.withColumn(col, F.coalesce("_own", "_mkt")).drop("_own", "_mkt")
    return fill_both_ways(out, [col], s)


def full_by_key(parts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """N-way full outer join of tables unique by key, as one union and one aggregation.

    Columns get the part's name as prefix; a chain of full joins would shuffle N times.
    """
    renamed = [df.select(*keys, *[F.col(c).alias(f"{n}_{c}") for c in df.columns if c not in keys]) for n, df in parts.items()]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)
    return stacked.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns if c not in keys])


def resolve_collisions(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join; a column on both sides keeps the left value, filled from the right."""
    shared = [c for c in right.columns if c in left.columns and c not in on]
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    return left.join(r, list(on), "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_r_{c}")) for c in shared}).drop(*[f"_r_{c}" for c in shared])


def attach_by_symbol(left: DataFrame, dim: DataFrame, key: str = "Symbol") -> DataFrame:
    """Symbol-level values onto rows, 0 where the symbol is unknown. Catalyst broadcasts ``dim``
    when its measured size is under the session's limit."""
    return left.join(dim, key, "left").na.fill(0, [c for c in dim.columns if c != key])


def interval_join(rows: DataFrame, windows: DataFrame, date: str = "Date", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Rows inside named closed day intervals, as an equi-join on months plus a range filter."""
    months = windows.withColumn("_m", F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))))
    keyed = rows.withColumn("_m", F.trunc(date, "month"))
    return keyed.join(months, "_m").where(F.col(date).between(F.col(start), F.col(end))).drop("_m")


def pre_event(windows: DataFrame, days: int = 30, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """The ``days`` before each window, up to the day before it starts."""
    return windows.withColumns({"_s": F.date_sub(start, days), "_e": F.date_sub(start, 1)}).drop(start, end).withColumnsRenamed({"_s": start, "_e": end})


def clip_windows(windows: DataFrame, rows: DataFrame, date: str = "Date", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Windows clipped to the data; the full data range when they do not meet it."""
    span = rows.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    w = windows.withColumn("_d", span.select(F.struct("a", "b")).scalar())
    s, e = F.greatest(start, "_d.a"), F.least(end, "_d.b")
    off = s > e
    return w.select(*[c for c in windows.columns if c not in (start, end)], F.when(off, F.col("_d.a")).otherwise(s).alias(start),
                    F.when(off, F.col("_d.b")).otherwise(e).alias(end), off.alias("window_adjusted"))


def align_text_frame(keys: DataFrame, text: DataFrame, on: Sequence[str] = ("Symbol", "Date")) -> DataFrame:
    """Text features for exactly the rows of ``keys``; numbers missing there become 0."""
    out = keys.select(*on).join(text, list(on), "left")
    return out.na.fill(0.0)


def zero_missing(*cols: str) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols]
