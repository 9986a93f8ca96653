"""Windows over time series.

A *calendar series* has one row per (key, day): a century of days is 36,525 rows, so a
window partition stays small however much raw data was aggregated into it, and no key
can hold a third of a large panel. Raw rows (articles, filings, intraday bars) have no
such bound; run those through :func:`positions` and :func:`chunked`, which cut a hot key
into slices with a halo and still return the rows the unsliced window would.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from riskloom.session import checkpoint


@dataclass(frozen=True)
class Series:
    """Partition keys and order of a time series."""

    keys: tuple[str, ...] = ("Symbol",)
    order: tuple[str, ...] = ("Date",)

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def rows(self, start: int, end: int) -> WindowSpec:
        return self.w.rowsBetween(start, end)

    def last(self, k: int) -> WindowSpec:
        return self.rows(-(k - 1), 0)

    @property
    def so_far(self) -> WindowSpec:
        return self.rows(Window.unboundedPreceding, 0)

    @property
    def backwards(self) -> WindowSpec:
        """From the end of the series down to the current row. A frame that runs to the end in
        series order is evaluated anew for every row; this one is a single pass."""
        return Window.partitionBy(*self.keys).orderBy(*[F.col(o).desc() for o in self.order]).rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, c: Column | str, k: int = 1) -> Column:
        return F.lag(_c(c), k).over(self.w)

    def lead(self, c: Column | str, k: int = 1) -> Column:
        return F.lead(_c(c), k).over(self.w)

    def change(self, c: Column | str, k: int = 1) -> Column:
        """Relative change over k rows; null when the base is zero or missing."""
        return F.try_divide(_c(c), self.lag(c, k)) - 1

    def full(self, k: int, agg: Callable[..., Column], *cols: Column | str, frame: WindowSpec | None = None,
             at_least: int | None = None) -> Column:
        """Rolling aggregate that is null until the frame holds ``at_least`` (default k) values."""
        frame = frame if frame is not None else self.last(k)
        cs = [_c(c) for c in cols]
        seen = cs[0]
        for c in cs[1:]:
            seen = F.when(seen.isNotNull(), c)
        return F.when(F.count(seen).over(frame) >= (at_least or k), agg(*cs).over(frame))

    def mean(self, c: Column | str, k: int, at_least: int | None = None) -> Column:
        return self.full(k, F.avg, c, at_least=at_least)

    def std(self, c: Column | str, k: int, at_least: int | None = None) -> Column:
        return self.full(k, F.stddev_samp, c, at_least=at_least)

    def corr(self, a: Column | str, b: Column | str, k: int, at_least: int | None = None) -> Column:
        """Rolling correlation; null when a side does not vary (``corr`` raises there in ANSI mode)."""
        frame = self.last(k)
        value = correlation(a, b, lambda e: e.over(frame))
        return F.when(F.count(_both(a, b)[0]).over(frame) >= (at_least or k), value)

    def fill_forward(self, c: Column | str) -> Column:
        return F.last(_c(c), ignorenulls=True).over(self.so_far)

    def fill_back(self, c: Column | str) -> Column:
        return F.last(_c(c), ignorenulls=True).over(self.backwards)


SYMBOL_DAY = Series()


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _both(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


def correlation(a: Column | str, b: Column | str, over: Callable[[Column], Column] = lambda e: e) -> Column:
    """Pearson correlation of the rows where both are set; null when a side does not vary."""
    x, y = _both(a, b)
    return F.try_divide(over(F.covar_samp(x, y)), over(F.stddev_samp(x)) * over(F.stddev_samp(y)))


def slope(y: Column | str, x: Column | str) -> Column:
    """Least-squares slope; null when ``x`` does not vary."""
    v, u = _both(y, x)
    return F.try_divide(F.covar_pop(v, u), F.var_pop(u))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_pos") -> DataFrame:
    """Exact 0-based row position inside each key, without giving a key to one task.

    ``keys + order`` must be unique. The rows are range-partitioned, so a hot key is cut
    between tasks; the checkpoint freezes that cut before the slice sizes are summed.
    """
    by = [*keys, *order]
    sliced = checkpoint(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
        .select(*keys, "_slice", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    joined = sliced.join(starts, [*keys, "_slice"])
    return joined.withColumn(name, F.col("_row") - F.col("_first") + F.col("_base")).drop(
        "_slice", "_row", "_first", "_base"
    )


def chunked(df: DataFrame, keys: Sequence[str], build: Callable[[DataFrame, Series], DataFrame], *, before: int = 0,
            after: int = 0, rows: int = 500_000, pos: str = "_pos") -> DataFrame:
    """Run bounded-frame windows over slices of ``rows`` positions plus a halo.

    ``build`` gets rows and the series to window over; frames may reach ``before`` rows
    back and ``after`` rows ahead. Halo rows are dropped from its result.
    """
    if max(before, after) > rows:
        raise ValueError("the halo must fit in one slice")
    home = F.floor(F.col(pos) / rows)
    inside = F.col(pos) % rows
    copies = F.filter(
        F.array(
            home,
            F.when(inside >= rows - before, home + 1),
            F.when((inside < after) & (home > 0), home - 1),
        ),
        lambda c: c.isNotNull(),
    )
    spread = df.withColumn("_home", home).withColumn("_chunk", F.explode(copies))
    out = build(spread, Series((*keys, "_chunk"), (pos,)))
    return out.where(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")
