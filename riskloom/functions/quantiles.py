"""Exact order statistics and running totals for columns of any size.

``percentile`` keeps every distinct value in one task. Here values are first counted in
monotone buckets (one small table), then only the buckets holding the wanted ranks are
looked at again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import checkpoint

BUCKETS_PER_E_FOLD = 1000.0
SMALLEST_SCALE = 1e6


def order_bucket(c: Column) -> Column:
    """Bucket number that never decreases with the value; about 0.1 % wide away from zero."""
    c = c.cast("double")
    return F.floor(F.signum(c) * F.log1p(F.abs(c) * SMALLEST_SCALE) * BUCKETS_PER_E_FOLD)


def running_totals(df: DataFrame, order: str, sums: Mapping[str, str], keys: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Running totals in order of a numeric column, two-level so that no task sees all rows.

    ``df`` holds one row per (keys, order) value. Adds each ``name`` as the total of
    ``sums[name]`` up to and including the row, and ``name_all`` as the total of the key.
    The slices are ranges of (keys, order) with about the same number of rows each, however close
    together the values are; the checkpoint freezes them before their sums are taken.
    """
    by = [*keys, F.col(order).desc() if descending else F.col(order).asc()]
    rows = checkpoint(df.repartitionByRange(*by).withColumn("_b", F.spark_partition_id()))
    per_bucket = rows.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        "_b",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_all") for n in sums],
    )
    direction = F.col(order).desc() if descending else F.col(order).asc()
    within = Window.partitionBy(*keys, "_b").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(offsets, [*keys, "_b"])
        .withColumns({n: F.sum(c).over(within) + F.col(f"_o_{n}") for n, c in sums.items()})
        .drop("_b", *[f"_o_{n}" for n in sums])
    )


def exact_quantiles(df: DataFrame, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """One row with a column per ``name -> (column, probability)``, linearly interpolated.

    Two passes over ``df``: bucket counts, then the values of the few buckets that hold
    the wanted ranks (at most two buckets per quantile, so that table is broadcast).
    """
    columns = sorted({c for c, _ in wanted.values()})
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")
    ).select("x.ci", "x.v").where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("b", order_bucket(F.col("v")))
    per_column = Window.partitionBy("ci")
    counts = (
        long.groupBy("ci", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(per_column.orderBy("b")))
        .withColumn("total", F.sum("n").over(per_column))
    )
    specs = F.array(
        *[F.struct(F.lit(name).alias("q"), F.lit(columns.index(c)).alias("qi"), F.lit(float(p)).alias("p")) for name, (c, p) in wanted.items()]
    )
    rank = F.col("s.p") * (F.col("total") - 1)
    hit = (
        counts.withColumn("s", F.explode(specs))
        .where(F.col("s.qi") == F.col("ci"))
        .select("ci", "b", (F.col("upto") - F.col("n")).alias("before"), "upto", F.col("s.q").alias("q"),
                F.floor(rank).alias("lo"), F.ceil(rank).alias("hi"), (rank - F.floor(rank)).alias("frac"))
        .where((F.col("before") <= F.col("hi")) & (F.col("upto") > F.col("lo")))
    )
    values = (
        long.join(F.broadcast(hit), ["ci", "b"])
        .groupBy("q", "before", "lo", "hi", "frac", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # a bucket may hold any number of values: their ranks are running totals in slices
    ranked = running_totals(values, "v", {"upto": "n"}, ["q", "before"]).withColumn("end", F.col("before") + F.col("upto")).withColumn("start", F.col("end") - F.col("n"))

    def at(r: str) -> Column:
        return F.max(F.when((F.col("start") <= F.col(r)) & (F.col("end") > F.col(r)), F.col("v")))

    per_q = ranked.groupBy("q", "frac").agg(at("lo").alias("a"), at("hi").alias("z"))
    value = F.col("a") + (F.col("z") - F.col("a")) * F.col("frac")
    return per_q.agg(*[F.max(F.when(F.col("q") == name, value)).alias(name) for name in wanted])


def one_row(df: DataFrame) -> Column:
    """All columns of a one-row table as a struct-valued scalar subquery."""
    return df.select(F.struct(*df.columns).alias("_row")).scalar()
