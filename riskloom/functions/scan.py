"""Linear recurrences over long series without giving a series to one task.

A step ``x -> a x + b`` is an affine map, and maps compose: slices of a series are composed on their own, the composed maps of
many slices again, and what enters each slice is joined back. Everything stays in SQL expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.series import positions
from riskloom.session import checkpoint

SLICE_ROWS = 256
FAN = 256


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = SLICE_ROWS) -> DataFrame:
    """``keys, slice, rows``: the rows of each slice (structs of the other columns and ``pos``), in order."""
    placed = positions(df, keys, order, "pos")
    rest = [c for c in df.columns if c not in keys]
    own = F.sort_array(F.collect_list(F.struct("pos", *rest)))  # at most ``rows`` of them
    return placed.groupBy(*keys, F.floor(F.col("pos") / rows).alias("slice")).agg(own.alias("rows"))


def _product(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: p * q)


def _through(m: Column, x: Column) -> Column:
    """A map (``a``, ``b``) applied to values, point by point."""
    return F.zip_with(_product(m["a"], x), m["b"], lambda p, q: p + q)


def carries(maps: DataFrame, start: DataFrame, keys: Sequence[str], fan: int = FAN, longest: int | None = None) -> DataFrame:
    """``keys, slice, x``: what enters each slice.

    ``maps`` has ``keys, slice, a, b`` (arrays: several recurrences run side by side), slices numbered from 0; ``start`` has
    ``keys, x``, what enters slice 0. Runs of ``fan`` slices are composed until one run is left, so a series of any
    length takes a handful of rounds and no task holds more than a run. ``longest`` is the number of slices of the longest
    series, if it is known.
    """
    if longest is None:
        longest = (maps.agg(F.max("slice").alias("m")).first()["m"] or 0) + 1
    runs = maps.groupBy(*keys, F.floor(F.col("slice") / fan).alias("run")).agg(F.sort_array(F.collect_list(F.struct("slice", "a", "b"))).alias("m"))
    if longest <= fan:
        entering = start.withColumn("run", F.lit(0).cast("long"))
    else:
        runs = checkpoint(runs)
        one = F.struct(F.col("m")[0]["a"].alias("a"), F.col("m")[0]["b"].alias("b"))
        both = F.aggregate(F.slice("m", 2, fan), one, lambda acc, s: F.struct(_product(s["a"], acc["a"]).alias("a"), _through(s, acc["b"]).alias("b")))
        composed = runs.withColumn("c", both).select(*keys, F.col("run").alias("slice"), "c.a", "c.b")
        entering = carries(composed, start, keys, fan, -(-longest // fan)).withColumnRenamed("slice", "run")
    none = F.array().cast("array<struct<slice:bigint,x:array<double>>>")
    step = lambda acc, s: F.struct(_through(s, acc["x"]).alias("x"), F.concat(acc["out"], F.array(F.struct(s["slice"].alias("slice"), acc["x"].alias("x")))).alias("out"))
    states = F.aggregate("m", F.struct(F.col("x"), none.alias("out")), step, lambda acc: acc["out"])
    return runs.join(entering, [*keys, "run"]).select(*keys, F.explode(states).alias("s")).select(*keys, "s.slice", "s.x")
