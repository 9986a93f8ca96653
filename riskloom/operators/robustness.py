"""Seeded perturbations and the volatility baseline."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.quantiles import one_row
from riskloom.functions.scan import SLICE_ROWS, carries, sliced
from riskloom.functions.series import SYMBOL_DAY, Series
from riskloom.functions.special import normal_tail
from riskloom.operators.stats import hash_uniform
from riskloom.session import checkpoint

# Fixed values.
NORMAL_95 = 1.6448536269514722
VOLATILITY_FLOOR = 1e-8
GRID_UNITS = 10_000
"""Grid points are whole ten-thousandths."""
REFINE = (150, 40)
GARCH_GRID = [(a / 100.0, b / 100.0) for a in (2, 5, 8, 12, 18, 25) for b in (50, 60, 70, 75, 80, 85, 90, 94, 97) if a + b < 100]


def add_noise(df: DataFrame, cols: Sequence[str], level: float = 0.05, key: Sequence[str] = ("Symbol", "Date"), seed: int = 42, strategy: str = "gaussian") -> DataFrame:
    """Noise scaled by each column's spread, drawn from keyed hashes, so a lost task redraws the same."""
    spread = df.agg(*[F.stddev_pop(c).alias(c) for c in cols])
    df = df.withColumn("_s", one_row(spread))

    def noise(c: str):
        u = hash_uniform(key, seed, c, "u")
        if strategy == "uniform":
            return u * 2 - 1
        if strategy != "gaussian":
            raise ValueError(f"unknown noise strategy {strategy}")
        v = hash_uniform(key, seed, c, "v")
        return F.sqrt(-2.0 * F.ln(1.0 - u)) * F.cos(2.0 * math.pi * v)

    return df.withColumns({c: F.col(c) + noise(c) * F.col(f"_s.{c}") * level for c in cols}).drop("_s")


def mask_rows(df: DataFrame, cols: Sequence[str], ratio: float, key: Sequence[str] = ("Symbol", "Date"), seed: int = 42) -> DataFrame:
    hit = hash_uniform(key, seed, "mask") < ratio
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in cols})


def _units(g: Column) -> tuple[Column, Column]:
    return g["a"] / GRID_UNITS, g["b"] / GRID_UNITS


def _next_variance(g: Column, var: Column, h: Column, r: Column) -> Column:
    alpha, beta = _units(g)
    return (1 - alpha - beta) * var + alpha * r * r + beta * h


def _entering(slices: DataFrame, points: DataFrame, key: str, longest: int) -> DataFrame:
    """Slices with the variance of their first row at every point of their symbol's grid, as ``x``."""
    own = slices.join(points, key)
    ends = F.transform("grid", lambda g: F.aggregate("rows", F.lit(0.0), lambda h, row: _next_variance(g, F.col("var"), h, row["r"])))
    maps = own.select(key, "slice", F.transform("grid", lambda g: F.pow(_units(g)[1], F.size("rows"))).alias("a"), ends.alias("b"))
    start = points.select(key, F.transform("grid", lambda g: F.col("var")).alias("x"))
    return spread(own.join(carries(maps, start, [key], longest=longest), [key, "slice"]), key)


def spread(slices: DataFrame, key: str) -> DataFrame:
    """Slices are few bytes and much work: they stay in as many tasks as the session asks for."""
    return slices.repartition(int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "slice")


def _best_point(slices: DataFrame, points: DataFrame, key: str, longest: int) -> DataFrame:
    """``key, var, best, loglik``: the point of the grid with the largest likelihood; of equals the smallest."""
    def step(acc: Column, row: Column, i: Column) -> Column:
        r, h = row["r"], acc["h"]
        ll = acc["ll"] - 0.5 * (math.log(2 * math.pi) + F.ln(h) + r * r / h)
        return F.struct(_next_variance(F.get("grid", i), F.col("var"), h, r).alias("h"), ll.alias("ll"))

    loglik = F.transform("x", lambda x, i: F.aggregate("rows", F.struct(x.alias("h"), F.lit(0.0).alias("ll")), lambda acc, row: step(acc, row, i), lambda acc: acc["ll"]))
    each = _entering(slices, points, key, longest).select(key, "var", F.posexplode(F.arrays_zip("grid", loglik.alias("ll"))).alias("i", "z"))
    sums = each.groupBy(key, "var", "z.grid").agg(F.sum("z.ll").alias("ll"))
    order = F.struct("ll", -F.col("grid.a"), -F.col("grid.b"))
    return sums.groupBy(key, "var").agg(F.max_by("grid", order).alias("best"), F.max("ll").alias("loglik"))


def _around(step: int) -> Column:
    """Grid of five by five points around ``best``, inside what is stationary."""
    moves = F.array(*[F.struct(F.lit(i * step).alias("a"), F.lit(j * step).alias("b")) for i in range(-2, 3) for j in range(-2, 3)])
    near = F.transform(moves, lambda m: F.struct((F.col("best.a") + m["a"]).alias("a"), (F.col("best.b") + m["b"]).alias("b")))
    return F.filter(near, lambda g: (g["a"] >= 10) & (g["b"] >= 0) & (g["a"] + g["b"] <= GRID_UNITS - 10))


def garch(df: DataFrame, ret: str = "Returns", confidence_z: float = NORMAL_95, min_observations: int = 100, s: Series = SYMBOL_DAY, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """GARCH(1,1) conditional volatility per symbol, variance-targeted: the best point of a grid by likelihood, refined twice.

    For fixed parameters the variance step is an affine map, so a series is cut into slices whose maps are composed; no
    task sees a whole series. Series that are too short or do not vary keep their rows with null estimates; ``status``
    tells. Rows without a return or a symbol have no estimate and no row.
    """
    key, date = s.keys[0], s.order[0]
    rows = checkpoint(df.where(F.col(ret).isNotNull() & F.col(key).isNotNull()).select(key, date, F.col(ret).cast("double").alias("r")))
    state = F.when(F.col("n") < min_observations, "too_short").when(F.col("var") > 0, "ok").otherwise("constant")
    symbols = checkpoint(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.var_pop("r").alias("var")).select(key, "n", "var", state.alias("status")))
    usable = symbols.where("status = 'ok'").select(key, "var")
    slices = checkpoint(spread(sliced(rows.join(usable.select(key), key, "left_semi"), [key], [date], slice_rows), key))
    longest = -(-int(symbols.agg(F.max("n").alias("n")).first()["n"] or 0) // slice_rows)
    coarse = F.array(*[F.struct(F.lit(round(a * GRID_UNITS)).alias("a"), F.lit(round(b * GRID_UNITS)).alias("b")) for a, b in GARCH_GRID])
    best = checkpoint(_best_point(slices, usable.withColumn("grid", coarse), key, longest))
    for step in REFINE:
        best = checkpoint(_best_point(slices, best.select(key, "var", _around(step).alias("grid")), key, longest))
    final = _entering(slices, best.select(key, "var", F.array("best").alias("grid")), key, longest)
    none = F.array().cast("array<double>")
    h = F.aggregate("rows", F.struct(F.col("x")[0].alias("h"), none.alias("out")),
                    lambda acc, row: F.struct(_next_variance(F.col("grid")[0], F.col("var"), acc["h"], row["r"]).alias("h"), F.concat(acc["out"], F.array(acc["h"])).alias("out")), lambda acc: acc["out"])
    paths = final.select(key, F.explode(F.arrays_zip("rows", h.alias("h"))).alias("z")).select(key, F.col(f"z.rows.{date}").alias(date), F.sqrt("z.h").alias("garch_volatility"))
    fitted = best.select(key, *[u.alias(n) for u, n in zip(_units(F.col("best")), ("alpha", "beta"))], "loglik")
    out = rows.join(symbols.drop("n", "var"), key).join(fitted, key, "left").join(paths, [key, date], "left")
    vol = F.col("garch_volatility")
    out = out.select(key, date, "r", "alpha", "beta", "loglik", "garch_volatility", "status")
    return out.withColumns({"garch_var_threshold": F.when(vol.isNotNull(), F.greatest(vol * confidence_z, F.lit(0.0))),
                            "garch_tail_probability": F.when(vol.isNotNull(), F.least(normal_tail(F.col("r") / F.greatest(F.coalesce(vol, F.lit(1.0)), F.lit(VOLATILITY_FLOOR))), F.lit(1.0)))}).drop("r")
