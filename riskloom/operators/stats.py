"""Hypothesis tests on aggregated sums."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.quantiles import running_totals
from riskloom.functions.series import SYMBOL_DAY, Series
from riskloom.functions.special import chi2_p_value, f_p_value, ks_p_value, t_p_value

HASH_BITS = 128


def keyed_md5(key: Sequence[str], *salt: object) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], *[F.lit(str(x)) for x in salt]).cast("binary"))


def hash_uniform(key: Sequence[str], *salt: object) -> Column:
    """Uniform number in [0, 1) that depends only on the key and the salt."""
    return F.conv(F.substring(keyed_md5(key, *salt), 1, 8), 16, 10).cast("double") / float(1 << 32)


def paired_t_test(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(a) - F.col(b))
    out = d.groupBy(*by).agg(F.count("_d").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg("_d").alias("mean_difference"), F.stddev_samp("_d").alias("_s"))
    out = out.withColumns({"effect_size": F.try_divide("mean_difference", "_s"), "statistic": F.try_divide(F.col("mean_difference") * F.sqrt("n"), F.col("_s"))})
    return out.withColumn("p_value", t_p_value(F.col("statistic"), F.col("n") - 1)).drop("_s")


def sign_flip_means(df: DataFrame, a: str, b: str, key: Sequence[str], permutations: int = 1000, seed: int = 0) -> DataFrame:
    """Mean of sign-flipped differences per permutation.

    Each row's signs are bits of keyed hashes. A task folds its rows into one vector of
    ``permutations`` sums, so nothing is multiplied out.
    """
    blocks = -(-permutations // HASH_BITS)
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        (F.col(a) - F.col(b)).alias("d"), F.concat(*[F.unhex(keyed_md5(key, seed, i)) for i in range(blocks)]).alias("h"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(permutations), 0
        for pdf in batches:
            raw = np.frombuffer(b"".join(pdf["h"]), dtype=np.uint8).reshape(len(pdf), -1)
            d = pdf["d"].to_numpy()
            for at in range(0, len(pdf), 1000):  # bounds the unpacked bits
                bits = np.unpackbits(raw[at:at + 1000], axis=1)[:, :permutations]
                total += d[at:at + 1000] @ (bits * 2.0 - 1.0)
            n += len(pdf)
        yield pd.DataFrame({"perm": np.arange(permutations), "total": total, "n": n})

    partial = rows.mapInPandas(fold, "perm int, total double, n long")
    return partial.groupBy("perm").agg((F.sum("total") / F.sum("n")).alias("mean"))


def permutation_test(df: DataFrame, a: str, b: str, key: Sequence[str], permutations: int = 1000, seed: int = 0) -> DataFrame:
    means = sign_flip_means(df, a, b, key, permutations, seed)
    d = F.col(a) - F.col(b)
    seen = df.agg(F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.avg(a).alias("x"), F.avg(b).alias("y"))
    obs = seen.select(F.struct("m", "s", "x", "y")).scalar()
    out = means.withColumn("_o", obs).agg(F.count_if(F.abs("mean") >= F.abs("_o.m")).alias("extreme"), F.count(F.lit(1)).alias("permutations"), F.first("_o").alias("_o"))
    return out.select(F.col("_o.m").alias("statistic"), F.try_divide("_o.m", "_o.s").alias("effect_size"), F.col("_o.x").alias("mean_a"), F.col("_o.y").alias("mean_b"), "extreme",
                      ((F.col("extreme") + 1) / (F.col("permutations") + 1)).alias("p_value"))


def _solve(x: np.ndarray, y: np.ndarray, yy: float) -> float:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return float(yy - y @ beta)


def granger(df: DataFrame, cause: str, effect: str, max_lag: int = 3, by: Sequence[str] = (), s: Series = SYMBOL_DAY) -> DataFrame:
    """SSR F and chi-squared test per lag, from cross-product sums aggregated on Spark.

    The executors solve a (2*lag+1)-square system per group; no series is collected.
    """
    parts = []
    for lag in range(1, max_lag + 1):
        names = ["_1", *[f"_y{k}" for k in range(1, lag + 1)], *[f"_x{k}" for k in range(1, lag + 1)], "_y"]
        cols = {"_1": F.lit(1.0), "_y": F.col(effect).cast("double")}
        cols |= {f"_y{k}": s.lag(F.col(effect).cast("double"), k) for k in range(1, lag + 1)}
        cols |= {f"_x{k}": s.lag(F.col(cause).cast("double"), k) for k in range(1, lag + 1)}
        rows = df.withColumns(cols).na.drop(subset=names)
        products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
        parts.append(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*products).alias("products")).withColumn("lag", F.lit(lag)))
    sums = parts[0]
    for p in parts[1:]:
        sums = sums.unionByName(p)

    @F.pandas_udf("restricted double, unrestricted double")
    def ssr(lag: pd.Series, products: pd.Series) -> pd.DataFrame:
        out = []
        for k, flat in zip(lag, products):
            size = 2 * k + 2
            m = np.zeros((size, size))
            m[np.triu_indices(size)] = flat
            m = m + np.triu(m, 1).T
            r, u = k + 1, 2 * k + 1
            out.append((_solve(m[:r, :r], m[:r, -1], m[-1, -1]), _solve(m[:u, :u], m[:u, -1], m[-1, -1])))
        return pd.DataFrame(out, columns=["restricted", "unrestricted"])

    out = sums.withColumn("_s", ssr("lag", "products"))
    gain, rest = F.col("_s.restricted") - F.col("_s.unrestricted"), F.col("_s.unrestricted")
    dof = F.col("n") - 2 * F.col("lag") - 1
    out = out.withColumns({"f_statistic": F.try_divide(gain / F.col("lag"), rest / dof), "chi2_statistic": F.try_divide(F.col("n") * gain, rest), "_dof": dof})
    return out.withColumns({"f_pvalue": f_p_value(F.col("f_statistic"), F.col("lag"), F.col("_dof")), "chi2_pvalue": chi2_p_value(F.col("chi2_statistic"), F.col("lag"))}).select(
        *by, "lag", "n", "f_statistic", "f_pvalue", "chi2_statistic", "chi2_pvalue")


def likelihood_ratio(null_ll: Column, alt_ll: Column, dof: int) -> dict[str, Column]:
    lr = 2.0 * (alt_ll - null_ll)
    return {"lr_statistic": lr, "degrees_freedom": F.lit(dof), "p_value": chi2_p_value(lr, F.lit(float(dof)))}


def ks_test(df: DataFrame, value: str, group: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Two-sample KS statistic from per-value counts and running shares."""
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count_if(F.col(group) == a).alias("ca"), F.count_if(F.col(group) == b).alias("cb"))
    t = running_totals(counts, "v", {"ta": "ca", "tb": "cb"}, by)
    gap = F.abs(F.try_divide("ta", "ta_all") - F.try_divide("tb", "tb_all"))
    out = t.groupBy(*by).agg(F.max(gap).alias("ks_statistic"), F.max("ta_all").alias("n_a"), F.max("tb_all").alias("n_b"),
                             F.try_divide(F.sum(F.col("v") * F.col("ca")), F.sum("ca")).alias("mean_a"), F.try_divide(F.sum(F.col("v") * F.col("cb")), F.sum("cb")).alias("mean_b"))
    out = out.where((F.col("n_a") > 0) & (F.col("n_b") > 0))
    return out.withColumn("p_value", ks_p_value(F.col("ks_statistic"), F.col("n_a"), F.col("n_b")))


def corrected_skew(c: str) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def source_values(df: DataFrame, sources: Mapping[str, Sequence[str]], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, source, column, v) rows of the finite values of each source's columns."""
    entries = [F.struct(F.lit(src).alias("source"), F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for src, cs in sources.items() for c in cs]
    long = df.select(*keys, F.explode(F.array(*entries)).alias("x")).select(*keys, "x.*")
    return long.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))


def bias_audit(df: DataFrame, sources: Mapping[str, Sequence[str]], positive: float = 0.05, negative: float = -0.05) -> DataFrame:
    """Per column and pooled per source: level, spread, skew, positive and negative rate."""
    long = source_values(df, sources)
    pooled = long.withColumn("column", F.lit("(all)"))
    return long.unionByName(pooled).groupBy("source", "column").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), corrected_skew("v").alias("skew"), F.avg((F.col("v") > positive).cast("int")).alias("positive_rate"),
        F.avg((F.col("v") < negative).cast("int")).alias("negative_rate"), F.count("v").alias("observation_count"))


def source_ks(df: DataFrame, sources: Mapping[str, Sequence[str]], a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """KS between two sources, overall or per group."""
    return ks_test(source_values(df, sources, by), "v", "source", a, b, by).withColumn("mean_difference", F.col("mean_a") - F.col("mean_b"))
