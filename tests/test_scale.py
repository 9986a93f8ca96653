"""The skew-safe building blocks give what the plain, unsliced computation gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions.quantiles import exact_quantiles, running_totals
from riskloom.functions.series import Series, chunked, positions
from riskloom.operators import evaluation as ev


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).normal(0, 1, 3001),
    np.concatenate([np.zeros(2000), np.random.default_rng(2).lognormal(0, 5, 1000)]),
    np.array([7.0]),
    np.array([-5.0, -5.0, 0.0, 1e-9, 3e12, float("nan")]),
    np.repeat([1.0, 2.0], [999, 1]),
])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(None if np.isnan(v) else float(v),) for v in values], "v double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.66, 0.99, 1.0]
    row = exact_quantiles(df, {f"q{i}": ("v", p) for i, p in enumerate(probs)}).first()
    known = values[~np.isnan(values)]
    assert np.allclose([row[f"q{i}"] for i in range(len(probs))], np.quantile(known, probs), rtol=1e-12)


def test_several_columns_at_once(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("a"), (-F.col("id") * 3).cast("double").alias("b"))
    row = exact_quantiles(df, {"x": ("a", 0.5), "y": ("b", 0.1), "z": ("a", 0.9)}).first()
    assert (row["x"], row["y"], row["z"]) == (500.0, -2700.0, 900.0)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = np.random.default_rng(3)
    pdf = {k: v for k, v in zip(("k", "v"), (rng.integers(0, 3, 500), rng.permutation(500) / 7.0 - 30))}
    df = spark.createDataFrame([(int(k), float(v), 1 + i % 4) for i, (k, v) in enumerate(zip(pdf["k"], pdf["v"]))], "k int, v double, n int")
    got = running_totals(df, "v", {"t": "n"}, ["k"], descending).toPandas().sort_values(["k", "v"], ascending=[True, not descending])
    assert (got["t"] == got.groupby("k")["n"].cumsum()).all()
    assert (got["t_all"] == got.groupby("k")["n"].transform("sum")).all()


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows."""
    n = 4000
    return spark.range(n).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 37).cast("string"))).alias("key"),
                                 F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("t"), "id", F.sin("id").alias("x")).repartition(9)


def test_positions_are_exact(hot):
    got = positions(hot, ["key"], ["t", "id"]).toPandas().sort_values(["key", "t", "id"])
    assert (got["_pos"] == got.groupby("key").cumcount()).all() and len(got) == 4000


def test_positions_without_key(hot):
    got = positions(hot, [], ["t", "id"]).toPandas().sort_values(["t", "id"])
    assert (got["_pos"].to_numpy() == np.arange(4000)).all()


@pytest.mark.parametrize("rows", [12, 100, 5000])
def test_sliced_windows_equal_whole_windows(hot, rows):
    def build(df, s):
        return df.withColumns({"m": F.avg("x").over(s.last(8)), "a": F.max("x").over(s.rows(1, 5)), "l": s.lag("x", 3)})

    whole = build(hot, Series(("key",), ("t", "id"))).select("id", "m", "a", "l").toPandas().sort_values("id")
    cut = chunked(positions(hot, ["key"], ["t", "id"]), ["key"], build, before=8, after=5, rows=rows).select("id", "m", "a", "l").toPandas().sort_values("id")
    assert len(cut) == 4000
    assert np.allclose(whole.to_numpy(dtype=float), cut.to_numpy(dtype=float), equal_nan=True)


def test_halo_must_fit(hot):
    with pytest.raises(ValueError):
        chunked(hot.withColumn("_pos", F.lit(0)), ["key"], lambda d, s: d, before=50, rows=10)


def test_auc_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    df = spark.createDataFrame([(int(a), float(b), i % 3) for i, (a, b) in enumerate(zip(y, p))], "y int, p double, g int")

    def brute(mask):
        pos, neg = p[mask & (y == 1)], p[mask & (y == 0)]
        return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])

    assert ev.auc(df, "p", "y").first()["auc"] == pytest.approx(brute(np.ones(300, bool)))
    for r in ev.auc(df, "p", "y", ["g"]).collect():
        assert r["auc"] == pytest.approx(brute(np.arange(300) % 3 == r["g"]))
    single = spark.createDataFrame([(1, 0.2)], "y int, p double")
    assert ev.auc(single, "p", "y").first()["auc"] is None


def test_score_stability_slices(spark):
    rng = np.random.default_rng(6)
    import pandas as pd

    pdf = pd.DataFrame({"Date": pd.date_range("2020-01-01", periods=400).date, "Symbol": "A", "Risk_Score": rng.random(400)})
    got = ev.score_stability(spark.createDataFrame(pdf), slice_rows=100).first()
    ma, vol = pdf["Risk_Score"].rolling(90).mean(), pdf["Risk_Score"].rolling(90).std()
    assert got["avg_rolling_volatility"] == pytest.approx(vol.mean()) and got["model_drift"] == pytest.approx(ma.iloc[-1] - ma.iloc[90])


def test_histogram_computes_its_values_once(spark):
    from pyspark.sql import functions as F

    from riskloom.operators.aggregates import histogram

    df = spark.createDataFrame([("a" * n,) for n in range(6)] + [(None,)], "t string")
    out = histogram(df.withColumn("v", F.regexp_count("t", F.lit("a")) / 2.0 - 0.5), "v", 0.0, 1.5, 3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp") == 1
    assert sorted(map(tuple, out.collect())) == [(0, 1), (1, 1), (2, 2)]


def test_keywords_shuffle_the_texts_once(spark):
    from riskloom.functions.text import keywords

    df = spark.createDataFrame([(1, "beta alpha beta xx"), (1, "beta alpha"), (2, None), (3, "gamma")], "doc_id int, t string")
    out = keywords(df, "doc_id", "t")
    rows = sorted(map(tuple, out.collect()))
    assert rows == [(1, "alpha", 2, 2), (1, "beta", 3, 1), (3, "gamma", 1, 1)]
    plan = keywords(df, "doc_id", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
