"""GARCH by composed maps against the plain loop."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions import scan
from riskloom.operators import robustness as rb


def loop(r):
    """Grid, then two finer grids, one row after the other."""
    var = r.var()

    def path(a, b):
        h, out = var, []
        for x in r:
            out.append(h)
            h = (1 - a / 1e4 - b / 1e4) * var + a / 1e4 * x * x + b / 1e4 * h
        return np.array(out)

    def best(points):
        ll = [(-0.5 * (np.log(2 * np.pi) + np.log(h := path(*p)) + r * r / h)).sum() for p in points]
        k = int(np.argmax(ll))
        return points[k], ll[k]

    p, _ = best([(round(a * 1e4), round(b * 1e4)) for a, b in rb.GARCH_GRID])
    for step in rb.REFINE:
        p, ll = best([(p[0] + i * step, p[1] + j * step) for i in range(-2, 3) for j in range(-2, 3) if p[0] + i * step >= 10 and p[1] + j * step >= 0 and p[0] + p[1] + (i + j) * step <= 9990])
    return p, ll, np.sqrt(path(*p))


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    h, out = 1e-4, []
    for _ in range(n):
        out.append(np.sqrt(h) * rng.normal())
        h = 2e-6 + 0.09 * out[-1] ** 2 + 0.89 * h
    return np.array(out)


@pytest.mark.parametrize("n,rows", [(10_000, 1430), (1200, 7)])
def test_slices_equal_the_loop(spark, n, rows, monkeypatch):
    """Seven slices, and over a hundred slices in several runs."""
    if rows == 7:
        monkeypatch.setattr(scan.carries, "__defaults__", (5, None))
    series = {"A": clustered(n, 1), "B": clustered(300, 2)}
    pdf = pd.concat([pd.DataFrame({"Symbol": k, "Date": pd.date_range("1990-01-01", periods=len(v)).date, "Returns": v}) for k, v in series.items()])
    out = rb.garch(spark.createDataFrame(pdf).repartition(6), slice_rows=rows).toPandas().sort_values(["Symbol", "Date"])
    for k, v in series.items():
        p, ll, vol = loop(v)
        own = out[out["Symbol"] == k]
        assert len(own) == len(v) and (own["status"] == "ok").all()
        assert own["alpha"].iloc[0] == p[0] / 1e4 and own["beta"].iloc[0] == p[1] / 1e4
        assert np.isclose(own["loglik"].iloc[0], ll, rtol=1e-9)
        assert np.allclose(own["garch_volatility"], vol, rtol=1e-9)


def test_no_python_group(spark):
    df = spark.createDataFrame([("A", f"2020-01-{i + 1:02d}", float(i % 3)) for i in range(20)], "Symbol string, Date string, Returns double").withColumn("Date", F.col("Date").cast("date"))
    plan = rb.garch(df, min_observations=10).drop("garch_tail_probability")._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "InArrow" not in plan


def test_carries_of_many_slices(spark):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(0.5, 1, (40, 2)), rng.normal(size=(40, 2))
    maps = spark.createDataFrame([("k", i, a[i].tolist(), b[i].tolist()) for i in range(40)], "k string, slice long, a array<double>, b array<double>")
    start = spark.createDataFrame([("k", [1.0, -2.0])], "k string, x array<double>")
    x, want = np.array([1.0, -2.0]), []
    for i in range(40):
        want.append(x)
        x = a[i] * x + b[i]
    got = {r["slice"]: r["x"] for r in scan.carries(maps, start, ["k"], fan=3).collect()}
    assert all(np.allclose(got[i], want[i]) for i in range(40))
