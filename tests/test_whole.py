"""No row, tone, element or regime is lost, and functions reach workers that cannot import the package."""

import os
import subprocess
import sys

import pytest
from pyspark.errors import PySparkException

from riskloom.functions.quantiles import exact_quantiles, running_totals
from riskloom.operators import aggregates as ag
from riskloom.operators import evaluation as ev
from riskloom.operators import models as md
from riskloom.operators import stored as st
from riskloom.session import checkpoint, scratch

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_regimes_without_weights_take_the_default(spark):
    rows = spark.createDataFrame([("low", 0.2, 0.6), ("high", 0.4, 0.8), ("new", 0.1, 0.5), (None, 0.3, 0.7)], "regime string, a double, b double")
    weights = spark.createDataFrame([("low", 1.0, 0.0)], "regime string, w_a double, w_b double")
    got = {r["regime"]: round(r["ensemble"], 9) for r in md.regime_ensemble(rows, weights, ["a", "b"]).collect()}
    assert got == {"low": 0.2, "high": 0.6, "new": 0.3, None: 0.5}
    given = {r["regime"]: round(r["ensemble"], 9) for r in md.regime_ensemble(rows, weights, ["a", "b"], default={"a": 3.0, "b": 1.0}).collect()}
    assert given == {"low": 0.2, "high": 0.5, "new": 0.2, None: 0.4}


def test_stacks_score_every_row(spark):
    train = spark.createDataFrame([("big", (i % 10) / 10, 0.5, int(i % 10 > 4)) for i in range(200)] + [("one_class", 0.5, 0.5, 1) for _ in range(60)] + [("small", 0.1, 0.2, i) for i in (0, 1)], "regime string, a double, b double, y int")
    model = st.RegimeEnsemble(models=["a", "b"], label="y", output="stacked", stacks=True).fit(train)
    values = model.values
    assert set(values["stacks"]) == {"big"} and set(values["regimes"]) == {"big", "one_class", "small"}
    new = spark.createDataFrame([("big", 0.9, 0.5), ("small", 0.1, 0.3), ("unseen", 0.4, 0.6), (None, 0.2, 0.2)], "regime string, a double, b double")
    got = {r["regime"]: r["stacked"] for r in model.transform(new).collect()}
    usual = lambda a, b: a * values["default"]["a"] + b * values["default"]["b"]
    assert got["big"] > 0.9 and (got["small"], got["unseen"], got[None]) == pytest.approx((usual(0.1, 0.3), usual(0.4, 0.6), usual(0.2, 0.2)))


def test_all_tones_of_an_event(spark):
    tones = ["t1", "t2", "t3", "t4"]
    df = spark.createDataFrame([("A", "2020-01-02", 0.1, 1, 0.5, 0.01, 0.1, 0.2, 0.3, 0.4)], "Symbol string, Date string, Risk_Probability double, Risk_Label int, Risk_Score double, Returns double, t1 double, t2 double, t3 double, t4 double")
    df = df.withColumn("Date", df["Date"].cast("date"))
    windows = spark.sql("SELECT 'w' AS name, DATE'2020-01-01' AS start_date, DATE'2020-01-05' AS end_date, 'x' AS type")
    r = ev.event_analysis(df, windows, tones).first()
    assert [r[f"{t}_avg"] for t in tones] == [0.1, 0.2, 0.3, 0.4]


def test_mean_vectors_of_any_length(spark):
    rows = [("A", 1, [float(i) for i in range(65)]), ("A", 1, [float(i + 2) for i in range(65)]), ("A", 1, None), ("B", 1, [1.0]), ("C", 1, None)]
    got = {r["Symbol"]: r for r in ag.mean_vectors(spark.createDataFrame(rows, "Symbol string, Date int, embedding array<double>")).collect()}
    assert got["A"]["mean_vector"] == [float(i + 1) for i in range(65)] and got["A"]["article_count"] == 3
    assert (got["B"]["mean_vector"], got["C"]["mean_vector"], got["C"]["article_count"]) == ([1.0], None, 1)
    with pytest.raises(PySparkException):
        ag.mean_vectors(spark.createDataFrame([("A", 1, [1.0]), ("A", 1, [1.0, 2.0])], "Symbol string, Date int, embedding array<double>")).collect()


def test_close_values_are_cut_into_slices(spark):
    n = 60_000
    close = spark.range(n).selectExpr("1.7e9 + pmod(id * 7919, 60000) AS v", "1L AS n").repartition(8)
    row = exact_quantiles(close, {"m": ("v", 0.5), "q": ("v", 0.25)}).first()
    assert row["m"] == 1.7e9 + (n - 1) / 2 and row["q"] == 1.7e9 + (n - 1) / 4
    totals = running_totals(close, "v", {"t": "n"})
    assert totals.selectExpr("max(abs(t - (v - 1.7e9 + 1)))").first()[0] == 0
    assert totals.count() == n
    rare = spark.range(20_000).selectExpr("id * 1e-15 AS v", "1L AS n")
    assert running_totals(rare, "v", {"t": "n"}, descending=True).selectExpr("max(t)").first()[0] == 20_000


@pytest.mark.parametrize("names", [["j1_paired_t_by_symbol", "j2_permutation", "j3_granger"], ["j7_ks_significance", "h21_model_significance", "m3_rolling_hook", "j13_garch"]])
def test_workers_need_no_copy_of_the_package(tmp_path, names):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from riskloom.plans import registry
from riskloom.session import local_session
registry.load()
spark = local_session(2, 2)
for name in {names!r}:
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").toArrow().num_columns
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-1500:]


def test_scratch_tables_go_with_their_block(spark):
    with scratch(spark):
        stored = checkpoint(spark.range(10))
        folder = stored.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].replace("//", "/")
        assert stored.count() == 10 and os.path.isdir(folder)
    assert not os.path.exists(folder)
