"""Fitted state: what is loaded scores like what was fitted, on rows the fit has not seen."""

import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskloom.operators import stored as st

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(3)
    n = 900
    y = rng.integers(0, 2, n)
    vol = np.r_[rng.uniform(0.1, 1, n - 20), np.full(20, np.nan)]
    # a is good when volatility is low, b when it is high
    a = np.clip(np.where(vol < 0.4, 0.5 + (y - 0.5) * 0.5, 0.5) + rng.normal(0, 0.2, n), 0, 1)
    b = np.clip(np.where(vol > 0.7, 0.5 + (y - 0.5) * 0.5, 0.5) + rng.normal(0, 0.2, n), 0, 1)
    pdf = pd.DataFrame({"id": range(n), "y": y, "regime_volatility": vol, "a": a, "b": b})
    df = spark.createDataFrame(pdf).withColumn("regime_volatility", F.when(~F.isnan("regime_volatility"), F.col("regime_volatility")))
    return pdf, df.where("id % 3 > 0"), df.where("id % 3 = 0")


def auc(p, y):
    order = pd.Series(p).rank().to_numpy()
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("stacks", [False, True])
def test_fit_save_load_predict(parts, tmp_path, stacks):
    pdf, train, test = parts
    fitted = st.scoring_pipeline(NAMES, "y", stacks=stacks).fit(train)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    one, two = (m.transform(test).orderBy("id").toPandas() for m in (fitted, loaded))
    pd.testing.assert_frame_equal(one, two)
    seen = pdf[pdf["id"] % 3 > 0]
    lo, hi = seen["regime_volatility"].quantile([0.33, 0.66])
    name = lambda v: "high_volatility" if v >= hi else "low_volatility" if v <= lo else "moderate_volatility"
    assert [name(v) for v in pdf[pdf["id"] % 3 == 0]["regime_volatility"]] == one["regime"].tolist()
    if stacks:
        assert set(loaded.stages[1].values["stacks"]) == {"low_volatility", "moderate_volatility", "high_volatility"}
        return
    kinds = seen["regime_volatility"].map(name)
    for kind, own in one.groupby("regime"):
        part = seen[kinds == kind]
        w = np.array([max(auc(part[m].to_numpy(), part["y"].to_numpy()), 1e-3) for m in NAMES])
        assert np.allclose(own["ensemble"], own[NAMES].to_numpy() @ (w / w.sum()))


def test_a_regime_without_stack_takes_its_weights_then_the_defaults(spark):
    state = '{"default": {"a": 0.5, "b": 0.5}, "regimes": {"r1": {"a": 1.0, "b": 0.0}, "r2": {"a": 0.2, "b": 0.8}}, "stacks": {"r2": {"coefficients": {"a": 0.0, "b": 0.0}, "intercept": 0.0}}}'
    model = st.RegimeEnsembleModel(state=state, models=NAMES, regime="regime", output="e")
    df = spark.createDataFrame([("r1", 0.3, 0.9), ("r2", 0.3, 0.9), ("new", 0.3, 0.9), (None, 0.3, 0.9)], "regime string, a double, b double")
    assert [round(r["e"], 9) for r in model.transform(df).collect()] == [0.3, 0.5, 0.6, 0.6]


def test_rare_regimes_and_one_class_take_the_defaults(spark):
    rows = [(0.1 * (i % 7), 0.9 - 0.1 * (i % 5), i % 2, "big") for i in range(200)] + [(0.2, 0.4, 1, "rare")] * 5
    model = st.RegimeEnsemble(models=NAMES, label="y", stacks=True).fit(spark.createDataFrame(rows, "a double, b double, y int, regime string"))
    values = model.values
    assert np.allclose([values["regimes"]["rare"][m] for m in NAMES], [values["default"][m] for m in NAMES]) and set(values["stacks"]) == {"big"}


def test_a_new_session_scores_the_same(parts, tmp_path):
    _, train, test = parts
    st.scoring_pipeline(NAMES, "y", stacks=True).fit(train).write().overwrite().save(str(tmp_path / "m"))
    want = PipelineModel.load(str(tmp_path / "m")).transform(test).orderBy("id").select("id", "ensemble", "ensemble_prediction").toPandas()
    test.write.parquet(str(tmp_path / "t"))
    code = f"""
from pyspark.ml import PipelineModel
from riskloom.session import local_session
spark = local_session(2, 2)
PipelineModel.load({str(tmp_path / 'm')!r}).transform(spark.read.parquet({str(tmp_path / 't')!r})).orderBy("id").select("id", "ensemble", "ensemble_prediction").toPandas().to_parquet({str(tmp_path / 'out.parquet')!r})
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"PYTHONPATH": root}, timeout=300, capture_output=True)
    pd.testing.assert_frame_equal(pd.read_parquet(tmp_path / "out.parquet"), want)
