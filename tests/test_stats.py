import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions import special as sp
from riskloom.operators import evaluation as ev
from riskloom.operators import graph as gr
from riskloom.operators import models as md
from riskloom.operators import robustness as rb
from riskloom.operators import stats as st


def test_tail_probabilities():
    assert sp.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert sp.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert sp.chi2_upper(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert sp.f_upper(3.708265, 3, 10) == pytest.approx(0.05, abs=1e-6)
    assert sp.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert sp.ks_upper(0.0, 10, 10) == 1.0 and sp.ks_upper(0.9, 100, 100) < 1e-6


def pairs(spark, shift):
    rng = np.random.default_rng(1)
    base = rng.normal(0.6, 0.05, 50)
    noise = rng.normal(0, 0.01, 50)
    return spark.createDataFrame([(i, float(b + shift + e), float(b)) for i, (b, e) in enumerate(zip(base, noise))], "id int, a double, b double")


def test_paired_tests_see_a_shift(spark):
    df = pairs(spark, 0.05)
    assert st.paired_t_test(df, "a", "b").first()["p_value"] < 1e-6
    assert st.permutation_test(df, "a", "b", ["id"], 500).first()["p_value"] < 0.01
    none = pairs(spark, 0.0)
    assert st.permutation_test(none, "a", "b", ["id"], 500).first()["p_value"] > 0.01


def test_permutation_does_not_depend_on_layout(spark):
    df = pairs(spark, 0.002)
    means = [sorted((r["perm"], round(r["mean"], 12)) for r in st.sign_flip_means(x, "a", "b", ["id"], 200).collect()) for x in (df.repartition(1), df.repartition(13))]
    assert means[0] == means[1]


def test_granger_finds_the_direction(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y = np.zeros(300)
    for t in range(1, 300):
        y[t] = 0.3 * y[t - 1] + 0.8 * x[t - 1] + rng.normal() * 0.5
    pdf = pd.DataFrame({"Symbol": "A", "Date": range(300), "x": x, "y": y})
    df = spark.createDataFrame(pdf)
    there = st.granger(df, "x", "y", 2).orderBy("lag").collect()
    back = st.granger(df, "y", "x", 2).orderBy("lag").collect()
    assert there[0]["f_pvalue"] < 1e-6 and back[0]["f_pvalue"] > 0.01
    yy, y1, x1 = y[1:], y[:-1], x[:-1]
    ones = np.ones(299)

    def ssr(*c):
        m = np.column_stack(c)
        return ((yy - m @ np.linalg.lstsq(m, yy, rcond=None)[0]) ** 2).sum()

    r, u = ssr(ones, y1), ssr(ones, y1, x1)
    assert there[0]["f_statistic"] == pytest.approx((r - u) / (u / (299 - 3)), rel=1e-8)


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(0, 1, 200), 1), np.round(rng.normal(0.5, 1, 150), 1)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    assert st.ks_test(df, "v", "g", "a", "b").first()["ks_statistic"] == pytest.approx(want)


def test_bias_audit_means(spark):
    df = spark.createDataFrame([(0.2, 0.1), (0.4, -0.1), (0.6, 0.3), (None, 0.1)], "f double, v double")
    rows = {(r["source"], r["column"]): r for r in st.bias_audit(df, {"f": ["f"], "v": ["v"]}).collect()}
    assert rows["f", "f"]["mean"] - rows["v", "v"]["mean"] == pytest.approx(0.3) and rows["f", "f"]["observation_count"] == 3


def test_noise_mask_and_delay(spark):
    from riskloom.operators.indicators import delayed

    df = spark.createDataFrame([("A", i, float(i)) for i in range(1, 201)], "Symbol string, Date int, v double")
    noisy = rb.add_noise(df, ["v"], 0.05).orderBy("Date").toPandas()["v"]
    again = rb.add_noise(df.repartition(11), ["v"], 0.05).orderBy("Date").toPandas()["v"]
    assert (noisy == again).all() and not np.allclose(noisy, range(1, 201))
    assert abs((noisy - np.arange(1, 201)).std() / (0.05 * np.arange(1, 201).std()) - 1) < 0.2
    share = rb.mask_rows(df, ["v"], 0.3).where("v IS NULL").count() / 200
    assert 0.15 < share < 0.45
    late = [r["v"] for r in delayed(df, ["v"], 1).orderBy("Date").limit(3).collect()]
    assert late == [1.0, 1.0, 2.0]


def test_garch_recovers_clustering(spark):
    rng = np.random.default_rng(9)
    h, rs = 1e-4, []
    for _ in range(1500):
        rs.append(rng.normal() * math.sqrt(h))
        h = 5e-6 + 0.12 * rs[-1] ** 2 + 0.83 * h
    df = spark.createDataFrame([("A", i, float(r)) for i, r in enumerate(rs)] + [("short", i, 0.01 * i) for i in range(5)], "Symbol string, Date int, Returns double")
    out = rb.garch(df).toPandas()
    short = out[out["Symbol"] == "short"]
    assert len(short) == 5 and set(short["status"]) == {"too_short"} and short["garch_volatility"].isna().all() and short["garch_tail_probability"].isna().all()
    out = out[out["Symbol"] == "A"]
    assert set(out["status"]) == {"ok"} and len(out) == 1500 and 0.8 <= out["alpha"].iloc[0] + out["beta"].iloc[0] < 1
    assert out["garch_tail_probability"].between(0, 1).all()


def triangle(spark):
    rows = [("a", "b", 0.9), ("b", "c", 0.6), ("a", "c", 0.3), ("c", "d", 0.9)]
    both = [(1, x, y, w) for x, y, w in rows] + [(1, y, x, w) for x, y, w in rows]
    return spark.createDataFrame(both, "Date int, src string, dst string, weight double")


def test_clustering_and_degree(spark):
    e = triangle(spark)
    got = {r["Symbol"]: r["graph_clustering"] for r in gr.clustering(e).collect()}
    g = (0.9 / 0.9 * 0.6 / 0.9 * 0.3 / 0.9) ** (1 / 3)
    assert got["a"] == pytest.approx(g) and got["c"] == pytest.approx(2 * g / 6) and got["d"] == 0.0
    assert {r["Symbol"]: r["degree"] for r in gr.degrees(e).collect()} == {"a": 2, "b": 2, "c": 3, "d": 1}


def test_eigenvector_matches_numpy(spark):
    e = triangle(spark)
    nodes = "abcd"
    m = np.zeros((4, 4))
    for r in e.collect():
        m[nodes.index(r["src"]), nodes.index(r["dst"])] = abs(r["weight"])
    vec = np.abs(np.linalg.eigh(m)[1][:, -1])
    got = {r["Symbol"]: r["graph_eigenvector"] for r in gr.eigenvector(e, iterations=40, every=10).collect()}
    assert np.allclose([got[n] for n in nodes], vec, atol=1e-4)


def test_pair_blocks_do_not_change_the_result(spark, walk):
    from riskloom.operators.indicators import returns

    p = returns(walk[1]).where("Symbol != 'ONE'")
    extra = p.where("Symbol = 'A'").withColumn("Symbol", F.lit("C")).withColumn("Returns", -F.col("Returns"))
    p = p.unionByName(extra)
    a = gr.pair_correlations(p, span=20, block=64).toPandas().sort_values(["a", "b", "Date"]).reset_index(drop=True)
    b = gr.pair_correlations(p, span=20, block=1).toPandas().sort_values(["a", "b", "Date"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
    assert a[(a["a"] == "A") & (a["b"] == "C")]["corr"].max() == pytest.approx(-1.0)


def test_ensembles(spark):
    df = spark.createDataFrame([(0.2, 0.8)], "a double, b double")
    assert md.static_ensemble(df, ["a", "b"]).first()["ensemble"] == pytest.approx(0.5)
    assert md.static_ensemble(df, ["a", "b"], weights={"a": 3, "b": 1}).first()["ensemble"] == pytest.approx(0.35)
    assert md.static_ensemble(df, ["a", "b"], scores={"a": 0.5}).first()["ensemble"] == pytest.approx((0.2 * 0.5 + 0.8 * 1e-3) / 0.501)


def test_small_regime_takes_global_weights(spark):
    rng = np.random.default_rng(12)
    rows = [("big" if i < 300 else "tiny", int(y), float(np.clip(0.5 + 0.3 * (y - 0.5) + rng.normal() * 0.2, 0, 1)), float(rng.random())) for i, y in enumerate(rng.integers(0, 2, 310))]
    w = {r["regime"]: r for r in md.regime_weights(spark.createDataFrame(rows, "regime string, y int, a double, b double"), ["a", "b"], "y").collect()}
    assert w["big"]["w_a"] > 0.5 and w["big"]["w_a"] + w["big"]["w_b"] == pytest.approx(1.0)
    df = spark.createDataFrame(rows, "regime string, y int, a double, b double")
    ga, gb = (ev.auc(df, c, "y").first()["auc"] for c in "ab")
    assert w["tiny"]["w_a"] == pytest.approx(ga / (ga + gb))


def test_early_warning_by_hand(spark):
    rows = [("A", i, p, y) for i, (p, y) in enumerate([(0.9, 0), (0.1, 0), (0.1, 1), (0.8, 0), (0.1, 0), (0.1, 0), (0.1, 0), (0.1, 1)])] + [("B", 0, 0.9, 0)]
    df = spark.createDataFrame(rows, "Symbol string, Date int, Risk_Probability double, Risk_Label int")
    row = ev.early_warning_score(ev.warning_flags(df, rows=3)).first()
    assert (row["total_events"], row["detected_events"], row["positive_alerts"], row["false_alarms"]) == (2, 1, 3, 2)
    assert row["cews"] == 0.0 and row["early_reward"] == 0.5


def test_lead_time_and_runs_by_hand(spark):
    rows = [("A", i, s, y) for i, (s, y) in enumerate([(0.6, 0), (0.7, 0), (0.1, 1), (0.6, 1), (0.1, 0), (0.1, 1)])]
    df = spark.createDataFrame(rows, "Symbol string, Date int, Risk_Score double, Risk_Label int")
    assert sorted(r["lead_rows"] for r in ev.lead_times(df).collect()) == [2, 5]
    assert sorted(r["run_length"] for r in ev.warning_runs(df).collect()) == [1, 2]
