"""Section I (models and ensembles) and the runs built on them (J4-J6, J11, J12)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from riskloom.functions.series import SYMBOL_DAY
from riskloom.operators import clean as cl
from riskloom.operators import evaluation as ev
from riskloom.operators import indicators as ind
from riskloom.operators import labels as lab
from riskloom.operators import models as md
from riskloom.operators import robustness as rb
from riskloom.operators import stored as st
from riskloom.plans.aggregate_queries import rounded
from riskloom.plans.evaluation_queries import auc_sql
from riskloom.plans.fixtures import full, panel_returns, predictions, r, rnd, sql
from riskloom.plans.registry import query
from riskloom.plans.series_queries import REGIME
from riskloom.plans.stats_queries import u_sql
from riskloom.session import checkpoint, new_folder

KEY = ["Symbol", "Date"]
FEATURES = ["Returns", "Volatility_5d", "Volatility_20d", "RSI", "Volume_Ratio"]
MODELS = ["Risk_Probability", "prob_b", "prob_c"]


def feature_panel(spark, d):
    """Five indicators and the label 'the next close is lower'."""
    p = ind.volume_ratio(ind.rsi(ind.volatility(panel_returns(spark, d), spans=(5, 20))))
    ahead = SYMBOL_DAY.lead("Returns")
    return p.withColumn("Risk_Label", F.when(ahead.isNotNull(), (ahead < 0).cast("int"))).select(*KEY, *FEATURES, "Risk_Label")


def matrix(spark, d):
    rows, features = md.modelling_matrix(checkpoint(feature_panel(spark, d)), "Risk_Label", FEATURES)
    return rows, features


def training_rows(spark, d):
    rows, features = matrix(spark, d)
    return md.prepare(rows, features, "Risk_Label")


def training_rows_with_volatility(spark, d):
    """The volatility is taken over whole series, before the rows are stored for the fits."""
    rows, features = matrix(spark, d)
    return md.prepare(st.with_volatility(rows), features, "Risk_Label")


def scaled_rows(spark, d):
    rows = training_rows(spark, d)
    return checkpoint(md.scaler().fit(rows.where(~F.col("is_test"))).transform(rows))


def test_metrics(model, rows, name):
    return md.model_table(md.scored(model, rows.where("is_test"), name), [name], "Risk_Label")


_fp = f"""SELECT Symbol, Date, Returns, {full('stddev_samp(Returns)', 'Returns', 5)} * sqrt(252.0::DOUBLE) AS v5, {full('stddev_samp(Returns)', 'Returns', 20)} * sqrt(252.0::DOUBLE) AS v20,
  Volume / nullif({full('avg(Volume)', 'Volume', 20)}, 0) AS vr, CASE WHEN lead(Returns) OVER (PARTITION BY Symbol ORDER BY Date) < 0 THEN 1 WHEN lead(Returns) OVER (PARTITION BY Symbol ORDER BY Date) IS NOT NULL THEN 0 END AS y FROM ret"""


@query("i1_modelling_matrix", sql(f"SELECT Symbol, Date, {r('coalesce(Returns, a)')} AS Returns, {r('coalesce(v5, b)')} AS Volatility_5d, {r('coalesce(v20, c)')} AS Volatility_20d, {r('coalesce(vr, e)')} AS Volume_Ratio, y AS Risk_Label FROM f, q WHERE y IS NOT NULL", "ret",
    f=_fp, q="SELECT quantile_cont(Returns, 0.5) a, quantile_cont(v5, 0.5) b, quantile_cont(v20, 0.5) c, quantile_cont(vr, 0.5) e FROM f WHERE y IS NOT NULL"))
def i1(spark, d):
    rows, _ = matrix(spark, d)
    return rounded(rows, "Returns", "Volatility_5d", "Volatility_20d", "Volume_Ratio").drop("RSI")


@query("i2_stratified_split", sql(f"SELECT Symbol, Date, y AS Risk_Label, u <= c AS is_test FROM f JOIN q USING (y)", "ret",
    f0=_fp, f=f"SELECT *, {u_sql('42', 'split')} AS u FROM f0 WHERE y IS NOT NULL", q="SELECT y, quantile_cont(u, 0.2) AS c FROM f GROUP BY 1"))
def i2(spark, d):
    rows = feature_panel(spark, d).where(F.col("Risk_Label").isNotNull())
    return md.stratified_split(rows.select(*KEY, "Risk_Label"), "Risk_Label")


@query("i3_standardise")
def i3(spark, d):
    from pyspark.ml.functions import vector_to_array

    return scaled_rows(spark, d).select(*KEY, "is_test", vector_to_array("scaled").alias("scaled"))


@query("i4_random_forest")
def i4(spark, d):
    rows = training_rows(spark, d)
    cv = md.random_forest("Risk_Label", trees=(20, 30, 50), depths=(5, 8), leaves=(1, 2), subsets=("sqrt",)).fit(rows.where(~F.col("is_test")))
    return test_metrics(cv.bestModel, rows, "random_forest")


@query("i5_logistic")
def i5(spark, d):
    rows = scaled_rows(spark, d)
    cv = md.logistic("Risk_Label", strengths=(1.0, 100.0)).fit(rows.where(~F.col("is_test")))
    return test_metrics(cv.bestModel, rows, "logistic_regression")


@query("i6_boosted_trees")
def i6(spark, d):
    rows = training_rows(spark, d)
    cv = md.boosted_trees("Risk_Label", rounds=(20, 40)).fit(rows.where(~F.col("is_test")))
    return test_metrics(cv.bestModel, rows, "boosted_trees")


@query("i7_max_margin")
def i7(spark, d):
    rows = scaled_rows(spark, d)
    score = md.max_margin(rows.where(~F.col("is_test")), "Risk_Label", iterations=30)
    return md.model_table(score(rows.where("is_test"), "svm"), ["svm"], "Risk_Label")


@query("i8_importances")
def i8(spark, d):
    rows = scaled_rows(spark, d)
    train = rows.where(~F.col("is_test"))
    rf = md.RandomForestClassifier(labelCol="Risk_Label", numTrees=20, maxDepth=5, seed=42).fit(train)
    lr = LogisticRegression(labelCol="Risk_Label", featuresCol="scaled").fit(train)
    a = md.importances(rf, FEATURES, spark).withColumn("model", F.lit("random_forest"))
    return a.unionByName(md.importances(lr, FEATURES, spark).withColumn("model", F.lit("logistic_regression")))


@query("i9_permutation_importance")
def i9(spark, d):
    rows = training_rows(spark, d)
    model = Pipeline(stages=[md.VectorAssembler(inputCols=FEATURES, outputCol="x"), LogisticRegression(labelCol="Risk_Label", featuresCol="x")]).fit(rows.where(~F.col("is_test")).select(*FEATURES, "Risk_Label"))
    return md.permutation_importance(lambda df: md.scored(model, df, "p"), rows.where("is_test"), FEATURES, "Risk_Label", repeats=5)


@query("i10_static_ensemble", sql(f"SELECT Symbol, Date, {r('(Risk_Probability * 0.6 + prob_b * 0.3 + prob_c * 0.001) / 0.901')} AS weighted, {r('(Risk_Probability + prob_b + prob_c) / 3')} AS equal FROM pred", "pred"))
def i10(spark, d):
    p = md.static_ensemble(predictions(spark, d), MODELS, weights={"Risk_Probability": 0.6, "prob_b": 0.3}, name="weighted")
    return rounded(md.static_ensemble(p, MODELS, name="equal").select(*KEY, "weighted", "equal"), "weighted", "equal")


def regime_rows(spark, d):
    p = predictions(spark, d).withColumn("y", lab.flag(F.col("Returns") < 0))
    return lab.volatility_regime(p)


ENSEMBLE = dict(
    **REGIME,
    rp="SELECT p.*, CASE WHEN p.Returns < 0 THEN 1 ELSE 0 END AS y, g.regime FROM pred p JOIN regimes g USING (Symbol, Date)",
    u="SELECT regime, y, 'a' AS model, Risk_Probability AS p FROM rp UNION ALL SELECT regime, y, 'b', prob_b FROM rp UNION ALL SELECT regime, y, 'c', prob_c FROM rp",
    ra=auc_sql("u", "p", "y", "regime, model"),
    wt="SELECT regime, max(auc) FILTER (model = 'a') / sum(auc) AS wa, max(auc) FILTER (model = 'b') / sum(auc) AS wb, max(auc) FILTER (model = 'c') / sum(auc) AS wc FROM (SELECT regime, model, greatest(coalesce(auc, 0.001), 0.001) AS auc FROM ra) GROUP BY 1",
)


@query("i11_regime_weights", sql(f"SELECT regime, {r('wa')} AS \"w_Risk_Probability\", {r('wb')} AS w_prob_b, {r('wc')} AS w_prob_c FROM wt", "pred", **ENSEMBLE))
def i11w(spark, d):
    return rounded(md.regime_weights(regime_rows(spark, d), MODELS, "y"), *[f"w_{m}" for m in MODELS])


@query("i11_regime_ensemble", sql(f"SELECT Symbol, Date, regime, {r('Risk_Probability * wa + prob_b * wb + prob_c * wc', 5)} AS ensemble FROM rp JOIN wt USING (regime)", "pred", **ENSEMBLE))
def i11(spark, d):
    rows = regime_rows(spark, d)
    out = md.regime_ensemble(rows, md.regime_weights(rows, MODELS, "y"), MODELS)
    return out.select(*KEY, "regime", rnd("ensemble", 5).alias("ensemble"))


@query("i12_platt")
def i12(spark, d):
    p = checkpoint(predictions(spark, d).withColumn("y", lab.flag(F.col("Returns") < 0)))
    return md.apply_platt(md.platt(p, "prob_c", "y"), p, "calibrated").select(*KEY, "prob_c", "calibrated", "y")


def held_out_rows(spark, d):
    """Predictions with their volatility, and which fifth of each class is kept for testing."""
    rows = st.with_volatility(predictions(spark, d).withColumn("y", lab.flag(F.col("Returns") < 0)))
    return checkpoint(md.stratified_split(rows.where("y is not null"), "y"))


HELD = dict(
    hv=f"SELECT *, CASE WHEN Returns < 0 THEN 1 ELSE 0 END AS y, {full('stddev_samp(Returns)', 'Returns', 30, at_least=10)} AS v, {u_sql('42', 'split')} AS u FROM pred",
    hs="SELECT hv.*, u <= c AS is_test FROM hv JOIN (SELECT y, quantile_cont(u, 0.2) AS c FROM hv GROUP BY 1) USING (y)",
    hq="SELECT quantile_cont(v, 0.33) AS lo, quantile_cont(v, 0.66) AS hi FROM hs WHERE NOT is_test",
    hr="SELECT hs.*, CASE WHEN v >= hi THEN 'high_volatility' WHEN v <= lo THEN 'low_volatility' ELSE 'moderate_volatility' END AS regime FROM hs, hq",
    hu=" UNION ALL ".join(f"SELECT regime, y, '{m}' AS model, {c} AS p FROM hr WHERE NOT is_test" for m, c in zip("abc", MODELS)),
    hra=auc_sql("hu", "p", "y", "regime, model"),
    hga=auc_sql("(SELECT 'all' AS regime, y, model, p FROM hu)", "p", "y", "regime, model"),
    hn="SELECT regime, count(*) AS n, sum(count(*)) OVER () AS total FROM hr WHERE NOT is_test GROUP BY 1",
    hm="SELECT hn.regime, hra.model, CASE WHEN n >= greatest(30, floor(0.05 * total)) THEN greatest(coalesce(hra.auc, 0.001), 0.001) ELSE greatest(coalesce(hga.auc, 0.5), 0.001) END AS auc FROM hn JOIN hra USING (regime) JOIN hga ON hga.model = hra.model",
    hw="SELECT regime, " + ", ".join(f"max(auc) FILTER (model = '{m}') / sum(auc) AS w{m}" for m in "abc") + " FROM hm GROUP BY 1",
)


@query("i11_regime_fit_predict", sql(f"SELECT Symbol, Date, regime, {r('Risk_Probability * wa + prob_b * wb + prob_c * wc', 5)} AS ensemble FROM hr JOIN hw USING (regime) WHERE is_test", "pred", **HELD))
def i11f(spark, d):
    """Regime cuts and weights of the training part, stored and loaded, score the test part."""
    rows = held_out_rows(spark, d)
    model = st.stored(st.scoring_pipeline(MODELS, "y"), rows.where(~F.col("is_test")), new_folder(spark, "regime-model"))
    out = model.transform(rows.where("is_test"))
    return out.select(*KEY, "regime", rnd("ensemble", 5).alias("ensemble"))


@query("i13_regime_meta_models")
def i13(spark, d):
    """Stacks of the training part, stored and loaded, score the test part."""
    rows = held_out_rows(spark, d)
    model = st.stored(st.scoring_pipeline(MODELS, "y", stacks=True, output="stacked"), rows.where(~F.col("is_test")), new_folder(spark, "stacks"))
    return model.transform(rows.where("is_test")).select(*KEY, "regime", "stacked", "stacked_prediction", "y")


def trained(spark, d, folder):
    """Three models, regime cuts, weights, stacks and thresholds of the training part in one saved pipeline; the test part."""
    rows = training_rows_with_volatility(spark, d)
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    models, _ = md.quick_train(train.withColumn("is_test", F.lit(False)), "Risk_Label", measure=False)
    scores = checkpoint(md.score_all(models, train))
    md.save_models(models, {}, folder, spark)
    st.stored(st.scoring_pipeline(list(models), "Risk_Label", stacks=True), scores, f"{folder}/state")
    return list(models), test


@query("i14_batch_score")
def i14(spark, d):
    """The test part scored by what the folder holds."""
    folder = new_folder(spark, "models")
    names, test = trained(spark, d, folder)
    models, _ = md.load_models(folder, names, spark)
    out = st.PipelineModel.load(f"{folder}/state").transform(md.score_all(models, test))
    return out.select(*KEY, *names, "regime", "ensemble", *[f"{c}_prediction" for c in [*names, "ensemble"]])


@query("i15_average_probability", sql(f"SELECT Symbol, Date, {r('(Risk_Probability + prob_b + prob_c) / 3')} AS average FROM pred", "pred"))
def i15(spark, d):
    return rounded(md.average_probability(predictions(spark, d), MODELS).select(*KEY, "average"), "average")


@query("i16_quick_train")
def i16(spark, d):
    return md.quick_train(training_rows(spark, d), "Risk_Label")[1]


@query("i17_cross_validated_auc")
def i17(spark, d):
    est = Pipeline(stages=[md.scaler(), LogisticRegression(labelCol="Risk_Label", featuresCol="scaled", weightCol="weight", maxIter=100)])
    return md.cross_validated_auc(training_rows(spark, d), "Risk_Label", est, folds=5)


@query("i18_save_and_load")
def i18(spark, d):
    """Rows of the test part on which loaded models and loaded state differ from those that were fitted: none."""
    rows = training_rows_with_volatility(spark, d)
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    models, _ = md.quick_train(train.withColumn("is_test", F.lit(False)), "Risk_Label", measure=False)
    state = st.scoring_pipeline(list(models), "Risk_Label", stacks=True).fit(checkpoint(md.score_all(models, train)))
    folder = new_folder(spark, "models")
    md.save_models(models, {m: 0.5 for m in models}, folder, spark)
    state.write().overwrite().save(f"{folder}/state")
    again, _ = md.load_models(folder, list(models), spark)
    columns = [*models, "ensemble", "ensemble_prediction"]
    one = state.transform(md.score_all(models, test)).select(*KEY, "regime", *columns)
    two = st.PipelineModel.load(f"{folder}/state").transform(md.score_all(again, test)).select(*KEY, *[F.col(c).alias(f"_{c}") for c in ["regime", *columns]])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ["regime", *columns]]
    both = one.join(two, KEY)
    for s in same[1:]:
        same[0] = same[0] & s
    return both.select(*KEY, *columns, same[0].alias("same"))


COEF = {"prob_b": 1.5, "prob_c": -0.75, "Returns": 0.1}


@query("i19_linear_attribution", sql(f"SELECT feature, {r('avg(abs(c))')} AS importance FROM u GROUP BY 1", "pred", p="SELECT Symbol, Date, prob_b, prob_c, coalesce(Returns, 0) AS Returns FROM pred",
    u=" UNION ALL ".join(f"SELECT '{f}' AS feature, ({f} - {m}) * {c} AS c FROM p" for f, c, m in (("prob_b", 1.5, 0.5), ("prob_c", -0.75, 0.5), ("Returns", 0.1, 0.0)))))
def i19(spark, d):
    p = predictions(spark, d).select(*KEY, "prob_b", "prob_c", F.coalesce("Returns", F.lit(0.0)).alias("Returns"))
    return rounded(md.global_attribution(md.linear_attribution(p, list(COEF), list(COEF.values()), [0.5, 0.5, 0.0])), "importance")


@query("j4_likelihood_ratio")
def j4(spark, d):
    rows, _ = matrix(spark, d)
    return md.nested_test(checkpoint(rows), ["Returns"], ["RSI", "Volume_Ratio"], "Risk_Label")


@query("j5_tone_impact")
def j5(spark, d):
    from riskloom.plans.join_queries import news_panel

    p = news_panel(spark, d)
    ahead = SYMBOL_DAY.lead("Returns")
    p = p.withColumn("Risk_Label", (ahead < 0).cast("int")).where("Risk_Label IS NOT NULL AND Returns IS NOT NULL")
    return md.nested_test(checkpoint(p.select("Returns", "Volume", "news_sentiment_mean", "news_count", "Risk_Label")), ["Returns", "Volume"], ["news_sentiment_mean", "news_count"], "Risk_Label")


@query("j6_graph_ablation")
def j6(spark, d):
    from riskloom.operators import graph as gr
    from riskloom.plans.stats_queries import daily_edges

    degree = gr.degrees(daily_edges(spark, d)).select("Date", "Symbol", F.col("degree").alias("graph_degree"), F.col("strength").alias("graph_strength"))
    p = feature_panel(spark, d).where(F.col("Risk_Label").isNotNull())
    rows = p.join(degree, KEY, "left").na.fill(0.0)
    base = ["Returns", "Volatility_20d", "RSI", "Volume_Ratio"]
    return md.feature_set_auc(rows, {"without_graph": base, "with_graph": [*base, "graph_degree", "graph_strength"]}, "Risk_Label")


@query("j11_robustness_sweep")
def j11(spark, d):
    rows, features = matrix(spark, d)
    rows = checkpoint(rows)

    def fit_and_score(df):
        x = md.class_weights(md.assembled(df, features), "Risk_Label")
        m = Pipeline(stages=[md.scaler(), LogisticRegression(labelCol="Risk_Label", featuresCol="scaled", weightCol="weight", maxIter=20)]).fit(x)
        return md.scored(m, x, "Risk_Probability").select(*KEY, "Risk_Label", rnd("Risk_Probability").alias("Risk_Probability"))

    changes = {
        "noise": lambda df: rb.add_noise(df, features, 0.1),
        "delay": lambda df: ind.delayed(df, ["RSI", "Volume_Ratio"], 2),
        "mask": lambda df: cl.median_fill(rb.mask_rows(df, ["Volume_Ratio"], 0.3), ["Volume_Ratio"]),
    }
    return md.robustness_sweep(rows, changes, fit_and_score)


@query("j12_experiment")
def j12(spark, d):
    p = checkpoint(panel_returns(spark, d))
    baselines = {"var": lambda df: ev.rolling_var(df).select("var_hist_threshold", "var_param_threshold", "var_exceedance_rate"),
                 "garch": lambda df: rb.garch(df).select("garch_volatility", "garch_var_threshold", "garch_tail_probability")}
    ablations = {"few_symbols": lambda df: cl.ablate(df, where={"Symbol": ["Brand#1", "Brand#2", "Brand#3"]}), "no_volume": lambda df: cl.ablate(df, drop=["Volume"])}
    return md.experiment(p, baselines, ablations)
