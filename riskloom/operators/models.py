"""Training and scoring with pyspark.ml, ensembles, attribution, and runs over them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.quantiles import exact_quantiles, one_row
from riskloom.functions.series import positions
from riskloom.operators import evaluation as ev
from riskloom.operators.aggregates import longform
from riskloom.operators.clean import clear_infinities, drop_sparse_columns, median_fill, select_features, valid_targets
from riskloom.operators.nested import NestedSearch
from riskloom.operators.stats import hash_uniform, likelihood_ratio
from riskloom.session import checkpoint, side_by_side, slices

# Ensemble rules.
FLOOR_WEIGHT = 1e-3
MIN_REGIME_ROWS = 30
MIN_REGIME_SHARE = 0.05
SPARSE_LIMIT = 0.3


def modelling_matrix(df: DataFrame, target: str, features: Sequence[str] | None = None, carry: Sequence[str] = ("Symbol", "Date")) -> tuple[DataFrame, list[str]]:
    """Keys, median-filled numeric features, target; columns over 30 % empty are dropped."""
    features = list(features or select_features(df, exclude=(*carry, target)))
    rows = valid_targets(df.select(*carry, *features, target), target, carry)
    rows = drop_sparse_columns(clear_infinities(rows), SPARSE_LIMIT, keep=[*carry, target])
    features = [f for f in features if f in rows.columns]
    return median_fill(rows, features), features


def assembled(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def stratified_split(df: DataFrame, label: str, key: Sequence[str] = ("Symbol", "Date"), test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the share ``test`` of each class with the smallest keyed hash.

    The cut is an exact quantile of the hashes per class, so no class is ranked in one task.
    """
    df = df.withColumn("_u", hash_uniform(key, seed, "split"))
    staged = df.select(F.when(F.col(label) == 0, F.col("_u")).alias("u0"), F.when(F.col(label) == 1, F.col("_u")).alias("u1"))
    cut = one_row(exact_quantiles(staged, {"c0": ("u0", test), "c1": ("u1", test)}))
    df = df.withColumn("_c", cut)
    return df.withColumn("is_test", F.col("_u") <= F.when(F.col(label) == 1, F.col("_c.c1")).otherwise(F.col("_c.c0"))).drop("_u", "_c")


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weights: rows / (2 * rows of the class)."""
    one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"))
    df = df.withColumn("_w", one.select(F.struct("n", "p")).scalar())
    mine = F.when(F.col(label) == 1, F.col("_w.p")).otherwise(F.col("_w.n") - F.col("_w.p"))
    return df.withColumn(name, F.col("_w.n") / (2.0 * mine)).drop("_w")


def scaler(inp: str = "features", out: str = "scaled") -> StandardScaler:
    return StandardScaler(inputCol=inp, outputCol=out, withMean=True, withStd=True)


def grid_search(estimator, grid, label: str, folds: int = 3, parallelism: int = 4, seed: int = 42) -> CrossValidator:
    return CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, parallelism=parallelism, seed=seed)


def random_forest(label: str, trees: Sequence[int] = (200, 300, 500), depths: Sequence[int] = (15, 20, 30), leaves: Sequence[int] = (1, 2),
                  subsets: Sequence[str] = ("sqrt", "log2"), **search) -> NestedSearch:
    rf = RandomForestClassifier(labelCol=label, weightCol="weight", seed=42)
    return NestedSearch(rf, label, "numTrees", trees, {"maxDepth": depths, "minInstancesPerNode": leaves, "featureSubsetStrategy": subsets}, **search)


def logistic(label: str, strengths: Sequence[float] = (0.1, 1.0, 10.0, 100.0), mixes: Sequence[float] = (0.0, 1.0), **cv) -> CrossValidator:
    """Penalty strength is the inverse of the usual C; mix 1 is L1 and 0 is L2."""
    lr = LogisticRegression(labelCol=label, featuresCol="scaled", weightCol="weight", maxIter=100)
    grid = ParamGridBuilder().addGrid(lr.regParam, [1.0 / c for c in strengths]).addGrid(lr.elasticNetParam, list(mixes)).build()
    return grid_search(lr, grid, label, **cv)


def boosted_trees(label: str, rounds: Sequence[int] = (100, 200), depths: Sequence[int] = (3, 5), rates: Sequence[float] = (0.05, 0.1), **search) -> NestedSearch:
    return NestedSearch(GBTClassifier(labelCol=label, weightCol="weight", seed=42), label, "maxIter", rounds, {"maxDepth": depths, "stepSize": rates}, **search)


def platt(df: DataFrame, score: str, label: str) -> PipelineModel:
    """One-feature logistic map from a raw score to a probability."""
    return Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="_raw"), LogisticRegression(featuresCol="_raw", labelCol=label, probabilityCol="_platt", rawPredictionCol="_pr", predictionCol="_pp")]).fit(df)


def apply_platt(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("_platt")[1])
    return out.drop("_raw", "_platt", "_pr", "_pp")


def max_margin(train: DataFrame, label: str, reg: float = 0.1, iterations: int = 50) -> Callable[[DataFrame, str], DataFrame]:
    """Linear max-margin classifier with calibrated probabilities."""
    svm = LinearSVC(labelCol=label, featuresCol="scaled", weightCol="weight", regParam=reg, maxIter=iterations).fit(train)

    def margin(df: DataFrame) -> DataFrame:
        return svm.transform(df).withColumn("_margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction")

    link = platt(margin(train), "_margin", label)

    def score(df: DataFrame, name: str) -> DataFrame:
        return apply_platt(link, margin(df), name).drop("_margin")

    score.model = svm
    return score


def scored(model, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def importances(model, features: Sequence[str], spark) -> DataFrame:
    """Tree importances or absolute coefficients, largest first."""
    model = getattr(model, "bestModel", model)
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    rows = [(f, abs(float(v))) for f, v in zip(features, values.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(score: Callable[[DataFrame], DataFrame], df: DataFrame, features: Sequence[str], label: str, repeats: int = 5, key: Sequence[str] = ("Symbol", "Date"),
                           seed: int = 42) -> DataFrame:
    """AUC lost when one feature is taken from another row.

    Rows get exact positions in a keyed-hash order; repeat r reads the value some rows
    further on, which is a permutation without shuffling all rows through one task.
    """
    placed = checkpoint(positions(df.select(*key, *features, label).withColumn("_h", hash_uniform(key, seed, "perm")), [], ["_h", *key]))
    n = placed.agg(F.count(F.lit(1))).scalar()
    base = ev.auc(score(placed), "p", label).scalar()
    parts = None
    for rep in range(1, repeats + 1):
        other = placed.select(F.pmod(F.col("_pos") + F.floor(n * rep / (repeats + 1)), n).alias("_pos"), *[F.col(f).alias(f"_o_{f}") for f in features])
        both = placed.join(other, "_pos")
        swapped = F.array(*[F.struct(F.lit(f).alias("changed"), *[F.col(f"_o_{g}" if g == f else g).alias(g) for g in features]) for f in features])
        long = both.select(F.col(label), F.explode(swapped).alias("s")).select(label, "s.*")
        aucs = ev.auc(score(long), "p", label, ["changed"])
        parts = aucs if parts is None else parts.unionByName(aucs)
    return parts.withColumn("drop", base - F.col("auc")).groupBy(F.col("changed").alias("feature")).agg(F.avg("drop").alias("importance"), F.stddev_samp("drop").alias("spread"))


def normalised(weights: Mapping[str, float]) -> dict[str, float]:
    w = {k: max(v, 0.0) for k, v in weights.items()}
    total = sum(w.values())
    return {k: (v / total if total > 0 else 1.0 / len(w)) for k, v in w.items()}


def static_ensemble(df: DataFrame, models: Sequence[str], weights: Mapping[str, float] | None = None, scores: Mapping[str, float] | None = None, name: str = "ensemble",
                    floor: float = FLOOR_WEIGHT) -> DataFrame:
    """Weights as given, else scores, both with a floor; else equal."""
    source = weights or scores
    w = normalised({m: max(float(source.get(m, 0.0)), floor) if source else 1.0 for m in models})
    return df.withColumn(name, sum((F.col(m) * w[m] for m in models[1:]), F.col(models[0]) * w[models[0]]))


def average_probability(df: DataFrame, models: Sequence[str], name: str = "average") -> DataFrame:
    return df.withColumn(name, sum((F.col(m) for m in models[1:]), F.col(models[0])) / len(models))


def regime_weights(df: DataFrame, models: Sequence[str], label: str, regime: str = "regime", floor: float = FLOOR_WEIGHT) -> DataFrame:
    """(regime, weights struct): AUC share of each model inside the regime; a regime with too few
    rows takes the global shares. Reads scores as per-value counts, not rows."""
    long = df.select(regime, label, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in models])).alias("x")).select(regime, label, "x.*")
    counts = checkpoint(ev.score_counts(long, "p", label, [regime, "model"]))
    pooled = counts.groupBy("model", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    overall = ev.auc_of_counts(pooled, ["model"]).select("model", F.greatest(F.coalesce("auc", F.lit(0.5)), F.lit(floor)).alias("a"))
    total = overall.agg(F.map_from_entries(F.collect_list(F.struct("model", "a"))).alias("m")).scalar()
    local = ev.auc_of_counts(counts, [regime, "model"]).select(regime, "model", F.greatest(F.coalesce("auc", F.lit(floor)), F.lit(floor)).alias("a"))
    one_model = counts.where(F.col("model") == models[0])
    sizes = one_model.groupBy(regime).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"))
    n_all = one_model.agg(F.sum(F.col("pos") + F.col("neg"))).scalar()
    enough = F.col("n") >= F.greatest(F.lit(MIN_REGIME_ROWS), F.floor(F.lit(MIN_REGIME_SHARE) * n_all))
    per = local.groupBy(regime).agg(F.map_from_entries(F.collect_list(F.struct("model", "a"))).alias("mine")).join(sizes, regime)
    per = per.withColumn("use", F.when(enough, F.col("mine")).otherwise(total))
    whole = sum((F.col("use")[m] for m in models[1:]), F.col("use")[models[0]])
    return per.select(regime, *[(F.col("use")[m] / whole).alias(f"w_{m}") for m in models])


def regime_ensemble(df: DataFrame, weights: DataFrame, models: Sequence[str], regime: str = "regime", name: str = "ensemble", default: Mapping[str, float] | None = None) -> DataFrame:
    """Rows of a regime without weights, or without regime, take the default weights (equal if none are given)."""
    usual = normalised(default or dict.fromkeys(models, 1.0))
    # one row of weights per regime
    joined = df.join(weights.select(regime, *[F.col(f"w_{m}") for m in models]), regime, "left")
    w = {m: F.coalesce(F.col(f"w_{m}"), F.lit(usual[m])) for m in models}
    return joined.withColumns({f"w_{m}": w[m] for m in models}).withColumn(name, sum((F.col(m) * F.col(f"w_{m}") for m in models[1:]), F.col(models[0]) * F.col(f"w_{models[0]}")))


def fit_regime_stacks(df: DataFrame, models: Sequence[str], label: str, regime: str = "regime") -> dict[str, LogisticRegressionModel]:
    """A logistic stack of the model probabilities for each regime that has enough rows and both classes.
    Regimes are a handful of names, so their counts come to the driver."""
    sizes = df.where(F.col(regime).isNotNull()).groupBy(regime).agg(F.count(label).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi")).collect()
    n_all = sum(r["n"] for r in sizes)
    usable = [r[regime] for r in sizes if r["n"] >= max(MIN_REGIME_ROWS, MIN_REGIME_SHARE * n_all) and r["lo"] != r["hi"]]
    rows = assembled(df, models, "_stack")
    fit = LogisticRegression(featuresCol="_stack", labelCol=label, regParam=1e-4, maxIter=50)
    usable.sort()
    return dict(zip(usable, side_by_side([partial(fit.fit, rows.where(F.col(regime) == g)) for g in usable])))


def linear_attribution(df: DataFrame, features: Sequence[str], coefficients: Sequence[float], means: Sequence[float]) -> DataFrame:
    """Long (row keys, feature, contribution): coefficient times distance from the mean."""
    entries = [F.struct(F.lit(f).alias("feature"), ((F.col(f) - float(m)) * float(c)).alias("contribution")) for f, c, m in zip(features, coefficients, means)]
    keys = [c for c in df.columns if c not in features]
    return df.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


def global_attribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def prepare(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str] = ("Symbol", "Date")) -> DataFrame:
    """Assembled, weighted and split rows, stored once because every fit reads them many times.

    They are dealt to even slices by a hash of ``key`` and sorted there: fits use every core, however few rows the shuffles
    before them had (those are merged to a single task), and the samples trees draw by slice do not follow the layout of ``df``.
    """
    rows = stratified_split(class_weights(assembled(df, features), label), label)
    n = slices(df.count(), df.sparkSession.sparkContext.defaultParallelism)
    return checkpoint(rows.repartition(n, *key).sortWithinPartitions(*key))


def quick_train(rows: DataFrame, label: str, trees: int = 100, boosting_rounds: int = 150, measure: bool = True) -> tuple[dict[str, PipelineModel], DataFrame | None]:
    """Random forest, balanced logistic regression and boosted trees; AUC, precision, recall on the test part."""
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    stages = {
        "random_forest": [RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=8, seed=42)],
        "logistic_regression": [scaler(), LogisticRegression(labelCol=label, featuresCol="scaled", weightCol="weight", maxIter=100)],
        "boosted_trees": [GBTClassifier(labelCol=label, maxIter=boosting_rounds, maxDepth=3, stepSize=0.1, subsamplingRate=0.9, seed=42)],
    }
    # boosting waits for many small jobs, the forest for a few large ones
    models = dict(zip(stages, side_by_side([partial(Pipeline(stages=s).fit, train) for s in stages.values()])))
    return models, model_table(score_all(models, test), list(models), label) if measure else None


def score_all(models: Mapping[str, PipelineModel], df: DataFrame) -> DataFrame:
    keep = df.columns
    for name, m in models.items():
        df = scored(m, df, name).select(*keep, name)
        keep = [*keep, name]
    return df


def model_table(df: DataFrame, models: Sequence[str], label: str, cut: float = 0.5) -> DataFrame:
    """(model, metric, value) for several probability columns in one set of passes."""
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in models])).alias("x")).select(label, "x.*")
    conf = ev.confusion_at(long, [cut], "p", label, strict=False, by=["model"]).select("model", "accuracy", "precision", "recall")
    return longform(ev.auc(long, "p", label, ["model"]), ["model"]).unionByName(longform(conf, ["model"]))


def batch_score(models: Mapping[str, PipelineModel], df: DataFrame, thresholds: Mapping[str, float], weights: Mapping[str, float] | None = None) -> DataFrame:
    """Probabilities of each model and of the weighted ensemble, with predictions at stored thresholds."""
    out = static_ensemble(score_all(models, df), list(models), weights=weights)
    return out.withColumns({f"{m}_prediction": (F.col(m) >= float(thresholds.get(m, 0.5))).cast("int") for m in [*models, "ensemble"]})


def cross_validated_auc(rows: DataFrame, label: str, estimator, folds: int = 5, key: Sequence[str] = ("Symbol", "Date")) -> DataFrame:
    """AUC per hash fold, and its mean and spread."""
    placed = rows.withColumn("fold", ev.hash_fold(key, folds))
    out = None
    for f in range(folds):
        m = estimator.fit(placed.where(F.col("fold") != f))
        part = scored(m, placed.where(F.col("fold") == f), "p").select(label, "p", F.lit(f).alias("fold"))
        out = part if out is None else out.unionByName(part)
    per = ev.auc(out, "p", label, ["fold"])
    return per.agg(F.avg("auc").alias("cv_mean"), F.stddev_pop("auc").alias("cv_std"), F.count("auc").alias("folds"))


def save_models(models: Mapping[str, PipelineModel], thresholds: Mapping[str, float], folder: str, spark) -> None:
    side_by_side([partial(m.write().overwrite().save, f"{folder}/models/{name}") for name, m in models.items()])
    spark.createDataFrame([(k, float(v)) for k, v in thresholds.items()], "model string, threshold double").write.mode("overwrite").parquet(f"{folder}/thresholds")


def load_models(folder: str, names: Sequence[str], spark) -> tuple[dict[str, PipelineModel], dict[str, float]]:
    models = dict(zip(names, side_by_side([partial(PipelineModel.load, f"{folder}/models/{n}") for n in names])))
    return models, {r["model"]: r["threshold"] for r in spark.read.parquet(f"{folder}/thresholds").collect()}


def log_likelihood(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Log-likelihood of an unpenalised logistic fit."""
    rows = assembled(df, features, "_x")
    m = LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.0, maxIter=200, tol=1e-9).fit(rows)
    p = F.greatest(F.least(vector_to_array("probability")[1], F.lit(1 - 1e-15)), F.lit(1e-15))
    y = F.col(label)
    return m.transform(rows).agg(F.sum(y * F.ln(p) + (1 - y) * F.ln(1 - p)).alias("ll"))


def nested_test(df: DataFrame, base: Sequence[str], extra: Sequence[str], label: str) -> DataFrame:
    """Likelihood-ratio test of base features against base plus extra features."""
    null, alt = log_likelihood(df, base, label), log_likelihood(df, [*base, *extra], label)
    both = null.select(F.col("ll").alias("null_loglike")).withColumn("alt_loglike", alt.scalar())
    return both.withColumns(likelihood_ratio(F.col("null_loglike"), F.col("alt_loglike"), len(extra)))


def feature_set_auc(df: DataFrame, sets: Mapping[str, Sequence[str]], label: str, key: Sequence[str] = ("Symbol", "Date")) -> DataFrame:
    """Test AUC of a balanced logistic model per feature set, on one and the same split."""
    rows = checkpoint(class_weights(stratified_split(df, label, key), label))
    out = None
    for name, cols in sets.items():
        x = assembled(rows, cols)
        stages = [scaler(), LogisticRegression(labelCol=label, featuresCol="scaled", weightCol="weight", maxIter=100)]
        m = Pipeline(stages=stages).fit(x.where(~F.col("is_test")))
        one = ev.auc(scored(m, x.where("is_test"), "p"), "p", label).select(F.lit(name).alias("feature_set"), "auc")
        out = one if out is None else out.unionByName(one)
    return out


def robustness_sweep(df: DataFrame, perturb: Mapping[str, Callable[[DataFrame], DataFrame]], fit_and_score: Callable[[DataFrame], DataFrame], label: str = "Risk_Label") -> DataFrame:
    """Baseline and perturbed metrics with deltas: each variant is fitted, scored and measured."""

    def measure(rows: DataFrame) -> DataFrame:
        p = checkpoint(fit_and_score(rows))
        early = ev.early_warning_score(ev.warning_flags(p, label=label)).select("early_reward", "false_alarm_penalty", "cews")
        return ev.metric_bundle(p, label=label).unionByName(longform(early))

    base = measure(df)
    out = None
    for name, change in perturb.items():
        one = ev.metric_deltas(base, measure(change(df))).withColumn("perturbation", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def experiment(df: DataFrame, baselines: Mapping[str, Callable[[DataFrame], DataFrame]], ablations: Mapping[str, Callable[[DataFrame], DataFrame]], keys: Sequence[str] = ("Symbol", "Date")) -> DataFrame:
    """Every baseline on the full table and on every ablation: (run, baseline, metric, value)."""
    out = None
    for run, cut in {"full": lambda x: x, **ablations}.items():
        rows = cut(df)
        for name, baseline in baselines.items():
            one = ev.run_summary(baseline(rows), keys=()).select(F.lit(run).alias("run"), F.lit(name).alias("baseline"), "metric", "value")
            out = one if out is None else out.unionByName(one)
    return out


def vector_of(cols: Sequence[str]) -> Column:
    return array_to_vector(F.array(*cols))
