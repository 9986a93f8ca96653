"""Fitted scoring state as pipeline stages: regime cuts, regime weights and stacks, thresholds.

Each estimator reads the training rows and gives a model whose state is a small JSON parameter, so a ``PipelineModel`` of them (and of
MLlib's own stages) is saved and loaded as one. A loaded model scores rows it has not seen with nothing fitted anew.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.quantiles import exact_quantiles
from riskloom.functions.series import SYMBOL_DAY, Series
from riskloom.operators import evaluation as ev
from riskloom.operators.models import FLOOR_WEIGHT, fit_regime_stacks, normalised, regime_weights
from riskloom.session import side_by_side

# Fixed values.
LOW, HIGH, UNKNOWN = "low_volatility", "high_volatility", "moderate_volatility"


def with_volatility(df: DataFrame, ret: str = "Returns", span: int = 30, s: Series = SYMBOL_DAY, name: str = "regime_volatility") -> DataFrame:
    """Trailing volatility, taken over the whole series before rows are split into parts."""
    return df.withColumn(name, s.std(ret, span, at_least=max(5, span // 3)))


class _Saved(DefaultParamsReadable, DefaultParamsWritable):
    def __repr__(self) -> str:
        return f"{type(self).__name__}({ {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)} })"


class _State(Model, _Saved):
    """A model whose fitted values are one JSON parameter."""

    state = Param(Params._dummy(), "state", "fitted values as JSON", TypeConverters.toString)

    def __init__(self, **values):
        super().__init__()
        if values:
            self._set(**values)

    @property
    def values(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


class _Cuts(Params):
    volatility = Param(Params._dummy(), "volatility", "column with the trailing volatility", TypeConverters.toString)
    regime = Param(Params._dummy(), "regime", "column for the regime", TypeConverters.toString)


class RegimeCutsModel(_State, _Cuts):
    """Names the regime of each row by the stored cuts; unknown volatility counts as moderate."""

    def _transform(self, df: DataFrame) -> DataFrame:
        cuts, v = self.values, F.col(self.getOrDefault(self.volatility))
        if cuts["low"] is None:
            return df.withColumn(self.getOrDefault(self.regime), F.lit(UNKNOWN))
        name = F.when(v >= cuts["high"], HIGH).when(v <= cuts["low"], LOW).otherwise(UNKNOWN)
        return df.withColumn(self.getOrDefault(self.regime), name)


class RegimeCuts(Estimator, _Saved, _Cuts):
    """Exact quantiles of the training rows' volatility."""

    low = Param(Params._dummy(), "low", "lower quantile", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "upper quantile", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, volatility: str = "regime_volatility", regime: str = "regime", low: float = 0.33, high: float = 0.66):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(volatility="regime_volatility", regime="regime", low=0.33, high=0.66)

    def _fit(self, df: DataFrame) -> RegimeCutsModel:
        v = self.getOrDefault(self.volatility)
        q = exact_quantiles(df, {"low": (v, self.getOrDefault(self.low)), "high": (v, self.getOrDefault(self.high))}).first()
        state = {"low": q["low"], "high": q["high"]} if q else {"low": None, "high": None}
        return RegimeCutsModel(state=json.dumps(state), volatility=v, regime=self.getOrDefault(self.regime))


class _Ensemble(Params):
    models = Param(Params._dummy(), "models", "probability columns", TypeConverters.toListString)
    regime = Param(Params._dummy(), "regime", "column with the regime", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "column for the combined probability", TypeConverters.toString)


class RegimeEnsembleModel(_State, _Ensemble):
    """A row takes its regime's stack, else its regime's weights, else the default weights."""

    def _transform(self, df: DataFrame) -> DataFrame:
        names, values, regime = self.getOrDefault(self.models), self.values, F.col(self.getOrDefault(self.regime))

        def weighted(weights: dict[str, float]):
            w = normalised({m: weights.get(m, 0.0) for m in names})
            return sum((F.col(m) * w[m] for m in names[1:]), F.col(names[0]) * w[names[0]])

        value = weighted(values["default"])
        for name, weights in sorted(values["regimes"].items()):
            value = F.when(regime == name, weighted(weights)).otherwise(value)
        for name, stack in sorted(values["stacks"].items()):
            z = sum((F.col(m) * stack["coefficients"][m] for m in names), F.lit(stack["intercept"]))
            value = F.when(regime == name, 1 / (1 + F.exp(-z))).otherwise(value)
        return df.withColumn(self.getOrDefault(self.output), value)


class RegimeEnsemble(Estimator, _Saved, _Ensemble):
    """Weights by AUC, overall and in each regime with enough rows; with ``stacks`` also a logistic stack in each regime that has enough
    rows and both classes."""

    label = Param(Params._dummy(), "label", "column with the label", TypeConverters.toString)
    stacks = Param(Params._dummy(), "stacks", "whether to fit stacks", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, models: Sequence[str] = (), label: str = "Risk_Label", regime: str = "regime", output: str = "ensemble", stacks: bool = False):
        super().__init__()
        self._set(**{k: list(v) if k == "models" else v for k, v in self._input_kwargs.items()})
        self._setDefault(label="Risk_Label", regime="regime", output="ensemble", stacks=False)

    def _fit(self, df: DataFrame) -> RegimeEnsembleModel:
        names, label, regime = self.getOrDefault(self.models), self.getOrDefault(self.label), self.getOrDefault(self.regime)
        long = df.select(label, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in names])).alias("x")).select(label, "x.*")
        # a row per model, a row per regime, a model per regime
        aucs, weights, fitted = side_by_side([
            lambda: ev.auc(long, "p", label, ["model"]).collect(),
            lambda: regime_weights(df.where(F.col(regime).isNotNull()), names, label, regime).collect(),
            lambda: fit_regime_stacks(df, names, label, regime) if self.getOrDefault(self.stacks) else {},
        ])
        overall = {r["model"]: r["auc"] for r in aucs}
        default = normalised({m: max(0.5 if overall.get(m) is None else overall[m], FLOOR_WEIGHT) for m in names})
        regimes = {r[regime]: {m: r[f"w_{m}"] for m in names} for r in weights}
        stacks = {g: {"coefficients": dict(zip(names, map(float, m.coefficients))), "intercept": float(m.intercept)} for g, m in fitted.items()}
        state = {"default": default, "regimes": regimes, "stacks": stacks}
        return RegimeEnsembleModel(state=json.dumps(state), models=list(names), regime=regime, output=self.getOrDefault(self.output))


class _Flags(Params):
    columns = Param(Params._dummy(), "columns", "probability columns", TypeConverters.toListString)


class ThresholdsModel(_State, _Flags):
    """``<column>_prediction`` at the stored threshold, which is inclusive."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{c}_prediction": (F.col(c) >= t).cast("int") for c, t in self.values.items()})


class Thresholds(Estimator, _Saved, _Flags):
    """The F-beta threshold of every probability column on the training rows, all columns in one pass."""

    label = Param(Params._dummy(), "label", "column with the label", TypeConverters.toString)
    beta = Param(Params._dummy(), "beta", "weight of recall", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, columns: Sequence[str] = (), label: str = "Risk_Label", beta: float = 1.0):
        super().__init__()
        self._set(**{k: list(v) if k == "columns" else v for k, v in self._input_kwargs.items()})
        self._setDefault(label="Risk_Label", beta=1.0)

    def _fit(self, df: DataFrame) -> ThresholdsModel:
        names, label = self.getOrDefault(self.columns), self.getOrDefault(self.label)
        # a handful of columns, a row of 181 grid points each
        best = side_by_side([ev.best_threshold(df, self.getOrDefault(self.beta), c, label).first for c in names])
        cuts = {c: 0.5 if b is None or b["threshold"] is None else float(b["threshold"]) for c, b in zip(names, best)}
        return ThresholdsModel(state=json.dumps(cuts), columns=list(names))


def scoring_pipeline(models: Sequence[str], label: str, stacks: bool = False, output: str = "ensemble", beta: float = 1.0) -> Pipeline:
    """Cuts, ensemble and thresholds of all columns, to be fitted on training rows with ``regime_volatility``."""
    return Pipeline(stages=[RegimeCuts(), RegimeEnsemble(models=list(models), label=label, stacks=stacks, output=output), Thresholds(columns=[*models, output], label=label, beta=beta)])


def stored(pipeline: Pipeline, train: DataFrame, folder: str) -> PipelineModel:
    """Fits, saves and loads again: what scores later is what the folder holds."""
    pipeline.fit(train).write().overwrite().save(folder)
    return PipelineModel.load(folder)
