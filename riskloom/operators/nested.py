"""Grid search over tree ensembles in which the large ensemble holds the small ones.

The first 200 trees of 500 are a forest of 200, and the first 100 rounds of 200 are a boosting of 100. For each other setting only
the largest ensemble is fitted per fold; its prefixes are scored in one scan of the fold and compared by one exact AUC job.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import evaluation as ev
from riskloom.session import checkpoint, side_by_side, slices


def first_trees(model, n: int):
    """The ensemble of the first ``n`` trees of a fitted forest or boosting; all of them if there are fewer."""
    old = model._java_obj
    trees = old.trees()
    n = min(n, len(trees))
    gateway = SparkContext._active_spark_context._gateway
    ml, new_array = gateway.jvm.org.apache.spark.ml, gateway.new_array
    boosted = isinstance(model, GBTClassificationModel)
    kind = ml.regression.DecisionTreeRegressionModel if boosted else ml.classification.DecisionTreeClassificationModel
    kept = new_array(kind, n)
    for i in range(n):
        kept[i] = trees[i]
    if boosted:
        weights = new_array(gateway.jvm.double, n)
        for i, w in enumerate(model.treeWeights[:n]):
            weights[i] = float(w)
        new = ml.classification.GBTClassificationModel(old.uid(), kept, weights, old.numFeatures(), old.numClasses())
        out = GBTClassificationModel(new)
    else:
        new = ml.classification.RandomForestClassificationModel(old.uid(), kept, old.numFeatures(), old.numClasses())
        out = RandomForestClassificationModel(new)
    for p, v in model.extractParamMap().items():  # columns, thresholds and the like
        if model.isSet(p):
            out._set(**{p.name: v})
    out._transfer_params_to_java()
    return out


def prefix_scores(model, df: DataFrame, sizes: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """``keep`` and one probability column ``p<size>`` per prefix, in one scan; 0 from a model that has seen one class only."""
    for n in sizes:
        own = first_trees(model, n).setProbabilityCol(f"_q{n}").setRawPredictionCol(f"_r{n}").setPredictionCol(f"_c{n}")
        df = own.transform(df)
    return df.select(*keep, *[F.coalesce(F.get(vector_to_array(f"_q{n}"), F.lit(1)), F.lit(0.0)).alias(f"p{n}") for n in sizes])


@dataclass
class Searched:
    """The best model, its setting and the mean AUC over folds of each setting and size."""

    bestModel: object
    best: dict
    metrics: list[dict]


@dataclass
class NestedSearch:
    """``estimator`` over every combination of ``grid`` (parameter name -> values) and of ``sizes``, values of ``size_param``.

    Folds follow from a hash of ``key``, so layout and retries do not change them. A fold whose rows have a single class has no AUC and does
    not count. Ties go to the earlier setting, then to the smaller ensemble. The best setting is fitted again on all rows.

    A fit is a chain of short jobs, so up to ``parallelism`` fits (default: one a core) go beside each other and share the cores: their rows
    are stored in as few slices as leave none idle, as each slice is a task of every job. A large table keeps slices of bounded size.
    """

    estimator: object
    label: str
    size_param: str
    sizes: Sequence[int]
    grid: Mapping[str, Sequence] = field(default_factory=dict)
    folds: int = 3
    key: Sequence[str] = ("Symbol", "Date")
    parallelism: int | None = None

    def fit(self, rows: DataFrame) -> Searched:
        sizes = sorted(set(self.sizes))
        settings = [dict(zip(self.grid, v)) for v in itertools.product(*self.grid.values())]
        tasks = list(itertools.product(range(len(settings)), range(self.folds)))
        cores = rows.sparkSession.sparkContext.defaultParallelism
        together = min(len(tasks), self.parallelism or cores)
        placed = rows.withColumn("_fold", ev.hash_fold(self.key, self.folds)).coalesce(slices(rows.count(), -(-cores // together)))
        placed = checkpoint(placed)

        def one(k: int, fold: int) -> list[tuple[int, int, float | None]]:
            model = self._with(settings[k], sizes[-1]).fit(placed.where(F.col("_fold") != fold))
            scored = prefix_scores(model, placed.where(F.col("_fold") == fold), sizes, [self.label])
            by_size = F.explode(F.array(*[F.struct(F.lit(n).alias("size"), F.col(f"p{n}").alias("p")) for n in sizes])).alias("x")
            table = ev.auc(checkpoint(scored.select(self.label, by_size).select(self.label, "x.*")), "p", self.label, ["size"])
            return [(k, r["size"], r["auc"]) for r in table.collect()]  # one row per size

        results = list(itertools.chain.from_iterable(side_by_side([partial(one, *t) for t in tasks], together)))
        metrics = []
        for k, n in itertools.product(range(len(settings)), sizes):
            values = [a for s, m, a in results if (s, m) == (k, n) and a is not None]
            metrics.append({**settings[k], self.size_param: n, "auc": sum(values) / len(values) if values else None})
        best = max(metrics, key=lambda m: -1.0 if m["auc"] is None else m["auc"])
        setting = {p: best[p] for p in self.grid}
        return Searched(self._with(setting, best[self.size_param]).fit(rows), best, metrics)

    def _with(self, setting: Mapping, size: int):
        own = self.estimator.copy()
        own._set(**setting, **{self.size_param: size})
        return own
