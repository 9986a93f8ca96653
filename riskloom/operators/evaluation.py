"""Prediction metrics, event analytics and risk metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.quantiles import exact_quantiles, one_row, running_totals
from riskloom.functions.series import SYMBOL_DAY, Series, chunked, positions
from riskloom.functions.special import t_p_value
from riskloom.operators.aggregates import longform
from riskloom.operators.clean import numeric_columns, top_per_group
from riskloom.operators.indicators import YEAR
from riskloom.operators.joins import interval_join, pre_event
from riskloom.operators.labels import clip
from riskloom.session import checkpoint

# Thresholds, windows and quantiles.
THRESHOLDS = (0.3, 0.5, 0.7)
GRID = [0.05 + i * 0.005 for i in range(181)]
NORMAL_05 = -1.6448536269514729
WARNING_ROWS = 30
PRECISION_K = 50


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def with_ratios(df: DataFrame, beta: float = 1.0) -> DataFrame:
    """Accuracy, precision, recall and F-beta from tp, tn, fp, fn; 0 where undefined."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    b = beta * beta
    df = df.withColumns({"accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    return df.withColumn("f_score", _ratio((1 + b) * tp, (1 + b) * tp + b * fn + fp))


def confusion_at(df: DataFrame, thresholds: Sequence[float] = THRESHOLDS, prob: str = "Risk_Probability", label: str = "Risk_Label", strict: bool = True,
                 by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts per threshold from one pass of conditional counts."""
    p, y = F.col(prob), F.col(label)

    def cell(t: float) -> Column:
        hit = p > t if strict else p >= t
        return F.struct(F.lit(float(t)).alias("threshold"), F.count_if(hit & (y == 1)).alias("tp"), F.count_if(~hit & (y == 0)).alias("tn"),
                        F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 1)).alias("fn"))

    one = df.groupBy(*by).agg(*[cell(t).alias(f"_{i}") for i, t in enumerate(thresholds)])
    return with_ratios(one.select(*by, F.inline(F.array(*[f"_{i}" for i in range(len(thresholds))]))))


def threshold_grid(df: DataFrame, grid: Sequence[float] = GRID, prob: str = "Risk_Probability", label: str = "Risk_Label", beta: float = 1.0) -> DataFrame:
    """Confusion counts for every grid threshold (score at or above it).

    Rows fall into one of ``len(grid) + 1`` slots and are counted there; the rest is a running
    total over that small table instead of a join of all rows with all thresholds.
    """
    slots = F.size(F.filter(F.array(*[F.lit(float(t)) for t in grid]), lambda t: t <= F.col("_p")))
    counts = (
        df.groupBy(F.col(prob).alias("_p")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
        .groupBy(slots.alias("slot")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    every = df.sparkSession.range(0, len(grid) + 1).select(F.col("id").cast("int").alias("slot")).join(counts, "slot", "left").na.fill(0)
    above = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    out = every.withColumns({"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above), "_p": F.sum("pos").over(whole), "_n": F.sum("neg").over(whole)})
    out = out.where("slot > 0").select(F.element_at(F.array(*[F.lit(float(t)) for t in grid]), F.col("slot")).alias("threshold"), "tp",
                                       (F.col("_n") - F.col("fp")).alias("tn"), "fp", (F.col("_p") - F.col("tp")).alias("fn"))
    return with_ratios(out, beta)


def best_threshold(df: DataFrame, beta: float = 1.0, prob: str = "Risk_Probability", label: str = "Risk_Label") -> DataFrame:
    """Grid threshold with the highest F-beta; the lowest one wins a tie."""
    grid = threshold_grid(df, prob=prob, label=label, beta=beta)
    return grid.agg(F.max_by("threshold", F.struct("f_score", -F.col("threshold"))).alias("threshold"), F.max("f_score").alias("f_score"))


def score_counts(df: DataFrame, prob: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score; all that rank metrics need."""
    return df.groupBy(*by, F.col(prob).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def score_totals(df: DataFrame, prob: str, label: str, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    return running_totals(score_counts(df, prob, label, by), "score", {"cum_pos": "pos", "cum_neg": "neg"}, by, descending)


def auc(df: DataFrame, prob: str = "Risk_Probability", label: str = "Risk_Label", by: Sequence[str] = ()) -> DataFrame:
    """Exact rank-sum ROC AUC (ties count half); null for a single-class group."""
    return auc_of_counts(score_counts(df, prob, label, by), by)


def auc_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    t = running_totals(counts, "score", {"cum_neg": "neg"}, by)
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
    return t.groupBy(*by).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def precision_at_k(df: DataFrame, k: int = PRECISION_K, prob: str = "Risk_Probability", label: str = "Risk_Label", tie: Sequence[str] = ("Symbol", "Date"),
                   by: Sequence[str] = ()) -> DataFrame:
    order = [F.desc(prob), *[F.col(c) for c in tie]]
    if not by:
        return df.orderBy(*order).limit(k).agg(F.avg(label).alias("precision_at_k"))
    return top_per_group(df, by, order, k).groupBy(*by).agg(F.avg(label).alias("precision_at_k"))


def metric_bundle(df: DataFrame, prob: str = "Risk_Probability", label: str = "Risk_Label", k: int = PRECISION_K, tie: Sequence[str] = ("Symbol", "Date"),
                  by: Sequence[str] = ()) -> DataFrame:
    """Long (by, metric, value): auc, brier, precision at 0.5, precision at k."""
    p, y = F.col(prob), F.col(label)
    base = df.groupBy(*by).agg(F.avg((p - y) * (p - y)).alias("brier"),
                               F.coalesce(F.try_divide(F.count_if((p >= 0.5) & (y == 1)), F.count_if(p >= 0.5)), F.lit(0.0)).alias("precision"))
    parts = [longform(base, by), longform(auc(df, prob, label, by), by), longform(precision_at_k(df, k, prob, label, tie, by), by)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def calibration(df: DataFrame, bins: int = 10, prob: str = "Risk_Probability", label: str = "Risk_Label") -> DataFrame:
    """Mean score and share of events per right-closed uniform bin; empty bins are absent."""
    b = F.greatest(F.ceil(F.col(prob) * bins) - 1, F.lit(0)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg(prob).alias("mean_predicted"), F.avg(label).alias("observed"), F.count(F.lit(1)).alias("n"))


def curve_points(df: DataFrame, prob: str = "Risk_Probability", label: str = "Risk_Label") -> DataFrame:
    """ROC and precision-recall points, one per distinct score, from the highest score down."""
    t = score_totals(df, prob, label, descending=True)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return t.select("score", "pos", "neg", tp.alias("tp"), fp.alias("fp"), F.try_divide(tp, F.col("cum_pos_all")).alias("recall"),
                    F.try_divide(fp, F.col("cum_neg_all")).alias("fpr"), F.try_divide(tp, tp + fp).alias("precision"), F.col("cum_pos_all").alias("positives"))


def pr_auc(points: DataFrame) -> DataFrame:
    """Trapezoid area; the point before each one follows from its own counts, so no row order is needed."""
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))
    step = F.col("pos") / F.col("positives")
    return points.agg(F.sum(step * (F.col("precision") + before) / 2).alias("pr_auc"))


def classification_report(df: DataFrame, pred: str, label: str = "Risk_Label", classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Per class, macro and support-weighted precision, recall and F1."""
    p, y = F.col(pred), F.col(label)
    one = df.agg(*[F.struct(F.lit(str(c)).alias("class"), F.count_if((p == c) & (y == c)).alias("tp"), F.count_if((p == c) & (y != c)).alias("fp"),
                            F.count_if((p != c) & (y == c)).alias("fn")).alias(f"_{c}") for c in classes])
    per = one.select(F.inline(F.array(*[f"_{c}" for c in classes])))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    per = per.select("class", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))
    cols = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro").alias("class"), *[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted").alias("class"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in cols], F.sum("support").alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def event_analysis(df: DataFrame, windows: DataFrame, tones: Sequence[str] = (), prob: str = "Risk_Probability", label: str = "Risk_Label", score: str = "Risk_Score",
                   ret: str = "Returns") -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("observations"), F.avg(ret).alias("avg_daily_return"), F.stddev_samp(ret).alias("volatility"), F.min(ret).alias("min_return"),
        F.max(ret).alias("max_return"), F.avg(F.when(F.col(ret).isNotNull(), (F.col(ret) < 0).cast("int"))).alias("negative_days_pct"),
        F.sum(label).cast("bigint").alias("risk_periods"), F.avg(label).alias("risk_rate"), F.avg(score).alias("avg_risk_score"), F.avg(prob).alias("avg_risk_probability"),
        F.max(prob).alias("max_risk_probability"), F.avg((F.col(prob) > 0.7).cast("int")).alias("high_risk_predictions_pct"),
    ]
    for t in tones:
        aggs += [F.avg(t).alias(f"{t}_avg"), F.stddev_samp(t).alias(f"{t}_volatility"), F.avg(F.when(F.col(t).isNotNull(), (F.col(t) < 0).cast("int"))).alias(f"{t}_negative_pct")]
    found = interval_join(df, windows).groupBy("name").agg(*aggs)
    return windows.select("name", "type").join(found, "name", "left").withColumn("status", F.when(F.col("observations").isNull(), "no_data").otherwise("ok"))


def event_warning_score(df: DataFrame, windows: DataFrame, label: str = "Risk_Label", days: int = 30) -> DataFrame:
    """How much the risk rate before an event exceeds the overall rate."""
    base = df.agg(F.avg(label)).scalar()
    rates = interval_join(df.select("Date", label), pre_event(windows, days)).groupBy("name").agg(F.avg(label).alias("pre_rate"))
    return rates.withColumn("base_rate", base).withColumn("early_warning_score", (F.col("pre_rate") - F.col("base_rate")) / (F.col("base_rate") + 1e-6))


def lead_times(df: DataFrame, score: str = "Risk_Score", label: str = "Risk_Label", cut: float = 0.5, back: int = WARNING_ROWS, s: Series = SYMBOL_DAY) -> DataFrame:
    """Rows between a risk start and the first warning in the ``back`` rows before it."""
    staged = df.withColumns({"_n": F.row_number().over(s.w), "_prev": s.lag(label)})
    staged = staged.withColumn("_first", F.min(F.when(F.col(score) > cut, F.col("_n"))).over(s.rows(-back, -1)))
    start = (F.col(label) == 1) & (F.coalesce(F.col("_prev"), F.lit(0)) != 1)
    return staged.where(start & F.col("_first").isNotNull()).select(*s.keys, *s.order, (F.col("_n") - F.col("_first")).alias("lead_rows"))


def spread_of(df: DataFrame, col: str) -> DataFrame:
    """Mean, median, max, min of small integers (rows of a calendar, so few distinct values)."""
    return df.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.percentile(col, F.lit(0.5)).alias("median"), F.max(col).alias("max"), F.min(col).alias("min"))


def warning_runs(df: DataFrame, score: str = "Risk_Score", cut: float = 0.5, s: Series = SYMBOL_DAY) -> DataFrame:
    """Lengths of consecutive warning rows per series."""
    on = F.coalesce((F.col(score) > cut).cast("int"), F.lit(0))
    staged = df.withColumn("_on", on).withColumn("_new", (F.col("_on") != F.coalesce(s.lag("_on"), F.lit(-1))).cast("int"))
    staged = staged.withColumn("_run", F.sum("_new").over(s.so_far)).where("_on = 1")
    return staged.groupBy(*s.keys, "_run").agg(F.count(F.lit(1)).alias("run_length"), F.min(s.order[0]).alias("run_start")).drop("_run")


def false_alarms(df: DataFrame, score: str = "Risk_Score", label: str = "Risk_Label", cut: float = 0.5, ahead: int = WARNING_ROWS, s: Series = SYMBOL_DAY) -> DataFrame:
    staged = df.withColumn("_next", F.max(label).over(s.rows(1, ahead))).where(F.col(score) > cut)
    miss = F.coalesce(F.col("_next") != 1, F.lit(True))
    return staged.agg(F.count_if(miss).alias("false_alarms"), F.count(F.lit(1)).alias("total_warnings"), F.avg(miss.cast("int")).alias("false_alarm_rate"))


def strategy_daily(df: DataFrame, ret: str = "Returns", score: str = "Risk_Score") -> DataFrame:
    """Exposure falls with the day's mean risk score; compounded against full exposure."""
    daily = df.groupBy("Date").agg(F.avg(ret).alias("Benchmark_Return"), F.avg(score).alias("score"))
    daily = daily.withColumn("exposure", clip(1.0 - 0.8 * F.col("score"), 0.2, 1.0))
    daily = daily.withColumn("Strategy_Return", F.col("Benchmark_Return") * F.col("exposure"))
    s = Series((), ("Date",))
    return daily.withColumns({f"{n}_Cumulative": F.product(1 + F.coalesce(F.col(f"{n}_Return"), F.lit(0.0))).over(s.so_far) for n in ("Strategy", "Benchmark")})


def strategy_summary(daily: DataFrame) -> DataFrame:
    s = Series((), ("Date",))
    peak = F.max("Strategy_Cumulative").over(s.so_far)
    daily = daily.withColumn("_dd", F.try_divide(F.col("Strategy_Cumulative") - peak, peak))

    def vol(n: str) -> Column:
        return F.stddev_samp(f"{n}_Return") * YEAR

    def sharpe(n: str) -> Column:
        return _ratio(F.avg(f"{n}_Return") * 252, vol(n))

    total = {n: F.max_by(f"{n}_Cumulative", "Date") - 1 for n in ("Strategy", "Benchmark")}
    return daily.agg(total["Strategy"].alias("total_return"), total["Benchmark"].alias("benchmark_return"), (total["Strategy"] - total["Benchmark"]).alias("excess_return"),
                     vol("Strategy").alias("volatility"), sharpe("Strategy").alias("sharpe_ratio"), F.min("_dd").alias("max_drawdown"), sharpe("Benchmark").alias("benchmark_sharpe"))


def tail_metrics(df: DataFrame, ret: str = "Returns") -> DataFrame:
    """VaR, expected shortfall, annual volatility, bias-corrected skewness and excess kurtosis."""
    df = checkpoint(df.select(F.col(ret).alias("r")).where(F.col("r").isNotNull()))
    q = one_row(exact_quantiles(df, {"v95": ("r", 0.05), "v99": ("r", 0.01)}))
    df = df.withColumn("q", q)
    n = F.count("r").cast("double")
    skew = F.skewness("r") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("r") + 6)
    return df.agg(F.max("q.v95").alias("var_95"), F.max("q.v99").alias("var_99"), F.avg(F.when(F.col("r") <= F.col("q.v95"), F.col("r"))).alias("expected_shortfall_95"),
                  F.avg(F.when(F.col("r") <= F.col("q.v99"), F.col("r"))).alias("expected_shortfall_99"), (F.stddev_samp("r") * YEAR).alias("volatility_annualized"),
                  skew.alias("skewness"), kurt.alias("kurtosis"))


def score_stability(df: DataFrame, score: str = "Risk_Score", span: int = 90, order: Sequence[str] = ("Date", "Symbol"), slice_rows: int = 500_000) -> DataFrame:
    """Rolling level and spread of scores over the whole date-ordered sequence.

    The sequence has no key, so it is cut into slices with a halo instead of one window.
    """
    placed = positions(df.select(*order, score), [], list(order))

    def build(rows: DataFrame, s: Series) -> DataFrame:
        return rows.withColumns({"ma": s.mean(score, span), "vol": s.std(score, span)})

    out = chunked(placed, [], build, before=span, rows=slice_rows)
    drift = F.max_by("ma", "_pos") - F.max(F.when(F.col("_pos") == span, F.col("ma")))
    return out.agg(F.avg(score).alias("avg_risk_score"), F.stddev_samp(score).alias("risk_score_volatility"), F.avg("vol").alias("avg_rolling_volatility"), drift.alias("model_drift"))


def crisis_metrics(df: DataFrame, windows: DataFrame, prob: str = "Risk_Probability", label: str = "Risk_Label", k: int = PRECISION_K) -> DataFrame:
    return metric_bundle(interval_join(df, windows), prob, label, k, by=["name"])


def rolling_var(df: DataFrame, ret: str = "Returns", span: int = 126, confidence: float = 0.95, z: float = NORMAL_05, s: Series = SYMBOL_DAY) -> DataFrame:
    """Historical and parametric value-at-risk thresholds over the last ``span`` known returns."""
    alpha = 1.0 - confidence
    df = df.where(F.col(ret).isNotNull())
    q = s.full(span, lambda c: F.percentile(c, F.lit(alpha)), ret)
    param = s.mean(ret, span) + z * s.full(span, F.stddev_pop, ret)
    df = df.withColumns({"_q": q, "_p": param, "_rs": F.when(F.count(ret).over(s.last(span)) >= span, F.collect_list(ret).over(s.last(span)))})
    share = F.size(F.filter("_rs", lambda x: x <= F.col("_q"))) / F.lit(float(span))
    return df.withColumns({
        "var_hist_threshold": F.when(F.col("_q").isNotNull(), F.greatest(-F.col("_q"), F.lit(0.0))),
        "var_param_threshold": F.when(F.col("_p").isNotNull(), F.greatest(-F.col("_p"), F.lit(0.0))),
        "var_exceedance_rate": F.when(F.col("_q").isNotNull(), share),
        "var_tail_probability": F.lit(alpha),
    }).drop("_q", "_p", "_rs")


def warning_flags(df: DataFrame, prob: str = "Risk_Probability", label: str = "Risk_Label", threshold: float = 0.5, rows: int = 5, s: Series = SYMBOL_DAY) -> DataFrame:
    staged = df.withColumns({"alert": (F.col(prob) >= threshold).cast("int"), "event": (F.col(label) == 1).cast("int")})
    staged = staged.withColumns({"_recent": F.max("alert").over(s.last(rows)), "_future": F.max(label).over(s.rows(0, rows - 1))})
    return staged.withColumns({"detected_event": ((F.col("event") == 1) & (F.col("_recent") == 1)).cast("int"),
                               "false_alarm": ((F.col("alert") == 1) & (F.col("_future") == 0)).cast("int")}).drop("_recent", "_future")


def _warning_parts(early: Column, penalty: Column) -> dict[str, Column]:
    return {"early_reward": early, "false_alarm_penalty": penalty, "cews": clip(early - penalty, 0.0, 1.0)}


def early_warning_score(flags: DataFrame) -> DataFrame:
    totals = flags.agg(F.sum("event").alias("total_events"), F.sum("detected_event").alias("detected_events"), F.sum("alert").alias("positive_alerts"), F.sum("false_alarm").alias("false_alarms"))
    return totals.withColumns(_warning_parts(_ratio(F.col("detected_events"), F.col("total_events")), _ratio(F.col("false_alarms"), F.col("positive_alerts"))))


def early_warning_timeline(flags: DataFrame) -> DataFrame:
    daily = flags.groupBy("Date").agg(F.sum("detected_event").alias("_d"), F.sum("event").alias("events"), F.sum("alert").alias("alerts"), F.sum("false_alarm").alias("false_alarms"))
    return daily.withColumns(_warning_parts(_ratio(F.col("_d"), F.col("events")), _ratio(F.col("false_alarms"), F.col("alerts")))).drop("_d")


def tag_case_events(df: DataFrame, threshold: float = 0.5, prob: str = "Risk_Probability", ret: str = "Returns", label: str = "Risk_Label", dd: str = "Drawdown") -> DataFrame:
    warn = F.coalesce(F.col(prob) >= threshold, F.lit(False))
    down = F.coalesce(F.col(dd) <= -0.05, F.lit(False)) | F.coalesce(F.col(ret) <= -0.02, F.lit(False)) | F.coalesce(F.col(label) == 1, F.lit(False))
    return df.withColumns({"warning_flag": warn, "downturn_flag": down, "combined_flag": warn & down})


def case_counts(tagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return tagged.groupBy(*by).agg(F.count(F.lit(1)).alias("observations"), *[F.count_if(F.col(f"{n}_flag")).alias(f"{n}_events") for n in ("warning", "downturn", "combined")])


def feature_triggers(tagged: DataFrame, features: Sequence[str], k: int = 3, keys: Sequence[str] = ("Symbol", "Date")) -> DataFrame:
    """Top-k features by absolute z-score for every warning row.

    A row has as many features as columns, so ranking them is a sort of an array in the row:
    no unpivot and no shuffle beyond the one-row statistics.
    """
    stats = tagged.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_samp(c).alias(f"d_{c}") for c in features])
    rows = tagged.where("warning_flag").withColumn("_s", one_row(stats))

    def z(c: str) -> Column:
        return F.when(F.col(f"_s.d_{c}") > 0, F.abs((F.col(c) - F.col(f"_s.m_{c}")) / F.col(f"_s.d_{c}")))

    entries = F.filter(F.array(*[F.struct((-z(c)).alias("nz"), F.lit(c).alias("feature")) for c in features]), lambda e: e["nz"].isNotNull())
    top = F.slice(F.array_sort(entries), 1, k)
    return rows.select(*keys, F.posexplode(top).alias("place", "e")).select(*keys, (F.col("place") + 1).alias("rank"), F.col("e.feature").alias("feature"), (-F.col("e.nz")).alias("z"))


def metric_deltas(base: DataFrame, other: DataFrame, on: Sequence[str] = ("metric",)) -> DataFrame:
    return base.withColumnRenamed("value", "baseline").join(other.withColumnRenamed("value", "perturbed"), list(on), "full").withColumn("delta", F.col("perturbed") - F.col("baseline"))


def hash_fold(key: Sequence[str], folds: int, seed: int = 0) -> Column:
    """Fold number from a keyed hash: stable across runs and layouts."""
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))).cast("binary"))
    return (F.conv(F.substring(h, 1, 6), 16, 10).cast("bigint") % folds).cast("int")


def compare_models(df: DataFrame, models: Sequence[str], reference: str, label: str = "Risk_Label", folds: int = 5, key: Sequence[str] = ("Symbol", "Date")) -> DataFrame:
    """AUC difference to a reference and its paired significance over hash folds."""
    long = df.withColumn("fold", hash_fold(key, folds)).select("fold", label, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in models])).alias("x"))
    per = auc(long.select("fold", label, "x.model", "x.p"), "p", label, ["model", "fold"])
    ref = per.where(F.col("model") == reference).select("fold", F.col("auc").alias("ref"))
    pairs = per.where(F.col("model") != reference).join(ref, "fold").withColumn("d", F.col("auc") - F.col("ref"))
    out = pairs.groupBy("model").agg(F.avg("d").alias("auc_difference"), F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("t_statistic"), F.count("d").alias("folds"))
    return out.withColumn("p_value", t_p_value(F.col("t_statistic"), F.col("folds") - 1))


def run_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    cols = [c for c in numeric_columns(df) if c not in keys]
    return longform(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(c) for c in cols]), keys)


def at_threshold(df: DataFrame, threshold: float, prob: str = "Risk_Probability", label: str = "Risk_Label") -> DataFrame:
    out = confusion_at(df, [threshold], prob, label, strict=False)
    return out.withColumn("alert_rate", (F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")))


def evaluation_bundle(df: DataFrame, windows: DataFrame, k: int = PRECISION_K) -> DataFrame:
    """Overall metrics, calibration and crisis metrics as one long table."""
    overall = metric_bundle(df, k=k).select(F.lit("overall").alias("section"), F.lit("all").alias("name"), "metric", "value")
    cal = calibration(df).select(F.concat(F.lit("bin_"), F.col("bin").cast("string")).alias("name"), "mean_predicted", "observed")
    cal = longform(cal, ["name"]).select(F.lit("calibration").alias("section"), "name", "metric", "value")
    crises = crisis_metrics(df, windows, k=k).select(F.lit("crisis").alias("section"), "name", "metric", "value")
    return overall.unionByName(cal).unionByName(crises)
