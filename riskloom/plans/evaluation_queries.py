"""Section H: prediction metrics, events, early warning and risk metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.series import SYMBOL_DAY
from riskloom.operators import aggregates as ag
from riskloom.operators import evaluation as ev
from riskloom.operators import indicators as ind
from riskloom.operators import labels as lab
from riskloom.operators.joins import clip_windows, interval_join
from riskloom.plans.aggregate_queries import rounded
from riskloom.plans.fixtures import W, events_catalogue, full, labelled, last, panel_returns, predictions, r, rnd, sql, text_labels, win
from riskloom.plans.registry import query

KEY = ["Symbol", "Date"]
RATIOS = f"""{r('coalesce((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 0)')} AS accuracy, {r('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)')} AS precision,
  {r('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)')} AS recall, {r('coalesce(2 * tp::DOUBLE / nullif(2 * tp + fn + fp, 0), 0)')} AS f_score"""


def confusion_sql(op: str, thresholds, source: str = "pred") -> str:
    values = ", ".join(f"({t!r}::DOUBLE)" for t in thresholds)
    return (f"SELECT t AS threshold, count(*) FILTER (p {op} t AND y = 1) AS tp, count(*) FILTER (NOT p {op} t AND y = 0) AS tn, count(*) FILTER (p {op} t AND y = 0) AS fp,"
            f" count(*) FILTER (NOT p {op} t AND y = 1) AS fn FROM (SELECT Risk_Probability AS p, Risk_Label AS y FROM {source}), (VALUES {values}) v(t) GROUP BY 1")


def auc_sql(source: str, score: str, label: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return (f"SELECT {g}sum(pos * (cn - neg / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * sum(neg), 0) AS auc FROM (SELECT *, sum(neg) OVER ({part}ORDER BY s) AS cn FROM"
            f" (SELECT {g}{score} AS s, count(*) FILTER ({label} = 1) AS pos, count(*) FILTER ({label} = 0) AS neg FROM {source} GROUP BY {g}{score})) " + (f"GROUP BY {by}" if by else ""))


def bundle_sql(source: str, by: str = "", score: str = "Risk_Probability", label: str = "Risk_Label", tie: str = "Symbol, Date") -> list[str]:
    g = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return [
        f"SELECT {g}'brier' AS metric, {r(f'avg(pow({score} - {label}, 2))')} AS value FROM {source}{grp}",
        f"SELECT {g}'precision' AS metric, {r(f'coalesce(count(*) FILTER ({score} >= 0.5 AND {label} = 1)::DOUBLE / nullif(count(*) FILTER ({score} >= 0.5), 0), 0)')} AS value FROM {source}{grp}",
        f"SELECT {g}'auc' AS metric, {r('auc')} AS value FROM ({auc_sql(source, score, label, by)})",
        f"SELECT {g}'precision_at_k' AS metric, {r(f'avg({label})')} AS value FROM (SELECT * FROM {source} QUALIFY row_number() OVER ({part}ORDER BY {score} DESC, {tie}) <= 50){grp}",
    ]


@query("h1_confusion", sql(f"SELECT *, {RATIOS} FROM c", "pred", c=confusion_sql(">", ev.THRESHOLDS)))
def h1(spark, d):
    return rounded(ev.confusion_at(predictions(spark, d)), "accuracy", "precision", "recall", "f_score")


@query("c13_threshold_grid", sql(f"SELECT *, {RATIOS} FROM c", "pred", c=confusion_sql(">=", ev.GRID)))
def c13(spark, d):
    return rounded(ev.threshold_grid(predictions(spark, d)), "accuracy", "precision", "recall", "f_score")


@query("h2_auc", sql(f"SELECT 'panel' AS name, {r('auc')} AS auc FROM ({auc_sql('pred', 'Risk_Probability', 'Risk_Label')}) UNION ALL SELECT 'text', {r('auc')} FROM ({auc_sql('textlabels', 'score', 'label')})", "pred", "textlabels"))
def h2(spark, d):
    a = ev.auc(predictions(spark, d)).select(F.lit("panel").alias("name"), rnd("auc").alias("auc"))
    return a.unionByName(ev.auc(text_labels(spark, d), "score", "label").select(F.lit("text").alias("name"), rnd("auc").alias("auc")))


@query("h3_metric_bundle", sql(" UNION ALL ".join(bundle_sql("textlabels", score="score", label="label", tie="doc_id")), "textlabels"))
def h3(spark, d):
    return rounded(ev.metric_bundle(text_labels(spark, d), "score", "label", tie=["doc_id"]), "value")


CAL = "SELECT CAST(greatest(ceil(Risk_Probability * 10) - 1, 0) AS INTEGER) AS bin, avg(Risk_Probability) AS mp, avg(Risk_Label) AS ob, count(*) AS n FROM pred GROUP BY 1"


@query("h4_calibration", sql(f"SELECT bin, {r('mp')} AS mean_predicted, {r('ob')} AS observed, n FROM ({CAL})", "pred"))
def h4(spark, d):
    return rounded(ev.calibration(predictions(spark, d)), "mean_predicted", "observed")


CURVE = dict(
    k="SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM textlabels GROUP BY 1",
    cv="SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM k",
)


@query("h5_curve_points", sql(f"SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {r('tp::DOUBLE / p')} AS recall, {r('fp::DOUBLE / n')} AS fpr, {r('tp::DOUBLE / (tp + fp)')} AS precision FROM cv", "textlabels", **CURVE))
def h5(spark, d):
    out = ev.curve_points(text_labels(spark, d), "score", "label")
    return rounded(out, "recall", "fpr", "precision").select("score", "tp", "fp", "recall", "fpr", "precision")


@query("h5_pr_auc", sql(f"SELECT {r('sum((pos::DOUBLE / p) * (tp::DOUBLE / (tp + fp) + coalesce((tp - pos)::DOUBLE / nullif(tp - pos + fp - neg, 0), 1)) / 2)')} AS pr_auc FROM cv", "textlabels", **CURVE))
def h5b(spark, d):
    return rounded(ev.pr_auc(ev.curve_points(text_labels(spark, d), "score", "label")), "pr_auc")


@query("h6_best_threshold", sql(f"SELECT t AS threshold, {r('f')} AS f_score FROM (SELECT threshold AS t, coalesce(5 * tp::DOUBLE / nullif(5 * tp + 4 * fn + fp, 0), 0) AS f FROM c) ORDER BY f DESC, t LIMIT 1", "pred", c=confusion_sql(">=", ev.GRID)))
def h6(spark, d):
    return rounded(ev.best_threshold(predictions(spark, d), beta=2.0), "f_score")


@query("h7_classification_report", sql(f"""SELECT class, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, CAST(support AS BIGINT) AS support FROM (SELECT * FROM m
    UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM m
    UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m)""", "pred",
    c="SELECT CASE WHEN Risk_Probability >= 0.5 THEN 1 ELSE 0 END AS p, Risk_Label AS y FROM pred",
    m=" UNION ALL ".join(f"SELECT '{k}' AS class, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, CAST(tp + fn AS BIGINT) AS support"
                         f" FROM (SELECT (count(*) FILTER (p = {k} AND y = {k}))::DOUBLE AS tp, count(*) FILTER (p = {k} AND y <> {k}) AS fp, count(*) FILTER (p <> {k} AND y = {k}) AS fn FROM c)" for k in (0, 1))))
def h7(spark, d):
    p = predictions(spark, d).withColumn("pred", (F.col("Risk_Probability") >= 0.5).cast("int"))
    return rounded(ev.classification_report(p, "pred"), "precision", "recall", "f1")


@query("h8_event_analysis", sql(f"""SELECT w.name, w.type, observations, {r('avg_daily_return')} AS avg_daily_return, {r('volatility')} AS volatility, {r('min_return')} AS min_return, {r('max_return')} AS max_return, {r('negative_days_pct')} AS negative_days_pct,
    risk_periods, {r('risk_rate')} AS risk_rate, {r('avg_risk_score')} AS avg_risk_score, {r('avg_risk_probability')} AS avg_risk_probability, max_risk_probability, {r('high')} AS high_risk_predictions_pct, {r('ta')} AS prob_b_avg,
    {r('tv')} AS prob_b_volatility, {r('tn')} AS prob_b_negative_pct, CASE WHEN observations IS NULL THEN 'no_data' ELSE 'ok' END AS status
    FROM windows w LEFT JOIN g USING (name)""", "pred", "windows",
    g="""SELECT name, count(*) AS observations, avg(Returns) AS avg_daily_return, stddev_samp(Returns) AS volatility, min(Returns) AS min_return, max(Returns) AS max_return, avg(CASE WHEN Returns < 0 THEN 1 WHEN Returns IS NOT NULL THEN 0 END) AS negative_days_pct,
    CAST(sum(Risk_Label) AS BIGINT) AS risk_periods, avg(Risk_Label) AS risk_rate, avg(Risk_Score) AS avg_risk_score, avg(Risk_Probability) AS avg_risk_probability, max(Risk_Probability) AS max_risk_probability,
    avg(CASE WHEN Risk_Probability > 0.7 THEN 1 ELSE 0 END) AS high, avg(prob_b) AS ta, stddev_samp(prob_b) AS tv, avg(CASE WHEN prob_b < 0 THEN 1 ELSE 0 END) AS tn FROM pred JOIN windows ON Date BETWEEN start_date AND end_date GROUP BY 1"""))
def h8(spark, d):
    out = ev.event_analysis(predictions(spark, d), events_catalogue(spark), tones=["prob_b"])
    return rounded(out, *[c for c in out.columns if c not in ("name", "type", "observations", "risk_periods", "status", "max_risk_probability")])


@query("h9_event_warning_score", sql(f"SELECT name, {r('pr')} AS pre_rate, {r('b')} AS base_rate, {r('(pr - b) / (b + 1e-6)')} AS early_warning_score FROM g, (SELECT avg(Risk_Label) AS b FROM pred)", "pred", "windows",
    g="SELECT name, avg(Risk_Label) AS pr FROM pred JOIN windows ON Date >= start_date - 30 AND Date < start_date GROUP BY 1"))
def h9(spark, d):
    return rounded(ev.event_warning_score(predictions(spark, d), events_catalogue(spark)), "pre_rate", "base_rate", "early_warning_score")


# score of half the label's volatility, so that warnings and quiet rows both occur
def warned(spark, d):
    return predictions(spark, d).withColumns({"Risk_Label": lab.flag(F.col("prob_b") > 0.55), "Risk_Score": F.col("prob_c")})


WARNED = dict(warned="SELECT Symbol, Date, Returns, CASE WHEN prob_b > 0.55 THEN 1 ELSE 0 END AS Risk_Label, prob_c AS Risk_Score FROM pred")


@query("h10_lead_times", sql(f"SELECT count(*) AS n, {r('avg(ld)')} AS mean, quantile_cont(ld, 0.5) AS median, CAST(max(ld) AS INTEGER) AS max, CAST(min(ld) AS INTEGER) AS min FROM b WHERE Risk_Label = 1 AND prev <> 1 AND ld IS NOT NULL", "pred", **WARNED,
    a=f"SELECT *, row_number() OVER ({W}) AS n, coalesce(lag(Risk_Label) OVER ({W}), 0) AS prev FROM warned",
    b=f"SELECT *, n - min(CASE WHEN Risk_Score > 0.5 THEN n END) OVER {win('30 PRECEDING', '1 PRECEDING')} AS ld FROM a"))
def h10(spark, d):
    return rounded(ev.spread_of(ev.lead_times(warned(spark, d)), "lead_rows"), "mean")


@query("h11_warning_runs", sql(f"SELECT Symbol, min(Date) AS run_start, count(*) AS run_length FROM b WHERE w GROUP BY Symbol, run", "pred", **WARNED,
    a=f"SELECT *, Risk_Score > 0.5 AS w, row_number() OVER ({W}) AS n FROM warned", b="SELECT *, n - row_number() OVER (PARTITION BY Symbol, w ORDER BY Date) AS run FROM a"))
def h11(spark, d):
    return ev.warning_runs(warned(spark, d)).select("Symbol", "run_start", "run_length")


@query("h12_false_alarms", sql(f"SELECT count(*) FILTER (nx IS NULL OR nx <> 1) AS false_alarms, count(*) AS total_warnings, {r('avg(CASE WHEN nx IS NULL OR nx <> 1 THEN 1 ELSE 0 END)')} AS false_alarm_rate FROM a WHERE Risk_Score > 0.5", "pred", **WARNED,
    a=f"SELECT *, max(Risk_Label) OVER {win('1 FOLLOWING', '30 FOLLOWING')} AS nx FROM warned"))
def h12(spark, d):
    return rounded(ev.false_alarms(warned(spark, d)), "false_alarm_rate")


STRATEGY = dict(
    sd="SELECT Date, avg(Returns / 1000) AS b, avg(Risk_Score) AS s FROM pred GROUP BY 1", se="SELECT *, b * least(greatest(1 - 0.8 * s, 0.2), 1) AS st, least(greatest(1 - 0.8 * s, 0.2), 1) AS ex FROM sd",
    sc="SELECT *, product(1 + coalesce(st, 0)) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING) AS cs, product(1 + coalesce(b, 0)) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING) AS cb FROM se",
    sp="SELECT *, (cs - max(cs) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING)) / max(cs) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING) AS dd FROM sc",
)


def strategy(spark, d):
    return ev.strategy_daily(predictions(spark, d).withColumn("Returns", F.col("Returns") / 1000))


@query("h13_strategy_daily", sql(f"SELECT Date, {r('ex')} AS exposure, {r('st', 7)} AS Strategy_Return, {r('cs', 4)} AS Strategy_Cumulative, {r('cb', 4)} AS Benchmark_Cumulative FROM sc", "pred", **STRATEGY))
def h13(spark, d):
    out = rounded(rounded(rounded(strategy(spark, d), "exposure"), "Strategy_Return", digits=7), "Strategy_Cumulative", "Benchmark_Cumulative", digits=4)
    return out.select("Date", "exposure", "Strategy_Return", "Strategy_Cumulative", "Benchmark_Cumulative")


_v = "(stddev_samp({0}) * sqrt(252.0::DOUBLE))"


@query("h13_strategy_summary", sql(f"""SELECT {r('arg_max(cs, Date) - 1', 3)} AS total_return, {r('arg_max(cb, Date) - 1', 3)} AS benchmark_return, {r('arg_max(cs, Date) - arg_max(cb, Date)', 3)} AS excess_return, {r(_v.format('st'))} AS volatility,
    {r('avg(st) * 252 / ' + _v.format('st'))} AS sharpe_ratio, {r('min(dd)')} AS max_drawdown, {r('avg(b) * 252 / ' + _v.format('b'))} AS benchmark_sharpe FROM sp""", "pred", **STRATEGY))
def h13b(spark, d):
    out = ev.strategy_summary(strategy(spark, d))
    return rounded(rounded(out, "total_return", "benchmark_return", "excess_return", digits=3), "volatility", "sharpe_ratio", "max_drawdown", "benchmark_sharpe")


@query("h14_tail_metrics", sql(f"""SELECT {r('any_value(v95)')} AS var_95, {r('any_value(v99)')} AS var_99, {r('avg(Returns) FILTER (Returns <= v95)')} AS expected_shortfall_95, {r('avg(Returns) FILTER (Returns <= v99)')} AS expected_shortfall_99,
    {r('stddev_samp(Returns) * sqrt(252.0::DOUBLE)', 5)} AS volatility_annualized, {r('skewness(Returns)', 5)} AS skewness, {r('kurtosis(Returns)', 4)} AS kurtosis FROM ret, (SELECT quantile_cont(Returns, 0.05) AS v95, quantile_cont(Returns, 0.01) AS v99 FROM ret)""", "ret"))
def h14(spark, d):
    out = ev.tail_metrics(panel_returns(spark, d))
    out = rounded(out, "var_95", "var_99", "expected_shortfall_95", "expected_shortfall_99")
    return rounded(rounded(out, "volatility_annualized", "skewness", digits=5), "kurtosis", digits=4)


@query("h15_score_stability", sql(f"SELECT {r('avg(Risk_Score)')} AS avg_risk_score, {r('stddev_samp(Risk_Score)')} AS risk_score_volatility, {r('avg(v)')} AS avg_rolling_volatility, {r('arg_max(m, n) - max(m) FILTER (n = 91)')} AS model_drift FROM b", "pred",
    a="SELECT *, row_number() OVER (ORDER BY Date, Symbol) AS n FROM (SELECT Symbol, Date, prob_c AS Risk_Score FROM pred)",
    b="SELECT *, CASE WHEN n >= 90 THEN avg(Risk_Score) OVER w END AS m, CASE WHEN n >= 90 THEN stddev_samp(Risk_Score) OVER w END AS v FROM a WINDOW w AS (ORDER BY n ROWS 89 PRECEDING)"))
def h15(spark, d):
    out = ev.score_stability(predictions(spark, d), score="prob_c", slice_rows=10_000)
    return rounded(out, *out.columns)


CRISIS = dict(cr="SELECT name, p.* FROM pred p JOIN windows ON Date BETWEEN start_date AND end_date")


@query("h16_crisis_metrics", sql(" UNION ALL ".join(bundle_sql("cr", "name")), "pred", "windows", **CRISIS))
def h16(spark, d):
    return rounded(ev.crisis_metrics(predictions(spark, d), events_catalogue(spark)), "value")


_w126 = last(126)


@query("h17_rolling_var", sql(f"""SELECT Symbol, Date, {r('greatest(-q, 0)')} AS var_hist_threshold, {r('greatest(-p, 0)')} AS var_param_threshold, {r('len(list_filter(rs, lambda x: x <= q)) / 126.0::DOUBLE')} AS var_exceedance_rate FROM b WHERE q IS NOT NULL""", "ret",
    a="SELECT * FROM ret WHERE Returns IS NOT NULL",
    b=f"SELECT *, {full('quantile_cont(Returns, 0.05)', 'Returns', 126)} AS q, {full('avg(Returns)', 'Returns', 126)} + -1.6448536269514729 * {full('stddev_pop(Returns)', 'Returns', 126)} AS p, list(Returns) OVER {_w126} AS rs FROM a"))
def h17(spark, d):
    out = ev.rolling_var(panel_returns(spark, d)).where(F.col("var_hist_threshold").isNotNull())
    return out.select(*KEY, *[rnd(c).alias(c) for c in ("var_hist_threshold", "var_param_threshold", "var_exceedance_rate")])


FLAGS = dict(
    f0="SELECT *, CASE WHEN Risk_Probability >= 0.5 THEN 1 ELSE 0 END AS alert FROM (SELECT * REPLACE (CASE WHEN prob_b > 0.55 THEN 1 ELSE 0 END AS Risk_Label) FROM pred)",
    flags=f"""SELECT *, CASE WHEN Risk_Label = 1 AND max(alert) OVER {last(5)} = 1 THEN 1 ELSE 0 END AS det,
      CASE WHEN alert = 1 AND max(Risk_Label) OVER {win('CURRENT ROW', '4 FOLLOWING')} = 0 THEN 1 ELSE 0 END AS fa FROM f0""",
)
PARTS = f"""{r('e')} AS early_reward, {r('f')} AS false_alarm_penalty, {r('least(greatest(e - f, 0), 1)')} AS cews"""


def flagged(spark, d):
    return ev.warning_flags(predictions(spark, d).withColumn("Risk_Label", lab.flag(F.col("prob_b") > 0.55)))


@query("h18_early_warning_score", sql(f"SELECT total_events, detected_events, positive_alerts, false_alarms, {PARTS} FROM (SELECT *, coalesce(detected_events::DOUBLE / nullif(total_events, 0), 0) AS e, coalesce(false_alarms::DOUBLE / nullif(positive_alerts, 0), 0) AS f FROM g)", "pred", **FLAGS,
    g="SELECT CAST(sum(Risk_Label) AS BIGINT) AS total_events, CAST(sum(det) AS BIGINT) AS detected_events, CAST(sum(alert) AS BIGINT) AS positive_alerts, CAST(sum(fa) AS BIGINT) AS false_alarms FROM flags"))
def h18(spark, d):
    return rounded(ev.early_warning_score(flagged(spark, d)), "early_reward", "false_alarm_penalty", "cews")


TIMELINE = dict(tl0="SELECT Date, CAST(sum(det) AS BIGINT) AS det, CAST(sum(Risk_Label) AS BIGINT) AS events, CAST(sum(alert) AS BIGINT) AS alerts, CAST(sum(fa) AS BIGINT) AS false_alarms FROM flags GROUP BY 1",
                tl="SELECT *, coalesce(det::DOUBLE / nullif(events, 0), 0) AS e, coalesce(false_alarms::DOUBLE / nullif(alerts, 0), 0) AS f FROM tl0")


@query("h18_early_warning_timeline", sql(f"SELECT Date, events, alerts, false_alarms, {PARTS} FROM tl", "pred", **FLAGS, **TIMELINE))
def h18b(spark, d):
    return rounded(ev.early_warning_timeline(flagged(spark, d)), "early_reward", "false_alarm_penalty", "cews")


CASE = dict(
    cs0=f"SELECT *, coalesce(Close / nullif(max(Close) OVER {win('UNBOUNDED PRECEDING')}, 0) - 1, 0) AS dd FROM pred",
    case_="""SELECT name, c.*, Risk_Probability >= 0.6 AS w, (dd <= -0.05 OR coalesce(Returns, 0) <= -0.02 OR Risk_Label = 1) AS dn FROM cs0 c JOIN (SELECT name, start_date, end_date FROM windows) ON Date BETWEEN start_date AND end_date""",
)


def case_rows(spark, d):
    p = ind.drawdown(predictions(spark, d))
    return ev.tag_case_events(interval_join(p, events_catalogue(spark)), threshold=0.6)


@query("h19_case_counts", sql("SELECT name, count(*) AS observations, count(*) FILTER (w) AS warning_events, count(*) FILTER (dn) AS downturn_events, count(*) FILTER (w AND dn) AS combined_events FROM case_ GROUP BY 1", "pred", "windows", **CASE))
def h19(spark, d):
    return ev.case_counts(case_rows(spark, d), ["name"])


_feats = ["Close", "Returns", "prob_b", "prob_c"]


@query("f7_feature_triggers", sql("SELECT Symbol, Date, CAST(rank AS INTEGER) AS rank, feature, " + r("z", 5) + " AS z FROM k WHERE rank <= 3", "pred",
    s="SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS d_{c}" for c in _feats) + " FROM pred",
    u=" UNION ALL ".join(f"SELECT Symbol, Date, '{c}' AS feature, abs(({c} - m_{c}) / d_{c}) AS z FROM pred, s WHERE Risk_Probability >= 0.6" for c in _feats),
    k="SELECT *, row_number() OVER (PARTITION BY Symbol, Date ORDER BY z DESC, feature) AS rank FROM u WHERE z IS NOT NULL"))
def f7(spark, d):
    tagged = ev.tag_case_events(ind.drawdown(predictions(spark, d)), threshold=0.6)
    return rounded(ev.feature_triggers(tagged, _feats), "z", digits=5)


@query("f7_trigger_counts", sql("SELECT feature, count(*) AS n FROM k WHERE rank <= 3 GROUP BY 1", "pred",
    s="SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS d_{c}" for c in _feats) + " FROM pred",
    u=" UNION ALL ".join(f"SELECT Symbol, Date, '{c}' AS feature, abs(({c} - m_{c}) / d_{c}) AS z FROM pred, s WHERE Risk_Probability >= 0.6" for c in _feats),
    k="SELECT *, row_number() OVER (PARTITION BY Symbol, Date ORDER BY z DESC, feature) AS rank FROM u WHERE z IS NOT NULL"))
def f7b(spark, d):
    tagged = ev.tag_case_events(ind.drawdown(predictions(spark, d)), threshold=0.6)
    return ev.feature_triggers(tagged, _feats).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("f6_precision_at_k", sql(f"SELECT {r('avg(Risk_Label)')} AS precision_at_k FROM (SELECT * FROM pred ORDER BY Risk_Probability DESC, Symbol, Date LIMIT 500)", "pred"))
def f6(spark, d):
    return rounded(ev.precision_at_k(predictions(spark, d), 500), "precision_at_k")


@query("h20_metric_deltas", sql(f"SELECT metric, {r('a')} AS baseline, {r('b')} AS perturbed, {r('b - a')} AS delta FROM (SELECT 'mean' AS metric, avg(Risk_Probability) AS a, avg(prob_b) AS b FROM pred UNION ALL SELECT 'brier', avg(pow(Risk_Probability - Risk_Label, 2)), avg(pow(prob_b - Risk_Label, 2)) FROM pred)", "pred"))
def h20(spark, d):
    p = predictions(spark, d)

    def long(c: str):
        return ag.longform(p.agg(F.avg(c).alias("mean"), F.avg(F.pow(F.col(c) - F.col("Risk_Label"), 2)).alias("brier")))

    return rounded(ev.metric_deltas(long("Risk_Probability"), long("prob_b")), "baseline", "perturbed", "delta")


FOLD = "CAST(('0x' || substr(md5(Symbol || '|' || CAST(Date AS VARCHAR) || '|0'), 1, 6))::BIGINT % 5 AS INTEGER)"
FOLDED = dict(
    y=f"SELECT *, CASE WHEN Returns < 0 THEN 1 ELSE 0 END AS yy, {FOLD} AS fold FROM pred",
    u="SELECT fold, yy, 'Risk_Probability' AS model, Risk_Probability AS p FROM y UNION ALL SELECT fold, yy, 'prob_b', prob_b FROM y UNION ALL SELECT fold, yy, 'prob_c', prob_c FROM y",
    fa=auc_sql("u", "p", "yy", "model, fold"),
    dd="SELECT a.model, a.auc - b.auc AS d FROM fa a JOIN fa b USING (fold) WHERE b.model = 'Risk_Probability' AND a.model <> 'Risk_Probability'",
)


@query("h21_compare_models", sql(f"SELECT model, {r('avg(d)')} AS auc_difference, {r('avg(d) / (stddev_samp(d) / sqrt(count(d)))', 4)} AS t_statistic, count(d) AS folds FROM dd GROUP BY 1", "pred", **FOLDED))
def h21(spark, d):
    p = predictions(spark, d).withColumn("y", lab.flag(F.col("Returns") < 0))
    out = ev.compare_models(p, ["Risk_Probability", "prob_b", "prob_c"], "Risk_Probability", "y")
    return rounded(rounded(out, "auc_difference"), "t_statistic", digits=4).drop("p_value")


@query("h21_model_significance")
def h21p(spark, d):
    p = predictions(spark, d).withColumn("y", lab.flag(F.col("Returns") < 0))
    return ev.compare_models(p, ["Risk_Probability", "prob_b", "prob_c"], "Risk_Probability", "y")


@query("h22_run_summary", sql(" UNION ALL ".join(f"SELECT '{m}' AS metric, {r(e + '::DOUBLE', 5)} AS value FROM pred" for m, e in [("rows", "count(*)"), *[(c, f"avg({c})") for c in ("Close", "Returns", "Risk_Label", "Risk_Score", "Risk_Probability", "prob_b", "prob_c")]]), "pred"))
def h22(spark, d):
    return rounded(ev.run_summary(predictions(spark, d)), "value", digits=5)


@query("h23_at_threshold", sql(f"SELECT *, {RATIOS}, {r('(tp + fp)::DOUBLE / (tp + fp + tn + fn)')} AS alert_rate FROM c", "pred", c=confusion_sql(">=", [0.42])))
def h23(spark, d):
    return rounded(ev.at_threshold(predictions(spark, d), 0.42), "accuracy", "precision", "recall", "f_score", "alert_rate")


@query("j14_evaluation_bundle", sql(" UNION ALL ".join(
    [f"SELECT 'overall' AS section, 'all' AS name, metric, value FROM ({q})" for q in bundle_sql("pred")]
    + [f"SELECT 'calibration', 'bin_' || bin, '{m}', {r(c)} FROM ({CAL})" for m, c in (("mean_predicted", "mp"), ("observed", "ob"))]
    + [f"SELECT 'crisis', name, metric, value FROM ({q})" for q in bundle_sql("cr", "name")]), "pred", "windows", **CRISIS))
def j14(spark, d):
    return rounded(ev.evaluation_bundle(predictions(spark, d), events_catalogue(spark)), "value")


def flagship(spark, d):
    """Panel, returns, volatility, label, regime and smoothed probability, then the daily risk
    level beside the daily early-warning score."""
    s = SYMBOL_DAY
    p = ind.volatility(panel_returns(spark, d), spans=(20,))
    p = lab.volatility_regime(lab.label_mean_step(p))
    p = p.withColumn("Risk_Probability", F.avg("Risk_Label").over(s.last(3)))
    flags = ev.warning_flags(p)
    daily = flags.groupBy("Date").agg(
        F.avg("Risk_Label").alias("Risk_Level"), F.count(F.lit(1)).alias("Sample_Count"), F.avg("Volatility_20d").alias("mean_volatility"),
        F.count_if(F.col("regime") == "high_volatility").alias("high_volatility_symbols"), F.sum("detected_event").alias("detected"), F.sum("event").alias("events"),
        F.sum("alert").alias("alerts"), F.sum("false_alarm").alias("false_alarms"))
    return rounded(daily, "Risk_Level", "mean_volatility")


@query("flagship_risk_timeline", sql(f"""SELECT Date, {r('avg(Risk_Label)')} AS Risk_Level, count(*) AS Sample_Count, {r('avg(v20)')} AS mean_volatility, count(*) FILTER (v30 >= hi) AS high_volatility_symbols, CAST(sum(det) AS BIGINT) AS detected, CAST(sum(Risk_Label) AS BIGINT) AS events,
    CAST(sum(alert) AS BIGINT) AS alerts, CAST(sum(fa) AS BIGINT) AS false_alarms FROM fl, (SELECT quantile_cont(v30, 0.66) AS hi FROM b) GROUP BY 1""", "labelled",
    a=f"SELECT *, avg(Risk_Label) OVER {last(3)} AS prob, {full('stddev_samp(Returns)', 'Returns', 20)} * sqrt(252.0::DOUBLE) AS v20, {full('stddev_samp(Returns)', 'Returns', 30, at_least=10)} AS v30 FROM labelled",
    b="SELECT *, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS alert FROM a",
    fl=f"SELECT *, CASE WHEN Risk_Label = 1 AND max(alert) OVER {last(5)} = 1 THEN 1 ELSE 0 END AS det, CASE WHEN alert = 1 AND max(Risk_Label) OVER {win('CURRENT ROW', '4 FOLLOWING')} = 0 THEN 1 ELSE 0 END AS fa FROM b"))
def flagship_query(spark, d):
    return flagship(spark, d)
