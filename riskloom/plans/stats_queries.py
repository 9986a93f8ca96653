"""Sections J (tests and perturbations) and K (graphs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import graph as gr
from riskloom.operators import robustness as rb
from riskloom.operators import stats as st
from riskloom.plans.aggregate_queries import rounded
from riskloom.plans.fixtures import W, labelled, panel_returns, predictions, r, rnd, scored_filings, scored_news, sql, text_labels, win
from riskloom.plans.join_queries import news_panel
from riskloom.plans.registry import query
from riskloom.session import checkpoint

KEY = ["Symbol", "Date"]


@query("j1_paired_t", sql(f"SELECT n, {r('a')} AS mean_a, {r('b')} AS mean_b, {r('d')} AS mean_difference, {r('d / s')} AS effect_size, {r('d * sqrt(n) / s', 4)} AS statistic FROM (SELECT count(*) AS n, avg(prob_b) AS a, avg(prob_c) AS b, avg(prob_b - prob_c) AS d, stddev_samp(prob_b - prob_c) AS s FROM pred)", "pred"))
def j1(spark, d):
    out = st.paired_t_test(predictions(spark, d), "prob_b", "prob_c").drop("p_value")
    return rounded(rounded(out, "mean_a", "mean_b", "mean_difference", "effect_size"), "statistic", digits=4)


@query("j1_paired_t_by_symbol")
def j1p(spark, d):
    return st.paired_t_test(predictions(spark, d), "prob_b", "prob_c", ["Symbol"])


PERMUTATIONS = 1000
# bit p of a row: bit 3 - p % 4 of hex digit p // 4 of its hashes, one after the other
_bits = f"SELECT p, avg(d * ((((('0x' || substr(h, CAST(1 + p // 4 AS INTEGER), 1))::INTEGER >> CAST(3 - p % 4 AS INTEGER)) & 1) * 2) - 1)) AS m FROM a, range({PERMUTATIONS}) t(p) GROUP BY 1"
_hashes = " || ".join(f"md5(Symbol || '|' || CAST(Date AS VARCHAR) || '|7|{i}')" for i in range(-(-PERMUTATIONS // 128)))


@query("j2_permutation", sql(f"SELECT {r('o')} AS statistic, {r('o / s')} AS effect_size, count(*) FILTER (abs(m) >= abs(o)) AS extreme, {r('(count(*) FILTER (abs(m) >= abs(o)) + 1) / 1001.0::DOUBLE')} AS p_value, {r('sum(abs(m))')} AS total_spread FROM b, (SELECT avg(d) AS o, stddev_samp(d) AS s FROM a) GROUP BY o, s", "pred",
    a=f"SELECT Risk_Score - Risk_Probability AS d, {_hashes} AS h FROM (SELECT Symbol, Date, prob_b AS Risk_Score, Risk_Probability FROM pred)", b=_bits))
def j2(spark, d):
    p = predictions(spark, d)
    test = st.permutation_test(p, "prob_b", "Risk_Probability", KEY, PERMUTATIONS, seed=7)
    spread = st.sign_flip_means(p, "prob_b", "Risk_Probability", KEY, PERMUTATIONS, seed=7).agg(F.sum(F.abs("mean"))).scalar()
    return rounded(test.withColumn("total_spread", spread), "statistic", "effect_size", "p_value", "total_spread").drop("mean_a", "mean_b")


@query("j3_granger")
def j3(spark, d):
    return st.granger(panel_returns(spark, d), "Volume", "Returns", 3)


@query("j3_granger_by_symbol")
def j3b(spark, d):
    return st.granger(panel_returns(spark, d), "Volume", "Returns", 2, by=["Symbol"])


def ks_sql(source: str, value: str, is_a: str, is_b: str, by: str = "") -> str:
    g, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    grp = f" GROUP BY {by}" if by else ""
    return (f"SELECT {g}max(abs(ta / na - tb / nb)) AS ks, any_value(na) AS na, any_value(nb) AS nb, sum(v * ca) / any_value(na) AS ma, sum(v * cb) / any_value(nb) AS mb FROM (SELECT *, sum(ca) OVER ({part}ORDER BY v)::DOUBLE AS ta, sum(cb) OVER ({part}ORDER BY v)::DOUBLE AS tb,"
            f" nullif(sum(ca) OVER ({part}), 0)::DOUBLE AS na, nullif(sum(cb) OVER ({part}), 0)::DOUBLE AS nb FROM (SELECT {g}{value} AS v, count(*) FILTER ({is_a}) AS ca, count(*) FILTER ({is_b}) AS cb FROM {source} WHERE {value} IS NOT NULL GROUP BY {g}{value})){grp}")


@query("j7_ks", sql(f"SELECT {r('ks')} AS ks_statistic, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, {r('ma')} AS mean_a, {r('mb')} AS mean_b FROM ({ks_sql('textlabels', 'score', 'label = 1', 'label = 0')})", "textlabels"))
def j7(spark, d):
    t = text_labels(spark, d).withColumn("g", F.when(F.col("label") == 1, "good").otherwise("bad"))
    return rounded(st.ks_test(t, "score", "g", "good", "bad"), "ks_statistic", "mean_a", "mean_b").drop("p_value")


@query("j7_ks_significance")
def j7p(spark, d):
    return st.ks_test(text_labels(spark, d).withColumn("g", F.when(F.col("label") == 1, "good").otherwise("bad")), "score", "g", "good", "bad")


SOURCES = {"news": ["title_sentiment_compound", "combined_sentiment_compound"], "filing": ["mda_sentiment", "risk_factors_sentiment"]}


def both_tones(spark, d):
    n = scored_news(spark, d).select("doc_id", "Symbol", "title_sentiment_compound", "combined_sentiment_compound")
    f = scored_filings(spark, d).select(F.col("page_id").alias("doc_id"), "mda_sentiment", "risk_factors_sentiment")
    return n.join(f, "doc_id", "left")


TONES = dict(
    bt="SELECT Symbol, tc, cc, m, k FROM scored LEFT JOIN (SELECT page_id AS doc_id, m, k FROM secscored) USING (doc_id)",
    lv="SELECT Symbol, 'news' AS source, 'title_sentiment_compound' AS col, tc AS v FROM bt UNION ALL SELECT Symbol, 'news', 'combined_sentiment_compound', cc FROM bt UNION ALL SELECT Symbol, 'filing', 'mda_sentiment', m FROM bt WHERE m IS NOT NULL UNION ALL SELECT Symbol, 'filing', 'risk_factors_sentiment', k FROM bt WHERE k IS NOT NULL",
)


@query("j8_bias_audit", sql(f"""SELECT source, col AS "column", {r('avg(v)')} AS mean, {r('stddev_pop(v)')} AS std, {r('skewness(v)')} AS skew, {r('avg(CASE WHEN v > 0.05 THEN 1 ELSE 0 END)')} AS positive_rate, {r('avg(CASE WHEN v < -0.05 THEN 1 ELSE 0 END)')} AS negative_rate, count(*) AS observation_count
    FROM (SELECT source, col, v FROM lv UNION ALL SELECT source, '(all)', v FROM lv) GROUP BY 1, 2""", "scored", "secscored", **TONES))
def j8(spark, d):
    return rounded(st.bias_audit(both_tones(spark, d), SOURCES), "mean", "std", "skew", "positive_rate", "negative_rate")


@query("j8_bias_ks_by_symbol", sql(f"SELECT Symbol, {r('ks')} AS ks_statistic, {r('ma')} AS mean_a, {r('mb')} AS mean_b, {r('ma - mb')} AS mean_difference FROM ({ks_sql('lv', 'v', chr(115) + 'ource = ' + chr(39) + 'news' + chr(39), 'source = ' + chr(39) + 'filing' + chr(39), 'Symbol')})", "scored", "secscored", **TONES))
def j8b(spark, d):
    out = st.source_ks(both_tones(spark, d), SOURCES, "news", "filing", ["Symbol"])
    return rounded(out.select("Symbol", "ks_statistic", "mean_a", "mean_b", "mean_difference"), "ks_statistic", "mean_a", "mean_b", "mean_difference")


def u_sql(*salt: str) -> str:
    return "(('0x' || substr(md5(Symbol || '|' || CAST(Date AS VARCHAR) || '|" + "|".join(salt) + "'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("j9_noise", sql(f"SELECT Symbol, Date, {r('Close + sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v) * s * 0.05', 4)} AS Close, {r('Volume + (w * 2 - 1) * t * 0.1', 5)} AS Volume FROM a, (SELECT stddev_pop(Close) AS s, stddev_pop(Volume) AS t FROM panel)", "panel",
    a=f"SELECT *, {u_sql('42', 'Close', 'u')} AS u, {u_sql('42', 'Close', 'v')} AS v, {u_sql('42', 'Volume', 'u')} AS w FROM panel"))
def j9(spark, d):
    from riskloom.plans.fixtures import panel

    p = rb.add_noise(panel(spark, d).select(*KEY, "Close", "Volume"), ["Close"], 0.05)
    p = rb.add_noise(p, ["Volume"], 0.1, strategy="uniform")
    return p.select(*KEY, rnd("Close", 4).alias("Close"), rnd("Volume", 5).alias("Volume"))


@query("j10_mask", sql(f"SELECT Symbol, Date, CASE WHEN NOT {u_sql('42', 'mask')} < 0.2 THEN Volume END AS Volume FROM panel", "panel"))
def j10(spark, d):
    from riskloom.plans.fixtures import panel

    return rb.mask_rows(panel(spark, d).select(*KEY, "Volume"), ["Volume"], 0.2)


def _variance(h: str, x: str) -> str:
    return f"(1 - ua / 10000.0::DOUBLE - ub / 10000.0::DOUBLE) * v + ua / 10000.0::DOUBLE * {x} * {x} + ub / 10000.0::DOUBLE * {h}"


def _best_sql(points: str) -> str:
    step = f"lambda a, b: {{'r': 0.0::DOUBLE, 'h': {_variance('a.h', 'b.r')}, 'll': a.ll - 0.5::DOUBLE * (ln(2 * pi()) + ln(a.h) + b.r * b.r / a.h)}}"
    ll = f"(list_reduce(x, {step}, {{'r': 0.0::DOUBLE, 'h': v, 'll': 0.0::DOUBLE}})).ll"
    return f"SELECT * FROM (SELECT *, {ll} AS ll FROM ({points})) QUALIFY row_number() OVER (PARTITION BY Symbol ORDER BY ll DESC, ua, ub) = 1"


def _around_sql(best: str, step: int) -> str:
    return f"SELECT * FROM (SELECT Symbol, v, x, ua + {step} * i AS ua, ub + {step} * j AS ub FROM {best}, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j)) WHERE ua >= 10 AND ub >= 0 AND ua + ub <= 9990"


_garch = dict(
    g0="SELECT Symbol, Date, Returns AS r, row_number() OVER (PARTITION BY Symbol ORDER BY Date) AS i FROM ret WHERE Returns IS NOT NULL",
    gs="SELECT Symbol, count(*) AS n, var_pop(r) AS v, list({'r': r, 'h': 0.0::DOUBLE, 'll': 0.0::DOUBLE} ORDER BY i) AS x FROM g0 GROUP BY 1",
    b0=_best_sql(f"SELECT Symbol, v, x, ua, ub FROM gs, (VALUES {', '.join(f'({round(a * 10000)}, {round(b * 10000)})' for a, b in rb.GARCH_GRID)}) t(ua, ub) WHERE n >= 100 AND v > 0"),
    b1=_best_sql(_around_sql("b0", rb.REFINE[0])), b2=_best_sql(_around_sql("b1", rb.REFINE[1])),
    hh=f"SELECT Symbol, 1::BIGINT AS i, v AS h FROM b2 UNION ALL SELECT hh.Symbol, hh.i + 1, {_variance('hh.h', 'g0.r')} FROM hh JOIN g0 ON g0.Symbol = hh.Symbol AND g0.i = hh.i JOIN b2 ON b2.Symbol = hh.Symbol",
)


@query("j13_garch", sql(f"SELECT g0.Symbol, Date, ua / 10000.0::DOUBLE AS alpha, ub / 10000.0::DOUBLE AS beta, {r('ll', 4)} AS loglik, {r('sqrt(h)')} AS garch_volatility, CASE WHEN n < 100 THEN 'too_short' WHEN gs.v > 0 THEN 'ok' ELSE 'constant' END AS status, {r('sqrt(h) * 1.6448536269514722')} AS garch_var_threshold FROM g0 JOIN gs USING (Symbol) LEFT JOIN b2 USING (Symbol) LEFT JOIN hh ON hh.Symbol = g0.Symbol AND hh.i = g0.i", "ret", **_garch).replace("WITH ", "WITH RECURSIVE ", 1))
def j13(spark, d):
    out = rb.garch(panel_returns(spark, d)).drop("garch_tail_probability")
    return rounded(rounded(out, "garch_volatility", "garch_var_threshold"), "loglik", digits=4)


@query("j13_garch_tail")
def j13b(spark, d):
    return rb.garch(panel_returns(spark, d)).select(*KEY, "garch_volatility", "garch_tail_probability")


GRAPH = dict(
    fd="SELECT Symbol, CAST(unnest(generate_series(min(Date), any_value(mx), INTERVAL 1 DAY)) AS DATE) AS Date FROM ret, (SELECT max(Date) AS mx FROM ret) GROUP BY Symbol",
    al0="SELECT fd.Symbol, fd.Date, Returns FROM fd LEFT JOIN ret USING (Symbol, Date) WHERE fd.Date IN (SELECT Date FROM ret)",
    al=f"SELECT * FROM (SELECT Symbol, Date, last_value(Returns IGNORE NULLS) OVER {win('UNBOUNDED PRECEDING')} AS r FROM al0) WHERE r IS NOT NULL",
    pr="SELECT x.Symbol AS a, y.Symbol AS b, x.Date, x.r AS ra, y.r AS rb FROM al x JOIN al y ON x.Date = y.Date AND x.Symbol < y.Symbol",
    # an undefined correlation (a side that does not vary) counts as 0; DuckDB returns NaN there
    pc="SELECT a, b, Date, CASE WHEN isnan(corr(ra, rb) OVER w) THEN 0 ELSE coalesce(corr(ra, rb) OVER w, 0) END AS c FROM pr WINDOW w AS (PARTITION BY a, b ORDER BY Date ROWS 59 PRECEDING) QUALIFY count(*) OVER w >= 30",
)
EDGES = dict(ed="SELECT Date, a AS src, b AS dst, c AS w FROM pc WHERE abs(c) >= 0.3 UNION ALL SELECT Date, b, a, c FROM pc WHERE abs(c) >= 0.3")


def correlations(spark, d):
    return gr.pair_correlations(panel_returns(spark, d))


def daily_edges(spark, d):
    """Edges of every market day, written once."""
    return checkpoint(gr.edges(correlations(spark, d)))


@query("k1_pair_correlation", sql(f"SELECT a, b, count(*) AS days, {r('avg(c)', 5)} AS mean_corr, {r('min(c)', 5)} AS min_corr, {r('max(c)', 5)} AS max_corr FROM pc GROUP BY 1, 2", "ret", **GRAPH))
def k1(spark, d):
    out = correlations(spark, d).groupBy("a", "b").agg(F.count(F.lit(1)).alias("days"), F.avg("corr").alias("mean_corr"), F.min("corr").alias("min_corr"), F.max("corr").alias("max_corr"))
    return rounded(out, "mean_corr", "min_corr", "max_corr", digits=5)


@query("k2_graph_density", sql(f"SELECT Date, pairs, possible, {r('CASE WHEN possible > 0 THEN pairs::DOUBLE / possible ELSE 0 END')} AS density FROM (SELECT n.Date, coalesce(s.pairs, 0) AS pairs, n.n * (n.n - 1) // 2 AS possible FROM (SELECT Date, count(*) AS n FROM al GROUP BY 1) n LEFT JOIN (SELECT Date, count(*) FILTER (abs(c) >= 0.3) AS pairs FROM pc GROUP BY 1) s USING (Date))", "ret", **GRAPH))
def k2(spark, d):
    rows = checkpoint(panel_returns(spark, d).select(*KEY, "Returns"))
    return rounded(gr.density(gr.pair_correlations(rows), gr.aligned_returns(rows)), "density")


@query("k2_edges", sql(f"SELECT Date, src, dst, {r('w', 5)} AS weight FROM ed", "ret", **GRAPH, **EDGES))
def k2b(spark, d):
    return rounded(daily_edges(spark, d), "weight", digits=5)


@query("k3_degree", sql(f"SELECT Date, src AS Symbol, count(*) AS degree, {r('sum(abs(w))', 5)} AS strength FROM ed GROUP BY 1, 2", "ret", **GRAPH, **EDGES))
def k3(spark, d):
    return rounded(gr.degrees(daily_edges(spark, d)), "strength", digits=5)


@query("k3_eigenvector")
def k3b(spark, d):
    return gr.eigenvector(daily_edges(spark, d))


@query("k4_clustering", sql(f"""SELECT n.Date, n.Symbol, {r('coalesce(g / nullif(d * (d - 1), 0), 0)', 5)} AS graph_clustering FROM n LEFT JOIN t USING (Date, Symbol)""", "ret", **GRAPH, **EDGES,
    wn="SELECT Date, src, dst, abs(w) / max(abs(w)) OVER (PARTITION BY Date) AS w FROM ed", n="SELECT Date, src AS Symbol, count(*) AS d FROM ed GROUP BY 1, 2",
    t="SELECT x.Date, x.src AS Symbol, sum(pow(x.w * y.w * z.w, 1 / 3.0::DOUBLE)) AS g FROM wn x JOIN wn y ON x.Date = y.Date AND x.src = y.src AND x.dst <> y.dst JOIN wn z ON z.Date = x.Date AND z.src = x.dst AND z.dst = y.dst GROUP BY 1, 2"))
def k4(spark, d):
    return rounded(gr.clustering(daily_edges(spark, d)), "graph_clustering", digits=5)


@query("k5_node_features", sql(f"""SELECT Symbol, Date, {r('coalesce((Returns - mr) / CASE WHEN dr < 1e-6 THEN 1 ELSE dr END, 0)')} AS Returns_std, {r('coalesce((prob_c - mc) / CASE WHEN dc < 1e-6 THEN 1 ELSE dc END, 0)')} AS prob_c_std,
    CASE WHEN Risk_Probability >= 0.5 THEN 1 ELSE 0 END AS gnn_risk_class, {r('abs(Risk_Probability - 0.5) * 2')} AS gnn_risk_margin, {r('(Risk_Probability - mp) / (dp + 1e-6)', 5)} AS gnn_risk_zscore, {r('tl')} AS gnn_target_std FROM pred JOIN s USING (Date)""", "pred",
    s="SELECT Date, avg(Returns) mr, stddev_pop(Returns) dr, avg(prob_c) mc, stddev_pop(prob_c) dc, avg(Risk_Probability) mp, stddev_pop(Risk_Probability) dp, stddev_pop(Risk_Label) tl FROM pred GROUP BY 1"))
def k5(spark, d):
    out = gr.node_features(predictions(spark, d), ["Returns", "prob_c"])
    out = rounded(rounded(out, "Returns_std", "prob_c_std", "gnn_risk_margin", "gnn_target_std"), "gnn_risk_zscore", digits=5)
    return out.select(*KEY, "Returns_std", "prob_c_std", "gnn_risk_class", "gnn_risk_margin", "gnn_risk_zscore", "gnn_target_std")
