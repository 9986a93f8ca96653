"""Graph queries have rows for every market day with an edge."""

from pyspark.sql import functions as F

from riskloom.plans import model_queries, registry, stats_queries
from riskloom.session import scratch

registry.load()
SF = "/root/testdata/sf0.001"


def test_eigenvector_covers_every_day_with_an_edge(spark):
    with scratch(spark):
        days = {r[0] for r in stats_queries.correlations(spark, SF).where(F.abs("corr") >= 0.3).select("Date").distinct().collect()}
        got = {r[0] for r in registry.QUERIES["k3_eigenvector"](spark, SF).select("Date").distinct().collect()}
    assert got == days and len({(d.year, d.month) for d in days}) < len(days)


def test_ablation_takes_the_graph_of_the_day(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(model_queries.md, "feature_set_auc", lambda rows, sets, label: seen.append(rows))
    with scratch(spark):
        model_queries.j6(spark, SF)
        days = seen[0].where("graph_degree > 0").select("Date").distinct().count()
        strong = stats_queries.daily_edges(spark, SF).select("Date", F.col("src").alias("Symbol")).distinct()
        want = seen[0].join(strong, ["Symbol", "Date"], "left_semi").select("Date").distinct().count()
        wrong = seen[0].where("graph_degree > 0").join(strong, ["Symbol", "Date"], "left_anti").count()
    assert days == want > 0 and wrong == 0
