"""Shape of the plans: what reaches the scan, and what must not appear."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import clean as cl
from riskloom.operators import indicators as ind
from riskloom.plans import registry
from riskloom.plans.fixtures import panel, panel_returns, table

registry.load()
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_needed_columns_and_filters(spark):
    df = cl.date_range(table(spark, SF, "lineitem").withColumn("Date", F.col("l_shipdate")), "1996-01-01", "1996-12-31").select("l_partkey")
    text = plan(df)
    assert "PushedFilters: [IsNotNull(l_shipdate)" in text and "l_extendedprice" not in text


def test_indicators_share_one_shuffle(spark):
    p = spark.createDataFrame([("A", 1, 1.0, 2.0, 1.0, 1.0)], "Symbol string, Date int, Close double, High double, Low double, Volume double")
    out = ind.vwap(ind.sma_stack(ind.parkinson(ind.bollinger(ind.rsi(ind.volatility(ind.returns(p)))))))
    assert plan(out).count("Exchange hashpartitioning") == 1
    assert plan(ind.macd(p)).count("Exchange hashpartitioning") == 1


def test_panel_aggregates_before_the_shuffle(spark):
    text = plan(panel(spark, SF))
    assert "partial_max" in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n.split("_")[0] in {"e1", "e13", "e31", "c1", "c2", "c3", "c5", "c8", "c9", "c10", "c11", "c12", "d4", "d8", "d12", "g15", "g21", "b3"}])
def test_no_pairwise_joins(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_names_and_oracles_line_up():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 180


def test_volatility_uses_panel_once(spark):
    assert plan(ind.volatility(panel_returns(spark, SF))).count("FileScan") == 2
