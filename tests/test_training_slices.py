"""Layout of the training rows, and independent jobs beside each other."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import models as md
from riskloom.session import side_by_side


def slice_contents(df):
    return sorted(df.groupBy(F.spark_partition_id().alias("s")).agg(F.sort_array(F.collect_list("Date")).alias("d")).select("d").toPandas()["d"].map(tuple))


def test_training_rows_use_the_cores_whatever_their_layout(spark):
    rows = spark.range(20_000).select(F.lit("A").alias("Symbol"), F.col("id").alias("Date"), F.rand(3).alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    one, many = (md.prepare(df, ["x"], "y") for df in (rows.coalesce(1), rows.repartition(13)))
    a, b = slice_contents(one), slice_contents(many)
    assert a == b and len(a) == 5 and max(map(len, a)) < 1.2 * min(map(len, a)) and sum(map(len, a)) == 20_000


def test_slices_grow_with_the_table():
    assert [md.slices(n, 12) for n in (0, 100, 9_000, 62_475, 10**7)] == [1, 1, 2, 12, 50]


def test_side_by_side_keeps_order_and_errors():
    assert side_by_side([lambda i=i: i * i for i in range(20)]) == [i * i for i in range(20)] and side_by_side([]) == []
    with pytest.raises(ZeroDivisionError):
        side_by_side([lambda: 1, lambda: 1 / 0])


def test_search_deals_a_small_table_to_few_slices(spark, monkeypatch):
    from riskloom.operators import nested

    stored, plain = [], nested.checkpoint
    monkeypatch.setattr(nested, "checkpoint", lambda df: stored.append(df.rdd.getNumPartitions()) or plain(df))
    rows = spark.range(400).select("id", F.rand(1).alias("x"), (F.col("id") % 2).cast("int").alias("y"), F.lit(1.0).alias("weight")).repartition(6)
    md.boosted_trees("y", rounds=(1, 2), depths=(1,), rates=(0.1,), folds=2, key=["id"]).fit(md.assembled(rows, ["x"]))
    assert stored[0] == 1


def test_enhanced_chain_reads_trades_and_texts_once(spark, monkeypatch):
    from riskloom.plans import scoring_queries as sq

    read, plain = [], sq.ind.relative_tone
    monkeypatch.setattr(sq.ind, "relative_tone", lambda df, *a: read.append((df.inputFiles(), df.rdd.getNumPartitions())) or plain(df, *a))
    sq.enhanced_chain(spark, "/root/testdata/sf0.001")
    files, tasks = read[0]
    assert files and not any("lineitem" in f or "documents" in f for f in files) and tasks >= 8
