import datetime as dt

from pyspark.sql import functions as F

from riskloom.session import new_folder
from riskloom.streaming import monitors as mo


def source(spark, rows):
    folder = new_folder(spark, "src")
    df = spark.createDataFrame(rows, "ts timestamp, Symbol string, id int, tone double")
    df.coalesce(1).write.parquet(folder)
    return mo.event_stream(spark, folder, "*.parquet", df.schema)


def run(spark, stream):
    folder = new_folder(spark, "run")
    mo.run_to_files(stream, folder).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def at(h, m=0, day=1):
    return dt.datetime(2024, 1, day, h, m)


def test_monitor_means_and_labels(spark):
    rows = [(at(1), "A", 1, 0.4), (at(1, 30), "A", 2, 0.6), (at(2), "B", 3, -0.5), (at(0, day=9), "Z", 9, 0.0)]
    out = run(spark, mo.tone_monitor(source(spark, rows), "tone", lookback="2 hours", step="2 hours"))
    got = {r["Symbol"]: (r["average_sentiment"], r["article_count"], r["sentiment_label"], r["risk_indicator"]) for r in out.collect()}
    assert got["A"] == (0.5, 2, "Positive", "Low") and got["B"] == (-0.5, 1, "Negative", "High")


def test_dedupe_and_episodes(spark):
    rows = [(at(1), "A", 1, 0.9), (at(1, 10), "A", 1, 0.9), (at(3), "A", 2, 0.9), (at(3, 5), "B", 2, 0.1), (at(0, day=9), "Z", 9, 0.9)]
    kept = run(spark, mo.deduplicated(source(spark, rows), ["Symbol", "id"]))
    assert kept.count() == 4
    episodes = run(spark, mo.warning_episodes(source(spark, rows), F.col("tone") > 0.5))
    assert sorted((r["Symbol"], r["warnings"]) for r in episodes.collect()) == [("A", 1), ("A", 2)]
