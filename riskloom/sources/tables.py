"""Reading stored tables and writing result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the stored tables.
PRICE_SCHEMA = "Symbol string, Date date, Open double, High double, Low double, Close double, Volume double"
NEWS_SCHEMA = ("symbol string, company_name string, title string, description string, content string, url string, published_date string, "
               "source string, query_used string, api_source string")
FILING_SCHEMA = ("symbol string, cik string, form_type string, filing_date date, accession_number string, mda_text string, risk_factors_text string, "
                 "mda_length int, risk_factors_length int, extraction_success boolean")
PREDICTION_SCHEMA = "Date date, Symbol string, Risk_Prediction int, Risk_Probability double, Actual_Risk_Label int"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=False, mode="PERMISSIVE")


def load_dataset(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet or CSV by suffix; anything else is refused."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        reader = spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)
        return reader.csv(path, header=True)
    raise ValueError(f"unsupported dataset format: {path}")


def combine(tables: Mapping[str, DataFrame], key: str = "Symbol") -> DataFrame:
    """Stack per-symbol tables; one without the key column gets its name as key."""
    keyed = [df if key in df.columns else df.withColumn(key, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), keyed)


def read_per_symbol(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All per-symbol CSV files of a folder in one scan; the file name is the symbol when the column is empty."""
    df = spark.read.schema(schema).csv(folder, header=True, recursiveFileLookup=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    return df.withColumn("Symbol", F.coalesce("Symbol", name))


def write_partitioned(df: DataFrame, folder: str, by: Sequence[str]) -> str:
    """One folder per key. The rebalance hint evens out file sizes: a hot key is cut into
    several files and small keys share a task."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(folder)
    return folder


def save_prices(df: DataFrame, folder: str) -> str:
    return write_partitioned(df, f"{folder}/prices", ["Symbol"])


def save_news(df: DataFrame, folder: str) -> str:
    return write_partitioned(df, f"{folder}/news", ["api_source"])


def save_integrated(df: DataFrame, profile: Mapping[str, DataFrame], folder: str) -> str:
    df.hint("rebalance").write.mode("overwrite").parquet(f"{folder}/integrated")
    for name, table in profile.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    return folder


def save_tone(news: DataFrame, filings: DataFrame, daily: DataFrame, folder: str) -> str:
    for name, df in (("news_sentiment", news), ("filing_sentiment", filings), ("daily_sentiment", daily)):
        df.hint("rebalance").write.mode("overwrite").parquet(f"{folder}/{name}")
    return folder


def save_predictions(df: DataFrame, folder: str) -> str:
    df.hint("rebalance").write.mode("overwrite").parquet(f"{folder}/predictions")
    return folder


def save_runs(df: DataFrame, folder: str) -> str:
    return write_partitioned(df, f"{folder}/runs", ["run", "baseline"])
