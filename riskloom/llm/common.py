"""Small helpers of the operators on documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
"""A word: what ASCII white space does not cut."""


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(*(columns or ("*",)))


def partitions(df: DataFrame) -> int:
    """Number of shuffle partitions the session asks for; a large job sets it to its size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % k


def whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_share(share, *key) -> Column:
    """Rows of about this share, chosen by 63 bits of a hash of the key, so that shares of any size keep rows."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.shiftrightunsigned(F.xxhash64(*key), 1) < share * F.lit(2.0**63)
