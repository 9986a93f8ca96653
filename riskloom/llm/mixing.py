"""Mixing sources to target weights by systematic sampling.

Sources get a share of all words by weight, at most ``cap`` times their own size; what a capped
source cannot take is shared again among the others. A source's documents, in order of size, then
have expected copies whose running sum crosses integers; a document is emitted once per crossing.
Everything is DataFrame functions: no Python on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, whole

LANES = 256
"""Lanes by id a size class is cut into, so that a hot source is spread over many tasks."""


def size_of(text: str) -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """``source, source_size`` (one row each) -> the same with ``target``.

    Sources in code-point order, null last, take the weights in turn. Sorted by the share at which
    they hit their cap, the first sources are capped and the rest divide what is left: the level
    where repeated resharing ends. The window runs over one row per source. No words: targets 0.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ws = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("_w", F.element_at(ws, (turn % len(weights) + 1).cast("int"))).withColumn("_max", F.col("source_size") * F.lit(float(cap)))
    by_cap = Window.orderBy(F.col("_max") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_max").over(earlier), F.lit(0.0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))
    s = s.withColumn("_level", left / weight)
    s = s.withColumn("_free", F.col("_level") * F.col("_w") < F.col("_max"))
    level = F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(everything)
    return s.withColumn("target", F.when(F.col("_free"), level * F.col("_w")).otherwise(F.col("_max"))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """Adds ``source_size``, ``target`` (of the source), ``copies`` and ``taken`` (copies x size).

    ``docs`` has ``doc_id, source, size``; other columns stay, input columns named like an output are
    replaced. Null sources are one source, a null size counts 0, null ids are one lane, repeated rows
    are separate documents. Empty table: no rows. The offset of a source is a hash of its name and
    ``seed``, so reruns agree. Sorting by size keeps the words taken within about one document of the
    target. No document gets more than ``cap`` copies (rounded up).
    """
    docs = docs.drop("source_size", "target", "copies", "taken").withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("long"))
    digits = F.col("size").cast("string")
    keyed = docs.withColumns({
        "_name": F.coalesce(F.col("source"), F.lit("")),
        "_null": F.col("source").isNull(),
        "_class": F.length(digits) * 10 + F.substring(digits, 1, 1).cast("int"),
        "_lane": F.coalesce(F.pmod(F.col("doc_id"), F.lit(LANES)), F.lit(-1)).cast("int"),
    })
    keys = ["_name", "_null", "_class", "_lane"]
    cells = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"))
    sizes = cells.groupBy("_name", "_null").agg(F.sum("_words").alias("source_size"))
    goals = targets(sizes.withColumn("source", F.when(~F.col("_null"), F.col("_name"))), weights, cap).select(
        F.coalesce(F.col("source"), F.lit("")).alias("_name"), F.col("source").isNull().alias("_null"), "source_size", "target")
    earlier = Window.partitionBy("_name", "_null").orderBy("_class", "_lane").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_name"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    starts = cells.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(goals, ["_name", "_null"]).select(
        *keys, "_base", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"), offset.alias("_u"))
    place = Window.partitionBy(*keys).orderBy("size", "doc_id")
    placed = keyed.withColumn("_row", F.row_number().over(place)).join(starts, keys)
    crossed = lambda i: F.floor(i * F.col("_rate") + F.col("_u"))
    at = F.col("_base") + F.col("_row")
    return (
        placed.withColumn("copies", crossed(at) - crossed(at - 1))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(*keys, "_base", "_row", "_rate", "_u")
    )


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as its copies."""
    once_each = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return mixed.where(F.col("copies") > 0).withColumn("_copy", once_each).drop("_copy")
