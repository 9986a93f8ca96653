"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned: words and word starts that labelled toxic texts hold far more often than others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import in_share, remainder, whole
from riskloom.session import checkpoint

# Words of the second person in the languages at hand, and signs read as letters.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner deinem deinen ihr euch euer eure sie ihnen tu te toi ton ta tes vous votre vos tú ti tus tuyo usted ustedes vosotros os"
READ_AS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"}

STARTS = (4, 5)
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’¿¡-–—*_~"
NEAR = 6
FEATURES = ["words", "hits", "hit_density", "weight", "weight_density", "kinds", "near_second_person", "capitals", "shouted", "exclamations", "punctuation", "obfuscated_hits", "obfuscated"]


def sample_labels(labels: DataFrame, sample: int) -> DataFrame:
    """``doc_id, toxic`` of labelled training documents (remainder of the id not 2), at most about
    ``sample`` of them, chosen by a hash of the id. A document is toxic if any of its labels says so."""
    known = checkpoint(
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder("doc_id", 4) != 2))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    share = min(1.0, sample / max(1, known.count()))
    return known.where(in_share(share, "doc_id"))


def learn_lexicon(train: DataFrame, size: int = 400, ratio: float = 8.0) -> dict[str, float]:
    """``toxic, text`` -> term and weight (log ratio of document shares). A term is a word or, with a
    trailing ``*``, the first letters of a longer one. At most ``size`` terms are kept."""
    word = F.regexp_replace("w", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    words = train.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))).alias("w"), F.monotonically_increasing_id().alias("row")).select("toxic", "row", word.alias("w"))
    starts = F.array(F.col("w"), *[F.when(F.length("w") > n, F.concat(F.substring("w", 1, n), F.lit("*"))) for n in STARTS])
    terms = words.select("toxic", "row", F.explode(starts).alias("term")).where(F.length("term") > 2).distinct()
    total = train.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    t, c = int(total["t"] or 0), int(total["c"] or 0)
    seen = terms.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    weight = F.log((F.col("t") + 0.5) / (t + 1)) - F.log((F.col("c") + 0.5) / (c + 1))
    strong = seen.where(F.col("t") >= max(3, 0.01 * t)).withColumn("weight", weight).where(F.col("weight") >= float(np.log(ratio)))
    return {r["term"]: r["weight"] for r in strong.orderBy(F.desc(F.col("weight") * F.sqrt("t")), "term").limit(size).collect()}


def features_of(text: str, lexicon: dict[str, float], second_person: set[str]) -> list[float]:
    def weight(w: str) -> float:
        return max(lexicon.get(w, 0.0), *(lexicon.get(w[:n] + "*", 0.0) if len(w) > n else 0.0 for n in STARTS))

    tokens = text.split()
    counts = Counter(tokens)
    hits, mass, kinds, shouted, odd, odd_hits = 0, 0.0, set(), 0, 0, 0
    where: set[str] = set()
    for token, n in counts.items():
        w = token.strip(EDGES)
        low = w.lower()
        if x := weight(low):
            hits, mass = hits + n, mass + n * x
            kinds.add(low)
            where.add(token)
        elif low and not low.isalpha():
            read = "".join(READ_AS.get(ch, ch) for ch in low if ch.isalnum() or ch in READ_AS)
            if any(ch.isalpha() for ch in low):
                odd += n
                if read != low and (x := weight(read)):
                    odd_hits, mass = odd_hits + n, mass + n * x
                    where.add(token)
        if len(w) > 2 and w.isupper():
            shouted += n
    near = 0
    if where:
        clean = [t.strip(EDGES).lower() in second_person for t in tokens]
        near = sum(any(clean[max(0, i - NEAR):i + NEAR + 1]) for i, t in enumerate(tokens) if t in where)
    words, chars = max(1, len(tokens)), max(1, len(text))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÀÇÑ"))
    marks = sum(map(text.count, ".,;:!?\"'()-"))
    return [float(np.log1p(len(tokens))), float(hits), hits / words, mass, mass / words, float(len(kinds)), near / max(1, hits + odd_hits), upper / chars, shouted / words, text.count("!") / words, marks / chars, float(odd_hits), odd / words]


def featured(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``docs`` (any flat columns and ``text``) with ``features``."""
    second_person = set(SECOND_PERSON.split())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features_of(t or "", lexicon, second_person) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.float64()))], [*names, "features"])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), "features array<double>"]))


def with_scores(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.3, rounds: int = 25, depth: int = 4) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; input columns of these names are replaced. Rows are scored where
    they are read: no shuffle of texts. See ``toxicity`` for what is learned from what."""
    docs = docs.drop("score", "predicted", "features", "rawPrediction", "probability", "prediction", "raw", "level")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    done = lambda df, score: df.select(*columns, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    # bounded by the sample: some 20,000 rows of an id and a flag
    chosen = F.broadcast(sample_labels(labels, sample))
    one = narrow.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # of rows that repeat an id always the same
    train = checkpoint(one.withColumn("fit", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(10)) < 7))
    share = train.agg(F.avg("toxic").alias("s"), F.sum(F.when(F.col("fit"), F.col("toxic"))).alias("t"), F.sum(F.when(F.col("fit"), 1 - F.col("toxic"))).alias("c")).first()
    if not share["t"] or not share["c"]:
        return done(docs, F.lit(float(share["s"] or 0.0)))
    lexicon = learn_lexicon(train.where("fit"))
    vectors = lambda df: df.withColumn("features", array_to_vector("features"))
    rows = vectors(checkpoint(featured(train, lexicon).drop("text").withColumn("label", F.col("toxic").cast("double"))))
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=11, minInstancesPerNode=2).fit(rows.where("fit").coalesce(2))
    raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("rawPrediction")[1])
    held = rows.where("not fit")
    level = None if held.isEmpty() else IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="level").fit(raw(held).coalesce(1))
    scored = raw(vectors(featured(docs, lexicon)))
    margin = 1 / (1 + F.exp(-2 * F.col("raw")))  # the trees' own probability orders the steps of the calibration
    if level is None:
        return done(scored, margin)
    return done(level.transform(scored), F.lit(0.9) * F.col("level") + F.lit(0.1) * margin)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs``.

    Labels are learned from at most about ``sample`` (20,000) labelled documents whose crc32 remainder is not
    2: seven tenths grow the trees and the lexicon, the rest calibrate. Null texts are empty and are
    scored like others; null ids are scored and not learned from; repeated rows get equal scores; null
    or contradicting labels: see ``sample_labels``. If the labels hold one class or none, the score
    is its share (0 without labels). Extra columns are not read. Empty table: no rows.
    """
    rows = with_scores(docs.select("doc_id", "text"), labels, **options)
    return rows.select(F.col("doc_id"), (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
