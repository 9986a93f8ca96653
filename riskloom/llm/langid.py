"""Language identification: one interpolated Kneser-Ney character model per language.

Texts are read as letters and single spaces. Counts of character 4-grams of a bounded sample give, for each
language and order, arrays of n-gram hashes sorted for binary search. The language with the
lowest cross-entropy per character is chosen; a calibrated posterior is its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import in_share, remainder, whole
from riskloom.session import checkpoint

ORDER = 4
DISCOUNT = 0.75
ALPHABET = 2000
"""Characters an unseen one is drawn from."""
CHUNK = 2_000_000
"""Characters worked on at a time."""
PRIME = np.uint64(0x9E3779B97F4A7C15)


def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def read(text: str, alpha: np.ndarray) -> np.ndarray:
    """Code points in lower case, runs of anything but letters as one space, spaces around; empty without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = alpha[c]
    if not ok.any():
        return np.zeros(0, np.uint32)
    c = np.where(ok, c, 32).astype(np.uint32)
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    return c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]


def hashes(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ (h >> np.uint64(29))) * PRIME + c.astype(np.uint64) + np.uint64(1)
    return h


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """Columns of the 4-grams that end at each character after the first; shorter starts are padded with spaces."""
    padded = np.concatenate([np.full(ORDER - 2, 32, np.uint32), codes])
    n = len(codes) - 1
    return [padded[i:i + n] for i in range(ORDER)]


class Model:
    """Sorted hash arrays of one language: for each order the discounted probability of an n-gram and
    the weight its context leaves to the next lower order."""

    def __init__(self, levels: list[tuple[np.ndarray, ...]]):
        self.levels = levels

    @classmethod
    def of(cls, columns: list[np.ndarray], counts: np.ndarray) -> Model:
        levels = []
        for order in range(ORDER, 0, -1):
            # below the top order a gram counts once for each character seen before it
            cols = columns[ORDER - order:]
            gram = hashes(cols)
            context = hashes(cols[:-1]) if order > 1 else np.zeros(len(gram), np.uint64)
            key, at, inv = np.unique(gram, return_index=True, return_inverse=True)
            n = np.bincount(inv, counts if order == ORDER else None).astype(float)
            ctx, cinv = np.unique(context[at], return_inverse=True)
            total, kinds = np.bincount(cinv, n), np.bincount(cinv)
            levels.append((key, np.maximum(n - DISCOUNT, 0) / total[cinv], ctx, DISCOUNT * kinds / total))
            if order > 1:  # distinct grams of this order are the counts of the next
                columns = [c[at] for c in columns]
        return cls(levels)

    def log_probability(self, columns: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(columns[0]), 1.0 / ALPHABET)
        for order in range(1, ORDER + 1):
            key, share, ctx, back = self.levels[ORDER - order]
            cols = columns[ORDER - order:]
            own, left = _find(key, share, hashes(cols), 0.0), _find(ctx, back, hashes(cols[:-1]) if order > 1 else np.zeros(len(p), np.uint64), 1.0)
            p = own + left * p
        return np.log(p)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def entropies(texts: list[str], models: list[Model], alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log probability per character of each text and model, and the numbers of characters. A
    distinct 4-gram is looked up once per chunk of texts."""
    means, sizes = np.zeros((len(texts), len(models))), np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        parts, of, used = [], [], 0
        while at < len(texts) and (not used or used + len(texts[at]) < CHUNK):
            codes = read(texts[at], alpha)
            used += len(texts[at]) + 1
            if len(codes) > 1:
                parts.append(grams(codes))
                of.append(at)
                sizes[at] = len(codes) - 1
            at += 1
        if not parts:
            continue
        columns = [np.concatenate(c) for c in zip(*parts)]
        inv, _ = pd.factorize(hashes(columns))
        first = np.zeros(inv.max() + 1, np.int64)
        first[inv[::-1]] = np.arange(len(inv))[::-1]
        starts = np.cumsum([0, *sizes[of][:-1]])
        distinct = [c[first] for c in columns]
        for m, model in enumerate(models):
            means[of, m] = np.add.reduceat(model.log_probability(distinct)[inv], starts) / sizes[of]
    return means, sizes


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alpha = letters()
    for b in batches:
        frame = pd.DataFrame({"lang": b.column("lang").to_pylist(), "text": b.column("text").to_pylist()})
        for lang, texts in frame.groupby("lang")["text"]:
            parts = [grams(c) for t in texts if len(c := read(t, alpha)) > 1]
            if parts:
                codes = pd.DataFrame({f"c{i}": np.concatenate(c).astype(np.int32) for i, c in enumerate(zip(*parts))})
                n = codes.value_counts().reset_index(name="n")
                yield pa.RecordBatch.from_pandas(n.assign(lang=lang)[["lang", "c0", "c1", "c2", "c3", "n"]], preserve_index=False)


def fit(train: DataFrame) -> dict[str, Model]:
    """``lang, text`` (a bounded sample) -> a model for each language. Counts are added up in Spark; only
    the distinct 4-grams of the sample come to the driver."""
    counts = train.select("lang", "text").mapInArrow(_counts, "lang string, c0 int, c1 int, c2 int, c3 int, n long")
    table = counts.groupBy("lang", "c0", "c1", "c2", "c3").agg(F.sum("n").alias("n")).toPandas()
    return {str(lang): Model.of([t[f"c{i}"].to_numpy().astype(np.uint32) for i in range(ORDER)], t["n"].to_numpy().astype(float)) for lang, t in sorted(table.groupby("lang"))}


def posterior(means: np.ndarray, sizes: np.ndarray, scale: float) -> np.ndarray:
    """Softmax of the evidence; long texts count as 300 characters, since characters are not independent."""
    z = scale * means * np.minimum(sizes, 300)[:, None]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def calibrate(means: np.ndarray, sizes: np.ndarray, truth: np.ndarray) -> tuple[float, np.ndarray]:
    """Scale of the evidence with the least log loss on texts the models have not seen, and for each language
    the log probability per character below which a text is rejected (its 0.5 % quantile, less 0.5)."""
    grid = np.geomspace(0.005, 2.0, 40)
    loss = [-np.log(posterior(means, sizes, s)[np.arange(len(truth)), truth] + 1e-12).mean() for s in grid]
    floor = np.array([np.quantile(means[truth == m, m], 0.005) - 0.5 if (truth == m).any() else -np.inf for m in range(means.shape[1])])
    return float(grid[int(np.argmin(loss))]), floor


def identify(docs: DataFrame, sample: int = 8_000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected``, one row per row of ``docs``.

    Learns from at most about ``sample`` documents with a language, an equal number of each language (all of a rarer
    one), chosen by a hash of the id among those whose crc32 remainder is not 2; four fifths are counted, one fifth calibrates. Null texts and
    texts without letters are ``und`` with score 0. ``lang_pred`` is always the best language;
    ``rejected`` marks texts less likely under it than its own calibration texts. Null ids are
    predicted and not learned from; repeated rows get equal results; extra columns are not read. Without a
    language to learn everything is ``und``. Empty table: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 4) != 2))
    counts = checkpoint(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    each = max(1, sample // max(1, counts.count()))
    chosen = known.join(counts, "lang").where(in_share(each / F.col("n"), "doc_id")).drop("n")
    train = checkpoint(chosen.withColumn("fit", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5)) > 0))
    models = fit(train.where("fit"))
    names, own = list(models), list(models.values())
    ids = [F.col("doc_id"), (remainder("doc_id", 4) == 2).alias("held_out")]
    if not own:
        return docs.select(*ids, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast([m.levels for m in own])  # bounded by the sample

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alpha, models = letters(), [Model(x) for x in shared.value]
        for b in batches:
            means, sizes = entropies([t or "" for t in b.column("text").to_pylist()], models, alpha)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(list(means), pa.list_(pa.float64())), pa.array(sizes)], ["doc_id", "lang", "means", "size"])

    measure = lambda df: df.select("doc_id", "lang", "text").mapInArrow(scores, "doc_id long, lang string, means array<double>, size long")
    held = measure(train.where("not fit")).where(F.col("lang").isin(names) & (F.col("size") > 0)).toPandas()
    scale, floor = calibrate(np.array(held["means"].tolist()), held["size"].to_numpy(), held["lang"].map(names.index).to_numpy()) if len(held) else (0.1, np.full(len(names), -np.inf))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            means, sizes = np.array(b.column("means").to_pylist()), b.column("size").to_numpy()
            best, some = means.argmax(1), sizes > 0
            score = posterior(means, sizes, scale)[np.arange(len(best)), best]
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "lang_pred": pa.array([names[i] if s else "und" for i, s in zip(best, some)], pa.string()),
                "score": np.where(some, score, 0.0), "rejected": np.where(some, means[np.arange(len(best)), best] < floor[best], True),
            })

    return measure(docs).mapInArrow(choose, "doc_id long, lang_pred string, score double, rejected boolean").select(*ids, "lang_pred", "score", "rejected")
