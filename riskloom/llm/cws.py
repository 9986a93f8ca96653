"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words in lower case, weighted by how often they occur. For each of the
``SAMPLES`` positions a term draws gamma variates from a hash of term and position; the term with the
smallest value is sampled together with its quantised weight. Two texts agree at a position with
a probability equal to their generalised Jaccard similarity (sum of minima over sum of maxima).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import partitions, whole

SAMPLES = 128
CHUNK = 600_000
"""Characters worked on at a time."""
STEPS = 1 << 16
EMPTY = b"\x20"
"""Term of a text without words; no word is white space."""


class Sampler:
    """Draws for terms. A gamma(2, 1) variate is read from a table of ``STEPS`` quantiles by 16 bits of a
    hash; the uniform one has 16 bits, too."""

    def __init__(self, samples: int = SAMPLES):
        u = (np.arange(STEPS) + 0.5) / STEPS
        x = np.sqrt(2 * u) + 0.5
        for _ in range(60):  # solve 1 - (1 + x) exp(-x) = u
            x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-12), 1e-6)
        self.gamma = x.astype(np.float32)
        self.log_gamma = np.log(x).astype(np.float32)
        self.seeds = np.array([(0x9E3779B97F4A7C15 * (j + 1)) % 2**64 for j in range(samples)], np.uint64)

    def draw(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (smallest wins) and 16-bit samples of terms (64-bit hashes) with their counts: one row per term."""
        values = np.empty((len(terms), len(self.seeds)), np.float32)
        samples = np.empty((len(terms), len(self.seeds)), np.uint16)
        for at in range(0, len(terms), 2048):
            z = terms[at:at + 2048, None] ^ self.seeds
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            part = z.view(np.uint16).reshape(*z.shape, 4)
            r, log_c, beta = self.gamma[part[..., 0]], self.log_gamma[part[..., 1]], part[..., 2] * np.float32(1 / STEPS)
            t = np.floor(np.log(counts[at:at + 2048, None]).astype(np.float32) / r + beta)
            values[at:at + 2048] = log_c - r * (t - beta) - r
            samples[at:at + 2048] = part[..., 3] ^ (t.astype(np.int64) * 40503).astype(np.uint16)
        return values, samples

    def signatures(self, texts: list[str]) -> np.ndarray:
        """One row of 16-bit samples per text. Equal (term, count) pairs of the texts are drawn once."""
        import xxhash

        index: dict[tuple[bytes, int], int] = {}
        rows = []
        for t in texts:
            counted = Counter(t.encode("utf-8", "surrogatepass").lower().split()) or {EMPTY: 1}
            rows.append(np.fromiter((index.setdefault(x, len(index)) for x in counted.items()), np.int64, len(counted)))
        terms = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w, _ in index), np.uint64, len(index))
        values, samples = self.draw(terms, np.fromiter((n for _, n in index), np.float64, len(index)))
        lanes = np.arange(len(self.seeds))
        out = np.empty((len(texts), len(lanes)), np.uint16)
        for i, idx in enumerate(rows):
            out[i] = samples[idx[values[idx].argmin(0)], lanes]
        return out


def in_order(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, tie, text, halo``: documents in ranges of ids, and after each range the first document of
    the next one (after the last range that of the first), marked as halo.

    Range bounds are quantiles of the ids: one number per partition comes to the driver. Texts are
    shuffled once, by range.
    """
    n = partitions(docs)
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []

    def of(ids):
        import pandas as pd

        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0), side="right")).astype(np.int32))

    rid = F.pandas_udf(of, "int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")).withColumn("rid", rid(F.col("doc_id").cast("double"))).withColumn("tie", F.xxhash64("text"))
    heads = rows.groupBy("rid").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("head"))
    ranges = Window.orderBy("rid")  # one row per range
    follow = heads.select("rid", F.coalesce(F.lead("head").over(ranges), F.first("head").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    wanted = F.broadcast(follow.select(F.col("rid").alias("to"), F.col("next.doc_id").alias("id"), F.col("next.tie").alias("t")))
    halo = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("t"))).dropDuplicates(["to"])
    columns = ["rid", "doc_id", "tie", "text", "halo"]
    both = rows.withColumn("halo", F.lit(False)).select(*columns).unionByName(halo.drop("rid").withColumnRenamed("to", "rid").withColumn("halo", F.lit(True)).select(*columns))
    return both.repartitionById(n, "rid").sortWithinPartitions("rid", "halo", F.col("doc_id").asc_nulls_first(), "tie")


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text of a document is its text with the last quarter of its code points (rounded down)
    replaced by as many from the start of the next document by id (or all it has); the last one is
    followed by the first, a single one by itself. Null texts are empty, null ids come first, rows with equal
    ids follow each other by a hash of the text. Texts without words share a fingerprint of
    their own, like nothing else. Likeness is the share of equal samples (standard error at most
    ``0.5 / sqrt(samples)``). Extra columns are not read. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        sampler = Sampler(samples)

        def done(texts: list[str], ids: list[int | None]) -> pa.RecordBatch:
            """``texts`` has one text more than ``ids``: the one after the last."""
            own = texts[:-1]
            edited = [t[:len(t) - len(t) // 4] + after[:len(t) // 4] for t, after in zip(own, texts[1:])]
            sig = sampler.signatures(texts + edited)
            mine, after, edit = sig[:len(own)], sig[1:len(own) + 1], sig[len(own) + 1:]
            return pa.record_batch({
                "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in own], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                "fingerprint": pa.array([s.tobytes().hex() for s in mine]), "edited_fingerprint": pa.array([s.tobytes().hex() for s in edit]),
                "near_edited": (mine == edit).mean(1), "near_next": (mine == after).mean(1),
            })

        texts, ids, used = [], [], 0
        for b in batches:
            for i, text, halo in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "halo"))):
                texts.append(text)
                if not halo:
                    ids.append(i)
                    used += len(text)
                if halo or used > CHUNK:  # a range ends with its halo; within one the text stays for the next chunk
                    if halo:
                        if ids:
                            yield done(texts, ids)
                        texts, ids = [], []
                    elif len(ids) > 1:
                        yield done(texts, ids[:-1])
                        texts, ids = texts[-1:], ids[-1:]
                    used = len(text) if ids else 0

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).mapInArrow(run, schema)
