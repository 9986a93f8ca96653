"""Line dedup: range-partitioned line hashes, streamed in order of document and position.

A line that many documents hold keeps its lines in one document only. What is passed on are
compressed keep bitmaps per document; texts are touched once, when the bitmaps are applied.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import lower_ascii, partitions, whole
from riskloom.session import checkpoint

BLANKS = " \t\n\x0b\f\r"
SLICE = "kind int, h1 long, h2 long, doc_id long, version long, pos int"


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key has ``min_chars`` code points: two 64-bit hashes of the key, the
    document (id and a hash of the text, so that rows that repeat an id stay apart) and the position."""
    lines = docs.select("doc_id", F.xxhash64(whole("text")).alias("version"), F.posexplode(F.split(whole("text"), "\n", -1)).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_chars).withColumn("line", line_key(F.col("line"))).where(F.length("line") >= min_chars)
    return keyed.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.col("doc_id").cast("long"), "version", "pos")


def first_occurrences(min_docs: int):
    """Streams one range of hashes, sorted by hash, document (largest first) and position.

    Lines of a run of equal hashes after its first document are dropped (kind 0) if the run has
    ``min_docs`` documents. The first and last run of a range may go on in the next one: their lines
    are passed on undecided (kind 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not sum(b.num_rows for b in parts):
            return
        table = pa.Table.from_batches(parts)
        h1, h2, version, pos = (table.column(c).to_numpy() for c in ("h1", "h2", "version", "pos"))
        known = table.column("doc_id").is_valid().to_numpy()
        doc = table.column("doc_id").fill_null(0).to_numpy()
        new_run = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        new_doc = new_run | np.r_[True, (doc[1:] != doc[:-1]) | (known[1:] != known[:-1])]
        of = np.cumsum(new_run) - 1
        docs = np.bincount(of, new_doc)
        nth = np.cumsum(new_doc)
        later = nth != nth[np.flatnonzero(new_run)][of]
        edge = (of == 0) | (of == of[-1])
        out = np.flatnonzero(edge | (later & (docs[of] >= min_docs)))
        yield from pa.table({
            "kind": edge[out].astype(np.int32), "h1": h1[out], "h2": h2[out], "doc_id": table.column("doc_id").take(out), "version": version[out], "pos": pos[out],
        }).to_batches(max_chunksize=100_000)

    return run


def keep_bitmap(dropped: np.ndarray) -> bytes:
    """Bits up to the last dropped line, padded with ones."""
    keep = np.ones((int(dropped.max()) // 8 + 1) * 8, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``doc_id, version, n_dropped, keep``: one row per document that loses lines.

    ``docs`` has ``doc_id, text``; ``version`` is a hash of the text, ``keep`` a zlib-compressed bitmap
    with a bit per line (bits after the last dropped line may be missing: those lines stay). Texts are
    split at the newline; a key is the line without ASCII white space at its ends and with A-Z in lower
    case. A key of ``min_chars`` code points found in ``min_docs`` documents stays in the largest
    doc_id that holds it, with all its repeats there. Null and empty texts are one empty line; a null id
    is the smallest id; rows that repeat an id count as one document. A hot line is cut between ranges:
    only the totals of the runs at range ends are joined back, two per range.
    """
    n = partitions(docs)
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last(), F.col("version"), F.col("pos")]
    hashes = checkpoint(line_hashes(docs, min_chars))
    ranges = hashes.repartitionByRange(n, *order).sortWithinPartitions(*order)
    streamed = checkpoint(ranges.mapInArrow(first_occurrences(min_docs), SLICE))
    open_runs = streamed.where("kind = 1").withColumn("who", F.struct("doc_id"))
    totals = (
        open_runs.groupBy("h1", "h2", "who").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("one").alias("docs"), F.max("who").alias("last")).where(F.col("docs") >= min_docs)
    )
    # at most two runs per range: n is the session's setting, so the broadcast side has 2 n rows or fewer
    closed = open_runs.join(F.broadcast(totals), ["h1", "h2"]).where(F.col("who") != F.col("last"))
    columns = ["doc_id", "version", "pos"]
    drops = streamed.where("kind = 0").select(*columns).unionByName(closed.select(*columns))
    per_doc = drops.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("pos"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.asarray(x, np.int64) for x in b.column("pos").to_pylist()]
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "version": b.column("version"), "n_dropped": pa.array([len(x) for x in lists], pa.int64()),
                "keep": pa.array([keep_bitmap(x) for x in lists], pa.binary()),
            })

    return per_doc.mapInArrow(pack, "doc_id long, version long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the kept text and ``n_lines`` (before), ``n_dropped``; columns of these names are replaced."""
    docs = docs.drop("n_lines", "n_dropped", "keep")
    left = docs.withColumn("_version", F.xxhash64(whole("text"))).alias("d")
    b = bitmaps.alias("b")
    joined = left.join(b, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d._version") == F.col("b.version")), "left")
    rows = joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("b.n_dropped"), F.col("b.keep"))
    lines = F.split(whole("text"), "\n", -1)
    kept = F.when(F.col("keep").isNull(), F.col("text")).otherwise(keep_lines(F.when(F.col("keep").isNotNull(), F.col("text")), F.col("keep")))
    return rows.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.col("n_dropped"), F.lit(0)).cast("long"), "text": kept}).drop("keep")


def _keep(text, keep):
    import pandas as pd

    out = []
    for t, k in zip(text, keep):
        if k is None or t is None:
            out.append(t)
            continue
        lines = t.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8))
        out.append("\n".join(x for i, x in enumerate(lines) if i >= len(bits) or bits[i]))
    return pd.Series(out, dtype=object)


def keep_lines(text: Column, keep: Column) -> Column:
    return F.pandas_udf(_keep, "string")(text, keep)
