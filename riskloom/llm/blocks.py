"""Dictionaries of a whole corpus, brought to its documents without shuffling their words.

Documents are dealt to blocks by a hash and shuffled once, compressed. A block sends each of its distinct words once,
packed by bucket of the word; what a bucket finds out about its words goes back the same
way, in the order in which the block sent them. Words are bytes without the separator.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import partitions, whole

SEPARATOR = b"\n"
PACKED = "block int, ids array<long>, flags array<boolean>, z binary"


def pack(parts: list[bytes]) -> bytes:
    import zstandard

    lengths = np.array([len(p) for p in parts], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(parts)).tobytes() + lengths + b"".join(parts))


def unpack(z: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(z)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.int64, n, 8)) + 8 * (n + 1)
    starts = np.r_[8 * (n + 1), ends[:-1]] if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def in_blocks(docs: DataFrame, flag, prepare: Callable[[str], bytes], most: int = 4_000_000, blocks: int | None = None) -> DataFrame:
    """``block, ids, flags, z``: the documents of a task for one block in a row (rows of up to ``most`` bytes),
    hash-partitioned by block. The block follows from id and text alone, so it is the same in every run."""
    n = blocks or partitions(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"), flag.alias("flag"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        total = 0

        def flush(which: Iterable[int]) -> pa.RecordBatch:
            out = [(b, *zip(*held.pop(b))) for b in list(which)]
            return pa.record_batch({
                "block": pa.array([o[0] for o in out], pa.int32()), "ids": pa.array([list(o[1]) for o in out], pa.list_(pa.int64())),
                "flags": pa.array([list(o[2]) for o in out], pa.list_(pa.bool_())), "z": pa.array([pack(list(o[3])) for o in out], pa.binary()),
            })

        for b in batches:
            for i, t, f, k in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "flag", "block"))):
                data = prepare(t)
                held.setdefault(k, []).append((i, f, data))
                total += len(data)
                if len(data) > most:
                    total -= sum(len(x[2]) for x in held[k])
                    yield flush([k])
            if total > 24 * most:
                yield flush(held)
                total = 0
        if held:
            yield flush(held)

    return rows.mapInArrow(run, PACKED).repartition(n, "block")


class Numbers(dict):
    """Numbers its keys as they are asked for."""

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        return n


def by_bucket(words: Iterable[bytes], buckets: int) -> list[tuple[int, list[bytes]]]:
    """Words by bucket, sorted: the order both ways."""
    out: dict[int, list[bytes]] = {}
    for w in sorted(words):
        out.setdefault(zlib.crc32(w) % buckets, []).append(w)
    return sorted(out.items())


def squeeze(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(a.tobytes())


def stretch(z: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), kind)


def join_words(words: list[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(SEPARATOR.join(words))


def split_words(z: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(z)
    return raw.split(SEPARATOR)
