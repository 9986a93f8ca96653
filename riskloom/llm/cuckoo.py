"""Exact dedup over a sharded cuckoo-filter index.

The live digests of a shard are kept twice: 16-bit fingerprints in a cuckoo filter, and the stored
keys (whole SHA-256 digests, with what the index counts) in buckets by their first bytes. A digest the
filter does not hold is new; a hit is verified in its bucket. A filter that overflows doubles
and is filled again from the stored keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import partitions, whole

SLOTS = 4
MAX_KICKS = 200
MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Partial-key cuckoo filter on arrays; whole batches are inserted, looked up and deleted at once.

    Keys are 64-bit hashes. The two buckets of a key are ``i`` and ``i ^ hash(fingerprint)``, so that an
    evicted fingerprint finds its other bucket without its key. Repeated keys take a slot each.
    """

    def __init__(self, capacity: int = 1024):
        self.mask = np.int64((1 << max(1, int(np.ceil(np.log2(max(capacity, 8) / SLOTS / 0.9)))) ) - 1)
        self.table = np.zeros((int(self.mask) + 1, SLOTS), np.uint16)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.asarray(keys).astype(np.uint64) * MIX
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return (h & np.uint64(0xFFFFFFFF)).astype(np.int64) & self.mask, mark

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        i, mark = self._places(keys)
        return (self.table[i] == mark[:, None]).any(1) | (self.table[self._other(i, mark)] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if it overflows: the caller resizes from the stored keys."""
        i, mark = self._places(keys)
        for kick in range(MAX_KICKS):
            for bucket in (i, self._other(i, mark)):
                todo = np.flatnonzero(mark)
                for _ in range(SLOTS):  # each bucket takes one of its waiting marks a turn
                    if not len(todo):
                        break
                    b, at = np.unique(bucket[todo], return_index=True)
                    free = (self.table[b] == 0).argmax(1)
                    ok = self.table[b, free] == 0
                    took = todo[at[ok]]
                    self.table[b[ok], free[ok]] = mark[took]
                    mark[took] = 0
                    todo = todo[mark[todo] != 0]
            left = np.flatnonzero(mark)
            if not len(left):
                return True
            b, at = np.unique(i[left], return_index=True)
            first = left[at]
            slot = (b + kick) % SLOTS
            out = self.table[b, slot].copy()
            self.table[b, slot] = mark[first]
            mark[first], i[first] = out, self._other(b, out)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Removes one fingerprint for each key; the keys must be stored ones."""
        places, marks = self._places(keys)
        for i, mark in zip(places, marks):
            for b in (i, self._other(np.array([i]), np.array([mark]))[0]):
                at = np.flatnonzero(self.table[b] == mark)
                if len(at):
                    self.table[b, at[0]] = 0
                    break


class Index:
    """The live digests of a shard: filter in front, stored keys behind."""

    def __init__(self, capacity: int = 1024):
        self.filter = CuckooFilter(capacity)
        self.buckets: dict[bytes, dict[bytes, list]] = {}
        self.live = 0

    @staticmethod
    def _hashes(digests: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(d[8:16] for d in digests), np.uint64)

    def _stored(self, digest: bytes) -> list | None:
        return self.buckets.get(digest[:3], {}).get(digest)

    def _resize(self) -> None:
        stored = [d for b in self.buckets.values() for d in b]
        capacity = 2 * max(self.live, self.filter.table.size)
        while True:
            self.filter = CuckooFilter(capacity)
            if not stored or self.filter.insert(self._hashes(stored)):
                return
            capacity *= 2

    def lookup(self, digests: list[bytes]) -> list[list | None]:
        """What is stored for each digest; only hits of the filter look into a bucket."""
        if not digests:
            return []
        return [self._stored(d) if hit else None for d, hit in zip(digests, self.filter.contains(self._hashes(digests)))]

    def insert(self, digests: list[bytes], values: list[list], merge) -> None:
        """Stores new digests with their value; ``merge(old, new)`` folds a value into a live one."""
        fresh: dict[bytes, list] = {}
        for d, value, found in zip(digests, values, self.lookup(digests)):
            if found is None and d not in fresh:
                fresh[d] = list(value)
            else:
                merge(fresh[d] if found is None else found, value)
        for d, value in fresh.items():
            self.buckets.setdefault(d[:3], {})[d] = value
        self.live += len(fresh)
        if fresh and (self.live > 0.95 * self.filter.table.size or not self.filter.insert(self._hashes(list(fresh)))):
            self._resize()

    def delete(self, digests: list[bytes]) -> int:
        """Removes digests; those that are not live are left out. Returns how many were live."""
        gone = [d for d, found in zip(digests, self.lookup(digests)) if found is not None]
        gone = list(dict.fromkeys(gone))
        for d in gone:
            del self.buckets[d[:3]][d]
        if gone:
            self.filter.delete(self._hashes(gone))
        self.live -= len(gone)
        return len(gone)

    def items(self) -> Iterator[tuple[bytes, list]]:
        for b in self.buckets.values():
            yield from b.items()


def merge_counts(old: list, new: list) -> None:
    """[rows, largest id]; a null id is smaller than any."""
    old[0] += new[0]
    if old[1] is None or (new[1] is not None and new[1] > old[1]):
        old[1] = new[1]


PARTS = "shard int, digest binary, n long, last long, op string"


def _partial(shards: int):
    """Counts the digests of a task, so that a text's copies leave a task as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bytes, str], list] = {}
        for b in batches:
            for d, i, op in zip(b.column("digest").to_pylist(), b.column("doc_id").to_pylist(), b.column("op").to_pylist()):
                if (old := seen.setdefault((d, op), [0, None])) is not None:
                    merge_counts(old, [1, i])
            if len(seen) >= 200_000:
                yield _rows(seen)
                seen = {}
        if seen:
            yield _rows(seen)

    def _rows(seen: dict) -> pa.RecordBatch:
        return pa.record_batch({
            "shard": pa.array([int.from_bytes(d[3:7], "big") % shards for d, _ in seen], pa.int32()), "digest": pa.array([d for d, _ in seen], pa.binary()),
            "n": pa.array([v[0] for v in seen.values()], pa.int64()), "last": pa.array([v[1] for v in seen.values()], pa.int64()), "op": pa.array([op for _, op in seen], pa.string()),
        })

    return run


def _shard(table: pa.Table) -> pa.Table:
    """Insertions of a shard go through its index in batches, then its deletions."""
    index = Index(1024)
    inserts = table.filter(pc.equal(table.column("op"), "insert"))
    for b in inserts.to_batches(max_chunksize=50_000):
        index.insert(b.column("digest").to_pylist(), [list(x) for x in zip(b.column("n").to_pylist(), b.column("last").to_pylist())], merge_counts)
    deletes = table.filter(pc.equal(table.column("op"), "delete"))
    if deletes.num_rows:
        index.delete(deletes.column("digest").to_pylist())
    rows = list(index.items())
    return pa.table({
        "digest": pa.array([d for d, _ in rows], pa.binary()), "keep_id": pa.array([v[1] for _, v in rows], pa.int64()), "group_size": pa.array([v[0] for _, v in rows], pa.int64()),
    })


def digest(text: str = "text"):
    return F.unhex(F.sha2(whole(text), 256))


def live_groups(rows: DataFrame) -> DataFrame:
    """``doc_id, digest, op`` ('insert' or 'delete') -> ``digest, keep_id, group_size`` of the digests that
    are live after all insertions and then all deletions. ``keep_id`` is the largest doc_id (null: none)."""
    shards = partitions(rows)
    parts = rows.select(F.col("doc_id").cast("long"), "digest", "op").mapInArrow(_partial(shards), PARTS)
    return parts.groupBy("shard").applyInArrow(_shard, "digest binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per document.

    Null texts count as empty; nothing is normalised. Of equal texts the largest doc_id stays; a null
    id only if no other holds the text; of rows that repeat id and text one stays. Empty table: no rows.
    Copies are counted per task before they are shuffled by shard, so no shard sees more than a row
    per task and text; the join back is one Spark can split where a text is hot.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"))
    groups = live_groups(own.withColumn("op", F.lit("insert")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.lit(1)))
    joined = own.withColumn("nth", nth).join(groups, "digest")
    return joined.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
