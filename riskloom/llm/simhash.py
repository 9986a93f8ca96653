"""SimHash near-dedup with pigeonring candidates.

A fingerprint is cut into a ring of four segments. If two fingerprints differ in at most ``distance`` = 3
bits, then from some segment on every chain of k segments differs in at most 3 k / 4 bits: none in
the first segment, at most one in the first two, at most two in the first three. The first two are the
join key (the second segment with each single bit changed on one side), the third and the whole
distance are checked on the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import partitions, whole
from riskloom.session import checkpoint

SEGMENTS = 4
WIDTH = 16
DISTANCE = 3
SMALL = 24
"""Buckets up to this size compare their members directly; larger ones grow trees."""
SPLIT = 16_384
"""Buckets over this size are cut by the bytes of their other segments first."""


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes (uint64)."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros((8, 8), np.int64)
    lanes = np.uint64(0x0101010101010101)
    for at in range(0, n, 255):  # a byte lane holds 255 at most
        part = hashes[at:at + 255]
        for s in range(8):
            total = np.add.reduce((part >> np.uint64(s)) & lanes)
            counts[s] += np.frombuffer(total.tobytes(), np.uint8)
    bits = 2 * counts > n
    return int(sum(1 << (8 * lane + s) for s in range(8) for lane in range(8) if bits[s, lane]))


def wide_simhash(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` uint64 of the same rule: the first is ``simhash``, each further one that of hashes mixed anew."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    x = hashes[None] + np.arange(words, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    x[0] = hashes
    counts = np.zeros((8, words, 8), np.int64)
    lanes = np.uint64(0x0101010101010101)
    for at in range(0, len(hashes), 255):  # a byte lane holds 255 at most
        part = x[:, at:at + 255]
        for s in range(8):
            total = np.add.reduce((part >> np.uint64(s)) & lanes, axis=1)
            counts[s] += total.view(np.uint8).reshape(words, 8)
    bits = (2 * counts > len(hashes)).transpose(1, 2, 0)
    return np.packbits(bits, axis=-1, bitorder="little").reshape(-1).view(np.uint64)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; fewer words give one shingle, none none."""
    import xxhash

    # bytes.lower and bytes.split know ASCII only, which is what is asked for
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    starts = np.r_[0, ends[:-1] + 1].tolist()
    stops = ends[words - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(stops))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, version, fp`` (a hash of the text; 64 bits as a long); null texts are empty, texts without words have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(shingle_hashes(t or "", words)) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "version": b.column("version"), "fp": fps.view(np.int64)})

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(whole("text")).alias("version"))
    return rows.mapInArrow(run, "doc_id long, version long, fp long")


def ring_keys(fps: DataFrame) -> DataFrame:
    """``key, fp, exact``: for each start of a chain its first two segments, and those with one bit of the second changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << WIDTH) - 1)
        flips = np.r_[0, 1 << np.arange(WIDTH)].astype(np.uint64)
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            if not len(fp):
                continue
            seg = [(fp >> np.uint64(WIDTH * i)) & low for i in range(SEGMENTS)]
            keys = [((np.uint64(i) << np.uint64(32)) | (seg[i] << np.uint64(16)))[:, None] | (seg[(i + 1) % SEGMENTS][:, None] ^ flips) for i in range(SEGMENTS)]
            key = np.concatenate([k.ravel() for k in keys]).view(np.int64)
            member = np.tile(np.repeat(fp, len(flips)), SEGMENTS).view(np.int64)
            exact = np.tile(np.arange(len(flips)) == 0, SEGMENTS * len(fp))
            yield from pa.table({"key": key, "fp": member, "exact": exact}).to_batches(max_chunksize=100_000)

    return fps.select("fp").mapInArrow(run, "key long, fp long, exact boolean")


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def trees(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among sorted distinct fingerprints: each one that is
    reached is compared once with those not reached yet."""
    rest = fps
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            f = front.pop()
            near = _close(rest, f)
            if near.any():
                found, rest = rest[near], rest[~near]
                yield np.full(len(found), f), found
                front.extend(found)


def bucket_links(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a bucket of any size. One over ``SPLIT`` is cut by each of the eight bytes in turn: a
    linked pair differs in three bits at most, so it meets in at least five of the cuts."""
    if len(fps) <= SPLIT:
        yield from trees(fps)
        return
    for byte in range(8):
        value = (fps >> np.uint64(8 * byte)) & np.uint64(255)
        for v in np.unique(value):
            yield from trees(fps[value == v])


def ring_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a < b) among the members of each bucket; the rows come sorted by key, exact members first."""

    def links(key: np.ndarray, fp: np.ndarray, exact: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.r_[True, key[1:] != key[:-1]]
        start = np.flatnonzero(first)
        size = np.diff(np.r_[start, len(key)])
        useful = (size > 1) & exact[start]  # some member has exactly this key
        small = np.repeat(useful & (size <= SMALL), size)
        k, f, e = key[small], fp[small], exact[small]
        pairs = []
        for gap in range(1, SMALL):
            if len(k) <= gap:
                break
            hit = (k[gap:] == k[:-gap]) & (e[gap:] | e[:-gap])
            if not hit.any():
                break
            a, b = f[:-gap][hit], f[gap:][hit]
            near = _close(a, b) & (a != b)
            pairs.append((a[near], b[near]))
        for g in np.flatnonzero(useful & (size > SMALL)):
            members = np.unique(fp[start[g]:start[g] + size[g]])
            pairs.extend(bucket_links(members))
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs))
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            if len(both):
                yield from pa.table({"a": both[:, 0].view(np.int64), "b": both[:, 1].view(np.int64)}).to_batches(max_chunksize=100_000)

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        exact = batch.column("exact").to_numpy(zero_copy_only=False)
        held.append((key, fp, exact))
        if key[0] == key[-1] or sum(len(h[0]) for h in held) < 500_000:
            continue
        key, fp, exact = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
        if cut:
            yield from links(key[:cut], fp[:cut], exact[:cut])
        held = [(key[cut:], fp[cut:], exact[cut:])]
    if held:
        yield from links(*(np.concatenate(x) for x in zip(*held)))


def link_table(fps: DataFrame) -> DataFrame:
    """``a, b``: links of distinct fingerprints; buckets over ``SMALL`` give a spanning forest instead of all pairs."""
    n = partitions(fps)
    keyed = ring_keys(fps).repartition(n, "key").sortWithinPartitions("key", F.col("exact").desc())
    return keyed.mapInArrow(ring_links, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node with a link.

    Rounds of contraction: each node points to the first of its neighbours and itself in an order by
    hash, links are moved to what their ends point to, and those inside a tree vanish. In the hashed
    order a chain shrinks by a constant share a round and a star in two rounds. The pointers of all
    rounds are then followed. All tables stay distributed.
    """
    step: list[DataFrame] = []
    links = checkpoint(links.select("a", "b"))
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = checkpoint(both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("node"), F.least(ranked("a"), F.col("m"))["v"].alias("root")))
        step.append(to)
        moved = links.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        links = checkpoint(moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not step:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = step[0]
    for to in step[1:]:
        roots = roots.join(to.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return roots


def near_dedup(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, version, fingerprint, component_id`` per document; ``version`` is a hash of the text.

    Texts: A-Z in lower case, words between ASCII white space, shingles of ``words`` words. Null and
    empty texts and those without words have the fingerprint 0, linked like any other. Fingerprints
    link at ``DISTANCE`` or fewer bits; ``component_id`` is the smallest doc_id reachable (null ids are
    passed over; null if a component has no other). Repeated rows share a component. Copies are one
    fingerprint before candidates are looked for. Empty table: no rows.
    """
    own = checkpoint(fingerprints(docs, words))
    distinct = checkpoint(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link_table(distinct))
    rooted = checkpoint(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = checkpoint(rooted.join(least, "root").select("fp", "component_id"))
    return own.join(named, "fp").select("doc_id", "version", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
