"""LM scoring by online logistic context mixing.

Texts are read as lower-case words with single spaces and an end sign, as bytes, bit by bit. Predictors of
several contexts (1 to 5 bytes, and a hash of the whole word so far) count the next bit under each context and
the bits so far; their stretched probabilities are combined by weights that a gate selects, learned online, and a
final map refines the result adaptively. Counts cover every training document and stay in Spark: a gram (what
tells all contexts of a byte, and the byte) goes to the bucket of its last three bytes, so that every context of
three bytes or more lies in one bucket, and what a bucket found about its grams goes back to the
blocks that sent them. Only the two shortest contexts, at most 2^24 keys, and the mixer are broadcast. The model
is then fixed, so that a document's score depends on nothing but its text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.blocks import Numbers, by_bucket, in_blocks, join_words, split_words, squeeze, stretch, unpack
from riskloom.llm.common import partitions, remainder
from riskloom.session import checkpoint

WINDOW = 6
"""The longest context in bytes, and the byte it predicts."""
CONTEXTS = 6
"""Last 1, 2, 3, 4 and 5 bytes; last 3 bytes with a hash of the word so far."""
CHUNK = 1_000_000
STRETCH = 50_000
"""Bytes whose grams are computed together: arrays that stay in a core's cache."""
BLOCK = 32_000_000
"""Bytes of text in a block, about; the number of blocks and buckets grows with the table."""
SLICE = 100_000
"""Grams that a task mixes at a time, about; grams of the same last three bytes stay together."""
PRIOR = 0.25
RATE = 0.3
PASSES = 3
LEVELS = 33
GATES = 8 * (CONTEXTS + 1)
FACTOR = 0x9E3779B97F4A7C15


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def prepared(text: str) -> bytes:
    """Words in lower case (A-Z), single spaces."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def u(x: int) -> np.uint64:
    return np.uint64(x)


POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a factor and of its inverse modulo 2^64, ``n`` or more; those of a stretch of usual length are kept."""
    if n <= 2 * STRETCH and POWERS:
        return POWERS[0]
    n = max(n, 2 * STRETCH)
    found = tuple(np.cumprod(np.r_[u(1), np.full(n, f, np.uint64)]) for f in (FACTOR, pow(FACTOR, -1, 2**64)))
    if n == 2 * STRETCH:
        POWERS[0] = found
    return found


def windows(texts: list[bytes]) -> np.ndarray:
    """The gram of every byte and end sign, from the top: the last three bytes before it (24 bits), the two before those
    (16), a hash of the word so far (16), the byte (8). Contexts start as zeros at each text."""
    out, part, size = [], [], 0
    for t in texts:
        if part and size + len(t) + WINDOW > STRETCH:
            out += stretch_of(part)
            part, size = [], 0
        part.append(t)
        size += len(t) + WINDOW
    return np.concatenate(out + stretch_of(part))


def stretch_of(texts: list[bytes]) -> list[np.ndarray]:
    pad = b"\0" * (WINDOW - 1)
    data = b"".join([x for t in texts for x in (pad, t, b"\0")])
    raw = np.frombuffer(data, np.uint8)
    n = max(0, len(raw) - WINDOW + 1)
    wide = raw.astype(np.uint64)
    g = wide[2:2 + n] << u(16)
    g |= wide[3:3 + n] << u(8)
    g |= wide[4:4 + n]
    g <<= u(40)
    g |= wide[:n] << u(32)
    g |= wide[1:1 + n] << u(24)
    g |= wide[5:5 + n]
    before = raw[4:4 + n]
    at = np.arange(n, dtype=np.int32)
    first = np.maximum.accumulate(np.where((before == 32) | (before == 0), at, np.int32(0)))
    power, inverse = powers(len(raw))
    wide *= power[:len(raw)]
    sums = np.cumsum(wide)  # before a byte: all bytes up to the one before it
    word = sums[4:4 + n] - sums[4:4 + n][first]
    word *= inverse[5:5 + n][first]
    word ^= word >> u(31)
    word *= u(0xD6E8FEB86659FD93)
    word >>= u(48)
    g |= word << u(8)
    starts = np.cumsum([0] + [len(t) + WINDOW for t in texts]).tolist()
    return [g[a:a + len(t) + 1] for a, t in zip(starts, texts)]


def buckets_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return ((((grams >> u(40)) + u(1)) * u(FACTOR)) >> u(33)) % u(buckets)


def context(grams: np.ndarray, k: int) -> np.ndarray:
    """Context k and the byte as one key."""
    byte, last = grams & u(255), grams >> u(40)
    if k < 3:
        return (last & u((1 << 8 * (k + 1)) - 1)) << u(8) | byte
    if k == 3:
        return last << u(16) | ((grams >> u(24)) & u(255)) << u(8) | byte
    return last << u(24) | ((grams >> u(24 if k == 4 else 8)) & u(65_535)) << u(8) | byte


def totals(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Occurrences below each of the nine nodes from a key's context to its byte (node x key), for distinct or repeated keys."""
    order = np.argsort(keys)
    keys = keys[order]
    sums = np.concatenate([[0], np.cumsum(n[order])])
    first = np.concatenate([[-1], np.bitwise_xor(keys[1:], keys[:-1]).astype(np.int64)])  # the highest bit in which a key differs from the one before
    out = np.empty((9, len(keys)), np.int64)
    for j in range(9):
        new = first.view(np.uint64) >= u(1 << (8 - j))
        cuts = np.append(np.flatnonzero(new), len(keys))
        out[j, order] = np.repeat(sums[cuts[1:]] - sums[cuts[:-1]], np.diff(cuts))
    return out


class Low:
    """Counts of the contexts of one and two bytes: keys of two bytes and the next, ascending, with their occurrences."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys = keys
        self.nodes = (totals(keys & u(65_535), n), totals(keys, n)) if len(keys) else ()

    def of(self, grams: np.ndarray, k: int) -> np.ndarray:
        return self.nodes[k][:, np.searchsorted(self.keys, context(grams, 1))]


def bits_of(grams: np.ndarray) -> np.ndarray:
    return ((grams & u(255)).astype(np.int64)[:, None] >> np.arange(7, -1, -1)) & 1


def inputs(grams: np.ndarray, n: np.ndarray, low: Low, leave_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretched predictions (gram x bit x context and a constant), gates and bits of all grams of some three-byte contexts.
    ``leave_out`` takes one occurrence of the gram itself out of the counts, as if it had not been seen yet."""
    bits = bits_of(grams)
    sign = (2 * bits - 1).astype(np.float32)
    x = np.ones((*bits.shape, CONTEXTS + 1), np.float32)
    seen = np.zeros(bits.shape, np.int64)
    for k in range(CONTEXTS):
        nodes = low.of(grams, k) if k < 2 else totals(context(grams, k), n)
        taken, other = nodes[1:], (nodes[:-1] - nodes[1:]).astype(np.float32)
        taken = (np.maximum(taken - 1, 0) if leave_out else taken).astype(np.float32)
        seen += ((taken + other) > 0).T
        x[:, :, k] = sign * np.log((taken + np.float32(PRIOR)) / (other + np.float32(PRIOR))).T  # the logit of (n1 + prior) / (n + 2 prior)
    x[:, :, -1] = 0.3
    return x, np.arange(8)[None, :] * (CONTEXTS + 1) + seen, bits


def slices(grams: np.ndarray) -> Iterator[slice]:
    """Cuts ascending grams between three-byte contexts."""
    last = grams >> u(40)
    starts = np.flatnonzero(np.r_[True, last[1:] != last[:-1]]) if len(last) else np.zeros(0, np.int64)
    a = 0
    while a < len(grams):
        i = np.searchsorted(starts, a + SLICE)
        b = int(starts[i]) if i < len(starts) else len(grams)
        yield slice(a, b)
        a = b


def start_weights() -> np.ndarray:
    return np.tile(np.array([0.3] * CONTEXTS + [0.0]), (GATES, 1))


def learn(w: np.ndarray, x: np.ndarray, gate: np.ndarray, bits: np.ndarray, n: np.ndarray, order: np.ndarray, rate: float) -> None:
    """Moves the weights online over grams in this order; each step moves those of the gates it met."""
    for at in range(0, len(order), 1024):
        part = order[at:at + 1024]
        xs, gs = x[part], gate[part]
        many = np.sqrt(n[part])[:, None]
        miss = many * (bits[part] - squash(np.einsum("nbk,nbk->nb", xs, w.astype(np.float32)[gs])))
        total = np.stack([np.bincount(gs.ravel(), (miss * xs[:, :, k]).ravel(), GATES) for k in range(x.shape[2])], 1)
        met = np.bincount(gs.ravel(), np.broadcast_to(many, gs.shape).ravel(), GATES)
        w += rate * total / np.maximum(met, 1)[:, None]


def level(x: np.ndarray) -> np.ndarray:
    """Bucket of a stretched probability."""
    return np.clip(np.round(x * 2) + LEVELS // 2, 0, LEVELS - 1).astype(np.int64)


class Model:
    """Low contexts, weights and refinement; the counts of longer contexts come with the grams of a bucket."""

    def __init__(self, low: Low, weights: np.ndarray, refined: np.ndarray | None = None):
        self.low, self.weights, self.refined = low, weights, refined

    def mixed(self, grams: np.ndarray, n: np.ndarray, leave_out: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, gate, bits = inputs(grams, n, self.low, leave_out)
        s = np.einsum("nbk,nbk->nb", x, self.weights.astype(np.float32)[gate]).astype(float)
        last = ((grams >> u(40)) & u(255)).astype(np.int64)[:, None]
        return s, last * LEVELS + level(s), bits

    def cost(self, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 of the probability of the byte of each gram; ascending, all grams of a bucket with their occurrences."""
        out = np.empty(len(grams))
        for part in slices(grams):
            s, cell, bits = self.mixed(grams[part], n[part])
            p = squash(s)
            if self.refined is not None:
                p = (p + self.refined[cell]) / 2
            p = np.clip(p, 1e-5, 1 - 1e-5)
            out[part] = np.log10(np.where(bits == 1, p, 1 - p)).sum(1)
        return out


def ascending(a: np.ndarray) -> bytes:
    """Ascending numbers by their differences, bytes of the same place together."""
    d = np.diff(a, prepend=a.dtype.type(0))
    return squeeze(np.ascontiguousarray(d.view(np.uint8).reshape(len(d), a.itemsize).T))


def climb(z: bytes, kind) -> np.ndarray:
    raw = stretch(z, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(kind).ravel(), dtype=kind)


SENT = "kind int, bucket int, block int, words binary, counts binary"


def corpus_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """What each block sends of its words (kind 0) and grams (kind 1), with their occurrences in its training documents."""

    def count(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        known: Counter[bytes] = Counter()
        others: set[bytes] = set()
        grams, held, trains, size = [], [], [], 0

        def fold() -> None:
            g = windows(held)
            inv, found = pd.factorize(g, size_hint=len(g) // 3)
            train = np.repeat(trains, [len(t) + 1 for t in held])
            grams.append((found, np.bincount(inv, train, minlength=len(found))))

        for flags, z in zip(table.column("flags").to_pylist(), table.column("z").to_pylist()):
            for train, text in zip(flags, unpack(z)):
                (known if train else others).update(text.split(b" "))
                held.append(text)
                trains.append(bool(train))
                size += len(text)
                if size > CHUNK:
                    fold()
                    held, trains, size = [], [], 0
        if held:
            fold()
        others.discard(b"")
        known.pop(b"", None)
        rows = [(0, b, join_words(ws), squeeze(np.array([known.get(w, 0) for w in ws], np.int64))) for b, ws in by_bucket(others | known.keys(), buckets)]
        g, inv = np.unique(np.concatenate([x for x, _ in grams]), return_inverse=True)
        n = np.bincount(inv, np.concatenate([x for _, x in grams])).astype(np.int64)
        of = buckets_of(g, buckets)
        order = np.argsort(of, kind="stable")
        found, starts = np.unique(of[order], return_index=True)
        rows += [(1, int(b), ascending(g[part]), squeeze(n[part])) for b, part in zip(found, np.split(order, starts[1:]))]
        return pa.table({
            "kind": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()),
            "words": pa.array([r[2] for r in rows], pa.binary()), "counts": pa.array([r[3] for r in rows], pa.binary()),
        })

    return blocks.groupBy("block").applyInArrow(count, SENT)


def merge(table: pa.Table) -> pa.Table:
    """Adds up a bucket. Words: the totals go back to each block in the order of its words, with the number
    of distinct training words and of training tokens of the bucket. Grams: one row (block -1) of all, ascending, with their
    occurrences, and a row per block with the places of its grams among them."""
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    blocks, words, counts = (table.column(c).to_pylist() for c in ("block", "words", "counts"))
    if kind == 1:
        lists = [climb(z, np.uint64) for z in words]
        g, inv = np.unique(np.concatenate(lists), return_inverse=True)
        n = np.bincount(inv, np.concatenate([stretch(z, np.int64) for z in counts])).astype(np.int64)
        places = np.split(inv.astype(np.uint32), np.cumsum([len(x) for x in lists])[:-1])
        rows = [(-1, ascending(g), squeeze(n), 0, 0), *((b, ascending(p), b"", 0, 0) for b, p in zip(blocks, places))]
    else:
        lists = [split_words(z) for z in words]
        ids: dict[bytes, int] = {}
        idx = [np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int64, len(ws)) for ws in lists]
        total = np.zeros(len(ids), np.int64)
        for i, z in zip(idx, counts):
            total[i] += stretch(z, np.int64)
        rows = [(b, b"", squeeze(total[i]), int((total > 0).sum()), int(total.sum())) for b, i in zip(blocks, idx)]
    return pa.table({
        "kind": pa.array([kind] * len(rows), pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "block": pa.array([r[0] for r in rows], pa.int32()),
        "words": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary()),
        "distinct": pa.array([r[3] for r in rows], pa.int64()), "tokens": pa.array([r[4] for r in rows], pa.int64()),
    })


MERGED = SENT + ", distinct long, tokens long"


def fit(grams: DataFrame) -> Model:
    """Short contexts, then weights learned on each bucket and averaged, then the refinement; ``grams`` has a row per bucket.
    To the driver come at most 2^24 keys of two bytes and the next, and two tables of fixed size."""
    sc = grams.sparkSession.sparkContext
    rows = grams.select("words", "counts")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for g, n in zip(b.column("words").to_pylist(), b.column("counts").to_pylist()):
                yield climb(g, np.uint64), stretch(n, np.int64)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, n in read(batches):
            keys, inv = np.unique(context(g, 1), return_inverse=True)
            yield pa.record_batch({"key": pa.array(keys.astype(np.int32)), "n": pa.array(np.bincount(inv, n).astype(np.int64))})

    found = rows.mapInArrow(pairs, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    low = sc.broadcast((found["key"].to_numpy(np.uint64), found["n"].to_numpy(np.int64)))

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Low(*low.value)
        for g, n in read(batches):
            w, used = start_weights(), 0
            for part in slices(g):
                x, gate, bits = inputs(g[part], n[part], table, True)
                for turn in range(PASSES):
                    order = np.argsort((g[part] + u(turn)) * u(FACTOR))
                    order = order[n[part][order] > 0]
                    learn(w, x, gate, bits, n[part], order, RATE / (1 + turn))
                    used += len(order)
            if used:
                yield pa.record_batch({"at": pa.array(np.arange(w.size, dtype=np.int32)), "w": pa.array(w.ravel() * used), "n": pa.array(np.full(w.size, float(used)))})

    learned = rows.mapInArrow(weights, "at int, w double, n double").groupBy("at").agg((F.sum("w") / F.sum("n")).alias("w")).toPandas()
    w = start_weights()
    if len(learned):
        w.ravel()[learned["at"].to_numpy()] = learned["w"].to_numpy()

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(Low(*low.value), w)
        hits = np.zeros((2, 256 * LEVELS))
        for g, n in read(batches):
            for part in slices(g):
                _, cell, bits = model.mixed(g[part], n[part], True)
                many = np.broadcast_to(n[part, None], bits.shape)
                for k in (0, 1):
                    hits[k] += np.bincount(cell[bits == k], many[bits == k], hits.shape[1])
        at = np.flatnonzero(hits.any(0))
        yield pa.record_batch({"at": pa.array(at.astype(np.int32)), "n0": hits[0, at], "n1": hits[1, at]})

    cells = rows.mapInArrow(refine, "at int, n0 double, n1 double").groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    prior = np.tile(squash((np.arange(LEVELS) - LEVELS // 2) / 2), 256)
    n0, n1 = np.zeros(256 * LEVELS), np.zeros(256 * LEVELS)
    n0[cells["at"]], n1[cells["at"]] = cells["n0"], cells["n1"]
    return Model(Low(*low.value), w, (n1 + 8 * prior) / (n0 + n1 + 8))


def costs(grams: DataFrame, model: Model) -> DataFrame:
    """``kind, block, bucket, counts``: to each block the costs of the grams that it sent to a bucket, in its order."""
    sent = grams.sparkSession.sparkContext.broadcast(model)

    def price(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "words", "counts"))))
        g, n = next((climb(w, np.uint64), stretch(c, np.int64)) for b, w, c in rows if b < 0)
        cost = sent.value.cost(g, n).astype(np.float32)
        out = [(b, squeeze(cost[climb(w, np.uint32)])) for b, w, _ in rows if b >= 0]
        return pa.table({
            "kind": pa.array([1] * len(out), pa.int32()), "block": pa.array([b for b, _ in out], pa.int32()),
            "bucket": pa.array([bucket] * len(out), pa.int32()), "counts": pa.array([z for _, z in out], pa.binary()),
        })

    return grams.groupBy("bucket").applyInArrow(price, "kind int, block int, bucket int, counts binary")


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``, a row per row of ``docs``.

    Learns from the documents whose crc32 remainder modulo 7 is not 2 (a null id: crc32 of an empty text, which is
    0). Null and empty texts have one token, the end. ``base_score`` is the add-one unigram log10 probability
    of the tokens, ``score`` the model's of the text: its words in lower case with single spaces, and the
    end. Repeated rows are documents like others; extra columns are not read. Without training
    documents all counts are 0. Empty table: no rows.
    """
    ids, train = docs.select("doc_id", "text"), remainder("doc_id", 7) != 2
    size = ids.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.when(train, 1)).alias("texts")).first()
    n = max(partitions(docs), -(-(size["bytes"] or 0) // BLOCK))
    blocks = in_blocks(ids, train, prepared, blocks=n)
    merged = checkpoint(corpus_counts(blocks, n).groupBy("kind", "bucket").applyInArrow(merge, MERGED))
    model = fit(merged.where("kind = 1 and block < 0"))
    per_bucket = merged.where("kind = 0").groupBy("bucket").agg(F.max("distinct").alias("v"), F.max("tokens").alias("n"))
    sums = per_bucket.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    texts = size["texts"]  # an end sign each
    distinct, tokens = int(sums["v"] or 0) + (texts > 0), int(sums["n"] or 0) + texts

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        packs, flags = table.column("z").to_pylist(), table.column("flags").to_pylist()
        numbers, total = Numbers(), tokens + distinct + 1
        end = float(np.log10((texts + 1) / total))
        words: list[np.ndarray] = []
        out: list[tuple] = []
        held: list[bytes] = []

        chunks: list[tuple[np.ndarray, np.ndarray, list[int]]] = []

        def flush() -> None:
            g = windows(held)
            inv, found = pd.factorize(g, size_hint=len(g) // 3)
            chunks.append((inv.astype(np.int32), found, [len(t) + 1 for t in held]))

        size = 0
        for own, fs, z in zip(table.column("ids").to_pylist(), flags, packs):
            for i, train, text in zip(own, fs, unpack(z)):
                ws = text.split(b" ") if text else []
                words.append(np.fromiter(map(numbers.__getitem__, ws), np.int32, len(ws)))
                out.append((i, not train, len(ws) + 1, len(text) + 1))
                held.append(text)
                size += len(text)
                if size > CHUNK:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        distinct_grams, places = np.unique(np.concatenate([found for _, found, _ in chunks]), return_inverse=True)
        by = dict(zip(zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist()), answers.column("counts").to_pylist()))
        of = buckets_of(distinct_grams, n)
        cost = np.empty(len(of))
        cost[np.argsort(of, kind="stable")] = np.concatenate([stretch(by[1, int(b)], np.float32) for b in np.unique(of)])
        scores: list[float] = []
        ends = np.cumsum([len(found) for _, found, _ in chunks])[:-1]
        for (inv, _, lengths), place in zip(chunks, np.split(places, ends)):
            scores += np.add.reduceat(cost[place][inv], np.cumsum([0, *lengths[:-1]])).tolist()
        c = np.zeros(len(numbers), np.int64)
        for bucket, ws in by_bucket(numbers, n):
            c[np.fromiter(map(numbers.__getitem__, ws), np.int64, len(ws))] = stretch(by[0, bucket], np.int64)
        logp, known = np.log10((c + 1) / total), c > 0
        places = np.concatenate([x for w in words for x in (w, [len(c)])]).astype(np.int64)  # each text's words and its end
        starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        bases = np.add.reduceat(np.append(logp, end)[places], starts).tolist()
        knowns = np.add.reduceat(np.append(known, texts > 0)[places].astype(np.int64), starts).tolist()
        out = [(i, h, k, m, base, b, s) for (i, h, k, b), m, base, s in zip(out, knowns, bases, scores)]
        cols = list(zip(*out))
        return pa.table({
            "doc_id": pa.array(cols[0], pa.int64()), "held_out": pa.array(cols[1], pa.bool_()), "n_tokens": pa.array(cols[2], pa.int64()), "n_known": pa.array(cols[3], pa.int64()),
            "train_tokens": pa.array([tokens] * len(out), pa.int64()), "base_score": pa.array(cols[4], pa.float64()), "score": pa.array(cols[6], pa.float64()),
            "bits_per_byte": pa.array([-s / np.log10(2) / b for s, b in zip(cols[6], cols[5])], pa.float64()),
        })

    answers = merged.where("kind = 0").select("kind", "block", "bucket", "counts").union(costs(merged.where("kind = 1"), model))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
