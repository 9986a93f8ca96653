"""Packing of documents into sequences by non-negative least squares over shallow length combinations.

A document gives full windows and a rest. Rests fall into classes of about equal length. Every way to fill a
window with at most ``depth`` classes is a column; non-negative least squares fits repeat counts to the histogram of
classes, which are rounded. The n-th document of a class takes the n-th place of that class in the combinations, so that
documents are placed by arithmetic on their rank. Documents beyond the places are the residual: they are cut greedily
into the room that the combinations leave and then into sequences of their own. Only the histogram comes to
the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.blocks import squeeze, stretch
from riskloom.llm.words import WordIds
from riskloom.session import checkpoint

WINDOW = 4096
WIDTH = 16
DEPTH = 4
END = 2
AXIS = 16
"""Bits of a stretch of the axis on which rests meet room."""
FAN = 12
"""Bits of a run of running totals."""


def combinations(classes: int, depth: int) -> np.ndarray:
    """All ways to write ``classes`` as a sum of at most ``depth`` classes, largest first, padded with zeros."""
    rows = np.zeros((1, 0), np.int32)
    left, top = np.array([classes]), np.array([classes])
    done = []
    for k in range(depth):
        slots = depth - k
        # the next class: at most the one before, at least what lets the remaining slots fill the rest
        low, high = -(-left // slots), np.minimum(left, top)
        n = np.maximum(high - low + 1, 0)
        of = np.repeat(np.arange(len(left)), n)
        value = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[of]
        rows, left, top = np.column_stack([rows[of], value]).astype(np.int32), left[of] - value, value
        full = left == 0
        done.append(np.pad(rows[full], ((0, 0), (0, depth - rows.shape[1]))))
        rows, left, top = rows[~full], left[~full], top[~full]
    return np.concatenate(done)


def nnls(columns: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises the weighted squared difference of ``target`` (per class, 1-based) and the classes that x
    times the ``columns`` use: an active-set method whose columns stay implicit."""
    n = len(target)
    w2 = np.r_[0.0, weight**2]
    b = np.r_[0.0, target]

    def dense(which: np.ndarray) -> np.ndarray:
        a = np.zeros((n + 1, len(which)))
        for k in range(columns.shape[1]):
            np.add.at(a, (columns[which, k], np.arange(len(which))), 1.0)
        a[0] = 0
        return a

    x = np.zeros(len(columns))
    active = np.zeros(0, np.int64)
    residual = b.copy()
    scale = max(1.0, float((w2 * b).max()))
    for _ in range(rounds or 3 * n):
        gain = (w2 * residual)[columns].sum(1)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-9 * scale:
            break
        active = np.r_[active, best]
        while True:
            a = dense(active)
            s = np.linalg.lstsq(a * np.sqrt(w2)[:, None], np.sqrt(w2) * b, rcond=None)[0]
            if (s > 0).all():
                x[active] = s
                break
            low = s <= 0
            step = np.min(x[active][low] / np.maximum(x[active][low] - s[low], 1e-300))
            x[active] += step * (s - x[active])
            gone = low & (x[active] <= 1e-12 * max(1.0, x.max()))
            if not gone.any():
                gone[np.flatnonzero(low)[np.argmin(x[active][low])]] = True
            x[active[gone]] = 0
            active = active[~gone]
            if not len(active):
                break
        residual = b - dense(active) @ x[active] if len(active) else b.copy()
    return x


@dataclass
class Plan:
    """Combinations in use (rows of classes), how often each is repeated, and where a class finds its places."""

    combos: np.ndarray
    repeats: np.ndarray

    def __post_init__(self):
        base = np.r_[0, np.cumsum(self.repeats)]
        self.sequences = int(base[-1])
        self.places: dict[int, tuple[np.ndarray, ...]] = {}
        for c in np.unique(self.combos[self.combos > 0]):
            rows = np.flatnonzero((self.combos == c).any(1))
            many = (self.combos[rows] == c).sum(1)
            slot = (self.combos[rows] == c).argmax(1)
            starts = np.r_[0, np.cumsum(many * self.repeats[rows])]
            self.places[int(c)] = (starts, many, slot, base[rows])

    def place(self, classes: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and slot of the document of this rank in its class; -1 for the residual."""
        seq, slot = np.full(len(rank), -1, np.int64), np.full(len(rank), -1, np.int64)
        for c in np.unique(classes):
            if int(c) not in self.places:
                continue
            starts, many, first, base = self.places[int(c)]
            at = np.flatnonzero((classes == c) & (rank < starts[-1]))
            i = np.searchsorted(starts, rank[at], side="right") - 1
            off = rank[at] - starts[i]
            seq[at], slot[at] = base[i] + off // many[i], first[i] + off % many[i]
        return seq, slot


def solve(histogram: dict[int, tuple[int, int]], classes: int, width: int, depth: int) -> Plan:
    """Plan for ``class -> (documents, tokens)``. Repeats are rounded and kept within the documents there are. Where the rounded
    combinations would leave more room than the residual fills, the ones that leave most are taken apart."""
    have = np.zeros(classes + 1, np.int64)
    room = np.zeros(classes + 1)
    for c, (n, tokens) in histogram.items():
        if c and n:
            have[c], room[c] = n, c * width - tokens / n
    columns = combinations(classes, depth)
    columns = columns[((have[columns] > 0) | (columns == 0)).all(1)]
    if not len(columns):
        return Plan(np.zeros((0, depth), np.int32), np.zeros(0, np.int64))
    # short classes matter less: they fill any room
    weight = np.where(np.arange(1, classes + 1) * 32 <= classes, 0.1, 1.0)
    x = nnls(columns, have[1:].astype(float), weight)
    used = np.argsort(-x, kind="stable")[:int((x > 0).sum())]
    left = have.copy()
    repeats = []
    for c in used:
        kinds, many = np.unique(columns[c][columns[c] > 0], return_counts=True)
        n = int(min(np.rint(x[c]), (left[kinds] // many).min()))
        left[kinds] -= many * n
        repeats.append(n)
    combos, repeats = columns[used], np.array(repeats, np.int64)
    space = room[combos].sum(1)
    short = float((space * repeats).sum() - (left[1:] * (np.arange(1, classes + 1) * width - room[1:])).sum())
    for c in np.argsort(-space, kind="stable"):
        if short <= 0:
            break
        n = int(min(repeats[c], np.ceil(short / (classes * width))))
        repeats[c] -= n
        short -= n * classes * width
    return Plan(combos[repeats > 0], repeats[repeats > 0])


TOKENS = "part int, row long, doc_id long, n long, class int, nth long, windows long, z binary"


def tokenized(docs: DataFrame, path: str, window: int, width: int) -> DataFrame:
    """Ids of every document, compressed, with its place in its task: ``nth`` of its class, full windows before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordIds(path)
        seen = np.zeros(window // width + 2, np.int64)
        row = full = 0
        end = np.uint32(END)
        for b in batches:
            if not b.num_rows:
                continue
            for first, ids, starts in coder.slices(b.column("text")):
                n = np.diff(starts) + 1
                rest = n % window
                kind = -(-rest // width)
                nth = np.empty(len(n), np.int64)
                for i, c in enumerate(kind):
                    nth[i] = seen[c]
                    seen[c] += 1
                z = [squeeze(np.append(ids[s:e], end)) for s, e in zip(starts[:-1], starts[1:])]
                own = b.slice(first, len(n))
                yield pa.record_batch({
                    "part": own.column("part"), "row": np.arange(row, row + len(n)), "doc_id": own.column("doc_id"), "n": n, "class": kind.astype(np.int32),
                    "nth": nth, "windows": np.cumsum(n // window) - n // window + full, "z": pa.array(z, pa.binary()),
                })
                row += len(n)
                full += int((n // window).sum())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part")).mapInArrow(run, TOKENS)


def _earlier(value: str, at: str, *by) -> Column:
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def before(df: DataFrame, keys: list[str], at: str, value: str, name: str, top: int, fan: int = FAN) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its key with a smaller ``at`` (unique in the key, from 0 to ``top``). Beyond
    2^``fan`` places they are summed up by runs of so many, and the runs in the same way."""
    if top < 1 << fan:
        return df.withColumn(name, _earlier(value, at, *(keys or [F.lit(0)])))
    placed = df.withColumnRenamed(at, "_at").withColumn("_run", F.shiftright("_at", fan))
    return by_runs(placed, keys, "_at", value, name, top >> fan, fan).withColumnRenamed("_at", at)


def by_runs(df: DataFrame, keys: list[str], at: str, value: str, name: str, top: int, fan: int = FAN) -> DataFrame:
    """``before`` for rows whose runs (``_run``, from 0 to ``top``) are given; ``at`` orders the rows of a run."""
    sums = df.groupBy(*keys, "_run").agg(F.sum(value).alias("_sum"))
    base = before(sums, keys, "_run", "_sum", f"_base{top}", top, fan).select(*keys, F.col("_run"), F.col(f"_base{top}").alias("_base"))
    own = _earlier(value, at, *keys, "_run")
    return df.join(base, [*keys, "_run"]).withColumn(name, own + F.col("_base")).drop("_run", "_base")


def on_axis(df: DataFrame, fields: list[str]) -> DataFrame:
    """Intervals ``[t, t + size)`` cut at the ends of stretches: ``stretch, t, end`` and a struct of ``fields``."""
    b = F.explode(F.sequence(F.shiftright("t", AXIS), F.shiftright(F.col("t") + F.col("size") - 1, AXIS)))
    cut = df.withColumn("stretch", b)
    return cut.select("stretch", F.greatest(F.col("t"), F.shiftleft("stretch", AXIS)).alias("t"), F.struct(F.col("t").alias("from"), (F.col("t") + F.col("size")).alias("to"), *fields).alias("own"))


def poured(rests: DataFrame, rooms: DataFrame) -> DataFrame:
    """Where the intervals of ``rests`` (part, row, start; t, size) meet those of ``rooms`` (seq; t, size): ``part, row, start, length,
    seq, t``. Both kinds cover the axis without overlaps, so what follows an end of either is one piece."""
    none = lambda df: F.lit(None).cast(df.schema["own"].dataType)
    r, s = on_axis(rests, ["part", "row", "start"]), on_axis(rooms, ["seq"])
    ends = r.select("stretch", "t", F.col("own").alias("r"), none(s).alias("s")).union(s.select("stretch", "t", none(r).alias("r"), F.col("own").alias("s")))
    ends = ends.groupBy("stretch", "t").agg(F.max("r").alias("r"), F.max("s").alias("s"))
    w = Window.partitionBy("stretch").orderBy("t")
    last = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c)
    spans = ends.select("stretch", "t", last("r"), last("s"), F.lead("t").over(w).alias("next"))
    end = F.least(F.coalesce("next", F.shiftleft(F.col("stretch") + 1, AXIS)), F.col("r.to"), F.col("s.to"))
    spans = spans.withColumn("end", end).where("r is not null and s is not null and end > t")
    return spans.groupBy("r.part", "r.row", "s.seq").agg(F.min(F.col("r.start") + F.col("t") - F.col("r.from")).alias("start"), F.sum(F.col("end") - F.col("t")).alias("length"), F.min("t").alias("t"))


def pieces(tokens: DataFrame, window: int, width: int, depth: int) -> DataFrame:
    """``part, row, start, length, sequence_id, offset`` of every piece of ``tokens``."""
    spark = tokens.sparkSession
    rest = F.col("n") % window
    histogram = {r["class"]: (r["docs"], r["tokens"]) for r in tokens.groupBy("class").agg(F.count(F.lit(1)).alias("docs"), F.sum(rest).alias("tokens")).collect()}  # at most window / width rows
    plan = solve(histogram, window // width, width, depth)
    slim = tokens.select("part", "row", "n", "class", "nth", "windows", rest.alias("rest"), F.floor(F.col("n") / window).alias("full"))
    parts = int(slim.agg(F.max("part").alias("m")).first()["m"] or 0)
    classes = before(slim.groupBy("class", "part").agg(F.count(F.lit(1)).alias("docs")), ["class"], "part", "docs", "docs_before", parts)
    wholes = before(slim.groupBy("part").agg(F.sum("full").alias("full")), [], "part", "full", "full_before", parts)
    ranked = slim.join(classes.drop("docs"), ["class", "part"]).join(wholes.drop("full"), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, slot = plan.place(b.column("class").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(slot)], [*b.schema.names, "seq", "slot"])

    ranked = ranked.select("part", "row", "class", "rest", "full", (F.col("windows") + F.col("full_before")).alias("window"), (F.col("nth") + F.col("docs_before")).alias("rank"))
    placed = checkpoint(ranked.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in ranked.dtypes) + ", seq long, slot long"))
    held, spare = F.col("seq") >= 0, (F.col("seq") < 0) & (F.col("rest") > 0)
    room = checkpoint(before(placed.where(held).groupBy("seq").agg((F.lit(window) - F.sum("rest")).alias("size")).where("size > 0"), [], "seq", "size", "t", plan.sequences))
    # a task's rows are a run: as many as its part of the input has
    rests = by_runs(placed.where(spare).withColumn("_run", F.col("part")), [], "row", "rest", "t", parts).select("part", "row", (F.col("full") * window).alias("start"), F.col("rest").alias("size"), "t")
    totals = placed.agg(F.sum("full").alias("full"), F.sum(F.when(spare, F.col("rest"))).alias("spare")).first()
    windows, spare_total = int(totals["full"] or 0), int(totals["spare"] or 0)
    room_total = int(room.agg(F.sum("size").alias("s")).first()["s"] or 0)
    over = max(0, spare_total - room_total)
    whole, tail = divmod(over, window)
    own = spark.range(whole).select((F.col("id") + plan.sequences).alias("seq"), F.lit(window).cast("long").alias("size"), (F.col("id") * window + room_total).alias("t"))
    # what is left fills sequences of powers of two, which need no padding
    bits = [1 << k for k in reversed(range(tail.bit_length())) if tail >> k & 1]
    ends = [(plan.sequences + whole + i, size, room_total + whole * window + sum(bits[:i])) for i, size in enumerate(bits)]
    rooms = room.select("seq", "size", "t").union(own)
    if ends:
        rooms = rooms.union(spark.createDataFrame(ends, "seq long, size long, t long"))
    cut = poured(rests, rooms).select("part", "row", "start", "length", "seq", (F.col("t") + depth).alias("place"))
    fixed = placed.where(held).select("part", "row", (F.col("full") * window).alias("start"), F.col("rest").alias("length"), "seq", F.col("slot").alias("place"))
    w = Window.partitionBy("seq").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    joint = fixed.union(cut).select("part", "row", "start", "length", (F.col("seq") + windows).alias("sequence_id"), F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"))
    full = placed.where("full > 0").select("part", "row", "window", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("i"))
    return full.select("part", "row", (F.col("i") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.col("window") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).union(joint)


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, width: int = WIDTH, depth: int = DEPTH, ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids`` if wanted), a row per piece.

    A document's ids are those of the tokenizer file at ``path`` without special tokens, and id 2. Null and empty texts have id 2
    alone; null ids and repeated rows are documents like others; extra columns are not read; empty table: no
    rows. Every sequence is full, but for room that the residual does not fill, and but for the last ones of the
    residual, whose sizes are powers of two. ``window`` must be a multiple of ``width`` and at most 2^16.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if window % width or window > 1 << AXIS:
        raise ValueError("the window must be a multiple of the width and at most 65,536")
    tokens = checkpoint(tokenized(docs, path, window, width))
    cuts = pieces(tokens.drop("z"), window, width, depth)
    cuts = cuts.groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, n, z, cs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "z", "cuts"))):
                own = stretch(z, np.uint32)
                for c in cs:
                    part = own[c["start"]:c["start"] + c["length"]]
                    out.append((doc, c["start"], c["length"], zlib.crc32(part.tobytes()), n, c["sequence_id"], c["offset"], *([part.tolist()] if ids else [])))
            if out:
                cols = list(zip(*out))
                arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(c, pa.list_(pa.int64())) for c in cols[7:]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else [])])

    return tokens.select("part", "row", "doc_id", "n", "z").join(cuts, ["part", "row"]).select("doc_id", "n", "z", "cuts").mapInArrow(run, OUT + (", ids array<long>" if ids else ""))
