"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut between any two characters that no piece has beside each other. Each distinct chunk of the corpus is encoded once: its substrings
of bounded length are exploded and joined to the piece table, the edges are grouped by chunk and
folded with Spark's higher-order ``aggregate``. The dictionary then goes back to the documents.

A model file says which rule its scores mean. Unigram models take the path with the largest sum of
scores (Viterbi). BPE models merge by rank: the fold takes the edges by rank and removes the
boundary inside an edge whose ends are boundaries and which holds exactly one more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.blocks import Numbers, by_bucket, in_blocks, join_words, split_words, squeeze, stretch, unpack
from riskloom.llm.common import partitions

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MASK = 61
"""Code points up to which a chunk's boundaries are bits of a long."""
RUN = 1_000
"""Code points up to which a chunk's substrings become rows. Longer runs, which no natural word reaches, are folded where they are."""
UNKNOWN = (1 << 20) - 1
"""Id of an edge over a character without a piece, or with one still to be looked up."""
SIMPLE = 0x250
"""Characters below this code point are looked up in a constant array, which plans carry and so is kept short."""
SLICES = 4
"""Lattice tasks for each of the other tasks. Grouping sorts all edges of a task, ten to twenty times its chunks, so a task gets few chunks."""
NEWLINE = "\x00\x01"
"""Stands for a newline inside the packed words, whose separator it is."""


@dataclass
class Pieces:
    """Piece table of a model file, read on the driver: at most some 10^5 rows, as the file bounds it."""

    path: str = MODEL
    unigram: bool | None = None
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)
    byte_ids: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def __post_init__(self):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(self.path, "rb") as f:
            model.ParseFromString(f.read())
        if self.unigram is None:
            self.unigram = model.trainer_spec.model_type == model.trainer_spec.UNIGRAM
        p = SentencePieceProcessor(model_file=self.path)
        n = p.get_piece_size()
        self.byte_ids = [0] * 256
        self.texts = [""] * n
        for i in range(n):
            if p.is_byte(i):
                self.byte_ids[int(p.id_to_piece(i)[3:5], 16)] = i
                self.texts[i] = p.id_to_piece(i)[3:5]
            elif not p.is_control(i) and not p.is_unknown(i):
                self.pieces.append(p.id_to_piece(i))
                self.scores.append(p.get_score(i))
                self.ids.append(i)
                self.texts[i] = p.id_to_piece(i).encode().hex().upper()

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @property
    def ranks(self) -> list[int]:
        """Equal scores have equal ranks: the leftmost goes first."""
        rank = {s: k for k, s in enumerate(sorted(set(self.scores), reverse=True))}
        return [rank[s] for s in self.scores]

    @property
    def singles(self) -> list[int]:
        """Id of each character below ``SIMPLE``."""
        known = {x: i for x, i in zip(self.pieces, self.ids) if len(x) == 1}
        return [known.get(chr(c), UNKNOWN) for c in range(SIMPLE)]

    @property
    def tied(self) -> list[int]:
        """Ranks that several longer pieces share (runs of white space in the public files)."""
        ranks = [r for r, x in zip(self.ranks, self.pieces) if len(x) > 1]
        return [r for r, n in Counter(ranks).items() if n > 1]

    @property
    def tied_pairs(self) -> list[str]:
        """Without one of these pairs of characters a chunk has no such piece."""
        tied = set(self.tied)
        return sorted({x[:2] for x, r in zip(self.pieces, self.ranks) if len(x) > 1 and r in tied})

    @property
    def pairs(self) -> list[str]:
        """Characters that stand beside each other in some piece. Between two others no merge and no piece reaches across."""
        return sorted({x[i:i + 2] for x in self.pieces for i in range(len(x) - 1)})

    def chunk_pattern(self) -> str:
        """Cuts before white space, around newlines and behind a run of word characters, as far as no piece
        has such a place inside. ``chunker`` cuts there too, and at more places."""
        crossing = {"\n" if "\n" in x else "" for x in self.pieces} - {""}
        inner_space = any(SPACE in x.lstrip(SPACE) for x in self.pieces)
        if crossing or inner_space:
            raise ValueError("pieces reach across white space; cut texts by another pattern")
        # what follows a word character inside some piece stays with it
        glued = {b for x in self.pieces for a, b in zip(x, x[1:]) if re.match(r"[^\W_]", a) and re.match(r"[\W_]", b)}
        glue = "".join(re.escape(c) for c in sorted(glued))
        word = rf"[^\W_]+(?:[{glue}][^\s{SPACE}]*)?" if glue else r"[^\W_]+"
        return rf"\n|{SPACE}*{word}|{SPACE}*[^\n{SPACE}\w]+[^\n{SPACE}]*|{SPACE}*_[^\n{SPACE}]*|{SPACE}+|[^\n{SPACE}]+"

    def frame(self, spark) -> DataFrame:
        rows = list(zip(self.pieces, self.ranks, self.scores, self.ids, map(len, self.pieces)))
        return spark.createDataFrame(rows, "piece string, rank long, score double, id int, len int")


def listed(values: list) -> Column:
    """A constant array of strings, folded once by the planner."""
    return F.split(F.lit(",".join(map(str, values))), ",")


def prepared(text: str) -> bytes:
    """White space escaped, a space in front; an empty text stays empty."""
    return (SPACE + text.replace(" ", SPACE)).encode("utf-8", "surrogatepass") if text else b""


UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def units(text: str) -> list[str]:
    """A prepared text up to the next white space each time, without the escape sign in front. Chunks lie within units: none has white space
    behind another character."""
    if not text:
        return []
    if SPACE + SPACE in text or text.endswith(SPACE):
        return [u[1:] for u in UNIT.findall(text)]
    return text[1:].split(SPACE)


def unit_lists(texts: list[bytes]) -> tuple[list[int], pa.Array]:
    """``units`` of prepared texts in UTF-8, and the order of the texts they are in: those without runs of white space first, cut by Arrow."""
    escape = SPACE.encode()
    runs = [not t or escape + escape in t or t.endswith(escape) for t in texts]
    plain, others = [i for i, r in enumerate(runs) if not r], [i for i, r in enumerate(runs) if r]
    cut = pc.split_pattern(pa.array([texts[i][len(escape):] for i in plain], pa.binary()), escape)
    rest = [[u.encode("utf-8", "surrogatepass") for u in units(texts[i].decode("utf-8", "surrogatepass"))] for i in others]
    return plain + others, pa.concat_arrays([cut, pa.array(rest, cut.type)])


def in_slices(distinct: pa.Array, size: int = 40_000) -> Iterator[list[str]]:
    """Units as strings, some at a time: a block's units and chunks are never all Python strings at once."""
    for i in range(0, len(distinct), size):
        yield [u.decode("utf-8", "surrogatepass") for u in distinct.slice(i, size).to_pylist()]


def chunker(pairs: list[str]):
    """Cuts units between any two characters that are not in ``pairs``: a function from units (without the escape sign in front) to
    their chunks in order and to the number of chunks of each unit. All units are cut at once, so no character costs a Python step."""
    chars = sorted({c for x in pairs for c in x})
    kind = np.zeros(max(map(ord, chars), default=0) + 2, np.uint16)  # 0: a character in no pair
    kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    beside = np.zeros((len(chars) + 1,) * 2, bool)
    for a, b in pairs:
        beside[kind[ord(a)], kind[ord(b)]] = True

    def cut(units: list[str]) -> tuple[list[str], np.ndarray]:
        if not units:
            return [], np.zeros(0, np.int64)
        text = SPACE + SPACE.join(units)
        kinds = kind[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(kind) - 1)]
        first = np.ones(len(kinds), bool)
        np.logical_not(beside[kinds[:-1], kinds[1:]], out=first[1:])
        del kinds
        begins = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) + 1)
        first[begins[:-1]] = True  # a unit of white space may precede another
        starts = np.flatnonzero(first)
        many = np.diff(np.searchsorted(starts, begins), prepend=0)
        at = [*starts.tolist(), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:])], many

    return cut


def merged(length: int, edges: list[int]) -> list[int]:
    """Edges of the final segmentation of a long chunk: the same rule with a heap. Edges are packed (see ``encoded_chunks``)."""
    import heapq

    table = {((x >> 26) & 0x1FFFFF, (x >> 20) & 63): x for x in edges}
    right = list(range(1, length + 1)) + [0]
    left = [-1, *range(length)]
    alive = [True] * length + [False]
    heap: list[tuple[int, int, int, int]] = []

    def offer(s: int) -> None:
        if 0 <= s < length and alive[s] and right[s] < length:
            end = right[right[s]]
            x = table.get((s, end - s))
            if x is not None:
                heapq.heappush(heap, (x >> 47, s, right[s], end))

    for s in range(length):
        offer(s)
    while heap:
        _, s, mid, end = heapq.heappop(heap)
        if alive[s] and right[s] == mid and mid < length and alive[mid] and right[mid] == end:
            alive[mid] = False
            right[s] = end
            if end < length:
                left[end] = s
            offer(s)
            if s:
                offer(left[s])
    return [table.get((s, right[s] - s), (s << 26) | (1 << 20) | UNKNOWN) for s in range(length) if alive[s]]


def viterbi(length: int, edges: list[int], scores: dict[int, float], unknown: float) -> list[int]:
    """Edges of the path with the largest score; ties go to the one that starts first."""
    by_end: dict[int, list[int]] = {}
    for x in edges:
        by_end.setdefault(((x >> 26) & 0x1FFFFF) + ((x >> 20) & 63), []).append(x)
    best, back = [0.0] + [-np.inf] * length, [0] * (length + 1)
    for end in range(1, length + 1):
        for x in sorted(by_end[end], key=lambda x: (x >> 26) & 0x1FFFFF):
            s = best[(x >> 26) & 0x1FFFFF] + scores.get(x & UNKNOWN, unknown)
            if s > best[end]:
                best[end], back[end] = s, x
    out, end = [], length
    while end:
        out.append(back[end])
        end = (back[end] >> 26) & 0x1FFFFF
    return out[::-1]


def merged_run(run: str, rank: dict[str, int], longest: int) -> list[str]:
    """Pieces of a run of any length, in order: merges by rank, leftmost first, with a heap. Time grows with n log n, memory with n;
    a substring is looked up when its two halves meet, so no list of edges is made."""
    import heapq
    from array import array

    n = len(run)
    right, left = array("q", range(1, n + 2)), array("q", range(-1, n))
    alive = bytearray(b"\x01") * n + bytearray(1)
    heap: list[int] = []

    def offer(s: int) -> None:
        mid = right[s]
        if mid < n:
            end = right[mid]
            if end - s <= longest and (r := rank.get(run[s:end])) is not None:
                heapq.heappush(heap, (((r << 40 | s) << 12) | (mid - s) << 6) | (end - s))  # rank, start, middle, end

    for s in range(n - 1):
        offer(s)
    while heap:
        x = heapq.heappop(heap)
        s = (x >> 12) & 0xFFFFFFFFFF
        mid, end = s + ((x >> 6) & 63), s + (x & 63)
        if alive[s] and right[s] == mid and alive[mid] and right[mid] == end:
            alive[mid], right[s] = 0, end
            if end < n:
                left[end] = s
            offer(s)
            if s:
                offer(left[s])
    return [run[s:right[s]] for s in range(n) if alive[s]]


def viterbi_run(run: str, scores: dict[str, float], longest: int, unknown: float) -> list[str]:
    """Pieces of the best path through a run of any length; ties go to the one that starts first. A character that is no piece
    costs ``unknown``."""
    from array import array

    n = len(run)
    best, back = array("d", [0.0]) * (n + 1), array("q", [0]) * (n + 1)
    for end in range(1, n + 1):
        best[end] = -np.inf
        for s in range(max(0, end - longest), end):
            score = scores.get(run[s:end], unknown if s == end - 1 else None)
            if score is not None and best[s] + score > best[end]:
                best[end], back[end] = best[s] + score, s
    out, end = [], n
    while end:
        out.append(run[back[end]:end])
        end = back[end]
    return out[::-1]


def _run_ids(pieces: Pieces):
    """Ids of runs over ``RUN`` code points, null for null."""
    ids, byte_ids, longest, unigram = dict(zip(pieces.pieces, pieces.ids)), pieces.byte_ids, pieces.longest, pieces.unigram
    rank = dict(zip(pieces.pieces, pieces.ranks))
    scored = dict(zip(pieces.pieces, pieces.scores))
    unknown = min(pieces.scores) - 10.0

    def of(run: str) -> list[int]:
        out: list[int] = []
        for x in viterbi_run(run, scored, longest, unknown) if unigram else merged_run(run, rank, longest):
            i = ids.get(x)
            out.extend([i] if i is not None else [byte_ids[b] for b in x.encode("utf-8", "surrogatepass")])
        return out

    def run(chunks):
        import pandas as pd

        return pd.Series([None if c is None else of(c) for c in chunks], dtype=object)

    return F.pandas_udf(run, "array<int>")


def encoded_chunks(chunks: DataFrame, pieces: Pieces) -> DataFrame:
    """``chunk`` (distinct) -> ``chunk, ids``.

    An edge is packed in a long: rank (16 bits), start (21), length (6), id (20); sorted, edges come by
    rank, then start. Single characters below ``SIMPLE`` and the escape sign are no edges of a BPE lattice (they are what no edge
    covers); their ids are in a constant array. A character without a piece is written as its UTF-8 bytes. An empty edge
    keeps chunks without any other. The join's piece table is broadcast: the model file bounds it. Of runs over ``RUN`` code points
    only the empty edge becomes a row; their ids, by the same rule, come from ``merged_run`` or ``viterbi_run`` in linear memory.
    """
    spark = chunks.sparkSession
    empty = spark.createDataFrame([("", 0xFFFF, 0.0, UNKNOWN, 0)], "piece string, rank long, score double, id int, len int")
    table = F.broadcast(pieces.frame(spark).union(empty).select("piece", "rank", "id"))
    # chunks stay where they are from here on: explosion, join, grouping and folds need no other shuffle
    placed = chunks.repartition(SLICES * partitions(chunks), "chunk")
    least = F.lit(1) if pieces.unigram else F.when(F.col("chunk").rlike(rf"[^\x{{0}}-\x{{{SIMPLE - 1:X}}}{SPACE}]"), 1).otherwise(2)
    long_run = F.length("chunk") > RUN
    starts = placed.select("chunk", least.alias("least"), F.explode(F.sequence(F.lit(0), F.when(long_run, 0).otherwise(F.length("chunk")))).alias("s"))
    most = F.least(F.lit(pieces.longest), F.length("chunk") - F.col("s") + 1)
    lengths = F.when(F.col("s") == 0, F.array(F.lit(0))).when(most >= F.col("least"), F.sequence(F.col("least"), most, F.lit(1))).otherwise(F.array().cast("array<int>"))
    spans = starts.select("chunk", "s", F.explode(lengths).alias("n"))
    found = spans.withColumn("piece", F.substring(F.col("chunk"), F.col("s"), F.col("n"))).join(table, "piece")
    two = lambda k: F.lit(1 << k).cast("long")
    edge = F.col("rank") * two(47) + F.greatest(F.col("s") - 1, F.lit(0)).cast("long") * two(26) + F.col("n").cast("long") * two(20) + F.col("id")
    start = lambda x: F.shiftright(x, 26).bitwiseAND(F.lit(0x1FFFFF))
    size = lambda x: F.shiftright(x, 20).bitwiseAND(F.lit(63))
    one = lambda x: x.bitwiseAND(F.lit(UNKNOWN)).cast("int")
    if not pieces.unigram:  # with the boundaries from its start to its end and those at its ends, as bits; of use up to ``MASK``
        first, bits = F.greatest(F.col("s") - 1, F.lit(0)), lambda k: F.expr(f"shiftleft({k}L, n)")
        edge = F.struct(edge.alias("edge"), F.call_function("shiftleft", bits(2) - 1, first).alias("all"), F.call_function("shiftleft", bits(1) + 1, first).alias("ends"))
    packed = (lambda x: x) if pieces.unigram else (lambda x: x["edge"])
    lattice = found.select("chunk", edge.alias("edge")).groupBy("chunk").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    if pieces.unigram:
        holes = F.filter(F.sequence(F.lit(0), F.length("chunk") - 1), lambda i: ~F.exists("edges", lambda x: (size(x) == 1) & (start(x) == i)))
        lattice = lattice.withColumn("edges", F.when(long_run, F.col("edges")).otherwise(F.concat("edges", F.transform(holes, lambda i: i.cast("long") * two(26) + F.lit((1 << 20) | UNKNOWN)))))
        short, kept = F.length("chunk") <= 400, _viterbi_fold(pieces, start, size)
    else:
        short, kept = F.length("chunk") <= MASK, _merge_fold(pieces)
        for pair in pieces.tied_pairs:  # pieces of equal rank grow from the left as they are found: the heap does that
            short &= ~F.contains("chunk", F.lit(pair))
    middle = ~short & ~long_run
    path = F.when(short, kept).when(middle, _long_path(pieces)(F.when(middle, F.length("chunk")), F.when(middle, F.transform("edges", packed))))
    by_start = F.sort_array(F.transform(path, lambda x: x.bitwiseAND(F.lit((1 << 47) - 1))))
    byte_ids, singles = listed(pieces.byte_ids).cast("array<int>"), listed(pieces.singles).cast("array<int>")
    space = dict(zip(pieces.pieces, pieces.ids)).get(SPACE, UNKNOWN)
    char = lambda x: F.substring(F.col("chunk"), (start(x) + 1).cast("int"), F.lit(1))
    known = lambda x: F.when(one(x) != UNKNOWN, one(x)).when(char(x) == SPACE, F.lit(space)).when(F.ascii(char(x)) < SIMPLE, F.element_at(singles, F.ascii(char(x)) + 1)).otherwise(F.lit(UNKNOWN))

    def spelled(x: Column) -> Column:
        own = F.filter("edges", lambda e: (size(packed(e)) == 1) & (start(packed(e)) == start(x)) & (one(packed(e)) != UNKNOWN))
        h = F.hex(F.encode(char(x), "UTF-8"))
        as_bytes = F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: F.element_at(byte_ids, F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("int") + 1))
        return F.when(known(x) != UNKNOWN, F.array(known(x))).when(F.size(own) > 0, F.transform(own, lambda e: one(packed(e)))).otherwise(as_bytes)

    paths = lattice.select("chunk", "edges", by_start.alias("path")).withColumn("ids", F.transform("path", one))
    ids = F.when(~F.array_contains("ids", UNKNOWN), F.col("ids")).otherwise(F.flatten(F.transform("path", spelled)))
    return paths.select("chunk", F.when(~long_run, ids).otherwise(_run_ids(pieces)(F.when(long_run, F.col("chunk")))).alias("ids"))


def _merge_fold(pieces: Pieces) -> Column:
    """The set of boundaries is a long; the result are the edges between neighbouring boundaries, and single
    characters that are left, with the id ``UNKNOWN`` if the constant array hasn't them."""
    join = "case when bit_count(m & x.all) = 3 and (m & x.ends) = x.ends then m ^ (m & x.all) ^ x.ends else m end"
    bounds = f"aggregate(edges, shiftleft(1L, length(chunk) + 1) - 1L, (m, x) -> {join})"
    many = f"transform(filter(edges, x -> (m & x.all) = x.ends and (x.edge & {62 << 20}L) > 0), x -> x.edge)"
    ids = f"cast(split('{','.join(map(str, pieces.singles))}', ',') as array<int>)"
    char, space = "substring(chunk, s + 1, 1)", dict(zip(pieces.pieces, pieces.ids)).get(SPACE, UNKNOWN)
    single = f"shiftleft(cast(s as bigint), 26) | {1 << 20}L | coalesce(get({ids}, ascii({char})), if({char} = '{SPACE}', {space}, {UNKNOWN}))"
    left = f"transform(filter(sequence(0, length(chunk) - 1), s -> (m & shiftleft(3L, s)) = shiftleft(3L, s)), s -> {single})"
    return F.expr(f"transform(array({bounds}), m -> concat({many}, {left}))[0]")


def _viterbi_fold(pieces: Pieces, start, size) -> Column:
    """Positions in turn: the best edge into each, from the scores at the last positions; then back from the end."""
    unknown = min(pieces.scores) - 10.0
    by_id = [unknown] * (max(pieces.ids) + 1)
    for i, s in zip(pieces.ids, pieces.scores):
        by_id[i] = s
    table = listed(by_id).cast("array<double>")
    ident = lambda x: x.bitwiseAND(F.lit(UNKNOWN)).cast("int")
    score = lambda x: F.when(ident(x) == UNKNOWN, F.lit(unknown)).otherwise(F.element_at(table, ident(x) + 1))

    def step(state: Column, end: Column) -> Column:
        into = F.filter("edges", lambda x: start(x) + size(x) == end)
        best = F.array_max(F.transform(into, lambda x: F.struct((F.element_at(state["best"], (start(x) + 1).cast("int")) + score(x)).alias("v"), (-start(x)).alias("s"), x.alias("x"))))
        return F.struct(F.concat(state["best"], F.array(best["v"])).alias("best"), F.concat(state["back"], F.array(best["x"])).alias("back"))

    empty = F.struct(F.array(F.lit(0.0)).alias("best"), F.array().cast("array<bigint>").alias("back"))
    back = F.aggregate(F.sequence(F.lit(1), F.length("chunk")), empty, step, lambda st: st["back"])

    def up(state: Column, x: Column) -> Column:
        hit = start(x) + size(x) == state["at"]
        return F.struct(F.when(hit, start(x)).otherwise(state["at"]).alias("at"), F.when(hit, F.concat(F.array(x), state["path"])).otherwise(state["path"]).alias("path"))

    last = F.struct(F.length("chunk").cast("long").alias("at"), F.array().cast("array<bigint>").alias("path"))
    return F.aggregate(F.reverse(back), last, up, lambda st: st["path"])


def _long_path(pieces: Pieces):
    unigram, scores = pieces.unigram, dict(zip(pieces.ids, pieces.scores))
    unknown = min(pieces.scores) - 10.0

    def run(lengths, edges):
        import pandas as pd

        def one(n, x):
            x = [int(v) for v in x]
            return viterbi(int(n), x, scores, unknown) if unigram else merged(int(n), x)

        return pd.Series([None if n is None or n != n else one(n, x) for n, x in zip(lengths, edges)], dtype=object)

    return F.pandas_udf(run, "array<bigint>")


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``doc_id, n_pieces, ids, text_sha256, decoded_sha256``, one row per row of ``docs`` (``doc_id, text``).

    The ids are those the model file stands for, without begin and end marks. Null and empty texts have
    no ids; null ids and repeated rows are documents like others; extra columns are not read; empty
    table: no rows. ``text_sha256`` is that of the text (null: empty; the escape sign U+2581 read as a space), to
    compare with ``decoded_sha256``, that of what ``decode`` gives back from the ids.
    """
    n = partitions(docs)
    blocks = in_blocks(docs, F.lit(True), prepared)
    pieces.chunk_pattern()  # raises if pieces reach across white space, where documents are cut into units
    pairs, spelled = pieces.pairs, pa.array([bytes.fromhex(x) for x in pieces.texts], pa.binary())

    def words(table: pa.Table) -> pa.Table:
        found = pa.chunked_array([pc.unique(unit_lists(unpack(z.as_py()))[1].flatten()) for z in table.column("z")], pa.binary())
        cut, seen = chunker(pairs), set()
        for some in in_slices(found.unique()):
            seen.update(cut(some)[0])
        rows = by_bucket(map(sendable, seen), n)
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(rows), pa.int32()), "words": pa.array([join_words(w) for _, w in rows], pa.binary())})

    sent = blocks.groupBy("block").applyInArrow(words, "bucket int, block int, words binary").repartition(n, "bucket")

    def distinct(table: pa.Table) -> pa.Table:
        seen: set[bytes] = set()
        for z in table.column("words").to_pylist():
            seen.update(split_words(z))
        return pa.table({"chunk": pa.array([w.decode("utf-8", "surrogatepass") for w in sorted(seen)], pa.string())})

    chunks = sent.groupBy("bucket").applyInArrow(distinct, "chunk string").withColumn("chunk", F.when(F.col("chunk") == NEWLINE, "\n").otherwise(F.col("chunk")))
    known = encoded_chunks(chunks, pieces).withColumn("chunk", F.when(F.col("chunk") == "\n", NEWLINE).otherwise(F.col("chunk")))
    known = known.withColumn("bucket", (F.crc32(F.encode("chunk", "UTF-8")) % n).cast("int")).repartition(n, "bucket")

    def answer(table: pa.Table, asked: pa.Table) -> pa.Table:
        lists = table.column("ids").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy()) if table.num_rows else np.zeros(0, np.int64)
        at = {c.encode("utf-8", "surrogatepass"): i for i, c in enumerate(table.column("chunk").to_pylist())}
        out = []
        for z in asked.column("words").to_pylist():
            idx = np.fromiter((at[w] for w in split_words(z)), np.int64)
            sizes = ends[idx] - np.r_[0, ends][idx]
            out.append((squeeze(gather(flat, ends[idx] - sizes, sizes).astype(np.int32)), squeeze(sizes.astype(np.int32))))
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "ids": pa.array([o[0] for o in out], pa.binary()), "sizes": pa.array([o[1] for o in out], pa.binary())})

    answers = known.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(answer, "block int, bucket int, ids binary, sizes binary").repartition(n, "block")

    def assemble(table: pa.Table, answers: pa.Table) -> pa.Table:
        import hashlib

        numbers, lists, sizes, doc_ids, shas = Numbers(), [], [], [], []
        for own, z in zip(table.column("ids"), table.column("z")):
            own, texts = own.as_py(), unpack(z.as_py())
            order, found = unit_lists(texts)
            lists.append(found.flatten())
            sizes.append(pc.list_value_length(found).to_numpy())
            for i in order:
                doc_ids.append(own[i])
                shas.append(hashlib.sha256(texts[i].replace(SPACE.encode(), b" ")[1:]).hexdigest())
        named = pa.chunked_array(lists, pa.binary()).dictionary_encode().combine_chunks()
        del lists
        rows = np.split(named.indices.to_numpy(), np.cumsum(np.concatenate(sizes))[:-1])
        cut, inside, many = chunker(pairs), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for some in in_slices(named.dictionary):
            found, each = cut(some)
            inside.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
            many.append(each)
        inside, many = np.concatenate(inside), np.concatenate(many)
        by = dict(zip(answers.column("bucket").to_pylist(), zip(answers.column("ids").to_pylist(), answers.column("sizes").to_pylist())))
        place, ids, sizes = np.zeros(len(numbers), np.int64), [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        number, at = {sendable(c): i for c, i in numbers.items()}, 0
        numbers.clear()
        for bucket, ws in by_bucket(number, n):
            place[np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))] = np.arange(at, at + len(ws))
            at += len(ws)
            ids.append(stretch(by[bucket][0], np.int32))
            sizes.append(stretch(by[bucket][1], np.int32))
        flat, sizes = np.concatenate(ids), np.concatenate(sizes).astype(np.int64)
        first = (np.cumsum(sizes) - sizes)[place] if at else place
        sizes = sizes[place] if at else place
        # from chunks to units
        flat = gather(flat, first[inside], sizes[inside])
        ends = np.r_[0, np.cumsum(sizes[inside])][np.cumsum(many)]
        first, sizes = np.r_[0, ends[:-1]].astype(np.int64), np.diff(ends, prepend=0)
        backs = []
        values = np.empty(sum(int(sizes[idx].sum()) for idx in rows), np.int32)
        offsets = np.zeros(len(rows) + 1, np.int64)
        for k, idx in enumerate(rows):
            one = gather(flat, first[idx], sizes[idx])
            offsets[k + 1] = offsets[k] + len(one)
            values[offsets[k]:offsets[k + 1]] = one
            back = spelled_out(spelled, one).replace(SPACE.encode(), b" ").removeprefix(b" ")
            backs.append(hashlib.sha256(back).hexdigest())
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_pieces": pa.array(np.diff(offsets)), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)), "text_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(backs, pa.string())})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, "doc_id long, n_pieces long, ids array<int>, text_sha256 string, decoded_sha256 string")


def sendable(chunk: str) -> bytes:
    return chunk.encode("utf-8", "surrogatepass") if chunk != "\n" else NEWLINE.encode()


def spelled_out(spelled: pa.Array, ids: np.ndarray) -> bytes:
    """Bytes of the pieces in a row."""
    if not len(ids):
        return b""
    _, ends, data = spelled.take(pa.array(ids)).buffers()
    return data[:int(np.frombuffer(ends, np.int32)[len(ids)])].to_pybytes() if data else b""


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Slices of an array, one after the other."""
    if not len(sizes):
        return flat[:0]
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)]


def decode(ids: Column, pieces: Pieces) -> Column:
    """Text of an array of ids: pieces in a row, byte pieces as bytes, the escape sign as a space, the space
    in front removed. Ids of marks give nothing; null gives null."""
    table = listed(pieces.texts)
    data = F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), ""))
    text = F.replace(F.decode(data, "UTF-8"), F.lit(SPACE), F.lit(" "))
    # bound once: the plan holds the table once
    return F.transform(F.array(text), lambda t: F.when(F.startswith(t, F.lit(" ")), F.substring(t, 2, 2**31 - 1)).otherwise(t))[0]
