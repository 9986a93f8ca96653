"""Phrases of two to four words that stick together, per language.

Documents are dealt to blocks. A block first asks for its words: a word below the least count cannot be in a candidate and becomes a
gap; the others have numbers. Then it counts the sequences of two to four numbers between gaps in a HAT-trie (``hattrie``) that spills
sorted runs, which are merged per prefix partition. What reaches the least count goes on as rows: cuts are joined to their
parts, and phrases inside a longer one that is about as frequent are dropped.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.blocks import Numbers, by_bucket, in_blocks, join_words, split_words, squeeze, stretch, unpack
from riskloom.llm.common import partitions, whole
from riskloom.llm.hattrie import HatTrie, digits, merged
from riskloom.session import checkpoint

LEAST = 30
LONGEST = 4
TOP = 2000
BREAKS = b".,;:!?\n\x0b\x0c\r"
GAP = b"\n"
CHUNK = 4_000_000
BLOCK_BYTES = 12_000_000
PARTITION_WORDS = 2_000_000
TO_GAPS = bytes.maketrans(BREAKS + b"\t", b"\n" * len(BREAKS) + b" ")
MARK = b"\x0b"
"""Between language and word: no word has it."""
KINDS = "kind int, block int, bucket int, z binary, lang string, word string, id long, count long"


def named(lang: bytes) -> bytes:
    return lang.replace(b"\\", b"\\\\").replace(b"\n", b"\\n")


def unnamed(lang: bytes) -> str:
    return lang.decode().replace("\\\\", "\0").replace("\\n", "\n").replace("\0", "\\")


def with_lang(lang: Column, text: Column) -> Column:
    """Language and text in one string, to be taken apart by ``by_lang``."""
    return F.concat(F.octet_length(lang).cast("string"), F.lit(":"), lang, text)


def by_lang(packs: list[bytes]) -> dict[bytes, list[bytes]]:
    """Texts of a block by language, in chunks of about ``CHUNK`` bytes; documents, pieces and gaps are set apart by gaps."""
    held: dict[bytes, list[list[bytes]]] = {}
    sizes: Counter[bytes] = Counter()
    for z in packs:
        for data in unpack(z):
            n, _, rest = data.partition(b":")
            lang, text = named(rest[:int(n)]), rest[int(n):]
            if sizes[lang] % CHUNK + len(text) >= CHUNK or lang not in held:
                held.setdefault(lang, []).append([])
            sizes[lang] += len(text)
            held[lang][-1].append(text.lower().translate(TO_GAPS))
    return {lang: [GAP.join(c).replace(GAP, b" \n ") for c in chunks] for lang, chunks in sorted(held.items())}


def coded(chunk: bytes) -> tuple[np.ndarray, list[str]]:
    """Numbers of the words of a chunk in order, and the words; gaps are a word, too."""
    lists = pc.split_pattern(pa.array([chunk.decode("utf-8", "surrogatepass")], pa.large_string()), " ")
    words = lists.flatten().dictionary_encode()
    return words.indices.to_numpy(), words.dictionary.to_pylist()


def word_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """What each block sends of its words: ``bucket, block, words, counts``."""

    def run(table: pa.Table) -> pa.Table:
        counts: Counter[bytes] = Counter()
        for lang, chunks in by_lang(table.column("z").to_pylist()).items():
            for chunk in chunks:
                codes, words = coded(chunk)
                for w, n in zip(words, np.bincount(codes, minlength=len(words)).tolist()):
                    if w not in ("", "\n"):
                        counts[lang + MARK + w.encode("utf-8", "surrogatepass")] += n
        rows = [(b, join_words(ws), squeeze(np.array([counts[w] for w in ws], np.int64))) for b, ws in by_bucket(counts, buckets)]
        block = table.column("block")[0].as_py()
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()),
            "words": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary()),
        })

    return blocks.groupBy("block").applyInArrow(run, "bucket int, block int, words binary, counts binary")


def numbered(sent: DataFrame, buckets: int, least: int) -> DataFrame:
    """Rows of a bucket. Kind 0: numbers of a block's words in the order it sent them, 0 for a rare word. Kind 1: a word with its
    number and count. Kind 2: words of a language."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        lists = [split_words(z) for z in table.column("words").to_pylist()]
        at: dict[bytes, int] = {}
        idx = [np.fromiter((at.setdefault(w, len(at)) for w in ws), np.int64, len(ws)) for ws in lists]
        total = np.zeros(len(at), np.int64)
        for i, z in zip(idx, table.column("counts").to_pylist()):
            total[i] += stretch(z, np.int64)
        words = list(at)
        often = np.array(sorted(np.flatnonzero(total >= least).tolist(), key=words.__getitem__), np.int64)
        number = np.zeros(len(at), np.int64)
        number[often] = bucket + 1 + buckets * np.arange(len(often))
        if len(often) and int(number.max()) >= 1 << 32:
            raise ValueError("over 2^32 words reach the least count")
        rows: list[tuple] = [(0, b, bucket, squeeze(number[i]), None, None, None, None) for b, i in zip(table.column("block").to_pylist(), idx)]
        langs: Counter[bytes] = Counter()
        for w, n in zip(words, total.tolist()):
            langs[w.rpartition(MARK)[0]] += n
        for i in often.tolist():
            lang, _, w = words[i].rpartition(MARK)
            rows.append((1, -1, bucket, None, unnamed(lang), w.decode("utf-8", "surrogatepass"), int(number[i]), int(total[i])))
        rows += [(2, -1, bucket, None, unnamed(lang), None, None, n) for lang, n in langs.items()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.table({c.split()[0]: pa.array(v, k) for c, v, k in zip(KINDS.split(", "), zip(*rows), kinds)})

    return sent.groupBy("bucket").applyInArrow(run, KINDS)


def sequences(ids: np.ndarray, longest: int):
    """``hi, lo`` of every run of 2 to ``longest`` numbers without a gap (0)."""
    shift = np.uint64(32)
    zero = np.zeros(len(ids), np.uint64)
    ahead = [np.r_[ids[k:], zero[:k]] for k in range(LONGEST)]
    ok = ids > 0
    for k in range(1, longest):
        ok = ok & (ahead[k] > 0)
        at = np.flatnonzero(ok)
        third = ahead[2][at] if k > 1 else zero[at]
        fourth = ahead[3][at] if k > 2 else zero[at]
        yield (ahead[0][at] << shift) | ahead[1][at], (third << shift) | fourth


def runs_of(blocks: DataFrame, answers: DataFrame, buckets: int, parts: int, longest: int, memory: int | None) -> DataFrame:
    """``part, hi, lo, n``: sorted runs of sequences (packed), by prefix partition."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        by = dict(zip(told.column("bucket").to_pylist(), told.column("z").to_pylist()))
        numbers, chunks = Numbers(), []
        for lang, cs in by_lang(table.column("z").to_pylist()).items():
            for c in cs:
                codes, words = coded(c)
                own = np.array([-1 if w == "\n" else -2 if w == "" else numbers[lang + MARK + w.encode("utf-8", "surrogatepass")] for w in words], np.int32)[codes]
                chunks.append(own[own > -2])
        number = np.zeros(len(numbers) + 1, np.uint64)  # the last one for gaps
        for bucket, ws in by_bucket(numbers, buckets):
            number[np.fromiter(map(numbers.__getitem__, ws), np.int64, len(ws))] = stretch(by[bucket], np.int64).astype(np.uint64)
        numbers.clear()
        out: list[tuple] = []

        def spill(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> None:
            part = digits(hi, parts).astype(np.int64)
            order = np.argsort(part, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                # ascending numbers differ by little, so their differences are short
                out.append((int(part[at[0]]), squeeze(np.diff(hi[at], prepend=np.uint64(0))), squeeze(lo[at]), squeeze(n[at])))

        trie = HatTrie(spill, **({"memory": memory} if memory else {}))
        for chunk in chunks:
            for hi, lo in sequences(number[chunk], longest):
                trie.add(hi, lo)
        trie.close()
        cols = list(zip(*out)) or [[]] * 4
        return pa.table({"part": pa.array(cols[0], pa.int32()), "hi": pa.array(cols[1], pa.binary()), "lo": pa.array(cols[2], pa.binary()), "n": pa.array(cols[3], pa.binary())})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "part int, hi binary, lo binary, n binary")


def frequent(runs: DataFrame, least: int) -> DataFrame:
    """``ids, a`` of the sequences whose runs add up to ``least``."""

    def run(table: pa.Table) -> pa.Table:
        hi, lo, n = merged([(np.cumsum(stretch(h, np.uint64)), stretch(x, np.uint64), stretch(c, np.int64)) for h, x, c in zip(*(table.column(c).to_pylist() for c in ("hi", "lo", "n")))])
        keep = n >= least
        hi, lo, n = hi[keep], lo[keep], n[keep]
        words = np.stack([hi >> np.uint64(32), hi & np.uint64(0xFFFFFFFF), lo >> np.uint64(32), lo & np.uint64(0xFFFFFFFF)], 1).astype(np.int64)
        return pa.table({"ids": pa.array([[int(x) for x in w if x] for w in words], pa.list_(pa.int64())), "a": pa.array(n, pa.int64())})

    return runs.groupBy("part").applyInArrow(run, "ids array<long>, a long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, memory: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language (null: all).

    Texts (null: empty) have A-Z lower-cased, are split at ``.,;:!?`` and line ends into pieces and those at spaces and tabs into
    words. ``a`` is how often a phrase of 2 to ``longest`` words occurs (``least`` or more), ``n`` the words of the language (null language:
    ``und``). A cut behind the first k words gives ``l`` and ``r``, how often both parts occur, and the score ``floor(2000000 a / (l + r))``; the
    cut with the lowest score counts, the first of equals. Phrases inside a longer candidate with four fifths of their count
    are dropped. Ties in score go by ``a``, then by the phrase's bytes. Repeated rows count as often as they occur; null ids
    are rows like others; extra columns are not read; empty table: no rows. Products are taken in 38 digits.
    """
    rows = docs.select("doc_id", with_lang(F.coalesce(F.col("lang").cast("string"), F.lit("und")), whole("text")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    buckets = max(partitions(docs), math.ceil(size / BLOCK_BYTES))
    blocks = in_blocks(rows, F.lit(True), lambda t: t.encode("utf-8", "surrogatepass"), blocks=buckets)
    told = checkpoint(numbered(word_counts(blocks, buckets), buckets, least))
    totals = told.where("kind = 2").groupBy("lang").agg(F.sum("count").alias("n"))
    parts = max(partitions(docs), math.ceil((told.where("kind = 2").agg(F.sum("count").alias("s")).first()["s"] or 0) / PARTITION_WORDS))
    runs = runs_of(blocks, told.where("kind = 0").select("block", "bucket", "z"), buckets, parts, longest, memory)
    found = checkpoint(frequent(runs.repartition(parts, "part"), least))
    words = told.where("kind = 1").select("id", "lang", "word", "count")
    counts = found.union(words.select(F.array("id"), "count"))
    size = F.size("ids")
    cuts = found.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("right"))
    cuts = cuts.join(counts.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left").join(counts.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right")
    score = F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("ids", "a", "b.score", "b.l", "b.r")
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ids", i, m)))))
    longer = found.where(size > 2).select(inner.alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))
    inside = F.expr("cast(100 as decimal(3,0)) * cast(longer as decimal(20,0)) >= cast(80 as decimal(3,0)) * cast(a as decimal(20,0))")
    kept = best.join(longer, "ids", "left").where(~F.coalesce(inside, F.lit(False)))
    spelled = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(words, "id").groupBy("ids").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = kept.join(spelled, "ids").join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
