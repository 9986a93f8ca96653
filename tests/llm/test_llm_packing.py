"""Packing: every id once, gapless sequences, little padding; the fit against its optimality conditions."""

import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import packing
from riskloom.llm.words import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, ids, window, wasted):
    """``rows`` are pieces with ids; repeated ids are told apart by nothing, so the test gives each row its own."""
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for i, t in zip(ids, texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == want and [r["start"] for r in own] == list(np.cumsum([0, *[r["length"] for r in own]])[:-1])
        for r in own:
            assert r["length"] == len(r["ids"]) > 0 and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(np.cumsum([0, *[r["length"] for r in own]])[:-1])
        total = sum(r["length"] for r in own)
        assert total <= window
        padding += 0 if total & (total - 1) == 0 else window - total
    assert padding <= wasted * sum(r["length"] for r in rows)
    assert sorted(by_seq) == list(range(len(by_seq)))
    return by_seq


@pytest.mark.parametrize("seed,window,width,depth", [(0, 256, 8, 3), (1, 128, 16, 4), (2, 4096, 16, 4)])
def test_pieces(table, seed, window, width, depth):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "Straße", "don't", "été,", "x1", "<|endoftext|>", "unbelievable", "你好", "a.b"]
    sizes = np.r_[rng.integers(0, 60, 150), rng.integers(60, 900, 20), [4000]]
    texts = [None, "", " \n\t", "a", *[" ".join(rng.choice(words, n)) for n in sizes], *["one hot text"] * 60]
    rows = packing.pack(table(texts).withColumn("n", F.lit("clash")).withColumn("part", F.lit(1)), window=window, width=width, depth=depth, ids=True).collect()
    check(rows, texts, list(range(len(texts))), window, 0.01)


def test_many_like_lengths_use_the_combinations(table):
    rng = np.random.default_rng(4)
    texts = [" ".join(["the"] * int(n)) for n in rng.integers(10, 250, 1500)]
    rows = packing.pack(table(texts), window=256, width=8, depth=3, ids=True).collect()
    by_seq = check(rows, texts, list(range(len(texts))), 256, 0.005)
    cut = sum(r["length"] < r["doc_tokens"] for r in rows if r["start"] == 0)
    assert cut < 0.25 * len(texts) and len(by_seq) <= 1.01 * sum(len(r["ids"]) for r in rows) / 256 + 9


def test_null_and_repeated_ids_and_empty(table):
    rows = packing.pack(table(["a b", "a b", "c", None], ids=[None, 7, 7, 7], parts=2), window=256).collect()
    assert sorted((r["doc_id"] is None, r["doc_tokens"]) for r in rows) == [(False, 1), (False, 2), (False, 3), (True, 3)]
    assert packing.pack(table(["a"]).where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(table(["a"]), window=100)


def test_running_sums_by_runs(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, int(v)) for k in "ab" for i, v in enumerate(rng.integers(0, 9, 300))]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(5)
    for top, fan in ((300, 12), (300, 3), (300, 2)):
        got = {(r["k"], r["at"]): r["s"] for r in packing.before(df, ["k"], "at", "v", "s", top, fan).collect()}
        for k in "ab":
            v = [x for q, _, x in rows if q == k]
            assert [got[k, i] for i in range(300)] == [0, *np.cumsum(v)[:-1].tolist()]


def test_reruns_agree(table):
    docs = table([f"text {i} " * (i % 50) for i in range(100)])
    assert sorted(packing.pack(docs, window=128).collect()) == sorted(packing.pack(docs, window=128).collect())


def test_combinations_are_all_of_them():
    got = {tuple(r[r > 0]) for r in packing.combinations(12, 4)}
    want = {tuple(sorted(c, reverse=True)) for k in (1, 2, 3, 4) for c in combinations_with_replacement(range(1, 13), k) if sum(c) == 12}
    assert got == want and len(packing.combinations(12, 4)) == len(want)


@pytest.mark.parametrize("seed", range(4))
def test_nnls_is_optimal(seed):
    """x >= 0, no gradient downhill, none where x > 0: the conditions that only the optimum meets."""
    rng = np.random.default_rng(seed)
    n = 24
    columns = packing.combinations(n, 3)
    target, weight = rng.integers(0, 200, n).astype(float), rng.uniform(0.1, 1, n)
    x = packing.nnls(columns, target, weight)
    a = np.zeros((n + 1, len(columns)))
    for k in range(columns.shape[1]):
        np.add.at(a, (columns[:, k], np.arange(len(columns))), 1.0)
    a = a[1:]
    gradient = a.T @ (weight**2 * (target - a @ x))
    assert (x >= 0).all() and gradient.max() < 1e-5 * target.sum() and np.abs(gradient[x > 1e-9]).max() < 1e-5 * target.sum()


def test_plan_fills_no_more_than_there_is():
    rng = np.random.default_rng(3)
    histogram = {int(c): (int(n), int(n) * int(c) * 8 - int(n) * 3) for c, n in zip(range(1, 33), rng.integers(0, 500, 32))}
    plan = packing.solve(histogram, 32, 8, 3)
    used = np.bincount(plan.combos.ravel(), np.repeat(plan.repeats, 3), 33)[1:]
    assert plan.sequences > 0 and all(u <= histogram[c][0] for c, u in enumerate(used, 1)) and (plan.combos.sum(1) == 32).all()
    classes = np.repeat(np.arange(1, 33), [histogram[c][0] for c in range(1, 33)])
    rank = np.concatenate([np.arange(histogram[c][0]) for c in range(1, 33)])
    seq, slot = plan.place(classes, rank)
    assert len(set(zip(seq[seq >= 0], slot[seq >= 0]))) == (seq >= 0).sum() == used.sum()


def test_words_equal_the_tokenizer():
    rng = np.random.default_rng(0)
    import pyarrow as pa

    signs = list("abcAB  \n\t'.,!?<|>12éßÄ你́ \x1c\x85 İıſ²½\x00-") + ["<|endoftext|>", "<|ENDOFTEXT|>", "word.", "x,", "'s", "'ll", "don't", " "]
    texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(5000)] + ["w" * 5000, "a b " * 20_000]
    coder = WordIds(PATH)
    ids, at = coder.encode(pa.array(texts))
    for i, e in enumerate(coder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i]:at[i + 1]].tolist() == e.ids, texts[i]
