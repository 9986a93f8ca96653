"""Phrases against counting in plain Python; the trie against a counter."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import collocations, hattrie

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, longest, top):
    count, words = {}, Counter()
    for lang, text in rows:
        f = count.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words["und" if lang is None else lang] += len(ws)
            for m in range(1, longest + 1):
                f.update(tuple(ws[i:i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in candidates.items():
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in candidates.items()):
                kept.append((-score, -a, " ".join(p).encode(), a, l, r))
        for k, (s, _, p, a, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, k, p.decode(), a, l, r, words[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("seed,memory", [(0, None), (1, 500)])
def test_phrases_equal_counting(spark, seed, memory, monkeypatch):
    if memory:  # pickled by value, so the small sizes reach the workers
        monkeypatch.setattr(hattrie, "BURST", 60)
        monkeypatch.setattr(collocations, "CHUNK", 3000)
        monkeypatch.setattr(collocations, "BLOCK_BYTES", 5000)
    rng = np.random.default_rng(seed)
    words = ["The", "the", "of", "Straße", "É", "é", "x-y", "a", "b", "c", " ", "\x00"] + [f"w{i}" for i in range(30)]
    p = 1 / np.arange(1, len(words) + 1)
    glue = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", " \r\n", "!? "]
    rows = []
    for i in range(400):
        text = "".join(w + g for w, g in zip(rng.choice(words, 40, p=p / p.sum()), rng.choice(glue, 40)))
        rows.append((i, [None, "en", "en", "de", "und", "a\nb\\"][i % 6], text))
    rows += [(None, "en", None), (1, "en", ""), (1, None, " . "), (5, "en", "new york city " * 3000)] + [(7, "de", "hot pair here now")] * 200
    docs = spark.createDataFrame([(i, t, lang) for i, lang, t in rows], "doc_id long, text string, lang string").repartition(5).withColumn("ids", F.lit("x")).withColumn("count", F.lit(1))
    got = collocations.collocations(docs, least=20, top=60, memory=memory).collect()
    assert sorted(tuple(r) for r in got) == brute([(lang, t) for _, lang, t in rows], 20, 4, 60)


def test_empty(table):
    assert collocations.collocations(table(["a b"]).where("false")).count() == 0
    assert collocations.collocations(table([None, "", "a b c"])).count() == 0


def test_large_counts_are_exact(spark):
    """The score of counts beyond what a product of 64 bits holds."""
    a, l, r = 4 * 10**17, 5 * 10**17, 7 * 10**17 + 1
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as s").first()
    assert row["s"] == 2000000 * a // (l + r)


@pytest.mark.parametrize("memory", [200, 10**6])
def test_trie_equals_a_counter(memory, monkeypatch):
    monkeypatch.setattr(hattrie, "BURST", 100)
    rng = np.random.default_rng(2)
    runs, want = [], Counter()
    trie = hattrie.HatTrie(lambda hi, lo, n: runs.append((hi, lo, n)), memory)
    for _ in range(30):
        hi = (np.minimum(rng.zipf(1.5, 400), 50).astype(np.uint64) << np.uint64(32)) | rng.integers(1, 90, 400).astype(np.uint64)
        lo = rng.integers(0, 6, 400).astype(np.uint64)
        trie.add(hi, lo)
        want.update(zip(hi.tolist(), lo.tolist()))
    assert any(c.children for c in trie.roots) or memory == 200
    trie.close()
    for hi, lo, _ in runs:
        pairs = list(zip(hi.tolist(), lo.tolist()))
        assert pairs == sorted(set(pairs))
    assert len(runs) > (9 if memory == 200 else 0)
    hi, lo, n = hattrie.merged(runs)
    assert dict(zip(zip(hi.tolist(), lo.tolist()), n.tolist())) == dict(want)
