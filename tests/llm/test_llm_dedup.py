"""Exact, line and near dedup against brute force, with odd rows."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import cuckoo, lines, simhash

ODD = [None, "", " ", "\n\n", "a", "a", "x" * 50_000, "Wörter und\tmehr", "wörter und mehr"]


def digests(n, start=0):
    return [hashlib.sha256(str(i).encode()).digest() for i in range(start, start + n)]


def test_filter_inserts_deletes_and_overflows():
    f = cuckoo.CuckooFilter(1000)
    keys = np.arange(1, 901, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    assert f.insert(keys.copy()) and f.contains(keys).all()
    other = np.arange(10_000, 40_000, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    assert f.contains(other).mean() < 0.01
    f.delete(keys[:400])
    assert f.contains(keys[400:]).all() and f.contains(keys[:400]).mean() < 0.02
    assert not f.insert(np.arange(50_000, 90_000, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def test_index_resizes_from_stored_keys_and_deletes():
    index = cuckoo.Index(16)
    d = digests(5000)
    for at in range(0, 5000, 700):
        index.insert(d[at:at + 700], [[1, i] for i in range(at, min(at + 700, 5000))], cuckoo.merge_counts)
    index.insert(d[:10], [[1, 99_999]] * 10, cuckoo.merge_counts)
    assert index.live == 5000 and index.lookup(d[:1]) == [[2, 99_999]] and index.filter.contains(index._hashes(d)).all()
    assert index.delete(d[:2500] + digests(5, 9000)) == 2500 and index.live == 2500
    assert index.lookup(d[:2500]) == [None] * 2500 and all(index.lookup(d[2500:]))
    index.insert(d[:1], [[1, 7]], cuckoo.merge_counts)
    assert index.lookup(d[:1]) == [[1, 7]]


def test_live_groups_with_deletions(spark, table):
    rows = table(["a", "b", "a", "c"]).select("doc_id", cuckoo.digest().alias("digest"), F.lit("insert").alias("op"))
    gone = table(["b", "zzz"]).select("doc_id", cuckoo.digest().alias("digest"), F.lit("delete").alias("op"))
    got = {r["group_size"]: r["keep_id"] for r in cuckoo.live_groups(rows.union(gone)).collect()}
    assert got == {2: 2, 1: 3}


def test_exact_dedup_odd_rows(table):
    texts, ids = [*ODD, "a", "a", "a"], [*range(len(ODD)), 5, None, 5]
    got = cuckoo.exact_dedup(table(texts, ids).withColumn("keep_id", F.lit("clash"))).collect()
    by = defaultdict(list)
    for t, i in zip(texts, ids):
        by[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert len(got) == len(texts)
    for h, members in by.items():
        own = [r for r in got if r["text_sha256"] == h]
        assert {r["group_size"] for r in own} == {len(members)} and {r["keep_id"] for r in own} == {max((m for m in members if m is not None), default=None)}
        assert sum(r["kept"] for r in own) == 1
    assert cuckoo.exact_dedup(table(["a"]).where("false")).count() == 0


def brute_lines(texts, ids, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for t, i in zip(texts, ids):
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    bad = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = {}
    for t, i in zip(texts, ids):
        ls = (t or "").split("\n")
        kept = [x for x in ls if bad.get(key(x), i) == i]
        out[i] = (len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("parts", [1, 8])
def test_line_dedup_against_brute_force(table, parts):
    rng = np.random.default_rng(1)
    pool = [f"line number {i} that is long enough to be counted as a passage" for i in range(30)] + ["short", "", "ÄÖ" * 20, "ÄÖ" * 19]
    hot = "THE hot line that nearly every document of the table repeats"
    texts = ["\n".join(rng.choice(pool, rng.integers(1, 12)).tolist() + ["  " + (hot if i % 2 else hot.lower()) + "\t"] * (i % 3)) for i in range(400)] + ODD
    ids = list(range(len(texts)))
    docs = table(texts, ids, parts=parts).withColumn("n_lines", F.lit("clash"))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in lines.apply_bitmaps(docs, lines.line_bitmaps(docs)).collect()}
    assert got == brute_lines(texts, ids)


def test_line_dedup_empty_and_repeated_rows(table):
    x = "a line of more than forty characters, to be dropped"
    empty = table(["a"]).where("false")
    assert lines.apply_bitmaps(empty, lines.line_bitmaps(empty)).count() == 0
    docs = table([x] * 7, [1, 2, 3, 3, 4, 4, None])
    got = lines.apply_bitmaps(docs, lines.line_bitmaps(docs, min_docs=5)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("1", ""), ("2", ""), ("3", ""), ("3", ""), ("4", x), ("4", x), ("None", "")])


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 10**9)
    for i in range(len(fps)):
        least[find(i)] = min(least[find(i)], ids[i])
    return [least[find(i)] for i in range(len(fps))]


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = set(rng.integers(0, 2**63, 300, dtype=np.uint64).tolist())
    for c, n in zip(centres, (400, 150, 60, 30, 10, 3)):
        for _ in range(n):  # balls and chains around a centre
            f = int(c)
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(5)
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.link_table(df)).collect()}
    want = brute_components(fps, list(range(len(fps))))
    by_root = defaultdict(set)
    for f, w in zip(signed, want):
        by_root[w].add(roots.get(f, f))
    assert all(len(v) == 1 for v in by_root.values()) and len({next(iter(v)) for v in by_root.values()}) == len(by_root)


def test_large_buckets_are_cut_exactly(monkeypatch):
    rng = np.random.default_rng(4)
    fps = np.unique(np.uint64(0xABCD0000) ^ (np.uint64(1) << rng.integers(32, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(32, 64, 500).astype(np.uint64)))
    monkeypatch.setattr(simhash, "SPLIT", 10)
    edges = {(int(min(a, b)), int(max(a, b))) for x, y in simhash.bucket_links(fps) for a, b in zip(x, y)}
    seen, todo = {int(fps[0])}, [int(fps[0])]
    while todo:
        f = todo.pop()
        for a, b in edges:
            for n in ({a, b} - {f} if f in (a, b) else ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
    assert len(seen) == len(fps)


def test_chain_of_links(spark):
    chain = [(1 << (3 * i)) - 1 for i in range(21)]
    df = spark.createDataFrame([(f,) for f in chain], "fp long")
    assert len({r["root"] for r in simhash.components(simhash.link_table(df)).collect()}) == 1


def test_simhash_bits():
    import xxhash

    text = "One two  THREE four\nfive one two three"
    words = text.lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.simhash(simhash.shingle_hashes(text, 3)) == want
    rng = np.random.default_rng(5)
    many = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    assert simhash.simhash(many) == sum(1 << b for b in range(64) if 2 * int(((many >> np.uint64(b)) & np.uint64(1)).sum()) > 1000)


def test_near_dedup_odd_rows(table, spark):
    rng = np.random.default_rng(6)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 200)) for _ in range(5)]
    texts = [*ODD, *base, *(b + " tail" for b in base), *base]
    got = simhash.near_dedup(table(texts, parts=4).withColumn("fp", F.lit("clash"))).collect()
    fps = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    assert len(got) == len(texts) and all(fps[i] == simhash.simhash(simhash.shingle_hashes(t or "", 3)) for i, t in enumerate(texts))
    want = brute_components([fps[i] for i in range(len(texts))], list(range(len(texts))))
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["doc_id"])] == want
    assert simhash.near_dedup(table(["a"]).where("false")).count() == 0
