"""The near-dedup stage of the pipeline against all pairs by Jaccard."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from riskloom.llm import similar


def shingles(text, words=5):
    ws = (text or "").lower().split()
    return {tuple(ws)} - {()} if len(ws) <= words else {tuple(ws[i:i + words]) for i in range(len(ws) - words + 1)}


def brute_groups(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"new{rng.integers(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    out = []
    for length in (6, 9, 30, 100, 300, 900):
        for _ in range(6):
            words = [f"w{x}" for x in rng.integers(0, 5000, length)]
            out += [" ".join(words)] + [edited(rng, words, max(1, round(length * share))) for share in (0.005, 0.015, 0.02, 0.022, 0.025, 0.03, 0.05)]
    words = [f"w{x}" for x in rng.integers(0, 5000, 150)]  # one large group, partly linked
    out += [edited(rng, words, int(n)) for n in rng.integers(1, 5, 150)]
    return out + [None, "", " \n", "a", "A", "a b", *out[:3]]


@pytest.mark.parametrize("small", [24, 3])
def test_stage_keeps_one_of_each_group_by_jaccard(spark, table, texts, small, monkeypatch):
    monkeypatch.setattr(similar, "SMALL", small)
    want = brute_groups(texts)
    docs = table(texts, parts=4)
    got = {r["doc_id"]: r["component_id"] for r in similar.groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(want))


def test_bounds_lose_nothing(texts):
    sets = [np.unique(similar.shingle_hashes(t or "", 5)) for t in texts[:200]]
    sketches = [np.frombuffer(similar.odd_sketch(s), np.uint64) for s in sets]
    for i, j in combinations(range(len(sets)), 2):
        alone = len(np.setxor1d(sets[i], sets[j]))
        assert np.bitwise_count(sketches[i] ^ sketches[j]).sum() <= alone and abs(len(sets[i]) - len(sets[j])) <= alone


def test_groups_that_share_their_smallest_id_keep_one_row_each(table):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = table([one, two, one + " end", two + " end"], [1, 1, 2, 3])
    assert sorted(r["text"] for r in similar.one_of_each(docs).collect()) == [one, two]


def test_fingerprints_are_simhashes_over_each_set_of_shingles(texts, table):
    from riskloom.llm.simhash import simhash

    rows = {r["doc_id"]: r for r in similar.signatures(table(texts[:60])).collect()}
    for i, t in enumerate(texts[:60]):
        marks = np.frombuffer(bytes(rows[i]["print"]), np.uint64)
        assert len(marks) == 4 and int(marks[0]) == simhash(np.unique(similar.shingle_hashes(t, 5)))


def test_pairs_at_the_limit_share_a_band_and_lie_in_the_radius(table):
    rng = np.random.default_rng(3)
    texts = []
    for n in (9, 18, 45, 90, 450):  # the second text ends otherwise: 8 of 10, 16 of 20, 40 of 50, ... shingles are common
        for _ in range(40):
            words = [f"w{x}" for x in rng.integers(0, 10**6, n + 4)]
            texts += [" ".join(words), " ".join(words[:n + 4 - n // 9] + [f"v{x}" for x in rng.integers(0, 10**6, n // 9)])]
    got = {r["doc_id"]: r["component_id"] for r in similar.groups(table(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]
    marks = {r["doc_id"]: np.frombuffer(bytes(r["print"]), np.uint64) for r in similar.signatures(table(texts)).collect()}
    far = lambda i, j: int(np.bitwise_count(marks[i] ^ marks[j]).sum())
    assert max(far(i, i + 1) for i in range(0, len(texts), 2)) <= similar.RADIUS < min(far(i, i + 2) for i in range(0, len(texts) - 2))
