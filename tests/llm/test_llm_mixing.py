from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3.0):
    """Share by weight; cap; share the excess again until nobody is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = {s for s in free if share[s] >= cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_taken(table):
    rng = np.random.default_rng(0)
    names = ["b", "a", None, "ü", "tiny", "none"]
    sources = [names[i] for i in rng.choice(5, 3000, p=[0.5, 0.2, 0.1, 0.15, 0.05])] + ["none", "none"]
    texts = ["w " * int(rng.integers(0, 60)) for _ in range(3000)] + ["", None]
    docs = table(texts, sources=sources).withColumn("size", mixing.size_of("text")).withColumn("target", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] is not None
    want = brute_targets(sizes)
    assert {s: round(v, 6) for s, v in target.items()} == {s: round(v, 6) for s, v in want.items()}
    assert all(abs(taken[s] - target[s]) <= 120 for s in target)
    assert sum(r["copies"] for r in got) == mixing.emit(mixing.mix(docs)).count()


def test_reruns_and_partitions_agree(table):
    texts = [f"{'w ' * (i % 7)}" for i in range(500)]
    rows = [mixing.mix(table(texts, sources=[f"s{i % 3}" for i in range(500)], parts=p).withColumn("size", mixing.size_of("text"))).select("doc_id", "taken").orderBy("doc_id").collect() for p in (1, 7)]
    assert rows[0] == rows[1]


def test_empty_null_ids_and_repeats(table):
    sized = lambda t: t.withColumn("size", mixing.size_of("text"))
    assert mixing.mix(sized(table(["a"]).where("false"))).count() == 0
    got = mixing.mix(sized(table(["a b", "a b", None, "c"], [None, 1, 1, 1], sources=["s"] * 4))).collect()
    assert len(got) == 4 and sum(r["size"] for r in got) == 5 and {r["target"] for r in got} == {5.0}
