"""Manifest against a tree built in plain Python; the multiproof's coordinates against all subsets."""

import hashlib
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from riskloom.llm import merkle


LOWER = {c: c + 32 for c in range(65, 91)}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [row[0], row[3], row[2], row[4], text]
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(hs, arity):
    out = [hs]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def siblings(tree, at, arity):
    out = []
    for level in tree[:-1]:
        lo = at // arity * arity
        out.append((at - lo, [h for i, h in enumerate(level[lo:lo + arity], lo) if i != at]))
        at //= arity
    return out


def brute(rows, altered, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        made[g] = own, levels([leaf(r, r[1]) for r in own], arity)
    above = levels([made[g][1][-1][0] for g in order], arity)
    out = []
    for k, g in enumerate(order):
        own, tree = made[g]
        for i, r in enumerate(own):
            proof = siblings(tree, i, arity) + siblings(above, k, arity)
            x = leaf(r, r[1].translate(LOWER) if altered(r[0]) and r[1] is not None else r[1])
            for at, s in proof:
                x = sha(*s[:at], x, *s[at:])
            out.append((r[0], tree[0][i], tree[-1][0], above[-1][0], sha(*(h for _, s in proof for h in s)), x, x == above[-1][0]))
    return out


def text_key(row):
    return tuple(map(str, row))


@pytest.mark.parametrize("arity,step,n", [(8, 4, 150), (2, 2, 37), (8, 1, 90), (3, 2, 1)])
def test_manifest_equals_a_tree_in_memory(spark, arity, step, n):
    langs = ["en"] * 6 + ["de", None, "Ä", "zz", "e"] + [f"x{k}" for k in range(6)]
    rows = [(i if i % 11 else None, None if i % 13 == 5 else f"Text {i} É\n" * (i % 4), langs[i * 7 % len(langs)], f"s{i % 3}" if i % 5 else None, i if i % 6 else None) for i in range(n)]
    rows += rows[:3] + [(1, "A" * 200_000, "en", "", 0)] * (n > 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).withColumns({"tree": F.lit(1), "at": F.lit("x")})
    got = merkle.manifest(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0, merkle.lower_ascii(F.col("text")), step, arity)
    want = brute([(r[0], r[1], r[2], r[3], r[4]) for r in rows], lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 0, arity)
    got = [tuple(r)[:7] for r in got.collect()]
    assert sorted(map(text_key, got)) == sorted(map(text_key, want))


def test_proofs_stand_alone(table):
    """Each expanded proof folds to the root with nothing but the leaf."""
    docs = table([f"text {i}" for i in range(100)], langs=["en", "de", None, "fr"] * 25)
    for r in merkle.manifest(docs).collect():
        x = r["leaf"]
        for at, own in zip(r["place"], r["siblings"]):
            x = sha(*own[:at], x, *own[at:])
        assert x == r["root"] == r["folded_root"] and r["verified"]
        assert r["proof_sha256"] == sha(*(h for s in r["siblings"] for h in s))


def test_order_of_rows_and_partitions_does_not_matter(table):
    texts, langs = [f"t{i}" for i in range(60)], ["a", "b"] * 30
    one = merkle.manifest(table(texts, langs=langs, parts=1)).collect()
    two = merkle.manifest(table(texts, langs=langs, parts=7)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_empty_and_single(table):
    assert merkle.manifest(table(["a"]).where("false")).count() == 0
    (r,) = merkle.manifest(table([None])).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == sha() and r["siblings"] == []


@pytest.mark.parametrize("count", [1, 2, 7, 9])
def test_missing_is_minimal(count):
    """With the named nodes all ways close, and without any one of them some does not."""
    sizes = merkle.level_sizes(count, 3)

    def closes(known):
        known = set(known)
        for level, size in enumerate(sizes[:-1]):
            for p in range(sizes[level + 1]):
                if all((level, c) in known for c in range(p * 3, min(size, p * 3 + 3))):
                    known.add((level + 1, p))
        return (len(sizes) - 1, 0) in known

    for k in range(1, count + 1):
        for own in combinations(range(count), k):
            extra = merkle.missing(list(own), sizes, 3)
            leaves = {(0, i) for i in own}
            assert closes(leaves | set(extra)) and not any(closes((leaves | set(extra)) - {x}) for x in extra)
