"""Merkle manifest of a dataset: a tree per group, a tree over the groups' roots, proofs of all leaves.

Leaves take their places by a range-partitioned numbering. A node has ``ARITY`` children, the last one of a level fewer. A
partition of leaves is a run of ``ARITY ** STEP`` neighbours: it hashes its own interiors, and only what is above it goes on to the
next step of levels. For the proofs a partition works out the coordinates of the nodes that its leaves need and that it
cannot derive from them, asks for their union once (an octopus multiproof), derives the interiors its leaves
share, and expands each leaf's own proof from those.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.series import positions
from riskloom.llm.common import lower_ascii
from riskloom.session import checkpoint

ARITY = 8
STEP = 4
"""Levels that a partition of leaves derives on its own."""
NODE = "tree string, level int, at long, h string"


def joined(values: list[str]) -> str:
    return hashlib.sha256("".join(values).encode()).hexdigest()


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.encode(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), "UTF-8"), 256)


def height(count: int, arity: int = ARITY) -> int:
    """Levels above the leaves: every level is an ``arity``-th of the one below, until one node remains."""
    levels = 0
    while count > 1:
        count, levels = -(-count // arity), levels + 1
    return levels


def level_sizes(count: int, arity: int = ARITY) -> list[int]:
    sizes = [count]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // arity))
    return sizes


def missing(leaves: list[int], sizes: list[int], arity: int = ARITY) -> list[tuple[int, int]]:
    """Coordinates (level, place) of the fewest nodes that, with these leaves, give every node on their ways to the root."""
    out, known = [], sorted(set(leaves))
    for level, size in enumerate(sizes[:-1]):
        have, parents = set(known), sorted({k // arity for k in known})
        out += [(level, c) for p in parents for c in range(p * arity, min(size, (p + 1) * arity)) if c not in have]
        known = parents
    return out


def interiors(base: int, step: int, arity: int):
    """Nodes of the next ``step`` levels above a run of neighbours."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("at").to_numpy())
        tree, count = table.column("tree")[0].as_py(), table.column("count")[0].as_py()
        at, hs = table.column("at").to_numpy()[order], table.column("h").take(order).to_pylist()
        first, out = int(at[0]), []
        for k in range(min(step, height(count, arity))):
            hs = [joined(hs[i:i + arity]) for i in range(0, len(hs), arity)]
            first //= arity
            count = -(-count // arity)
            out += [(base + k + 1, first + i, h, count) for i, h in enumerate(hs)]
        return pa.table({
            "tree": pa.array([tree] * len(out), pa.string()), "level": pa.array([o[0] for o in out], pa.int32()), "at": pa.array([o[1] for o in out], pa.int64()),
            "h": pa.array([o[2] for o in out], pa.string()), "count": pa.array([o[3] for o in out], pa.int64()),
        })

    return run


def climb(nodes: DataFrame, step: int = STEP, arity: int = ARITY) -> DataFrame:
    """All nodes of the trees whose leaves are ``nodes`` (tree, at, h, count: leaves of the tree): ``tree, level, at, h``, in steps of
    ``step`` levels; each step shuffles what the last one left, a ``arity ** step``-th."""
    span = arity**step
    done, level, rows = [], 0, nodes
    while not rows.isEmpty():

        up = rows.where("count > 1").withColumn("run", F.floor(F.col("at") / span)).groupBy("tree", "run").applyInArrow(interiors(level, step, arity), NODE + ", count long")
        up = checkpoint(up)
        done.append(up.drop("count"))
        level += step
        rows = up.where((F.col("level") == level) & (F.col("count") > 1)).select("tree", "at", "h", "count")
    out = nodes.select("tree", F.lit(0).alias("level"), "at", "h")
    for d in done:
        out = out.union(d)
    return out


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings array<array<string>>, place array<int>"


def prove(leaves: DataFrame, nodes: DataFrame, groups: DataFrame, step: int = STEP, arity: int = ARITY) -> DataFrame:
    """Proofs of ``leaves`` (tree, at, doc_id, leaf, shown: the leaf to fold, null for its own) under ``nodes``, whose tree of groups is
    named null; ``groups``: ``tree, count, place, trees`` (leaves of the group, its place among the groups, their number)."""
    span = arity**step
    runs = groups.select("tree", "count", "place", "trees", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / span))).alias("run"))

    def ask(batches):
        for b in batches:
            out: list[tuple] = []
            for tree, count, place, trees, run in zip(*(b.column(c).to_pylist() for c in ("tree", "count", "place", "trees", "run"))):
                own = list(range(run * span, min(count, (run + 1) * span)))
                out += [(tree, run, tree, level, at) for level, at in missing(own, level_sizes(count, arity), arity)]
                out += [(tree, run, None, level, at) for level, at in missing([place], level_sizes(trees, arity), arity)]
            if out:
                cols = list(zip(*out))
                yield pa.record_batch({"tree": pa.array(cols[0], pa.string()), "run": pa.array(cols[1], pa.int64()), "of": pa.array(cols[2], pa.string()), "level": pa.array(cols[3], pa.int32()), "at": pa.array(cols[4], pa.int64())})

    wanted = runs.mapInArrow(ask, "tree string, run long, of string, level int, at long")
    right = nodes.select(F.col("tree").alias("of"), "level", "at", "h").alias("n")
    fetched = wanted.alias("w").join(right, F.col("w.of").eqNullSafe(F.col("n.of")) & (F.col("w.level") == F.col("n.level")) & (F.col("w.at") == F.col("n.at")))
    fetched = fetched.select("w.tree", "w.run", F.col("w.of").isNull().alias("above"), "w.level", "w.at", "n.h")
    rows = leaves.join(groups, "tree").withColumn("run", F.floor(F.col("at") / span))

    def fold(table: pa.Table, extra: pa.Table) -> pa.Table:
        order = np.argsort(table.column("at").to_numpy())
        at = table.column("at").to_numpy()[order].tolist()
        doc, own, shown = (table.column(c).take(order).to_pylist() for c in ("doc_id", "leaf", "shown"))
        count, place, trees = (table.column(c)[0].as_py() for c in ("count", "place", "trees"))
        sizes, above = level_sizes(count, arity), level_sizes(trees, arity)
        known = {(a, level, i): h for a, level, i, h in zip(*(extra.column(c).to_pylist() for c in ("above", "level", "at", "h")))}
        known.update(((False, 0, i), h) for i, h in zip(at, own))
        # shared interiors, from the leaves up: every node on a way is derived once
        way = at
        for level, size in enumerate(sizes[:-1]):
            way = sorted({i // arity for i in way})
            known.update(((False, level + 1, p), joined([known[False, level, c] for c in range(p * arity, min(size, (p + 1) * arity))])) for p in way)
        subroot = known[False, len(sizes) - 1, 0]
        known[True, 0, place] = subroot
        up = place
        for level, size in enumerate(above[:-1]):
            up //= arity
            known[True, level + 1, up] = joined([known[True, level, c] for c in range(up * arity, min(size, (up + 1) * arity))])
        root = known[True, len(above) - 1, 0]
        steps = [(False, level, size) for level, size in enumerate(sizes[:-1])] + [(True, level, size) for level, size in enumerate(above[:-1])]
        out: list[tuple] = []
        shared: dict[int, tuple] = {}  # what leaves under one node of the first level share: the rest of their proof
        for i, d, h, s in zip(at, doc, own, shown):
            key = i // arity
            if key not in shared:
                rest, j = [], i
                for n, (a, level, size) in enumerate(steps):
                    if n == len(sizes) - 1:
                        j = place
                    if n or a:
                        run = range(j // arity * arity, min(size, (j // arity + 1) * arity))
                        rest.append((j % arity, [known[a, level, c] for c in run if c != j]))
                    j //= arity
                shared[key] = rest
            proof = list(shared[key])
            if len(sizes) > 1:
                proof.insert(0, (i % arity, [known[False, 0, c] for c in range(key * arity, min(count, (key + 1) * arity)) if c != i]))
            x = s or h
            for where, siblings in proof:
                x = joined([*siblings[:where], x, *siblings[where:]])
            out.append((d, h, subroot, root, joined([v for _, siblings in proof for v in siblings]), x, x == root, [siblings for _, siblings in proof], [where for where, _ in proof]))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.list_(pa.string())), pa.list_(pa.int32())]
        names = [c.split()[0] for c in PROOF.split(", ")]
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(names, zip(*out), kinds)} if out else {name: pa.array([], kind) for name, kind in zip(names, kinds)})

    return rows.groupBy("tree", "run").cogroup(fetched.groupBy("tree", "run")).applyInArrow(fold, PROOF)


def manifest(docs: DataFrame, tampered: Column | None = None, text_shown: Column | None = None, step: int = STEP, arity: int = ARITY) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, siblings, place``, a row per row of ``docs``.

    ``docs`` has ``doc_id, source, lang, n_chars, text``; extra columns are not read. A leaf is the SHA-256 of these fields. Groups are the
    values of ``lang`` (null: a group of its own, the first); leaves ascend by doc_id (null first; rows that repeat one by leaf).
    ``siblings`` and ``place`` are the proof, level by level; ``proof_sha256`` hashes it. Where ``tampered`` holds, the
    proof is folded from the leaf of ``text_shown`` instead of the text; ``verified`` says whether the fold meets the root. Empty
    table: no rows.
    """
    source, lang, n_chars, text = (F.col(c) for c in ("source", "lang", "n_chars", "text"))
    made = leaf(F.col("doc_id"), source, lang, n_chars, text)
    shown = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf(F.col("doc_id"), source, lang, n_chars, text_shown))
    # a null group sorts first and has no sign in front; ``row`` splits rows that are equal in all else
    tree = F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))
    slim = checkpoint(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), made.alias("leaf"), shown.alias("shown"), F.monotonically_increasing_id().alias("row")))
    leaves = checkpoint(positions(slim, ["tree"], ["doc_id", "leaf", "row"], "at").drop("row"))
    counts = checkpoint(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("count")))
    trees = counts.count()
    groups = checkpoint(positions(counts.withColumn("all", F.lit(0)), ["all"], ["tree"], "place").drop("all").withColumn("trees", F.lit(trees).cast("long")))
    own = checkpoint(climb(leaves.join(counts, "tree").select("tree", "at", F.col("leaf").alias("h"), "count"), step, arity))
    tops = own.join(groups, "tree").groupBy("tree", "place", "trees").agg(F.max_by("h", "level").alias("h"))
    above = climb(checkpoint(tops.select(F.lit("").alias("tree"), F.col("place").alias("at"), "h", F.col("trees").alias("count"))), step, arity)
    nodes = own.unionByName(above.withColumn("tree", F.lit(None).cast("string")))
    return prove(leaves, nodes, groups, step, arity)
