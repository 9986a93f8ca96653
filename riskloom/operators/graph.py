"""Correlation graph features, one graph per snapshot day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.series import SYMBOL_DAY, Series
from riskloom.session import checkpoint

# Fixed values.
SPAN = 60
EDGE_CUT = 0.3
SYMBOL_BLOCK = 64


def aligned_returns(df: DataFrame, ret: str = "Returns", s: Series = SYMBOL_DAY) -> DataFrame:
    """A return for every market day from a symbol's first day on, carried over days it did not trade."""
    key, date = s.keys[0], s.order[0]
    last_day = df.agg(F.max(date)).scalar()
    days = df.groupBy(key).agg(F.min(date).alias("a")).select(key, F.explode(F.sequence("a", last_day)).alias(date))
    days = days.join(df.select(date).distinct(), date, "left_semi")
    full = days.join(df.select(key, date, F.col(ret).alias("r")), [key, date], "left")
    return full.withColumn("r", s.fill_forward("r")).where(F.col("r").isNotNull())


def pair_correlations(df: DataFrame, span: int = SPAN, s: Series = SYMBOL_DAY, block: int = SYMBOL_BLOCK) -> DataFrame:
    """Trailing correlation of every symbol pair on every day.

    The result has one row per pair and day by definition. Symbols are hashed into blocks and
    joined per (day, block pair), so no task forms all pairs of a day.
    """
    key, date = s.keys[0], s.order[0]
    # read on both sides of the join and for the symbol count
    rows = checkpoint(aligned_returns(checkpoint(df.select(key, date, "Returns")), s=s))
    blocks = F.greatest(F.lit(1), F.ceil(rows.select(key).distinct().agg(F.count(F.lit(1))).scalar() / block)).cast("int")
    rows = rows.withColumn("_n", blocks).withColumn("_b", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    other = F.sequence(F.lit(0), F.col("_n") - 1)
    left = rows.select(date, F.col(key).alias("a"), F.col("r").alias("ra"), F.col("_b").alias("_i"), F.explode(other).alias("_j"))
    right = rows.select(date, F.col(key).alias("b"), F.col("r").alias("rb"), F.explode(other).alias("_i"), F.col("_b").alias("_j"))
    pairs = left.join(right, [date, "_i", "_j"]).where("a < b").drop("_i", "_j")
    p = Series(("a", "b"), (date,))
    return pairs.select("a", "b", date, F.coalesce(p.corr("ra", "rb", span, at_least=max(10, span // 2)), F.lit(0.0)).alias("corr"),
                        (F.count(F.lit(1)).over(p.last(span)) >= max(10, span // 2)).alias("_ok")).where("_ok").drop("_ok")


def edges(corr: DataFrame, cut: float = EDGE_CUT, date: str = "Date") -> DataFrame:
    """Both directions of every pair at or above the cut."""
    strong = corr.where(F.abs("corr") >= cut)
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return strong.select(date, F.explode(both).alias("e"), F.col("corr").alias("weight")).select(date, "e.src", "e.dst", "weight")


def density(corr: DataFrame, nodes: DataFrame, cut: float = EDGE_CUT, date: str = "Date") -> DataFrame:
    """Share of the possible edges that exist, for every day of ``nodes`` (a row per day and symbol). Pairs that are
    too young to have a correlation are possible, too; a day with one symbol has density 0."""
    strong = corr.groupBy(date).agg(F.count_if(F.abs("corr") >= cut).alias("pairs"))
    count = nodes.groupBy(date).agg(F.count(F.lit(1)).alias("_n")).withColumn("possible", F.expr("_n * (_n - 1) div 2"))
    out = count.join(strong, date, "left").select(date, F.coalesce("pairs", F.lit(0)).alias("pairs"), "possible")
    return out.withColumn("density", F.coalesce(F.try_divide("pairs", "possible"), F.lit(0.0)))


def degrees(e: DataFrame, date: str = "Date") -> DataFrame:
    return e.groupBy(date, F.col("src").alias("Symbol")).agg(F.count(F.lit(1)).alias("degree"), F.sum(F.abs("weight")).alias("strength"))


def eigenvector(e: DataFrame, iterations: int = 20, every: int = 5, date: str = "Date") -> DataFrame:
    """Eigenvector centrality of each day's graph by power iteration on absolute weights.

    Adding the vector itself each step shifts the spectrum, so bipartite graphs converge too.
    Scaled and checkpointed every few steps.
    """
    flat = checkpoint(e.select(date, "src", "dst", F.abs("weight").alias("w")))
    nodes = flat.select(date, "src").distinct()
    # a self link of weight 1 adds the vector itself, so each step reads the vector once
    links = checkpoint(flat.unionByName(nodes.select(date, "src", F.col("src").alias("dst"), F.lit(1.0).alias("w"))))
    v = nodes.select(date, F.col("src").alias("node"), F.lit(1.0).alias("x"))
    for step in range(1, iterations + 1):
        pushed = links.join(v.withColumnRenamed("node", "src"), [date, "src"]).select(date, F.col("dst").alias("node"), (F.col("w") * F.col("x")).alias("x"))
        v = pushed.groupBy(date, "node").agg(F.sum("x").alias("x"))
        if step % every == 0 or step == iterations:
            norm = v.groupBy(date).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
            v = checkpoint(v.join(norm, date).select(date, "node", (F.col("x") / F.col("norm")).alias("x")))
    return v.select(date, F.col("node").alias("Symbol"), F.col("x").alias("graph_eigenvector"))


def clustering(e: DataFrame, date: str = "Date") -> DataFrame:
    """Weighted local clustering: geometric mean of triangle weights relative to the largest weight.

    Edges point from the node of lower degree to the higher one, so a hub opens few wedges
    and each triangle is found once. The edge list is read six times, so it is checkpointed.
    """
    e = checkpoint(e.select(date, "src", "dst", "weight"))
    top = e.groupBy(date).agg(F.max(F.abs("weight")).alias("top"))
    deg = degrees(e, date).select(date, F.col("Symbol").alias("node"), "degree")
    w = e.join(top, date).select(date, "src", "dst", (F.abs("weight") / F.col("top")).alias("w"))
    d_src = deg.withColumnsRenamed({"node": "src", "degree": "_ds"})
    d_dst = deg.withColumnsRenamed({"node": "dst", "degree": "_dd"})
    up = w.join(d_src, [date, "src"]).join(d_dst, [date, "dst"]).where(F.struct("_ds", "src") < F.struct("_dd", "dst")).select(date, "src", "dst", "w")
    x = up.select(date, "src", F.col("dst").alias("v"), F.col("w").alias("w1"))
    y = up.select(date, "src", F.col("dst").alias("u"), F.col("w").alias("w2"))
    wedges = x.join(y, [date, "src"]).where("v != u")
    close = up.select(date, F.col("src").alias("v"), F.col("dst").alias("u"), F.col("w").alias("w3"))
    tri = wedges.join(close, [date, "v", "u"]).withColumn("g", F.cbrt(F.col("w1") * F.col("w2") * F.col("w3")))
    each = tri.select(date, F.explode(F.array("src", "v", "u")).alias("node"), "g").groupBy(date, "node").agg(F.sum("g").alias("g"))
    out = deg.join(each, [date, "node"], "left")
    value = F.coalesce(F.try_divide(2 * F.col("g"), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0))
    return out.select(date, F.col("node").alias("Symbol"), value.alias("graph_clustering"))


def node_features(df: DataFrame, features: list[str], score: str = "Risk_Probability", label: str = "Risk_Label", date: str = "Date") -> DataFrame:
    """Cross-sectional standard scores, score class, margin and z-score, and target dispersion."""
    stats = df.groupBy(date).agg(*[F.avg(c).alias(f"_m_{c}") for c in [*features, score]], *[F.stddev_pop(c).alias(f"_d_{c}") for c in [*features, score]],
                                 F.stddev_pop(label).alias("gnn_target_std"))
    out = df.join(stats, date)

    def standard(c: str):
        dev = F.when(F.col(f"_d_{c}") < 1e-6, F.lit(1.0)).otherwise(F.col(f"_d_{c}"))
        return F.coalesce((F.col(c) - F.col(f"_m_{c}")) / dev, F.lit(0.0))

    p = F.col(score)
    return out.withColumns({
        **{f"{c}_std": standard(c) for c in features}, "gnn_risk_class": (p >= 0.5).cast("int"), "gnn_risk_margin": F.abs(p - 0.5) * 2.0,
        "gnn_risk_zscore": (p - F.col(f"_m_{score}")) / (F.col(f"_d_{score}") + 1e-6),
    }).drop(*[c for c in stats.columns if c.startswith("_")])
