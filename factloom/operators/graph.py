"""Directed graphs as edge tables (src, dst[, seq]): degrees, instability, reachability, cycles, layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut


def edges(df: DataFrame, src: str, dst: str, seq: str | None = None) -> DataFrame:
    """Distinct edges, each with its smallest seq."""
    key = F.min(seq) if seq else F.lit(0)
    return df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(key.alias("seq"))


def degrees(e: DataFrame) -> DataFrame:
    """node, out_degree, in_degree; self-edges do not count."""
    d = e.where("src <> dst")
    one = d.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    two = d.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return one.unionByName(two).groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def instability(e: DataFrame) -> DataFrame:
    d = degrees(e)
    total = F.col("out_degree") + F.col("in_degree")
    return d.withColumn("instability", F.when(total == 0, 0.0).otherwise(F.col("out_degree") / total))


def unstable_edges(e: DataFrame, ignoring: Sequence = ()) -> DataFrame:
    """Edges from a more stable node to a less stable one; ignored nodes lose both sides."""
    kept = e.where(~F.col("src").isin(*ignoring) & ~F.col("dst").isin(*ignoring) & (F.col("src") != F.col("dst"))) if ignoring else e.where("src <> dst")
    i = instability(kept).select("node", "instability")
    a = i.select(F.col("node").alias("src"), F.col("instability").alias("src_instability"))
    b = i.select(F.col("node").alias("dst"), F.col("instability").alias("dst_instability"))
    return kept.join(a, "src").join(b, "dst").where("src_instability < dst_instability").select("src", "dst", "src_instability", "dst_instability")


def reachable(e: DataFrame, roots: DataFrame, reverse: bool = False, max_rounds: int = 1000) -> DataFrame:
    """node, level: what the roots (node) reach, each node once at its shortest distance, without the roots.

    A frontier loop: each round joins the last frontier with the edges and drops what is known. Every round is written
    to the shared folder, so lineage stays short and a lost executor costs no round.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = e.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    frontier = cut(roots.select("node").distinct())
    seen, out = [frontier], []
    for level in range(1, max_rounds + 1):
        new = frontier.join(step, "node").select(F.col("next").alias("node")).distinct()
        for s in seen:
            new = new.join(s.select("node"), "node", "left_anti")
        new = cut(new)
        if new.isEmpty():
            break
        seen = _compact([*seen, new])
        out.append(new.withColumn("level", F.lit(level)))
        frontier = new
    else:
        raise RuntimeError(f"nodes are farther than {max_rounds} steps")
    r = out[0] if out else roots.select("node").limit(0).withColumn("level", F.lit(0))
    for o in out[1:]:
        r = r.unionByName(o)
    return r


def _compact(seen: list[DataFrame]) -> list[DataFrame]:
    """Keeps the number of tables that are looked up small."""
    if len(seen) < 6:
        return seen
    u = seen[0].select("node")
    for s in seen[1:]:
        u = u.unionByName(s.select("node"))
    return [cut(u)]


def trimmed(e: DataFrame, sides: tuple[str, ...] = ("src", "dst"), max_rounds: int = 10_000) -> DataFrame:
    """Edges between nodes that lie on a cycle or between cycles: nodes without outgoing or incoming edges are taken
    away until none is left. sides ("src",): only those without outgoing edges, so what leads to a cycle stays."""
    left = cut(e.where("src is not null and dst is not null").select("src", "dst", "seq"))
    n = left.count()
    for _ in range(max_rounds):
        if not n:
            return left
        nodes = left.select(F.col("src").alias("node")).distinct()
        if "dst" in sides:
            nodes = nodes.join(left.select(F.col("dst").alias("node")).distinct(), "node")
        left2 = left.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
        if "dst" in sides:
            left2 = left2.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi")
        left2 = cut(left2)
        m = left2.count()
        left, n, same = left2, m, n == m
        if same:
            return left
    raise RuntimeError("the graph was not trimmed")


def first_cycle(e: DataFrame, max_rounds: int = 60) -> list:
    """The cycle that a depth-first search finds first, closed by its first node; [] if there is none.

    The search takes nodes as they appear in the edges (by seq, src, dst; the source of an edge before its target) and
    each node's edges in that order. What leads to no cycle is trimmed away first, so the search never has to turn
    back: it follows first edges from the first node that is left. These are followed on the cluster, the steps doubled
    in each round; only the cycle itself comes to the driver.
    """
    live = trimmed(e, ("src",))
    at = F.struct("seq", "src", "dst")
    # All edges tell the order of nodes, also those to nodes that are gone.
    whole = e.where("src is not null and dst is not null")
    seen = whole.select(F.col("src").alias("node"), F.struct(at, F.lit(0)).alias("at")).unionByName(whole.select(F.col("dst").alias("node"), F.struct(at, F.lit(1)).alias("at")))
    start = seen.join(live.select(F.col("src").alias("node")).distinct(), "node", "left_semi").agg(F.min_by("node", "at").alias("node")).first()["node"]
    if start is None:
        return []
    jump = cut(live.groupBy(F.col("src").alias("node")).agg(F.min_by("dst", at).alias("next")))
    walk = cut(jump.where(F.col("node") == F.lit(start)).select("node", F.lit(0).cast("bigint").alias("step")))
    for k in range(max_rounds):
        ahead = walk.join(jump, "node").select(F.col("next").alias("node"), (F.col("step") + F.lit(1 << k)).alias("step"))
        walk = cut(walk.unionByName(ahead).groupBy("node").agg(F.min("step").alias("step")))
        m = walk.count()
        if m < (1 << (k + 1)):
            # Fewer nodes than steps: the walk has come back to a node, its last step leads there.
            break
        jump = cut(jump.join(jump.select(F.col("node").alias("next"), F.col("next").alias("_next")), "next").select("node", F.col("_next").alias("next")))
    else:
        raise RuntimeError(f"the walk is longer than 2 to the power of {max_rounds}")
    last = walk.agg(F.max_by("node", "step").alias("node")).first()["node"]
    back = live.where(F.col("src") == F.lit(last)).agg(F.min_by("dst", at).alias("node")).first()["node"]
    ring = walk.where(F.col("step") >= walk.where(F.col("node") == F.lit(back)).select("step").scalar()).orderBy("step").select("node").collect()
    return [*[r["node"] for r in ring], back]
