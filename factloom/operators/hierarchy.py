"""Parent-child links to full hierarchies: path, depth, root and descendants of each node, with cycles told apart.

Bottom-up leaf peeling. Each round peels the leaves; a leaf sends its parent the size and height of its subtree and,
where lists are asked for, the rows of its descendants and itself. So that a chain of n nodes takes O(log n) rounds
and not n, inner nodes of chains whose hash is a local minimum are spliced out as well: the edge of their only child
takes over what they hold. Once the nodes left fit one task they are peeled there, by the same rules. Reverse peel
order then assigns roots, depths and paths: a node's parent at its removal is always known before it. What is never
peeled lies on a cycle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from factloom.session import cut

#: So many nodes are peeled in one task; more are first reduced by rounds over the cluster. Rows do not depend on it.
LOCAL_NODES = 500_000
#: A key with more rows than this is split over several tasks.
HEAVY_ROWS = 1_000_000


def _kind(df: DataFrame) -> str:
    return df.schema["node"].dataType.simpleString()


def _via(kind: str) -> str:
    return f"array<struct<n:{kind},d:int>>"


def _hot(rows: DataFrame, key: str) -> DataFrame:
    """Keys with more than HEAVY_ROWS rows, at most a millionth as many as rows, and the tasks each is split over."""
    n = rows.groupBy(F.col(key).alias("hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY_ROWS)
    return cut(n.select("hot", F.ceil(F.col("n") / HEAVY_ROWS).cast("int").alias("parts")))


def _joined(many: DataFrame, one: DataFrame, key: str, key_one: str, hot: DataFrame | None, how: str, by: str) -> DataFrame:
    """many joined with one on key, the rows of hot keys told apart by a hash of by."""
    if hot is None:
        return many.join(one, F.col(key) == F.col(key_one), how)
    a = many.join(hot, F.col(key) == F.col("hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1)))).drop("hot", "parts")
    b = one.join(hot, F.col(key_one) == F.col("hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("hot", "parts")
    return a.join(b, (F.col(key) == F.col(key_one)) & (F.col("_salt") == F.col("_part")), how).drop("_salt", "_part")


def _round(alive: DataFrame, n: int) -> DataFrame:
    """One round. gone: leaf, chain or null; edges over spliced nodes lead on to those nodes' parents.

    A node holds s and h, size and height of what was peeled below it. Its edge holds dist, the links it stands for,
    and es, eh: size of what the spliced nodes on it hold, they included, and its height below the parent.
    """
    edge = ["node", "dist", "es", "eh"]
    kids = alive.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("kids"), F.max(F.struct(*edge)).alias("k"))
    hash_ = lambda c: F.xxhash64(c, F.lit(n))
    k, p, me = F.col("k.node"), F.col("parent"), F.col("node")
    inner = (F.col("kids") == 1) & p.isNotNull() & (me != p) & (hash_(me) < hash_(k)) & ((k == p) | (hash_(me) < hash_(p)))
    m = alive.join(kids, me == F.col("of"), "left").drop("of").withColumn("gone", F.when(F.col("kids").isNull(), F.lit("leaf")).when(inner, F.lit("chain")))
    s = m.where("gone = 'chain'").select(k.alias("c_child"), me.alias("c_node"), p.alias("c_parent"), *[F.col(x).alias(f"c_{x}") for x in ("dist", "es", "eh", "s", "h", "via")])
    u = m.join(s, me == F.col("c_child"), "left")
    cut_ = F.col("c_node").isNotNull()
    # A step of its own: next to a new dist the old one could not be named in the lambda.
    u = u.withColumn("moved", F.transform("c_via", lambda x: F.struct(x["n"].alias("n"), (x["d"] + F.col("dist")).cast("int").alias("d"))))
    here = F.array(F.struct(F.col("c_node").alias("n"), F.col("dist").alias("d")))
    return u.select(
        "node",
        F.coalesce("c_parent", "parent").alias("parent"),
        F.when(cut_, F.col("dist") + F.col("c_dist")).otherwise(F.col("dist")).cast("int").alias("dist"),
        F.when(cut_, F.col("es") + F.col("c_es") + F.col("c_s") + 1).otherwise(F.col("es")).alias("es"),
        F.when(cut_, F.greatest(F.col("eh") + F.col("c_dist"), F.col("c_eh"), F.col("c_h") + F.col("c_dist"))).otherwise(F.col("eh")).cast("int").alias("eh"),
        "s", "h",
        F.when(cut_ & F.col("via").isNotNull(), F.concat("via", here, F.col("moved"))).otherwise(F.col("via")).alias("via"),
        "gone", F.when(F.col("gone") == "chain", F.col("k")).alias("k"), "kids",
    )


def _after(done: DataFrame) -> DataFrame:
    """The nodes that stay, with what the leaves of the round sent them; combined before the exchange."""
    sent = done.where("gone = 'leaf' and parent is not null").groupBy(F.col("parent").alias("to")).agg(
        F.sum(F.col("s") + 1 + F.col("es")).alias("ss"), F.max(F.greatest(F.col("h") + F.col("dist"), F.col("eh"))).alias("hh")
    )
    left = done.where("gone is null").join(sent, F.col("node") == F.col("to"), "left")
    return left.select("node", "parent", "dist", "es", "eh", (F.col("s") + F.coalesce("ss", F.lit(0))).alias("s"), F.greatest(F.col("h"), F.coalesce("hh", F.lit(0))).cast("int").alias("h"), "via")


def _sent_rows(removed: DataFrame, lists: DataFrame | None, most: int) -> DataFrame:
    """The descendant rows that removed nodes send over their edges: themselves and all that was sent to them."""
    ends = F.concat("via", F.array(F.struct(F.col("parent").alias("n"), F.col("dist").alias("d"))))
    to = removed.where("parent is not null").select("node", F.explode(ends).alias("e")).select(F.col("node").alias("from"), F.col("e.n").alias("to"), F.col("e.d").alias("d"))
    return _passed_on(to, lists, most)


def _passed_on(to: DataFrame, lists: DataFrame | None, most: int) -> DataFrame:
    own = to.select(F.col("to").alias("ancestor"), F.col("from").alias("descendant"), F.col("d").alias("distance"))
    if lists is None:
        return own
    hot = _hot(lists, "ancestor") if most > HEAVY_ROWS else None
    more = _joined(lists, to, "ancestor", "from", hot, "inner", "descendant")
    return own.unionByName(more.select(F.col("to").alias("ancestor"), "descendant", (F.col("distance") + F.col("d")).cast("int").alias("distance")))


class _Local:
    """The same peeling over the nodes of one task."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        parts = [b for b in batches if len(b)]
        self.n = sum(map(len, parts))
        if not self.n:
            return
        pdf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        self.node = pdf["node"].to_numpy()
        has = pdf["parent"].notna().to_numpy()
        at = pd.Index(self.node)
        par = np.full(self.n, -1, dtype=np.int64)
        par[has] = at.get_indexer(pdf["parent"][has].astype(pdf["node"].dtype))
        self.par = par.tolist()
        self.dist, self.size, self.height = pdf["dist"].tolist(), pdf["s"].tolist(), pdf["h"].tolist()
        es, eh = pdf["es"].tolist(), pdf["eh"].tolist()
        self.via = [[(x["n"], x["d"]) for x in v] if v is not None and len(v) else () for v in pdf["via"]] if "via" in pdf else None
        kids = np.bincount(par[par >= 0], minlength=self.n)
        todo = np.flatnonzero(kids == 0).tolist()
        kids, par_, size, height, dist = kids.tolist(), self.par, self.size, self.height, self.dist
        order = []
        while todo:
            v = todo.pop()
            order.append(v)
            p = par_[v]
            if p >= 0:
                size[p] += size[v] + 1 + es[v]
                height[p] = max(height[p], height[v] + dist[v], eh[v])
                kids[p] -= 1
                if not kids[p]:
                    todo.append(p)
        self.order = order
        # Reverse peel order: the parent is known before the node.
        self.state, self.root, self.depth = ["cycle"] * self.n, [-1] * self.n, [0] * self.n
        for v in reversed(order):
            p = par_[v]
            if p < 0:
                self.state[v], self.root[v] = "tree", v
            elif self.state[p] == "tree":
                self.state[v], self.root[v], self.depth[v] = "tree", self.root[p], self.depth[p] + dist[v]
            else:
                self.state[v] = "below_cycle"

    def rows(self, paths: bool) -> Iterator[pd.DataFrame]:
        at, batch = 0, 50_000
        while at < self.n:
            span, cells = range(at, min(self.n, at + batch)), 0
            tree = [self.state[v] == "tree" for v in span]
            out = {
                "node": self.node[span.start : span.stop], "root": pd.Series([self.node[self.root[v]] if t else None for v, t in zip(span, tree)], dtype=object),
                "depth": pd.array([self.depth[v] if t else None for v, t in zip(span, tree)], dtype="Int32"), "n_descendants": [self.size[v] for v in span],
                "height": np.array([self.height[v] for v in span], dtype=np.int32), "state": [self.state[v] for v in span],
            }
            if paths:
                made = []
                for v, t in zip(span, tree):
                    p, x = [], v
                    while t and x >= 0:
                        p.append(self.node[x])
                        p += [n for n, _ in self.via[x]]
                        x = self.par[x]
                    made.append(p[::-1] if t else None)
                    cells += len(p)
                    if cells > 2_000_000:
                        break
                out = {k: list(c)[: len(made)] for k, c in out.items()} | {"path": made}
                out["depth"] = pd.array(out["depth"], dtype="Int32")
                at += len(made)
            else:
                at += len(span)
            yield pd.DataFrame(out)

    def lists(self, everywhere: bool) -> Iterator[pd.DataFrame]:
        """Leaves first, each peeled node sends its list to the nodes of its edge and hands it to its parent: at any
        time a node lies in one list, so memory is linear. everywhere: on and below cycles too, where lists end."""
        mine: dict[int, list] = {}
        a, b, d = [], [], []
        for v in self.order:
            got = mine.pop(v, [])
            got.append((v, 0))
            p = self.par[v]
            if p < 0 or not (everywhere or self.state[v] == "tree"):
                continue
            ends = [*(self.via[v] if self.via else ()), (self.node[p], self.dist[v])]
            for end, far in ends:
                for x, near in got:
                    a.append(end)
                    b.append(self.node[x])
                    d.append(near + far)
                if len(a) > 500_000:
                    yield pd.DataFrame({"ancestor": a, "descendant": b, "distance": np.array(d, dtype=np.int32)})
                    a, b, d = [], [], []
            far = self.dist[v]
            mine.setdefault(p, []).extend((x, near + far) for x, near in got)
        if a:
            yield pd.DataFrame({"ancestor": a, "descendant": b, "distance": np.array(d, dtype=np.int32)})


def _local_rows(paths: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = _Local(batches)
        if x.n:
            yield from x.rows(paths)

    return run


def _local_lists(everywhere: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = _Local(batches)
        if x.n:
            yield from x.lists(everywhere)

    return run


def _solved(links: DataFrame, node: str, parent: str, paths: bool, lists: bool, max_rounds: int) -> tuple[DataFrame, DataFrame | None]:
    e = links.select(F.col(node).alias("node"), F.col(parent).alias("parent")).where("node is not null and parent is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    e = cut(e)
    kind = _kind(e)
    with_via = paths or lists
    roots = e.select(F.col("parent").alias("node")).distinct().join(e.select("node"), "node", "left_anti").withColumn("parent", F.lit(None).cast(kind))
    via = F.array().cast(_via(kind)) if with_via else F.lit(None).cast(_via(kind))
    alive = e.unionByName(roots).select("node", "parent", F.lit(1).alias("dist"), F.lit(0).cast("bigint").alias("es"), F.lit(0).alias("eh"), F.lit(0).cast("bigint").alias("s"), F.lit(0).alias("h"), via.alias("via"))
    alive = cut(alive)
    n, rounds, sent = alive.count(), [], None
    while n > LOCAL_NODES:
        if len(rounds) >= max_rounds:
            raise RuntimeError(f"the hierarchy was not peeled in {max_rounds} rounds")
        seen = Observation()
        done = cut(_round(alive, len(rounds)).observe(seen, F.count("gone").alias("gone"), F.max("kids").alias("kids"), F.max("s").alias("s")))
        got = seen.get
        if not got["gone"]:
            break  # every node left is its own parent
        removed = done.where("gone is not null")
        rounds.append((removed, got["kids"] or 0))
        if lists:
            new = cut(_sent_rows(removed, sent, got["s"] or 0))
            sent = new if sent is None else sent.unionByName(new)
        alive, n = cut(_after(done)), n - got["gone"]
    cols = f"node {kind}, root {kind}, depth int, n_descendants bigint, height int, state string" + (f", path array<{kind}>" if paths else "")
    shown = [c.split(" ")[0] for c in cols.split(", ")]
    if n > LOCAL_NODES:
        null = {"root": kind, "depth": "int", "path": f"array<{kind}>"}
        known = alive.select(*[F.lit("cycle").alias(c) if c == "state" else F.lit(None).cast(null[c]).alias(c) if c in null else F.col({"n_descendants": "s", "height": "h"}.get(c, c)).alias(c) for c in shown])
    else:
        keep = alive.columns if with_via else [c for c in alive.columns if c != "via"]
        one = alive.select(*keep).coalesce(1)
        known = one.mapInPandas(_local_rows(paths), cols)
        if lists:
            near = f"ancestor {kind}, descendant {kind}, distance int"
            if not rounds:
                return cut(known).join(e, "node", "left").select("node", "parent", *shown[1:]), one.mapInPandas(_local_lists(False), near)
            to = cut(one.mapInPandas(_local_lists(True), near)).select(F.col("descendant").alias("from"), F.col("ancestor").alias("to"), F.col("distance").alias("d"))
            sent = sent.unionByName(_passed_on(to, sent, HEAVY_ROWS + 1))
    known = cut(known)
    for removed, kids in reversed(rounds):
        above = known.select(F.col("node").alias("p_node"), F.col("root").alias("p_root"), F.col("depth").alias("p_depth"), F.col("state").alias("p_state"), *([F.col("path").alias("p_path")] if paths else []))
        hot = _hot(removed, "parent") if kids > HEAVY_ROWS else None
        down = _joined(removed, above, "parent", "p_node", hot, "left", "node")
        top, tree = F.col("parent").isNull(), F.col("p_state") == "tree"
        place: list[Column] = [
            F.when(top, F.col("node")).otherwise(F.col("p_root")).alias("root"),
            F.when(top, F.lit(0)).otherwise(F.col("p_depth") + F.col("dist")).cast("int").alias("depth"),
            F.when(top | tree, F.lit("tree")).otherwise(F.lit("below_cycle")).alias("state"),
        ]
        if paths:
            place.append(F.when(top, F.array("node")).when(tree, F.concat("p_path", F.reverse(F.transform("via", lambda x: x["n"])), F.array("node"))).alias("path"))
        down = down.select("node", "gone", "k", "s", "h", *place)
        leaves = down.where("gone = 'leaf'").select("node", "root", "depth", F.col("s").alias("n_descendants"), F.col("h").alias("height"), "state", *(["path"] if paths else []))
        # A spliced node's subtree is what it held and that of its only child, which was removed later or as a leaf.
        below = known.unionByName(leaves).select(F.col("node").alias("b_node"), F.col("n_descendants").alias("b_s"), F.col("height").alias("b_h"), F.col("state").alias("b_state"))
        chain = down.where("gone = 'chain'").withColumn("child", F.col("k.node")).join(below, F.col("child") == F.col("b_node"), "left")
        chain = chain.select(
            "node", "root", "depth", (F.col("s") + F.col("b_s") + 1 + F.col("k.es")).alias("n_descendants"), F.greatest(F.col("h"), F.col("b_h") + F.col("k.dist"), F.col("k.eh")).cast("int").alias("height"),
            F.when(F.col("b_state") == "cycle", F.lit("cycle")).otherwise(F.col("state")).alias("state"), *(["path"] if paths else []),
        )
        known = cut(known.unionByName(leaves).unionByName(chain.select(*known.columns)))
    if sent is not None:
        # Lists of nodes on and below cycles would have no end.
        sent = sent.join(known.where("state = 'tree'").select(F.col("node").alias("descendant")), "descendant", "left_semi").select("ancestor", "descendant", "distance")
    return known.join(e, "node", "left").select("node", "parent", *shown[1:]), sent


def hierarchy(links: DataFrame, node: str = "node", parent: str = "parent", paths: bool = False, max_rounds: int = 200) -> DataFrame:
    """Columns: node, parent, root, depth INT, n_descendants BIGINT, height INT, state STRING; with paths also path
    ARRAY (root first, node last).

    links has one row for each node with a parent; nodes without such a row are roots. state is 'tree', 'cycle' for
    nodes on a cycle or 'below_cycle' for what hangs below one; those have null root, depth and path, and the size and
    height of nodes on a cycle count only what hangs below the cycle. A node that is its own parent is a cycle of one.
    Roots are rows too, with null parent and depth 0, if they have a child. Null nodes or parents and repeated rows are
    left out; if a node has several parents the smallest holds. An empty table gives no rows. Extra columns are ignored.
    """
    return _solved(links, node, parent, paths, False, max_rounds)[0]


def with_descendants(links: DataFrame, node: str = "node", parent: str = "parent", max_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """hierarchy() and one row for each node of a tree and node below it: ancestor, descendant, distance INT.

    Lists are rows: that of a root that holds a third of all nodes never has to lie in one task.
    """
    tree, lists = _solved(links, node, parent, False, True, max_rounds)
    if lists is None:
        lists = tree.where("state = 'none'").select(F.col("node").alias("ancestor"), F.col("node").alias("descendant"), F.col("depth").alias("distance"))
    return tree, lists


def cyclic_ancestors(tree: DataFrame, max_rounds: int = 30) -> DataFrame:
    """From hierarchy(), for nodes on or below a cycle: node, ancestor, distance INT, each ancestor once, where the walk
    up meets it first; a node on a cycle is its own ancestor as well.

    Each round doubles the steps that are followed: a node takes over what the node so many steps above it has found.
    """
    up = cut(tree.where("state <> 'tree'").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    jump, n = up.select("node", F.col("ancestor").alias("top")), up.count()
    for k in range(max_rounds):
        above = up.select(F.col("node").alias("top"), "ancestor", (F.col("distance") + F.lit(1 << k)).alias("distance"))
        found = jump.join(above, "top").select("node", "ancestor", "distance")
        up = cut(up.unionByName(found).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        m = up.count()
        if m == n:
            return up
        n = m
        jump = cut(jump.join(jump.select(F.col("node").alias("top"), F.col("top").alias("next")), "top").select("node", F.col("next").alias("top")))
    raise RuntimeError(f"the cycles were not followed in {max_rounds} rounds")
