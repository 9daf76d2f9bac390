"""What types inherit by name, over classes, protocols, extensions and typealiases."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.literals import without_generics
from factloom.operators.matcher import bare
from factloom.session import cut

#: As many pairs of names, with what they resolve to, are walked from copies that the tasks hold.
LOCAL_EDGES = 2_000_000
_CELLS, _LIST = 1_000_000, 10_000


def _plain(entry):
    return F.trim(without_generics(bare(F.trim(entry))))


def resolved(names: DataFrame, declared: DataFrame) -> DataFrame:
    """names (name) to declarations (qualified_name): the exact qualified name, else the simple name's only
    declaration, else the only one at top level, else all of that name. Two equi-joins."""
    d = declared.select("qualified_name").distinct().withColumn("simple", F.substring_index("qualified_name", ".", -1))
    n = names.select("name").distinct().withColumn("last", F.substring_index("name", ".", -1))
    exact = n.join(d.select(F.col("qualified_name").alias("name")), "name", "left_semi").select("name", F.col("name").alias("qualified_name"))
    rest = n.join(exact.select("name"), "name", "left_anti").join(d, F.col("last") == F.col("simple"))
    # A name that is written with its enclosing type must end a candidate's name as a whole.
    rest = rest.where((F.col("name") == F.col("last")) | F.concat(F.lit("."), F.col("qualified_name")).endswith(F.concat(F.lit("."), F.col("name"))))
    top = ~F.contains("qualified_name", F.lit("."))
    tally = rest.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if(top).alias("n_top"))
    kept = rest.join(tally, "name").where((F.col("n") == 1) | (F.col("n_top") != 1) | top)
    return exact.unionByName(kept.select("name", "qualified_name"))


def closure(types: DataFrame, extensions: DataFrame | None = None, aliases: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """qualified_name, ancestor, level: each name a declaration inherits, at its smallest level (1: its own clause).

    types: qualified_name, inherited (classes, structs, enums, actors and protocols). extensions: name, inherited; they
    count for the declaration they extend. aliases: name, type_text and, if there, path and seq; the last of a name in
    source order holds (path, then seq; without these by text), chains
    are followed, circles end. Ancestors are names as written, without attributes and generic arguments, and what they
    resolve to; unknown names stop there; circular inheritance ends since no name is taken twice. Null lists are empty.
    """
    declared = types.where("qualified_name is not null").select("qualified_name")
    own = types.where("qualified_name is not null").select("qualified_name", F.explode("inherited").alias("entry"))
    if extensions is not None:
        e = extensions.where("name is not null").select(F.col("name"), F.explode("inherited").alias("entry")).withColumn("name", _plain(F.col("name")))
        own = own.unionByName(e.join(resolved(e, declared), "name").select("qualified_name", "entry"))
    edges = own.withColumn("name", _plain(F.col("entry"))).where("name <> ''").select("qualified_name", "name").distinct()
    if aliases is not None:
        a = aliases.where("name is not null and type_text is not null").groupBy("name").agg(F.max_by("type_text", F.struct(*[c for c in ("path", "seq") if c in aliases.columns], "type_text")).alias("target")).select("name", _plain(F.col("target")).alias("target"))
        a = cut(a)
        for _ in range(20):
            # Each pass doubles the length of alias chains that are followed; circles stay among themselves.
            b = a.select(F.col("name").alias("_n"), F.col("target").alias("_t"))
            a = a.join(b, F.col("target") == F.col("_n"), "left").select("name", F.coalesce("_t", "target").alias("target"))
            a = cut(a)
            if a.join(a.select(F.col("name").alias("_n")), F.col("target") == F.col("_n"), "left_semi").where("name <> target").isEmpty():
                break
        edges = edges.unionByName(edges.join(a, "name").select("qualified_name", F.col("target").alias("name"))).distinct()
    edges = cut(edges)
    hits = cut(resolved(edges, declared))
    return _walked(edges, hits) if edges.count() + hits.count() <= LOCAL_EDGES else _in_rounds(edges, hits, max_rounds)


def _in_rounds(edges: DataFrame, hits: DataFrame, max_rounds: int) -> DataFrame:
    """The closure by one join a level, for graphs that no task holds; each round's rows are written."""
    # An ancestor is the name itself and, where it is known, the declaration it stands for.
    edges = cut(edges.join(hits.withColumnRenamed("qualified_name", "is"), "name", "left"))
    seen = cut(edges.select("qualified_name", "name", "is").withColumn("level", F.lit(1)))
    frontier, pieces = seen, [seen]
    for level in range(2, max_rounds):
        nxt = edges.select(F.col("qualified_name").alias("is_"), F.col("name").alias("n2"), F.col("is").alias("i2"))
        new = frontier.where("is is not null").join(nxt, F.col("is") == F.col("is_")).select("qualified_name", F.col("n2").alias("name"), F.col("i2").alias("is")).distinct()
        for p in pieces:
            new = new.join(p.select("qualified_name", "name"), ["qualified_name", "name"], "left_anti")
        frontier = cut(new.withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        pieces.append(frontier)
        if len(pieces) > 6:
            whole = pieces[0]
            for p in pieces[1:]:
                whole = whole.unionByName(p)
            pieces = [cut(whole)]
    else:
        raise RuntimeError(f"names are inherited over more than {max_rounds} steps")
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    named = out.select("qualified_name", F.col("name").alias("ancestor"), "level").unionByName(out.where("is is not null").select("qualified_name", F.col("is").alias("ancestor"), "level"))
    return named.groupBy("qualified_name", "ancestor").agg(F.min("level").alias("level"))


def _walked(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """The closure by searches in the tasks, each from its share of the declarations and over a copy of the whole graph.

    The graph alone is written and sent, packed to numbers; what a search finds leaves its task as rows of the result, so
    nothing of the closure's size, which may be the square of the graph's, is shuffled or written on the way.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.lit(False).alias("hit"), F.col("qualified_name").alias("a"), F.col("name").alias("b"))
    pairs = pairs.unionByName(hits.select(F.lit(True).alias("hit"), F.col("name").alias("a"), F.col("qualified_name").alias("b")))
    packed = pairs.coalesce(1).mapInArrow(_packed, "n long, part binary").collect()
    n = packed[0]["n"] if packed else 0
    graph = spark.sparkContext.broadcast(b"".join(r["part"] for r in packed))
    del packed
    tasks = min(4 * spark.sparkContext.defaultParallelism, n // 500 + 1)
    found = spark.range(0, n, 1, tasks).mapInArrow(lambda batches: _searches(graph, batches), "qualified_name string, level int, ancestors array<string>")
    return found.select("qualified_name", F.explode("ancestors").alias("ancestor"), "level")


def _lists(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Targets of each of n numbers, laid end to end, and where each number's begin."""
    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]), b[np.argsort(a, kind="stable")]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The graph in numbers: names, declarations in any order that mixes them, names in their clauses, resolutions."""
    t = [b for b in batches if b.num_rows]
    if not t:
        return
    t = pa.Table.from_batches(t)
    names = pc.unique(pa.chunked_array([*t["a"].chunks, *t["b"].chunks]))
    hit = t["hit"].to_numpy()
    a, b = (pc.index_in(t[c], names).to_numpy().astype(np.int32) for c in ("a", "b"))
    starts = np.random.default_rng(0).permutation(np.unique(a[~hit]))
    whole = pickle.dumps((names, starts, *_lists(a[~hit], b[~hit], len(names)), *_lists(a[hit], b[hit], len(names))), protocol=5)
    for k in range(0, len(whole), 1 << 22):
        yield pa.record_batch({"n": pa.array([len(starts)], pa.int64()), "part": pa.array([whole[k : k + (1 << 22)]], pa.binary())})


def _targets(cells: np.ndarray, n: int, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Cells (search * n + number) to the cells of their targets in the same searches."""
    number = cells % n
    k = at[number + 1] - at[number]
    end = np.cumsum(k)
    return np.repeat(cells - number, k) + to[np.arange(end[-1] if len(end) else 0) + np.repeat(at[number] - end + k, k)]


def _fresh(marks: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Cells without a mark, each once; they get one."""
    cells = cells[marks[cells] == 0]
    order = np.arange(1, len(cells) + 1, dtype=marks.dtype)
    marks[cells] = order
    return cells[marks[cells] == order]


def _searches(graph, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Breadth-first searches, several side by side; a row for each of them and level, more if the list is long."""
    names = None
    for batch in batches:
        if names is None:
            names, starts, own_at, own, hit_at, hit = pickle.loads(graph.value)
            n = len(names)
            wide = max(1, _CELLS // n)
            # By search and number: taken as a name, as a declaration, given out as an ancestor.
            named, declared, given = (np.zeros(wide * n, np.int32) for _ in range(3))
        ids = starts[batch.column(0).to_numpy()]
        for k in range(0, len(ids), wide):
            roots, level, marked = ids[k : k + wide], 1, []
            ahead = _fresh(named, _targets(np.arange(len(roots)) * n + roots, n, own_at, own))
            while len(ahead):
                d = _fresh(declared, _targets(ahead, n, hit_at, hit))
                out = np.sort(_fresh(given, np.concatenate([ahead, d])))
                marked += [(named, ahead), (declared, d), (given, out)]
                if len(out):
                    search = out // n
                    begin = np.union1d(np.flatnonzero(np.diff(search, prepend=-1)), np.arange(0, len(out), _LIST))
                    lists = pa.ListArray.from_arrays(pa.array([*begin, len(out)], pa.int32()), names.take(pa.array(out % n)))
                    yield pa.record_batch({"qualified_name": names.take(pa.array(roots[search[begin]])), "level": pa.array(np.full(len(begin), level, np.int32)), "ancestors": lists})
                ahead = _fresh(named, _targets(d, n, own_at, own))
                level += 1
            for marks, cells in marked:
                marks[cells] = 0
