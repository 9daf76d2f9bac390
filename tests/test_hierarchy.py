import random

import pytest

from factloom.operators import hierarchy as module
from factloom.operators.hierarchy import cyclic_ancestors, hierarchy, with_descendants


@pytest.fixture(params=["one task", "rounds, split keys"], autouse=True)
def peeled(request, monkeypatch):
    """The rows are the same whether the nodes fit one task or not, and whether keys are split or not."""
    if request.param != "one task":
        monkeypatch.setattr(module, "LOCAL_NODES", 15)
    if "split" in request.param:
        monkeypatch.setattr(module, "HEAVY_ROWS", 3)



def brute(parent):
    out = {}
    for n in set(parent) | set(parent.values()):
        path, seen, x = [n], {n}, n
        while x in parent:
            x = parent[x]
            if x in seen:
                break
            path.append(x)
            seen.add(x)
        if x in parent:
            y, ring = parent[x], {x}
            while y != x:
                ring.add(y)
                y = parent[y]
            out[n] = ("cycle" if n in ring else "below_cycle", None, None, None)
        else:
            out[n] = ("tree", x, len(path) - 1, path[::-1])
    return out


def run(spark, pairs):
    return {r["node"]: (r["state"], r["root"], r["depth"], r["path"]) for r in hierarchy(spark.createDataFrame(pairs, "node long, parent long"), paths=True).collect()}


def test_random_forests_with_cycles(spark):
    for seed in (1,):
        random.seed(seed)
        parent = {n: random.randrange(n) for n in range(1, 40)}
        parent |= {100 + n: 99 + n for n in range(1, 45)}  # a chain, root 100
        parent |= {200: 201, 201: 202, 202: 200, 203: 200, 204: 203, 205: 204, 300: 300, 301: 300, 400: 401, 401: 400}
        assert run(spark, list(parent.items())) == brute(parent)


def test_nulls_repeats_several_parents_and_extra_columns(spark):
    df = spark.createDataFrame([(2, 1, "x"), (2, 1, "y"), (3, 2, None), (3, 7, None), (None, 1, ""), (4, None, "")], "node long, parent long, root string")
    got = {r["node"]: (r["root"], r["depth"]) for r in hierarchy(df).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2)}


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], "node long, parent long")).count() == 0


def test_descendants_and_sizes(spark):
    random.seed(7)
    parent = {n: random.randrange(n) for n in range(1, 30)} | {100 + n: 99 + n for n in range(1, 25)} | {130: 110, 131: 130, 200: 201, 201: 200, 202: 201, 203: 202}
    links = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in parent.items()], "node string, parent string")
    tree, lists = with_descendants(links)
    want = {(f"n{a}", f"n{n}", len(path) - 1 - k) for n, (state, _, _, path) in brute(parent).items() if state == "tree" for k, a in enumerate(path[:-1])}
    got = [tuple(r) for r in lists.collect()]
    assert set(got) == want and len(got) == len(want)
    for r in tree.where("state = 'tree'").collect():
        mine = [d for a, _, d in want if a == r["node"]]
        assert (r["n_descendants"], r["height"]) == (len(mine), max(mine, default=0))
    assert with_descendants(links.limit(0))[1].count() == 0


def test_ancestors_on_and_below_cycles(spark):
    parent = {n: n + 1 for n in range(40)} | {40: 30, 100: 35, 101: 100, 7000: 7000, 7001: 7000, 200: 201}
    want = set()
    for n in set(parent) - {200}:
        x, seen = n, {}
        while (x := parent[x]) not in seen:
            seen[x] = len(seen) + 1
        want |= {(n, a, d) for a, d in seen.items()}
    got = cyclic_ancestors(hierarchy(spark.createDataFrame(list(parent.items()), "node long, parent long")))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
