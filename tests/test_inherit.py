from types import SimpleNamespace

import pandas as pd
import pyarrow as pa

from factloom.operators import inherit
from factloom.operators.inherit import closure, resolved
from factloom.plans.inheritance import inherited_names, with_closure
from factloom.sources import readers
from factloom.sources.declarations import _facts, read_facts, view

CODE = """
class Grandparent {}
class Parent: Grandparent {}
class Child: Parent {}
protocol Entity: Persistable {}
protocol Persistable {}
struct Record: Entity {}
extension Parent: Titled {}
typealias Old = Older
typealias Older = Parent
class Legacy: Old {}
class View: UIView, @unchecked Sendable {}
class A: B {}
class B: A {}
class Box<T> {}
class IntBox: Box<Int> {}
"""


def test_closure_over_facts(spark):
    f = read_facts(readers.inline_sources(spark, {"a.swift": CODE})).cache()
    types = view(f, "type").unionByName(view(f, "protocol"))
    got = {}
    for r in closure(types, view(f, "extension"), view(f, "typealias")).collect():
        got.setdefault(r["qualified_name"], {})[r["ancestor"]] = r["level"]
    assert got["Child"] == {"Parent": 1, "Grandparent": 2, "Titled": 2}
    assert got["Record"] == {"Entity": 1, "Persistable": 2}
    assert {"Old", "Parent", "Grandparent", "Titled"} <= set(got["Legacy"])
    assert got["View"] == {"UIView": 1, "Sendable": 1}
    assert got["A"] == {"B": 1, "A": 2} and got["IntBox"] == {"Box": 1}
    assert closure(types.limit(0), view(f, "extension").limit(0), view(f, "typealias").limit(0)).count() == 0


def test_resolution(spark):
    d = spark.createDataFrame([("Base",), ("Legacy.Base",), ("X.User",), ("Y.User",), ("Only.One",)], "qualified_name string")
    names = spark.createDataFrame([("Base",), ("Legacy.Base",), ("User",), ("One",), ("Nope",), ("Z.One",)], "name string")
    assert {tuple(r) for r in resolved(names, d).collect()} == {("Base", "Base"), ("Legacy.Base", "Legacy.Base"), ("User", "X.User"), ("User", "Y.User"), ("One", "Only.One")}


def test_names_on_and_below_circular_inheritance_are_kept(spark):
    rows = [(1, "A", ["B", "P"]), (2, "B", ["C", "Codable"]), (3, "C", ["A", "R"]), (4, "Below", ["A"]), (5, "Self", ["Self", "S"]), (6, "Lower", ["Below", "L"])]
    schema = "type_id long, module string, qualified_name string, name string, keyword string, inherited array<string>, observed_at timestamp_ntz, received_at timestamp_ntz"
    types = spark.createDataFrame([(i, "M", n, n, "class", e, None, None) for i, n, e in rows], schema)
    got = {}
    for r in inherited_names(types).collect():
        got.setdefault(r["node"], {})[r["name"]] = r["level"]
    a = {"B": 0, "P": 0, "C": 1, "Codable": 1, "A": 2, "R": 2}
    below = {"A": 0} | {n: level + 1 for n, level in a.items() if n != "A"}
    assert got[1] == a and got[4] == below and got[5] == {"Self": 0, "S": 0}
    assert got[6] == {"Below": 0, "L": 0, "A": 1} | {n: level + 1 for n, level in below.items() if n != "A"}
    assert {r["type_id"] for r in with_closure(types).where("array_contains(all_inherited, 'Codable')").collect()} == {1, 2, 3, 4, 6}


def _dense(spark):
    """Forty declarations in a circle, each inheriting the next three: forty ancestors each."""
    return spark.createDataFrame([(f"T{i}", [f"T{(i + k) % 40}" for k in (1, 2, 3)]) for i in range(40)], "qualified_name string, inherited array<string>")


def test_tables_on_the_way_hold_the_graph_and_not_its_closure(spark, monkeypatch):
    written, cut = [], inherit.cut

    def counted(df):
        written.append(cut(df))
        return written[-1]

    monkeypatch.setattr(inherit, "cut", counted)
    rows = closure(_dense(spark)).collect()
    assert len(rows) == 40 * 40 and max(r["level"] for r in rows) == 14
    assert sum(w.count() for w in written) <= 2 * 40 * 3


def test_searches_in_tasks_and_rounds_over_the_cluster_agree(spark, monkeypatch):
    more = [("X.User", ["Base", "P"]), ("Y.User", ["Q<T0>"]), ("Own", ["User", "@unchecked Sendable", "Own"]), ("Base", None), ("Q", ["Own"]), ("Alone", [])]
    types = _dense(spark).unionByName(spark.createDataFrame([*more, ("T0", ["User"])], "qualified_name string, inherited array<string>"))
    extensions = spark.createDataFrame([("User", ["Titled"]), ("T9", ["Own"])], "name string, inherited array<string>")
    aliases = spark.createDataFrame([("P", "Older"), ("Older", "T5")], "name string, type_text string")
    one = {tuple(r) for r in closure(types, extensions, aliases).collect()}
    assert {("Own", "User", 1), ("Own", "X.User", 1), ("Own", "Titled", 2), ("Own", "T5", 2), ("Own", "T6", 3), ("Own", "Own", 1)} <= one
    monkeypatch.setattr(inherit, "LOCAL_EDGES", 0)
    two = closure(types, extensions, aliases).collect()
    assert len(two) == len(one) and {tuple(r) for r in two} == one


def test_searches_side_by_side_and_long_lists(monkeypatch):
    pairs = [(False, f"N{i}", f"N{j}") for i in range(30) for j in range(30) if i != j and i % 7 < 3 and (i * j) % 4 == 1] + [(True, f"N{i}", f"N{i}") for i in range(30)]
    batch = pa.table({"hit": [p[0] for p in pairs], "a": [p[1] for p in pairs], "b": [p[2] for p in pairs]}).to_batches()
    parts = pa.Table.from_batches(inherit._packed(iter(batch)))
    graph, n, seen = SimpleNamespace(value=b"".join(parts["part"].to_pylist())), parts["n"][0].as_py(), []
    for cells, most in ((1, 2), (100, 3), (1_000_000, 10_000)):
        monkeypatch.setattr(inherit, "_CELLS", cells)
        monkeypatch.setattr(inherit, "_LIST", most)
        rows = [r for b in inherit._searches(graph, iter([pa.record_batch({"id": list(range(n))})])) for r in b.to_pylist()]
        assert max(len(r["ancestors"]) for r in rows) <= most
        seen.append(sorted((r["qualified_name"], a, r["level"]) for r in rows for a in r["ancestors"]))
    wanted = []
    for root in {a for hit, a, _ in pairs if not hit}:
        levels, ahead = {}, [root]
        while ahead:
            ahead = list(dict.fromkeys(b for x in ahead for hit, a, b in pairs if not hit and a == x and b not in levels))
            levels |= dict.fromkeys(ahead, max(levels.values(), default=0) + 1)
        wanted += [(root, a, k) for a, k in levels.items()]
    assert seen[0] == seen[1] == seen[2] == sorted(wanted)


def test_facts_of_large_batches_leave_in_parts():
    files = pd.DataFrame({"path": [f"{i}.swift" for i in range(1201)], "text": [f"class C{i}: D {{}}\n" for i in range(1201)]})
    parts = list(_facts(iter([files, files[:0]])))
    assert max(p["path"].nunique() for p in parts) <= 500
    assert list(pd.concat(parts)["name"]) == [f"C{i}" for i in range(1201)]
