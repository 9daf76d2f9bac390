import pytest

from factloom.sources import syntax
from factloom.sources.readers import inline_sources

TEXT = """import Foundation
// é and more
class A: B {
  func run(_ x: Int, with y: [String] = ["a", b.c]) throws -> Int {
    guard x > 0 else { return 0 } // why
    if x == 1, let z = find(x) {
      save(z, at: -3, flag: true)
    } else if x == 2 {
      items.forEach { print($0) }
    } else { throw E.bad(nil) }
    for i in 0..<x { cache[i] = (i, "é") }
    repeat { step() } while x < 3
    return store.load(id: 0x1F)
  }
}
"""


@pytest.fixture(scope="module")
def nodes(spark):
    files = inline_sources(spark, {"A.swift": TEXT, "B.swift": "let d = [\"k\": 1.5]\nfunc g() { run() }\n", "C.swift": ""})
    return files, syntax.read_nodes(files).cache()


def kinds(df):
    out = {}
    for r in df.collect():
        out[r["kind"]] = out.get(r["kind"], 0) + 1
    return out


def test_nodes_nest(nodes):
    rows = {(r["path"], r["node_id"]): r for r in nodes[1].collect()}
    for (path, _), r in rows.items():
        assert r["ancestors"] == sorted(r["ancestors"]) and r["depth"] == len(r["ancestors"])
        if r["parent_id"] is not None:
            p = rows[(path, r["parent_id"])]
            assert p["start"] <= r["start"] and r["end"] <= p["end"] and r["ancestors"] == [*p["ancestors"], p["node_id"]]
        else:
            assert r["kind"] == "sourceFile"
    k = kinds(nodes[1].where("path = 'A.swift'"))
    assert (k["ifExpr"], k["guardStmt"], k["forStmt"], k["repeatStmt"], k["returnStmt"], k["throwStmt"], k["classDecl"], k["functionDecl"]) == (1, 1, 1, 1, 2, 1, 1, 1)
    assert "whileStmt" not in k and k["closure"] == 1 and k["subscript"] == 1 and k["array"] == 2 and k["tuple"] == 1


def test_navigation(nodes):
    files, all_ = nodes
    f = syntax.of_kind(all_, "functionDecl").where("name = 'run'")
    assert {r["kind"] for r in syntax.parents(all_, f).collect()} == {"memberBlock"}
    assert {r["kind"] for r in syntax.ancestors(all_, f).collect()} == {"sourceFile", "classDecl", "memberBlock"}
    assert {r["name"] for r in syntax.containing(all_, syntax.of_kind(all_, "functionDecl"), "throwStmt").collect()} == {"run"}
    assert kinds(syntax.descendants(all_, syntax.of_kind(all_, "ifExpr")))["functionCall"] == 4
    assert {r["name"] for r in syntax.of_kind(all_, "functionCall").collect()} == {"find", "save", "print", "E.bad", "step", "store.load", "run"}
    block = syntax.children(all_, f).where("kind = 'codeBlock'")
    assert {r["kind"] for r in syntax.children(all_, block).collect()} == {"guardStmt", "ifExpr", "forStmt", "repeatStmt", "returnStmt"}
    e = syntax.enclosing(all_, syntax.of_kind(all_, "throwStmt"), "classDecl", "functionDecl").first()["enclosing"]
    assert [(x["kind"], x["name"]) for x in e] == [("classDecl", "A"), ("functionDecl", "run")]
    text = {r["source"] for r in syntax.slices(syntax.of_kind(all_, "guardStmt", "tuple", "subscript"), files).collect()}
    assert text == {"guard x > 0 else { return 0 }", '(i, "é")', "[i]"}


def test_expressions(nodes):
    rows = syntax.expressions(nodes[1]).collect()
    args = {(r["label"], r["value"]): r for r in rows if r["kind"] == "argument"}
    assert args[("at", "-3")]["int_value"] == -3 and args[("flag", "true")]["bool_value"] is True and args[("id", "0x1F")]["int_value"] == 31 and args[(None, "z")]["reference_name"] == "z" and args[(None, "nil")]["is_nil"]
    elements = {r["value"]: r for r in rows if r["kind"] == "element"}
    assert elements['"a"']["string_value"] == "a" and (elements["b.c"]["reference_name"], elements["b.c"]["reference_base"]) == ("c", "b")
    assert {r["double_value"] for r in rows if r["kind"] == "numberLiteral"} >= {1.5}
