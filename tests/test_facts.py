import os

import pytest

from factloom.sources import readers
from factloom.sources.declarations import facts, read_facts, view

CODE = '''import struct Foundation.Date
@testable import Core

/// The base.
open class Base<T: P>: NSObject, @unchecked Sendable where T: Q {
  public private(set) var a: Int = 1, b: [String: Int] = [:]
  let (c, d) = make(x: 1)
  static let shared: Base = .init()
  init?(_ a: Int) throws { super.init(); store?.save(a, to: b).done() }
  /* plain */
  @MainActor func run<U>(_ x: @escaping (Int) -> Void, with y: U = .a) async throws -> [U]? {
    if a { await go() } else if b { } ; switch c { case 1: break; case 2: fallthrough; default: break }
    return nil
  }
  enum Kind: String { case one = "1", two; case three(Int, label: String) }
  typealias Pair = (Int, Int)
}
extension Base.Kind: CustomStringConvertible { var description: String { rawValue } }
protocol Shape { associatedtype X
  var area: Double { get }
  func draw(in y: Int) }
#if DEBUG
func debug() { UIImage(named: "x"); Task.detached { } }
#else
let fallback = 2
#endif
'''


def test_facts_of_a_file():
    rows = facts("a.swift", CODE)
    by = lambda kind: [r for r in rows if r["kind"] == kind]
    assert [(r["name"], r["keyword"]) for r in by("import")] == [("Foundation.Date", "struct"), ("Core", None)]
    t = by("type")
    assert [(r["qualified_name"], r["keyword"], r["inherited"]) for r in t] == [("Base", "class", ["NSObject", "@unchecked Sendable"]), ("Base.Kind", "enum", ["String"])]
    assert t[0]["documentation"] == "/// The base." and t[0]["visibility"] == "open" and t[0]["line"] == 5 and t[0]["generics"] == ["T: P"]
    assert [(r["name"], r["type_text"], r["value"]) for r in by("property")] == [("a", "Int", "1"), ("b", "[String: Int]", "[:]"), ("c", None, "make(x: 1)"), ("d", None, "make(x: 1)"), ("shared", "Base", ".init()"), ("description", "String", None), ("area", "Double", None), ("fallback", None, "2")]
    i = by("initializer")[0]
    assert i["keyword"] == "failable" and i["is_throwing"] and i["parameters"] == [{"label": None, "name": "a", "type_text": "Int"}]
    f = {r["name"]: r for r in by("function")}
    assert set(f) == {"run", "draw", "debug"} and f["run"]["return_type"] == "[U]?" and f["run"]["is_async"] and f["run"]["body_line_count"] == 4 and f["run"]["await_count"] == 1
    assert f["run"]["parameters"] == [{"label": None, "name": "x", "type_text": "@escaping (Int) -> Void"}, {"label": "with", "name": "y", "type_text": "U"}]
    assert f["run"]["attributes"] == [{"name": "MainActor", "arguments": None}] and f["draw"]["body_line_count"] == 0
    assert [(r["name"], r["value"], r["type_text"]) for r in by("enum_case")] == [("one", '"1"', None), ("two", None, None), ("three", None, "Int, label: String")]
    calls = {(r["value"], tuple(r["labels"])) for r in by("call")}
    assert {("store?.save", (None, "to")), ("go", ()), ("UIImage", ("named",)), ("make", ("x",)), ("super.init", ())} <= calls
    assert [(r["name"], r["preceding"]) for r in by("branch")] == [("DEBUG", []), ("", ["DEBUG"])]
    assert [r["seq"] for r in rows] == list(range(len(rows)))


def test_bindings_and_assignments():
    rows = facts("a.swift", "func f() {\n  let a = 1, b: Int\n  guard let c = d(e: 2), var g else { return }\n  x.y = a + 1\n  n += 2\n  if let h = i { j = h }\n  k(l: { m in m = 3 })\n}\n")
    assert [(r["name"], r["keyword"], r["value"]) for r in rows if r["kind"] == "binding"] == [("a", "let", "1"), ("c", "let", "d(e: 2)"), ("g", "var", None), ("h", "let", "i")]
    assert [(r["name"], r["keyword"], r["value"], r["owner"]) for r in rows if r["kind"] == "assignment"] == [("x.y", "=", "a + 1", "f"), ("n", "+=", "2", "f"), ("j", "=", "h", "f"), ("m", "=", "3", "f")]


def test_broken_and_empty_texts_do_not_crash():
    assert facts("a", None) == [] and facts("a", "") == []
    for k in range(0, len(CODE), 7):
        facts("a.swift", CODE[:k])
        facts("a.swift", CODE[k:])


def test_facts_table(spark):
    f = read_facts(readers.inline_sources(spark, {"b.swift": "actor A { }", "a.swift": CODE}))
    assert {r["name"] for r in view(f, "type", "actor", "class").collect()} == {"A", "Base"}


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_functions_agree_with_the_export(spark):
    files = {r["file_id"]: r["text"] for r in spark.read.parquet(f"{SF}/source_files.parquet").where("lang = 'swift'").collect()}
    seen = 0
    for r in spark.read.parquet(f"{SF}/function_decls.parquet").collect():
        got = {(x["line"], x["col"]): x for x in facts("f", files.get(r["file_id"])) if x["kind"] == "function"}
        x = got.get((r["line"], r["col"]))
        if x:
            seen += 1
            assert (x["name"], x["enclosing"], x["is_async"], x["is_throwing"], x["return_type"], x["body_line_count"]) == (r["name"], r["enclosing"], r["is_async"], r["is_throwing"], r["return_type"], r["body_line_count"])
            assert x["parameters"] == [p.asDict() for p in r["parameters"]]
    assert seen > 50
