import ast
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import docpairs
from factloom.llm.grammars import check
from factloom.llm.sources import documented_functions, parse_faults

VALID = {
    "swift": [
        "", "\ufeffimport Foundation\r\n", "#!/usr/bin/env swift\nprint(1)\n", "let a = b ? c : d\nlet e = f ?? g!\n", "/* a /* nested { */ b */ let x = 1",
        "struct A<T: P>: B, C where T.X == Int {\n  private(set) var x: Int { get { 1 } set { y = newValue } }\n  subscript(i: Int) -> T { a[i] }\n  init?(_ a: [Int: String] = [:]) throws { return nil }\n}\n",
        "protocol P: AnyObject { associatedtype Q: R\n  func f(_ a: inout Int, b c: @escaping (Int, Bool) -> Void) async throws -> [Q]?\n  var v: Int { get set }\n  init() }\n",
        "enum E: Int { case a = 1, b\n  indirect case c(E, label: Int)\n  static func == (l: E, r: E) -> Bool { l.rawValue == r.rawValue } }\n",
        "func f() {\n  guard let x = y, case .some(let z) = w, x > 3 else { return }\n  for (i, e) in list.enumerated() where e.rank > 2 { continue }\n  switch x { case 1, 2: break\n  case let .a(b) where b: f()\n  default: fallthrough }\n  do { try g() } catch let e as E { } catch { throw error }\n  defer { n -= 1 }\n  repeat { } while a < b\n}\n",
        'let s = "a \\(f("b", c: "\\(d)")) }"\nlet r = #"\\(no) " {"#\nlet m = """\n  { [ ( \\(x)\n  <<<<<<< ours\n  =======\n  """\n', "let a = list.map { $0.rank }.reduce(0, +) / 3\nf { a, b in a }\n  .g(x) { [weak self] (a: Int) -> Int in a } onEnd: { }\n",
        "#if DEBUG && os(iOS)\nimport A\n#elseif canImport(B)\nlet b = 1\n#else\n#endif\n", "let k = \\.a.b\nlet p = \\Type.x[0]\nlet t = (a: 1, b: 2).a\nlet g = Set<Result<Int, any Error>>()\n", "@available(*, deprecated, message: \"(\")\n@MainActor public final class A { deinit { } }\n",
        "let x = if a { 1 } else { 2 }\nlet y = switch z { case 1: 2\ndefault: 3 }\n", "actor A { nonisolated func f() async -> some Collection<Int> { await g() } }\n", "// =======\n/// <<<<<<< a\nlet c = 1 // >>>>>>> b",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9 {"]}', " [] ", "0"],
    "python": ["", "x = 1\n", 'def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n    """<<<<<<< x"""\n    return a if b else [i for i in c if i]\n', "class A(B):\n    @p\n    async def f(self):\n        async with a as b, c: pass\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise\nfinally:\n    del x, y\n", "match x:\n    case [1, *_] if y: pass\n", "f(*a, **b, c=1)\nx: int = (yield)\n", "if x:\n\tpass\nelse: pass"],
    "c": ["", "#ifndef A_H\n#define A_H\n#include <a.h>\n/* { */\ntypedef struct a { uint64_t x; const char *n; } a_t;\nint f(const char *p, uint32_t n);\n#endif /* A_H */\n", "static inline int f(int a[], void (*g)(int)) { for (int i = 0; i < 3; ++i) { a[i] += (uint8_t)g; } return sizeof(struct a); }\n", "enum e { A = 1, B, };\nint x = 1, *y = &x;\n"],
}
INVALID = {
    "swift": [
        "struct A {\n  func f() {\n}\n", "}\n", "func f(", "struct A { func f() -> Int }", 'let a = "open\n', 'let a = """\nopen', "/* open", "<<<<<<< ours\nlet a = 1\n=======\nlet a = 2\n>>>>>>> theirs\n", "let a = 1\n=======\n", "struct A {\n  let a = 1\n  <<<<<<< ours\n  let b = 1\n  =======\n  let b = 2\n  >>>>>>> theirs\n}\n", "let a = 1 +\n  let b = 2\n", "let a = 1 let b = 2\n",
        "#if DEBUG\nlet a = 1\n", "#endif\n", "<!DOCTYPE html>\n<html></html>\n", '{\n  "a": 1\n}\n', '"""Doc."""\nimport sys\n', "module: X\nlayers:\n  - name: D\n", "--- a/x\n+++ b/x\n", "# Title\n", "[12:04:19] building X\nexit status 65\n", "let a = (1, 2\n", "class { }\n", "let x = [1, 2\nlet y = 3\n",
    ],
    "json": ["", "{", '{"a": 1,}', "[1 2]", "{'a': 1}", '{"a": 1} x', "<<<<<<< a\n{}", '"a\nb"', "01", "[NaN]"],
    "python": ["def f(:\n  pass\n", "x = (1\n", "if x:\npass\n", "x = 'a\n", '"""a', "<<<<<<< a\nx = 1\n", "  x = 1\n", "def f()\n  pass\n", "return = 1\n", "if x:\n    a\n  b\n", "x y\n"],
    "c": ["int f(", "int x\n", "#ifndef A\n", "/* a", "struct a { int x; }", "#endif\n", "<<<<<<< a\nint x;\n", "int f(void) { return 1; ", "#unknown x\n"],
}


@pytest.mark.parametrize("lang", list(VALID))
def test_valid_and_invalid_texts(lang):
    for t in VALID[lang]:
        assert check(t, lang) is None, (t, check(t, lang))
    for t in INVALID[lang]:
        assert check(t, lang) is not None, t


def test_positions_and_causes():
    f = check("let a = 1\nlet b = (\n}\n", "swift")
    assert (f.line, f.col, f.cause) == (3, 1, "syntax")
    f = check("a\r\n<<<<<<< x\r\n", "swift")
    assert (f.line, f.col, f.cause, f.message) == (2, 1, "conflict", "merge marker in source file")
    assert check("func f() {\n", "swift").cause == "truncated" and check('{"a": 1}', "swift").cause == "wrong_language"
    assert check(None, "swift") is None and check("x", "cobol") is None and check("x", None) is None and check("{", " JSON ").line == 1


def test_long_and_deep_texts():
    assert check("[" * 5000 + "]" * 5000, "json") is None
    assert check("let a = " + "(" * 500 + "1" + ")" * 500, "swift") is None
    assert check("let a = 1\n" * 50_000, "swift") is None


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)), st.integers(0, 200))
def test_json_agrees_with_the_standard_library(value, cut):
    for t in (json.dumps(value), json.dumps(value, indent=1, ensure_ascii=False), json.dumps(value)[:-1], json.dumps(value)[cut:]):
        try:
            json.loads(t, parse_constant=lambda x: 1 / 0)
            ok = True
        except (ValueError, ZeroDivisionError):
            ok = False
        assert (check(t, "json") is None) == ok, t


def test_python_agrees_with_the_standard_library():
    import pathlib
    import statistics

    for m in (statistics, json.decoder, ast):
        t = pathlib.Path(m.__file__).read_text()
        assert check(t, "python") is None
        lines = t.split("\n")
        for k in range(1, len(lines), max(1, len(lines) // 25)):
            part = "\n".join(lines[:k]) + "\n"
            try:
                ast.parse(part)
                ok = True
            except SyntaxError:
                ok = False
            assert (check(part, "python") is None) == ok, k


SOURCE = '''
/// Saves what was changed since the last run.
@available(*, deprecated, message: "use (other")
public static func save<T: P>(_ a: [Int: String], to b: @escaping (Int, Bool) -> Void = { _, _ in }) async throws -> T? {
  /// Not this one either.
  func inner() { }
  let s = "/// no \\(f("}"))"
}
class A {
  /// The doc of a property.
  var x = 1
  func bare() { }
  /** Resets. */ func reset() { }
  /**
   * Drops whatever is older than a day.
   */

  // plain
  func drop() { }
#if DEBUG
  /// - Parameter x: y
  /// Keeps the order of arrival.
  func keep(x: Int) { if a { } else { } }
#endif
  var y: Int { /// in an accessor
    func no() { } ; return 1 }
  init() { /// in an init
    func no2() { } }
}
protocol P { /// trailing
  func t()
  /// Says how many there are.
  func count(of x: Int, `in` y: Int) -> Int }
extension A { struct B { enum C { case a
  //// no documentation
  func n() { }
  /// Operators work as well.
  static func + (l: C, r: C) -> C { l } } } }
'''


def test_documented_functions():
    found = {(f.name, f.signature): f for f in docpairs.functions(SOURCE)}
    assert set(found) == {("save", "save(_:to:)"), ("reset", "reset()"), ("drop", "drop()"), ("keep", "keep(x:)"), ("count", "count(of:in:)"), ("+", "+(l:r:)")}
    f = found[("save", "save(_:to:)")]
    assert (f.line, f.labels, f.names) == (4, (None, "to"), ("a", "b")) and f.code.startswith("@available") and f.code.rstrip().endswith("}")
    # A line that follows a field without a blank one goes on with it.
    assert docpairs.plain_sentences(found[("keep", "keep(x:)")].documentation) == ""
    assert docpairs.is_trivial(found[("reset", "reset()")].documentation, "reset")


def test_trivial_comments():
    for doc in ("///", "/// <#Description#>", "/// TODO: write\n/// this later", "/// MARK: - Load", "/// swiftlint:disable:next length", "/// See `other(_:)`.", "/// Loads the items.", "/// loadItems function.", "/// ```\n/// loadItems()\n/// ```", "/// - Parameter x: the first one\n/// - Returns: a lot", "/// ...", "/**\n * \n */", "/// Same as ``x()``", "/// N/A", None, ""):
        assert docpairs.is_trivial(doc, "loadItems"), doc
    for doc in ("/// Loads items from disk.", "/// Never blocks.", "/// ```\n/// x\n/// ```\n/// Oldest first.", "/// - Parameter x: y\n///\n/// Runs once.", "/// See `a` before you call it, since it may block."):
        assert not docpairs.is_trivial(doc, "loadItems"), doc


FILES = "file_id long, repository string, path string, name string, lang string, language_mode string, text string, ingested_at timestamp_ntz, cause string"


def test_tables_with_nulls_repeats_and_clashing_columns(spark):
    import datetime

    t = lambda n: datetime.datetime(2025, 1, n)
    doc = "/// Keeps the order of arrival.\nfunc f() { }\n"
    rows = [
        (1, "r", "a", "a", "swift", "5", doc, t(1), "x"), (1, "r", "a", "a", "swift", "5", doc, t(1), "x"), (2, None, None, None, " Swift ", None, "func f(", None, None), (3, "r", "c", "c", "json", None, None, t(1), ""),
        (4, "r", "d", "d", None, None, "}", t(1), ""), (None, "r", "e", "e", "swift", None, "}", t(1), ""), (5, "r", "f", "f", "swift", "6", "}", t(1), ""), (5, "r", "f", "f", "swift", "6", doc, t(2), ""), (6, "r", "g", "g", "swift", "6", "", t(2), ""),
    ]
    df = spark.createDataFrame(rows, FILES)
    assert {r["file_id"]: r["valid"] for r in parse_faults(df).collect()} == {1: True, 2: False, 5: True, 6: True}
    assert {(r["file_id"], r["line"], r["signature"]) for r in documented_functions(df).collect()} == {(1, 2, "f()"), (5, 2, "f()")}
    assert parse_faults(df.limit(0)).count() == 0 and documented_functions(df.limit(0)).count() == 0


def test_valid_forms_that_look_odd():
    good = {
        "swift": ["let a = m.reduce { first, _ in first }", "do { try f() } catch is E { }", "do { try f() } catch where x { }", "switch a { case is X: b()\ndefault: c() }", "func f() async { async let a = g()\n_ = await a }", "z >>= 7", "let s = t[..<i]", "struct S { static func == <A, B>(l: A, r: B) -> Bool { true } }", "let STRING = 1, NUMBER = 2\nvar EOF = STRING", "if #available(macOS 26, iOS 26, *), a { }", "guard let p = unsafe try? q() else { fatalError() }", "let x: Array<Array<Int>> = []", "if case is X = y { }"],
        "python": ["a.STRING\nNAME = NUMBER\n", "x = f'{a['b']}' f\"{d[\"k\"]!r:>{w}}\"\n", "x = f'{{}} {a:{b}}'\n", "s = rf'\\d{{2}} {x}'\n", "עִברִית = 1\n", "y = f'''{\n  a # note }\n}'''\n"],
        "c": ["int STRING = 1;\nint NUMBER;\n", "extern int remove (const char *name) __THROW;\n", "#ifdef __cplusplus\nextern \"C\" {\n#endif\nint a;\n#ifdef __cplusplus\n}\n#endif\n", "__BEGIN_DECLS\nint f(void) __nonnull ((1));\n__END_DECLS\n", "#if 0\nthis is ( no C\n#else\nint a;\n#endif\n", "#if A\nint f(int a) {\n#else\nint f(long a) {\n#endif\nreturn 1; }\n", "void f(void) {\n  LIST(a b, c)\n  each(p, q) { h(); }\n}\nDEFINE(x)\nint a;\n"],
        "json": ['{"a": [1, "STRING"]}'],
    }
    for lang, texts in good.items():
        for t in texts:
            assert check(t, lang) is None, (lang, t, check(t, lang))
    assert check("int f(void) { return 0 }", "c").message.startswith("expected ,, ;")
    bad = {"c": ["void f(void) {\n  g(x)\n}\n", "#if A\nint a;\n#else\nint f( {\n#endif\n", "#if A\nint a;\n#elif B\nint b\n#else\nint c;\n#endif\n"], "python": ["x = f'{a'\ny = (\n"], "swift": ["async func f() { }\nlet a = = 2"]}
    for lang, texts in bad.items():
        for t in texts:
            assert check(t, lang) is not None, (lang, t)


def test_messages_name_what_was_expected():
    assert check('{"a" 1}', "json").message == "expected :" and check('{"a": }', "json").message == "expected a value"
    assert check("class A {\n  var b = 1\n", "swift").message.startswith("the file ends too early: expected")
    assert "a name" in check("import\n", "python").message
    m = {check(t, "swift").message for t in ("func f(a Int) { }", "struct { }", "let a = )", "for in b { }")}
    assert len(m) == 4 and all("expected" in x for x in m)


def test_deep_nesting_is_no_fault():
    n = 20_000
    assert check("[" * n + "]" * n, "json") is None and check("[" * n + "]" * (n - 1), "json").cause == "truncated"
    assert check("x = " + "(" * 5_000 + "1" + ")" * 5_000 + "\n", "python") is None
    assert check("let x = " + "(" * 5_000 + "1" + ")" * 5_000, "swift") is None
