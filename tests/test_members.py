import pytest
from pyspark.sql import functions as F

from factloom.functions import literals
from factloom.operators import collections_ as c
from factloom.operators import matcher as m
from factloom.operators import members
from factloom.sources.declarations import read_facts, view
from factloom.sources.readers import inline_sources

TEXT = """import Foundation
import struct Log.Entry
@available(iOS, deprecated: 13, message: "x, y") final class A: B {
  weak var owner: B?
  lazy var list: [Int] = { load(limit: 3) }()
  nonisolated(unsafe) static var shared: Optional<A> = nil
  override func run() { super.run(); store.save(item, at: 3) }
  mutating func other() { }
  convenience init(x: Int) { self.init() }
  let name = "a\\u{e4}\\n", n = -0xFF, d = 1_000.5, k = \\.a.b
}
indirect enum E { case a }
"""


@pytest.fixture(scope="module")
def facts(spark):
    return read_facts(inline_sources(spark, {"A.swift": TEXT, "B.swift": "let x = 1\n"})).cache()


def names(df, matcher):
    return {r["name"] for r in df.where(matcher.ok()).collect()}


def test_modifiers_and_attributes(facts):
    p, f = view(facts, "property"), view(facts, "function")
    assert names(p, m.is_weak()) == {"owner"} and names(p, m.is_lazy()) == {"list"} and names(p, m.is_static()) == {"shared"}
    assert names(p, m.is_nonisolated()) == names(p, m.is_nonisolated(unsafe=True)) == {"shared"} and names(p, m.is_nonisolated(unsafe=False)) == set()
    assert names(p, m.has_optional_type()) == {"owner", "shared"}
    assert names(f, m.is_override()) == {"run"} and names(f, m.is_mutating()) == {"other"} and names(f, m.is_dynamic()) == set()
    assert names(view(facts, "initializer"), m.is_convenience()) == {"init"} and names(view(facts, "type"), m.is_indirect()) == {"E"}
    t = view(facts, "type")
    assert names(t, m.has_attribute_argument("@available", "deprecated: 13")) == {"A"} and names(t, m.has_attribute_argument("available", "ios")) == set()
    assert t.where("name = 'A'").select(m.attribute("available")["name"]).first()[0] == "available"
    assert m.is_override().description() == "be an override" and m.grouped("be tidy", m.is_weak() & m.is_lazy()).description() == "be tidy"


def test_calls_and_imports(facts):
    calls = view(facts, "call")
    f = members.with_calls(view(facts, "function"), calls)
    assert names(f, m.calls("store.save(_:at:)")) == {"run"} and names(f, m.calls("load")) == set()
    assert names(calls, m.has_argument_label("at")) == {"save"}
    p = members.with_calls(view(facts, "property"), calls)
    assert names(p, m.calls("load(limit:)")) == {"list"}
    files = members.with_imports(facts.select("path", F.col("path").alias("name")).distinct(), view(facts, "import"))
    assert names(files, m.imports("Log", "Nothing")) == {"A.swift"} and files.where("name = 'B.swift'").first()["imports"] == []
    whole = members.with_calls(files, calls, by_owner=False)
    assert names(whole, m.calls("save")) == {"A.swift"}


def test_literals(spark):
    rows = [(r'"a\u{e4}\n\"\\"',), ('#"raw\\n"#',), (r'"x \(y)"',), ("-0xFF",), ("1_000",), ("99999999999999999999",), ("1_000.5e1",), ("true",), ("nil",), ("\\A.b.c",), ("a.b?.c",), ("f(x: 1)",), ("a.g<Int>(2)",), (None,), ('""',)]
    df = spark.createDataFrame(rows, "t string").withColumn("n", F.monotonically_increasing_id()).coalesce(1).orderBy("n")
    t = F.col("t")
    col = lambda f: [r[0] for r in df.select(f(t)).collect()]
    assert col(literals.string_value) == ['aä\n"\\', "raw\\n"] + [None] * 12 + [""]
    assert [x for x in col(literals.int_value) if x is not None] == [-255, 1000]
    assert [x for x in col(literals.double_value) if x is not None] == [1000.0, 1e20, 10005.0]
    assert [x for x in col(literals.bool_value) if x is not None] == [True] and sum(col(literals.is_nil)) == 1
    assert [x for x in col(literals.key_path) if x] == ["A.b.c"]
    assert [x for x in col(literals.reference_name) if x] == ["c"] and [x for x in col(literals.reference_base) if x] == ["a.b?"]
    assert [x for x in col(literals.callee) if x] == ["f", "a.g"]
    types = spark.createDataFrame([("[Int]",), ("[String: [Int]]",), ("Set<A>",), ("Array<B>?",), ("M.T<U>",)], "t string")
    assert [tuple(r) for r in types.select(literals.is_array_type(t), literals.is_dictionary_type(t), literals.is_set_type(t), literals.simple_type_name(t)).collect()][1:3] == [(False, True, False, "[String: [Int]]"), (False, False, True, "Set")]
    lines = spark.createDataFrame([("ab\tcd",), ("a" * 9,), ("x\r\n\ty",)], "t string")
    assert [r[0] for r in lines.select(literals.has_line_longer_than(t, 6)).collect()] == [False, True, False] and [r[0] for r in lines.select(literals.has_line_longer_than(t, 4)).collect()] == [True, True, True]


def test_generic_arguments_of_any_depth(spark):
    deep = "A" + "<B" * 12 + ">" * 12 + ".C"
    rows = [(deep,), ("Map<K, (A) -> B<C>>",), ("Plain",), ("M.T<U>.V",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(literals.without_generics(F.col("t"))).collect()]
    assert got == ["A.C", "Map", "Plain", "M.T.V", None]


def test_lists_sets_and_ranges(spark):
    df = spark.createDataFrame([("a", 3, None), ("a", 1, "x"), ("b", 2, "y"), ("b", None, "x")], "k string, v int, s string")
    g = c.grouped(df, ["k"], "v")
    assert {r["k"]: r["values"] for r in g.collect()} == {"a": [1, 3], "b": [None, 2]} and c.lookup(g, "k", "b").count() == 1 and c.lookup(g, "k", "z").count() == 0
    assert {tuple(r) for r in c.any_and_all(df, ["k"], {"one": F.col("v") == 1}, {"named": F.col("s").isNotNull()}).collect()} == {("a", True, False), ("b", False, True)}
    one, two = df.select("s"), spark.createDataFrame([("x",), (None,)], "s string")
    assert {r[0] for r in c.difference(one, two).collect()} == {"y"} and {r[0] for r in c.intersection(one, two).collect()} == {"x", None} and c.union(one, two).count() == 3
    row = spark.range(1).select(F.array(*[F.lit(x) for x in (3, 1, 2)]).alias("l"), F.lit(1).alias("i"))
    got = row.select(c.sorted_by(F.col("l"), lambda a, b: a > b), c.subscript(F.col("l"), F.col("i")), c.sliced(F.col("l"), F.lit(1), F.lit(3)), c.indices(F.col("l")), c.same_set(F.col("l"), F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(3))), c.compact_map(F.col("l"), lambda x: F.when(x > 1, x * 2)), c.flat_map(F.col("l"), lambda x: F.array(x, x)), c.in_range(F.col("i"), F.lit(0), F.lit(1)), c.in_range(F.col("i"), F.lit(0), F.lit(1), closed=True), c.range_count(F.lit(2), F.lit(5), True)).first()
    assert tuple(got) == ([3, 2, 1], 1, [1, 2], [0, 1, 2], True, [6, 4], [3, 3, 1, 1, 2, 2], False, True, 4)
    for bad in (c.subscript(F.col("l"), F.lit(3)), c.sliced(F.col("l"), F.lit(2), F.lit(9)), c.range_count(F.col("i"), F.lit(0))):
        with pytest.raises(Exception, match="range"):
            row.select(bad).collect()


def test_conditions_are_true_false_or_unknown(spark):
    from factloom.functions import conditions as k

    cases = [("os(Linux)", True), ("!os(Linux)", False), ("os(macOS) || os(Linux)", True), ("DEBUG && os(macOS)", False), ("DEBUG || os(Linux)", True), ("DEBUG", None), ("!(os(Windows) && DEBUG)", True), ("os(iOS)", None), ("(os(Linux)", None), ("swift(>=5.9) && os(Linux)", None), ("", None)]
    for text, want in cases:
        assert k.value(text, "Linux") is want, text
    assert [k.branch_value(c, p, "Linux") for c, p in (("os(macOS)", []), ("os(Linux)", ["os(macOS)"]), ("", ["os(macOS)"]), ("", ["os(Linux)"]), ("os(Linux)", ["DEBUG"]))] == [False, True, True, False, None]
    rows = read_facts(inline_sources(spark, {"a.swift": "#if os(Linux)\nimport A\n#elseif DEBUG\nimport B\n#else\nimport C\n#endif\n"}))
    got = [r["is_active"] for r in k.with_values(view(rows, "branch"), "Linux").orderBy("line").collect()]
    assert got == [True, False, False]


def test_requirements_and_texts(spark):
    from factloom.functions import versions as v

    rows = [("from:1.2.0", "1.9.9"), ("from:1.2.0", "2.0.0"), ("exact:1.2.0", "1.2.0"), ("exact:1.2.0", "1.2.1"), ("upToNextMinor:1.2.3", "1.2.9"), ("upToNextMinor:1.2.3", "1.3.0"), ("branch:main", "1.0.0"), ("from:1.2.0", "1.2.0-beta"), (None, "1.0.0")]
    df = spark.createDataFrame(rows, "r string, v string")
    assert [r[0] for r in df.select(v.allows(F.col("r"), F.col("v"))).collect()] == [True, False, True, False, True, False, None, False, None]
    got = df.select(v.minimum_version(F.col("r")), v.major_version(F.col("r")), v.is_exact_version(F.col("r"))).collect()
    assert tuple(got[0]) == ("1.2.0", 1, False) and tuple(got[2]) == ("1.2.0", 1, True) and tuple(got[6]) == (None, None, False)
    t = spark.createDataFrame([("éa", "éa"), ("x", None), (None, None), ("👩‍👩‍👧b", "b")], "a string, b string")
    assert [tuple(r) for r in t.select(literals.grapheme_count(F.col("a")), literals.same_text(F.col("a"), F.col("b"))).collect()] == [(2, True), (1, False), (None, True), (2, False)]
