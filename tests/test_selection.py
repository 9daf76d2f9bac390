import itertools
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.operators import matcher as m
from factloom.operators.selection import Roles, Selection

ROWS = [
    ("BaseViewModel", "App/BaseViewModel.swift", 1, "class", False, []), ("HomeViewModel", "App/HomeViewModel.swift", 2, "class", True, ["BaseViewModel"]),
    ("CartViewModel", "Shop/CartViewModel.swift", 3, "class", True, ["BaseViewModel", "@unchecked Sendable"]), (None, None, 4, "struct", None, None),
]


@pytest.fixture(scope="module")
def classes(spark):
    df = spark.createDataFrame(ROWS, "name string, path string, seq int, keyword string, is_final boolean, inherited array<string>")
    return Selection(df.withColumn("line", F.col("seq")).withColumn("col", F.lit(1)), Roles(order=("seq",)), "classes")


def names(s):
    return [r["name"] for r in s.df.orderBy("seq").collect()]


def test_filters_are_two_valued_and_described(classes):
    assert names(classes.suffixed("ViewModel").excluding("BaseViewModel")) == ["HomeViewModel", "CartViewModel"]
    assert names(classes.excluding("HomeViewModel")) == ["BaseViewModel", "CartViewModel"]  # no name: left out as well
    assert names(classes.where(~(m.field("is_final") == True))) == ["BaseViewModel", None]  # noqa: E712
    assert names(classes.where(m.field("is_final") != None)) == ["BaseViewModel", "HomeViewModel", "CartViewModel"]  # noqa: E711
    assert names(classes.under("./App/")) == ["BaseViewModel", "HomeViewModel"]
    s = classes.under("../Elsewhere")
    assert s.is_empty() and s.warnings == ("'../Elsewhere' is outside the codebase root",)
    assert classes.suffixed("A", "B").description == "classes suffixed 'A' or 'B'"
    with pytest.raises(ValueError):
        classes.name_matching("(")


def test_descriptions():
    a, b, c = m.named("A"), m.flag("final", "f"), m.is_public()
    assert (a & b).description() == "be named 'A' and be final"
    assert ((a & b) | ~c).description() == "((be named 'A' and be final) or not be public)"
    assert (~(a & b)).description() == "not (be named 'A' and be final)"
    assert (m.field("line_count") <= 5).description() == "have a line_count of at most 5"


def test_reports_name_the_witness_first(spark):
    rows = [("a", "A.swift", 1, 2, [("p", 7, 9), ("@q", 8, 3)]), ("b", "B.swift", 4, 5, [("@r", None, None)])]
    df = spark.createDataFrame(rows, "name string, path string, line int, col int, members array<struct<name:string,line:int,col:int>>")
    v = Selection(df, Roles(order=("path",))).violations(of=m.all_members("members", "be plain", lambda x: ~x["name"].startswith("@")))
    assert sorted((r["path"], r["line"], r["column"]) for r in v.erased().collect()) == [("A.swift", 8, 3), ("B.swift", 4, 5)]


def test_violations_and_witnesses(classes):
    v = classes.suffixed("ViewModel").violations(of=m.directly_inherits("BaseViewModel"))
    assert [r["name"] for r in v.erased().collect()] == ["BaseViewModel"]
    assert tuple(v.counts().first()) == (3, 1)
    w = classes.violations(of=m.all_members("inherited", "be plain", lambda x: ~x.startswith("@")))
    assert [(r["name"], r["witness"]) for r in w.offenders.collect()] == [("CartViewModel", "@unchecked Sendable")]
    assert names(classes.where(m.directly_conforms("Sendable"))) == ["CartViewModel"]
    assert names(classes.where(m.declares_inheritance("Sendable"))) == []


def test_order_and_size(classes):
    assert [r["seq"] for r in classes.sorted("keyword").df.collect()] == [1, 2, 3, 4]
    assert [r["seq"] for r in classes.reversed().df.collect()] == [4, 3, 2, 1]
    assert [r["seq"] for r in classes.prefix(2).df.collect()] == [1, 2]
    assert [r["seq"] for r in classes.drop_first().df.collect()] == [2, 3, 4]
    assert names(classes.prefix_while(m.field("seq") < 3)) == ["BaseViewModel", "HomeViewModel"]
    with pytest.raises(ValueError):
        classes.only()
    with pytest.raises(ValueError):
        classes.prefix(-1)
    assert classes.named("HomeViewModel").only()["seq"] == 2 and "1 element" in repr(classes.named("HomeViewModel"))


CALLS = [
    ("UIImage", ["named"], "UIImage(named:)", True), ("UIImage", [], "UIImage(named:)", False), ("UIImage", [], "UIImage()", True), ("Task.detached", [], "Task.detached", True),
    ("store.save", [None, "to"], "save(_:to:)", True), ("session?.dataTask", [], "session.dataTask()", True), ("factory!.make", [], "make", True), ("a.b.c", [], "b.c", True), ("a.b.c", [], "a.c", False),
]


def test_call_references(spark):
    for called, labels, wanted, expected in CALLS:
        df = spark.createDataFrame([(called, labels)], "called string, labels array<string>")
        assert df.select(m.two_valued(m.call_references(F.col("called"), F.col("labels"), wanted))).first()[0] is expected, (called, wanted)


def plain(glob, path):
    """The meaning of a glob, part by part."""
    g, p = glob.strip("/").split("/"), path.split("/")

    def part(pattern, text):
        return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), text) is not None

    def go(i, j):
        if i == len(g):
            return j == len(p)
        if g[i] == "**":
            return go(i + 1, j) or (j < len(p) and go(i, j + 1))
        return j < len(p) and part(g[i], p[j]) and go(i + 1, j + 1)

    return go(0, 0)


def test_globs_exhaustively(spark):
    parts = ["**", "*", "a", "a*b", "?"]
    globs = ["/".join(x) for n in (1, 2, 3) for x in itertools.product(parts, repeat=n)]
    texts = ["/".join(x) for n in (1, 2, 3) for x in itertools.product(["a", "b", "aab", "c.swift"], repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "path string").coalesce(1)
    for k in range(0, len(globs), 40):
        got = df.select("path", *[paths.matches_any(F.col("path"), [g]).alias(str(i)) for i, g in enumerate(globs[k : k + 40])]).collect()
        for r in got:
            for i, g in enumerate(globs[k : k + 40]):
                assert r[str(i)] == plain(g, r["path"]), (g, r["path"])


def test_many_stars_stay_linear(spark):
    df = spark.createDataFrame([("a" * 3000,)], "path string")
    assert df.where(paths.matches_any(F.col("path"), ["*a" * 40 + "b"])).count() == 0
