import pytest
from pyspark.sql import functions as F

from factloom.functions import layout as l
from factloom.operators import corrections as c
from factloom.operators import matcher as m
from factloom.operators.selection import NameFilter, Roles, Selection, manual
from factloom.streaming import editor

P = "rule string, proposal long, path string, start int, end int, replacement string"


def test_plans_reject_what_overlaps_or_breaks_a_file(spark):
    files = spark.createDataFrame([("a.swift", "let ab = 1\n"), ("b.swift", "f(1)\n"), ("c.swift", "let c = 3\n")], "path string, text string")
    rows = [("r", 1, "a.swift", 4, 6, "xy"), ("s", 2, "a.swift", 4, 6, "xy"), ("r", 3, "a.swift", 9, 10, "2"), ("t", 4, "b.swift", 1, 2, ""), ("t", 5, "b.swift", 2, 3, "9")]
    rows += [("u", 6, "c.swift", 4, 5, "d"), ("u", 7, "c.swift", 5, 5, "!"), ("v", 8, "gone.swift", 0, 0, "x"), ("v", 9, "c.swift", 8, 9, "4"), ("v", 10, "c.swift", 99, 100, "")]
    changes, rejected = c.plan(files, spark.createDataFrame(rows[:-1], P))
    assert {(r["path"], r["text"]) for r in changes.collect()} == {("a.swift", "let xy = 2\n"), ("c.swift", "let c = 4\n")}
    assert {r["proposal"]: r["reason"][:20] for r in rejected.collect()} == {4: "cannot prepare the c", 5: "cannot prepare the c", 6: "the correction overl", 7: "the correction overl", 8: "the file is not part"}
    assert "-let ab = 1\n+let xy = 2" in c.patch(changes.where("path = 'a.swift'")).first()["diff"]
    changes, rejected = c.plan(files, spark.createDataFrame(rows[:3] + rows[8:9], P), scope=["sub"], protected=["c.swift"])
    assert changes.count() == 0 and {r["proposal"] for r in rejected.collect()} == {1, 2, 3, 9}


def test_outcomes_combine(spark):
    e = "array<struct<path:string,start:int,end:int,replacement:string>>"
    rows = [(["satisfied", "undetermined"], [[], [("a", 0, 1, "x")]]), (["violation", "unavailable"], [[("a", 0, 1, "x")], None]), (["violation", "satisfied"], [[("a", 0, 1, "x")], []]), (["not_applicable", "satisfied"], [None, None]), (["not_applicable"], [None])]
    df = spark.createDataFrame(rows, f"o array<string>, e array<{e}>")
    got = [(r["x"]["outcome"], len(r["x"]["edits"])) for r in df.select(c.combined(F.col("o"), F.col("e")).alias("x")).collect()]
    assert got == [("undetermined", 0), ("unavailable", 0), ("violation", 1), ("satisfied", 0), ("not_applicable", 0)]
    one = spark.createDataFrame([(None, None), (False, None), (True, []), (True, [("a", 0, 1, "")])], f"f boolean, e {e}")
    assert [r[0] for r in one.select(c.outcome(F.col("f"), F.col("e"))).collect()] == ["not_applicable", "satisfied", "unavailable", "violation"]
    rows = spark.createDataFrame([("A", "a.swift", 3), ("B", "b.swift", 5)], "name string, path string, at int")
    v = Selection(rows, Roles(order=("path",), line=None, column=None)).violations(of=m.named("A"))
    fix = F.array(F.struct(F.col("path"), F.col("at").alias("start"), (F.col("at") + 1).alias("end"), F.lit("A").alias("replacement")))
    assert [(r["path"], r["start"], r["end"], r["replacement"]) for r in c.with_fix(v, fix, ["path", "name"]).collect()] == [("b.swift", 5, 6, "A")]


def test_layouts():
    o = l.Options(width=14)
    assert l.render(l.line("a", "b", l.joined("c", ","))) == "a b c,"
    assert l.render(l.joined("f(", l.indent(l.NEWLINE, l.lines("x,", "y")), l.NEWLINE, ")"), margin="  ") == "f(\n    x,\n    y\n  )"
    assert l.render(l.wrap("alpha", "beta", "gamma", "delta"), o) == "alpha beta\ngamma delta"
    assert l.render(l.joined("call(", l.align(l.lines("a,", "b")), ")")) == "call(a,\n     b)"
    assert l.render(l.lines("a", l.BLANK, "b", "c")) == "a\n\nb\nc"
    assert l.render(l.lines(*l.blank_between(["var a", "func b", "func c"], lambda x: x.startswith("func")))) == "var a\nfunc b\n\nfunc c"
    assert l.grouped(["b1", "a2", "c", "a1"], [lambda x: x[0] == "a", lambda x: x[0] == "b"], {0: str}) == [["a1", "a2"], ["b1"], ["c"]]
    assert l.arranged(["x", "y"], lambda e: l.lines(*e)) == "x\ny" and l.longest_line("a\tb\r\nabc", 4) == 5
    assert l.if_fits("long line", l.lines("long", "line"), 5, 20) == "long\nline" and l.if_fits("abc", l.lines("x"), 5, 20) == "abc"
    for bad in (lambda: l.arranged(["x", "y"], lambda e: l.lines(e[0], e[0])), lambda: l.arranged([], lambda e: l.lines()), lambda: l.Options(width=0), lambda: l.render(l.line("a", l.NEWLINE))):
        with pytest.raises(l.LayoutError):
            bad()


def test_selections_as_values(spark):
    df = spark.createDataFrame([("ALoader", "x/a", 1), ("BLoader", "y/b", 2), ("C", "x/c", 3), (None, "x/d", 4)], "name string, path string, seq int")
    s = Selection(df, Roles(), "types")
    f = s.filtering([NameFilter("suffixed", ("Loader",)), NameFilter("under", ("x",))])
    assert [r["name"] for r in f] == ["ALoader"] and f[0]["seq"] == 1 and s.filtering([]).count() == 4
    with pytest.raises(IndexError):
        f[1]
    with pytest.raises(ValueError):
        NameFilter("like", ("x",))
    rows = {(r["step"], r["seq"], r["selected"]) for r in f.inspect_rows(df, ["seq"]).collect()}
    assert rows == {(0, 1, True), (0, 2, True), (0, 3, False), (0, 4, False), (1, 1, True), (1, 2, False)}
    assert tuple(manual("be nice", df.limit(1), df).counts().first()) == (4, 1)


def test_editor_state(spark, tmp_path):
    old = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "uri string, diagnostics array<string>")
    new = spark.createDataFrame([("b", ["z"])], "uri string, diagnostics array<string>")
    got = {r["uri"]: r["diagnostics"] for r in editor.snapshot(old, new, spark.createDataFrame([("c",)], "uri string")).collect()}
    assert got == {"a": [], "b": ["z"], "c": []}
    lines = spark.createDataFrame([("aä😀b", 1), ("aä😀b", 4), ("aä😀b", 8), ("a", 99)], "l string, c int")
    assert [r[0] for r in lines.select(editor.utf16_column(F.col("l"), F.col("c"))).collect()] == [0, 2, 4, 1]
    deps = editor.captured(spark.createDataFrame([("r", "file", "A/x"), ("r", "file", "A/x"), ("s", "descendants", "B"), ("t", "clock", None), ("t", "file", "C")], "rule string, kind string, path string"))
    assert {r["rule"] for r in deps.collect()} == {"r", "s"} and deps.count() == 2
    kept = editor.invalidated(spark.createDataFrame([("r", 1), ("s", 2), ("t", 3)], "rule string, n int"), spark.createDataFrame([("B/q",)], "path string"), deps)
    assert {r["rule"] for r in kept.collect()} == {"r"}
    src, out = tmp_path / "in", []
    src.mkdir()
    (src / "1.json").write_text('{"uri":"a","generation":1,"result":"x","parsed":true}\n{"uri":"a","generation":2,"result":"bad","parsed":false}\n')
    stream = spark.readStream.schema("uri string, generation long, result string, parsed boolean").json(str(src))
    q = editor.last_good_results(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in out] == [("a", 2, "x", True)]
