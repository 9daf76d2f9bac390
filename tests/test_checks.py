import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import edits, graph, index, layering, report
from factloom.plans import relations
from factloom.sources import readers
from factloom.streaming import editor


def test_layering_declarations():
    L, E = layering.Layer, layering.LayeringError
    for bad in ((L("A"), L("A")), (L("A", may=("B",)),), (L("A", may=("B",), forbidden=("B",)), L("B")), (L("A", may=("B",)), L("B", may=("A",))), (L("A", modules=("m",)), L("B", modules=("m",)))):
        with pytest.raises(E):
            layering.Layering(bad)
    x = layering.Layering((L("Domain", may=()), L("Data", may=("Domain",)), L("UI", forbidden=("Data",))))
    assert [x.allows("UI", "Domain"), x.allows("UI", "Data"), x.allows("Domain", "Data"), x.allows("Data", "Data")] == [True, False, False, True]


def test_layering_over_imports(spark):
    L = layering.Layer
    x = layering.Layering((L("Domain", ("Domain/**",), ("Domain",), may=()), L("Data", ("Data/**",), ("Data",), may=("Domain",)), L("UI", ("UI/**",), ("UI",), may=("Domain",), required=("Domain",))))
    imports = spark.createDataFrame([("Data/UserStore.swift", "Domain"), ("Data/UserStore.swift", "Foundation"), ("UI/HomeView.swift", "Domain"), ("UI/HomeView.swift", "Data"), ("UI/HomeView.swift", "SwiftUI"), (None, "Data")], "path string, module string")
    used = layering.used_edges(imports, x)
    assert [(r["path"], r["module"]) for r in layering.layering_violations(used, x).collect()] == [("UI/HomeView.swift", "Data")]
    assert layering.missing_required(used, x).count() == 0
    both = layering.Layering((L("A", ("a/**",)), L("B", ("**/b.swift",))))
    with pytest.raises(Exception, match="several layers"):
        spark.createDataFrame([("a/b.swift",)], "path string").select(both.layer_of(F.col("path"))).collect()


def test_stability_of_a_chain(spark):
    e = graph.edges(spark.createDataFrame([("Utils", "Logging"), ("Core", "Utils"), ("Data", "Core"), ("UI", "Core"), ("UI", "Core")], "a string, b string"), "a", "b")
    assert [(r["src"], r["dst"]) for r in graph.unstable_edges(e).collect()] == [("Core", "Utils")]
    assert graph.unstable_edges(e, ["Utils"]).count() == 0


def test_reachability_and_cycles(spark):
    e = graph.edges(spark.createDataFrame([("A", "C", 1), ("A", "B", 2), ("C", "D", 3), ("B", "D", 4), ("D", "B", 5), (None, "A", 6)], "a string, b string, n int"), "a", "b", "n")
    roots = spark.createDataFrame([("A",)], "node string")
    assert {(r["node"], r["level"]) for r in graph.reachable(e, roots).collect()} == {("C", 1), ("B", 1), ("D", 2)}
    assert {r["node"] for r in graph.reachable(e, spark.createDataFrame([("D",)], "node string"), reverse=True).collect()} == {"C", "B", "A"}
    assert graph.first_cycle(e) == ["D", "B", "D"]  # A, C, D, B, and back to D
    chain = graph.edges(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"), "a", "b")
    assert graph.first_cycle(chain) == []


def test_first_cycle_equals_a_depth_first_search(spark):
    import random

    def search(pairs):
        follow, nodes = {}, []
        for a, b in dict.fromkeys(pairs):
            follow.setdefault(a, []).append(b)
            nodes += [a, b]
        done = set()

        def visit(n, path):
            for x in follow.get(n, ()):
                if x in path:
                    return [*path[path.index(x) :], x]
                if x not in done and (got := visit(x, [*path, x])):
                    return got
            done.add(n)
            return []

        return next((c for n in dict.fromkeys(nodes) if n not in done and (c := visit(n, [n]))), [])

    random.seed(3)
    cases = [[("a", "z"), ("p", "q"), ("q", "p"), ("z", "y"), ("y", "z")], [("a", "z"), ("p", "q"), ("q", "p"), ("q", "a"), ("z", "y"), ("y", "z")], [("s", "s")]]
    cases += [[(random.choice("abcdefgh"), random.choice("abcdefgh")) for _ in range(n)] for n in (5, 9)]
    for pairs in cases:
        e = graph.edges(spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs)], "a string, b string, n int"), "a", "b", "n")
        assert graph.first_cycle(e) == search(pairs), pairs


def test_module_graph_keeps_edges_of_either_order(spark, tmp_path):
    pairs = {("A", "D"), ("D", "B"), ("B", "C"), ("C", "D"), ("C", "E"), ("F", "A"), ("B", "D")}
    modules = sorted({m for p in pairs for m in p})
    rows = [(f"s:{m}", m, 2) for m in modules] + [(f"s:{dst}", src, 4) for src, dst in pairs] + [("s:A", "A", 4), (None, "A", 4), ("s:B", None, 4)]
    spark.createDataFrame(rows, "usr string, module string, roles int").write.parquet(f"{tmp_path}/occurrences.parquet")
    core = set(pairs)
    while core != (core := {(a, b) for a, b in core if a in {y for _, y in core} and b in {x for x, _ in core}}):
        pass
    seen, todo = {"A"}, ["A"]
    while todo:
        n = todo.pop()
        new = {b for a, b in pairs if a == n} - seen
        seen, todo = seen | new, [*todo, *new]
    assert core == {("D", "B"), ("B", "C"), ("C", "D"), ("B", "D")}
    got = [tuple(r) for r in relations.acyclic_core(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(core)
    assert {r["node"] for r in relations.reachable(spark, str(tmp_path)).collect()} == seen - {"A"} == {"B", "C", "D", "E"}


def test_folder_layout(spark):
    files = [f"Sources/App/{p}/x.swift" for p in ("Orders/Models", "Orders/Views", "Orders/ViewModels", "Profile/Models", "Profile/Helpers")]
    df = spark.createDataFrame([(f,) for f in files], "path string")
    got = {tuple(r) for r in layering.folder_layout(df, "Sources/App/*", ["Models", "ViewModels", "Views"]).collect()}
    assert got == {("Sources/App/Profile", "ViewModels", "missing"), ("Sources/App/Profile", "Views", "missing"), ("Sources/App/Profile", "Helpers", "unexpected")}


def test_files_at_the_top_are_no_folders(spark):
    df = spark.createDataFrame([("README.md",), ("Sources/A/x.swift",)], "path string")
    assert [r["folder"] for r in layering.folder_groups(df, "*").collect()] == ["Sources"]
    assert {tuple(r) for r in layering.folder_layout(df, "*", ["B"]).collect()} == {("Sources", "B", "missing"), ("Sources", "A", "unexpected")}
    assert {tuple(r) for r in layering.nearest(df, spark.createDataFrame([("", 1), ("README.md", 2)], "folder string, v int")).collect()} == {("README.md", "", 1), ("Sources/A/x.swift", "", 1)}


def test_build_graphs_are_whole_or_fail(spark, tmp_path):
    def export(*targets):
        rows = [{"target": {"type": "RULE", "rule": {"name": n, "ruleClass": "lib", "ruleInput": list(d), "attribute": []}}, "configurationId": 1} for n, *d in targets]
        p = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        p.write_text(json.dumps({"results": rows, "configurations": [{"id": 1, "checksum": "c", "isTool": False}]}))
        return readers.build_graph(spark, str(p))

    t, e = export(("//a", "//b"), ("//b",))
    assert {(r["src_label"], r["dst_label"]) for r in e.collect()} == {("//a", "//b")} and t.count() == 2
    with pytest.raises(Exception, match="unknown target: //x"):
        export(("//a", "//x"))[1].collect()
    with pytest.raises(Exception, match="comes twice"):
        export(("//a",), ("//a",))[0].collect()


def test_baselines_match_nulls(spark):
    s = "rule string, name string, path string"
    rows = spark.createDataFrame([("r", None, "a"), ("r", "n", "a"), ("r", "n", "b")], s)
    base = spark.createDataFrame([("r", None, "a"), ("r", "n", "zzz")], s)
    assert {r["path"] for r in layering.accepted(rows, base).where("name is not null").collect()} == {"a", "b"} and layering.accepted(rows, base).count() == 2
    assert [r["path"] for r in layering.stale(base, rows).collect()] == ["zzz"]


def test_splice_and_conflicts(spark):
    assert edits.splice("aäb", [(1, 3, "o"), (4, 4, "!")]) == "aob!"
    for bad in ([(0, 2, ""), (1, 3, "")], [(1, 1, "x"), (1, 1, "y")], [(0, 99, "")]):
        with pytest.raises(edits.EditConflict):
            edits.splice("abcd", bad)
    df = spark.createDataFrame([("f", 0, 5, ""), ("f", 3, 4, ""), ("f", 7, 8, ""), ("g", 1, 2, ""), ("g", 1, 1, "")], "path string, start int, end int, replacement string")
    assert {(r["path"], r["start"], r["end"]) for r in edits.conflicts(df).collect()} == {("f", 3, 4), ("g", 1, 1)}


def test_reports(spark):
    e = spark.createDataFrame([("r", "error", "a\nb, 5%", "x:y,z.swift", 3, 4)], "rule string, level string, message string, path string, line int, column int")
    assert report.compiler_lines(e).first()[0] == "x:y,z.swift:3:4: error: a b, 5%"
    assert report.annotation_lines(e).first()[0] == "::error file=x%3Ay%2Cz.swift,line=3::a%0Ab, 5%25"
    assert '"startLine":3' in report.sarif_results(e).first()[0]
    some = "rule string, level string, message string, path string, line int, column int, kind string"
    e = spark.createDataFrame([("r", "error", "m\"", "Sources/My App/a#1.swift", 3, 4, None), ("r", "warning", "w", None, None, None, "warning"), (None, "error", None, "ä.swift", 1, None, "diagnostic")], some)
    rules_ = spark.createDataFrame([("r", "a rule", None, "error", "R.swift", 1, 2)], "id string, name string, hint string, level string, path string, line int, column int")
    assert sorted(r[0] for r in report.compiler_lines(e, rules_, quiet=False).collect()) == sorted(['Sources/My App/a#1.swift:3:4: error: m"', "<unknown>: warning: w", "ä.swift:1: error: ", "R.swift:1:2: note: rule 'r' is declared here", "Checked 1 rule: 3 violations."])
    assert {r[0] for r in report.annotation_lines(e).collect()} == {'::error file=Sources/My App/a#1.swift,line=3::m"', "::warning::w", "::error file=ä.swift,line=1::"}
    whole = json.loads("".join(r["line"] for r in report.json_document(e, rules_).collect()))
    assert whole["schemaVersion"] == 1 and whole["summary"] == {"checkedRules": 1, "violations": 1} and sorted(x["kind"] for x in whole["events"]) == ["diagnostic", "violation", "warning"]
    log = json.loads("".join(r["line"] for r in report.sarif_log(e, rules_).collect()))["runs"][0]
    assert {x["locations"][0]["physicalLocation"]["artifactLocation"].get("uri") for x in log["results"]} == {"Sources/My%20App/a%231.swift", None}
    assert log["invocations"][0]["executionSuccessful"] is False and len(log["invocations"][0]["toolExecutionNotifications"]) == 1 and log["tool"]["driver"]["rules"][0]["id"] == "r"
    empty = json.loads("".join(r["line"] for r in report.sarif_log(e.limit(0), rules_).collect()))["runs"][0]
    assert empty["results"] == [] and empty["invocations"][0]["executionSuccessful"] is True


def test_readers(spark, tmp_path):
    (tmp_path / "App" / "Gen").mkdir(parents=True)
    (tmp_path / "App" / "A b.swift").write_text("let a = 1\nlet b = 2\n")
    (tmp_path / "App" / "Gen" / "B.swift").write_text("")
    (tmp_path / "App" / "no.txt").write_text("x")
    got = readers.source_files(spark, str(tmp_path), excluding=["**/Gen/**"]).collect()
    assert [(r["path"], r["name"], r["line_count"]) for r in got] == [("App/A b.swift", "A b.swift", 3)]
    disk = readers.inline_sources(spark, {"a.swift": "x", "b.swift": "y"})
    o = readers.with_overlay(disk, spark.createDataFrame([("b.swift", "z"), ("c.swift", "w")], "path string, text string"))
    assert {(r["path"], r["text"]) for r in o.collect()} == {("a.swift", "x"), ("b.swift", "z"), ("c.swift", "w")}
    spark.dataSource.register(readers.Folders)
    assert {r["path"] for r in spark.read.format("source_folders").option("root", str(tmp_path)).load().collect()} == {"App", "App/Gen"}


def test_incremental_rules(spark):
    deps = spark.createDataFrame([("r1", "file", "A/b"), ("r2", "descendants", "A"), ("r3", "descendants", "B")], "rule string, kind string, path string")
    assert {r["rule"] for r in editor.affected_rules(spark.createDataFrame([("A/b",)], "path string"), deps).collect()} == {"r1", "r2"}


def test_newest_results_on_a_stream(spark, tmp_path):
    src, out = tmp_path / "in", []
    src.mkdir()
    (src / "1.json").write_text('{"uri":"a","generation":2,"result":"x"}\n{"uri":"a","generation":1,"result":"old"}\n')
    stream = spark.readStream.schema("uri string, generation long, result string").json(str(src))
    q = editor.newest_results(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in out] == [("a", 2, "x", True)]


def test_definitions_and_references(spark):
    occ = spark.createDataFrame([("u", "f", "fn", "M", "a.swift", 1, 1, 2), ("u", "f", "fn", "M", "b.swift", 3, 5, 4), ("u", "f", "fn", "M", "b.swift", 2, 5, 4), ("u", "f", "fn", "M", "b.swift", 2, 5, 4), ("v", "g", "fn", "M", "a.swift", 2, 1, 2), ("v", "g", "fn", "M", "c.swift", 2, 1, 2), ("v", "g", "fn", "M", "b.swift", 9, 1, 4)], "usr string, name string, kind string, module string, file string, line int, col int, roles long")
    assert [tuple(r) for r in index.file_references(occ).collect()] == [("b.swift", "a.swift", 2, 5, 2)]
    assert {(r["usr"], r["ambiguous"]) for r in index.definition_files(occ).collect()} == {("u", False), ("v", True)}


def test_list_edits():
    t = 'f(a, "x, (", [1, 2])\ng()\nh(\n  ä,\n  b\n)\n'
    g, h = t.encode().index(b"g(") + 1, t.encode().index(b"h(") + 1
    apply = lambda *e: edits.splice(t, list(e))
    assert apply(edits.insert_element(t, 1, 1, "z")).startswith('f(a, z, "x, (", [1, 2])')
    assert apply(edits.insert_element(t, 1, 3, "z")).startswith('f(a, "x, (", [1, 2], z)')
    assert "g(z)" in apply(edits.insert_element(t, g, 0, "z"))
    assert "h(\n  ä,\n  b,\n  z\n)" in apply(edits.insert_element(t, h, 2, "z"))
    assert apply(edits.remove_element(t, 1, 0)).startswith('f("x, (", [1, 2])') and apply(edits.remove_element(t, 1, 2)).startswith('f(a, "x, (")')
    assert "h(\n  b\n)" in apply(edits.remove_element(t, h, 0))
    assert edits.splice("if ((a)) { }", edits.unwrap("if ((a)) { }", 3)) == "if (a) { }"
    for bad in (lambda: edits.insert_element(t, 1, 9, "z"), lambda: edits.remove_element(t, g, 0), lambda: edits.insert_element("f(a", 1, 0, "z"), lambda: edits.unwrap("()", 0)):
        with pytest.raises(edits.EditConflict):
            bad()


def test_wrapped_lists():
    assert edits.wrapped("(", ["a", "b"], ")") == "(a, b)"
    assert edits.wrapped("(", ["aaa", "bbb"], ")", "  ", 8) == "(\n    aaa,\n    bbb\n  )"
    with pytest.raises(ValueError):
        edits.wrapped("(", [], ")", width=0)


def test_nearest_settings(spark):
    files = spark.createDataFrame([("A/B/c.swift",), ("A/c.swift",), ("D/e.swift",)], "path string")
    modes = spark.createDataFrame([("A", "5"), ("A/B", "6")], "folder string, language_mode string")
    assert {tuple(r) for r in layering.language_modes(files, modes, "4").collect()} == {("A/B/c.swift", "6"), ("A/c.swift", "5"), ("D/e.swift", "4")}
