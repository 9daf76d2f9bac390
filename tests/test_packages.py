import pytest

from factloom.operators import dependencies, packages
from factloom.sources import manifest, readers

MANIFEST = """// swift-tools-version: 5.9
import PackageDescription
let package = Package(
  name: "Kit",
  products: [.library(name: "Kit", targets: ["UI"])],
  targets: [
    .target(name: "Core-Base"),
    .target(name: "Data", dependencies: ["Core-Base", .product(name: "Log", package: "log")], exclude: ["Generated"]),
    .target(name: "UI", dependencies: [.target(name: "Data")], path: "Sources/App", sources: ["Views", "Main.swift"]),
    .target(name: "Open", dependencies: ["Data", makeOne()]),
    .target(name: "Nothing"),
    .plugin(name: "Gen", capability: .buildTool(), dependencies: ["Data"]),
    .testTarget(name: "UITests", dependencies: ["UI"]),
  ]
)
"""
IMPORTS = [("Sources/Core-Base/a.swift", "Foundation"), ("Sources/Data/b.swift", "Log"), ("Sources/Data/Generated/g.swift", "UI"), ("Sources/App/Views/v.swift", "Core_Base"), ("Sources/App/Main.swift", "UI"), ("Sources/App/Other.swift", "Open"), ("Sources/Open/o.swift", "UI"), ("Plugins/Gen/p.swift", "Foundation"), ("Tests/UITests/t.swift", "UI"), ("README.md", "UI")]


@pytest.fixture(scope="module")
def package(spark):
    m = manifest.read_manifests(readers.inline_sources(spark, {"Package.swift": MANIFEST})).cache()
    files = spark.createDataFrame([(p, "x") for p, _ in IMPORTS] + [(None, "x")], "path string, target string")
    imports = spark.createDataFrame([(p, m_, 3, 1) for p, m_ in IMPORTS], "path string, module string, line int, col int")
    return m, files, imports


def test_files_of_targets(package):
    got = {tuple(r) for r in packages.target_files(package[0], package[1]).collect()}
    assert got == {("Core-Base", "Sources/Core-Base/a.swift"), ("Data", "Sources/Data/b.swift"), ("UI", "Sources/App/Views/v.swift"), ("UI", "Sources/App/Main.swift"), ("Open", "Sources/Open/o.swift"), ("Gen", "Plugins/Gen/p.swift"), ("UITests", "Tests/UITests/t.swift")}


def test_package_dependencies(package):
    undeclared, unused, empty = packages.check_dependencies(*package)
    # Open's list is not fully known, Nothing has no files, plug-ins run what they depend on.
    assert [(r["target"], r["module"], r["path"]) for r in undeclared.collect()] == [("UI", "Core_Base", "Sources/App/Views/v.swift")]
    assert {tuple(r) for r in unused.collect()} == {("Data", "Core-Base"), ("UI", "Data")}
    assert [r["target"] for r in empty.collect()] == ["Nothing"]
    assert packages.check_dependencies(*package, ignoring=["UI", "Nothing"])[0].count() == 0


def test_relations_of_targets(package):
    m = package[0]
    assert {r["dst"] for r in packages.package_edges(*package).where("src = 'UI'").collect()} == {"Core-Base"}
    assert {r["target"] for r in packages.direct_dependencies(m, "UI").collect()} == {"Data"}
    assert {tuple(r) for r in packages.transitive_dependencies(m, "UITests").collect()} == {("UI", 1), ("Data", 2), ("Core-Base", 3)}
    assert {r["target"] for r in packages.tests_depending_on(m, "Data").collect()} == {"UITests"}
    assert {r["target"] for r in packages.shipped_targets(m).collect()} == {"UI", "Data", "Core-Base"}
    assert [tuple(r) for r in packages.products_containing(m, "UI").collect()] == [("Kit", "known")]


OCC = "usr string, name string, kind string, module string, file string, line int, col int, roles long"


def test_dependencies_between_groups(spark):
    rows = [("a", "A", "class", "M", "M/A/a.swift", 1, 1, 2), ("b", "B", "class", "M", "M/B/b.swift", 1, 1, 2), ("c", "C", "class", "N", "N/C/c.swift", 1, 1, 2)]
    rows += [("b", "B", "class", "M", "M/A/a.swift", 9, 2, 4), ("b", "B", "class", "M", "M/A/a.swift", 5, 7, 4), ("c", "C", "class", "M", "M/B/b.swift", 2, 2, 4), ("a", "A", "class", "N", "N/C/c.swift", 3, 3, 4), ("a", "A", "class", None, None, 1, 1, 4)]
    occ = spark.createDataFrame(rows, OCC)
    got = {(r["src_file"], r["dst_file"], r["line"]) for r in dependencies.check_dependencies(occ, ["**/*.swift"], ["**/A/**"], ["*"]).collect()}
    assert got == {("M/B/b.swift", "N/C/c.swift", 2)}
    groups = {"a": ["M/A/**"], "b": ["M/B/**"], "c": ["N/**"]}
    ring = dependencies.check_cycles(occ, groups).orderBy("step").collect()
    assert [(r["src"], r["dst"], r["line"]) for r in ring] == [("a", "b", 5), ("b", "c", 2), ("c", "a", 3)]
    assert dependencies.check_cycles(occ.where("file <> 'N/C/c.swift'"), groups).count() == 0
    with pytest.raises(Exception, match="several groups"):
        dependencies.group_edges(occ, {"a": ["M/**"], "b": ["M/B/**"]}).collect()
    with pytest.raises(Exception, match="several folders"):
        dependencies.check_dependencies(occ, ["**/*.swift"], [], ["*", "*/A"]).collect()
    assert dependencies.only_modules(occ, ["N"]).count() == 2
    assert {r["message"] for r in dependencies.index_query(occ, "A", "Z")[1].collect()} == {"the index has no symbol named 'Z'"}


def test_conformers_end_on_circles(spark):
    rel = spark.createDataFrame([("x", "P"), ("y", "x"), ("P", "y"), ("z", None), ("w", "Q")], "usr string, base string")
    assert {tuple(r) for r in dependencies.conformers(rel, "P").collect()} == {("x", 1), ("y", 2)}
    assert {r["node"] for r in dependencies.conformers(rel, "P", direct=True).collect()} == {"x"}
