import pytest
from pyspark.sql import functions as F

from factloom.functions.versions import version_key
from factloom.operators import matcher as m
from factloom.operators import rules
from factloom.operators.selection import Roles, Selection
from factloom.sources import manifest, readers

MANIFEST = '''// swift-tools-version: 5.9
import PackageDescription
let prefix = "Core"
let shared: [Target.Dependency] = ["Domain", .product(name: "Log", package: "swift-log")]
let package = Package(
  name: prefix + "Kit",
  platforms: [.macOS(.v13), .iOS("16.0")],
  products: [.library(name: "Kit", targets: ["Domain", "Data"])],
  dependencies: [.package(url: "https://x.example/swift-log.git", from: "1.2.0"), .package(path: "../Local"), .package(url: "https://x.example/a", .upToNextMajor(from: "2.0.0"))],
  targets: [
    .target(name: "Domain"),
    .target(name: "Data", dependencies: shared + ["Net"], path: "Src/Data", exclude: ["README.md"]),
    .testTarget(name: "DataTests", dependencies: [.target(name: "Data", condition: .when(platforms: [.linux])), makeOne()]),
  ]
)
#if os(Linux)
package.targets += [.target(name: "LinuxOnly")]
#endif
package.targets.append(.executableTarget(name: "tool"))
'''


def test_manifest(spark):
    got = [tuple(r) for r in manifest.read_manifests(readers.inline_sources(spark, {"Package.swift": MANIFEST})).orderBy("position").collect()]
    rows = {(k, n): (t, o, v, q, s) for _, k, n, t, o, v, q, _, s in got}
    assert ("package", "CoreKit") in rows and rows[("platform", "macOS")][2] == "v13"
    assert rows[("dependency", "swift-log")] == ("url", None, "https://x.example/swift-log.git", "from:1.2.0", "known")
    assert rows[("dependency", "a")][3] == "upToNextMajor:2.0.0" and rows[("dependency", "Local")][0] == "path"
    assert rows[("target", "Data")][2] == "Src/Data" and rows[("target", "DataTests")][2] == "Tests/DataTests" and rows[("target", "LinuxOnly")][4] == "conditional" and rows[("target", "tool")][0] == "executableTarget"
    deps = {(o, n): s for _, k, n, _, o, _, _, _, s in got if k == "target_dependency"}
    assert deps[("Data", "Domain")] == deps[("Data", "Log")] == deps[("Data", "Net")] == "known" and deps[("DataTests", "Data")] == "conditional"
    assert [s for (o, n), s in deps.items() if o == "DataTests" and n != "Data"] == ["unresolved"]
    df = spark.createDataFrame(got, manifest.SCHEMA)
    assert {(r["owner"], r["complete"]) for r in manifest.is_complete(df, "target_dependency").collect()} == {("Data", True), ("DataTests", False)}
    assert manifest.rows("p", None) == [] and isinstance(manifest.rows("p", MANIFEST[:400]), list)


def test_versions(spark):
    ordered = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.10.0", "2.0.0"]
    df = spark.createDataFrame([(v,) for v in reversed(ordered)], "v string")
    assert [r["v"] for r in df.orderBy(version_key(F.col("v"))).collect()] == ordered
    bad = spark.createDataFrame([("1.0",), (None,), ("01.0.0",), ("1.0.0+b",)], "v string").select(version_key(F.col("v")).alias("k")).collect()
    assert [r["k"] is None for r in bad] == [True, True, True, False]


def test_rules(spark):
    df = spark.createDataFrame([("A", "Lib/a.swift", 1, 1, True), ("B", "Lib/Old/b.swift", 2, 1, False), ("C", "App/c.swift", 3, 1, False)], "name string, path string, seq int, line int, is_final boolean").withColumn("col", F.lit(1))
    s = Selection(df, Roles(), "types")
    final = rules.Rule("final", lambda: s.violations(of=m.flag("final", "is_final")), hint="add final")
    lib = rules.Rule("lib", lambda: [s.violations(of=m.flag("final", "is_final")), s.named("Z").violations(of=m.named("Q"))], "advisory", folder="Lib", but=("Lib/Old",))
    none = rules.Rule("none", lambda: s.named("Z").violations(of=m.named("Q")))
    r = rules.run([final, lib, none])
    assert {(e["rule_id"], e["name"], e["level"]) for e in r.events.collect()} == {("final", "B", "error"), ("final", "C", "error")} and r.failed()
    assert {tuple(x) for x in r.counts.collect()} == {("final", 3, 2), ("lib", 3, 0), ("none", 0, 0)}
    assert [x["rule_id"] for x in r.warnings().collect()] == ["none"]
    assert {e["name"] for e in r.scoped("App").events.collect()} == {"C"}
    base = rules.record_baseline(r)
    assert [tuple(x) for x in base.collect()] == [("final", "C", "App/c.swift"), ("final", "B", "Lib/Old/b.swift")]
    assert not rules.run([final], baseline=base).failed()
    more = base.unionByName(spark.createDataFrame([("final", "X", "x")], "rule string, name string, path string"))
    assert [x["name"] for x in rules.stale_entries(more, r).collect()] == ["X"]
    assert not rules.run([final, none], only=["none"]).failed()
    for bad in ({"only": ["zzz"]}, {"skip": ["final", "lib", "none"]}):
        with pytest.raises(ValueError):
            rules.run([final, lib, none], **bad)
    with pytest.raises(ValueError):
        rules.run([final, final])


def test_nested_baselines_accept_below_their_folder_only(spark):
    b = spark.createDataFrame([("r", "n", "a.swift", "Sub"), ("r", "n", "b.swift", None), ("r", "n", "../c.swift", "Sub"), ("r", "n", "d.swift", "./")][:3], "rule string, name string, path string, folder string")
    assert {r["path"] for r in rules.scoped_baseline(b).collect()} == {"Sub/a.swift", "b.swift"}


def test_many_rules_in_one_scan(spark):
    df = spark.createDataFrame([("A", "a.swift", 1, 1, True), ("B", "b.swift", 2, 1, None)], "name string, path string, line int, col int, is_final boolean")
    s = Selection(df, Roles(order=("path",)), "types")
    checks = {"final": m.flag("final", "is_final"), "a": m.named("A")}
    r = rules.check_all(s, checks, {"a": "advisory"})
    assert {(e["rule_id"], e["level"], e["name"], e["line"]) for e in r.events.collect()} == {("final", "error", "B", 2), ("a", "warning", "B", 2)}
    assert {tuple(c) for c in r.counts.collect()} == {("final", 2, 1), ("a", 2, 1)} and r.failed()
    one = rules.run([rules.Rule(k, lambda k=k: s.violations(of=checks[k])) for k in checks])
    assert {(e["rule_id"], e["rule"]) for e in r.events.collect()} == {(e["rule_id"], e["rule"]) for e in one.events.collect()}
