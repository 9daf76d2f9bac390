"""Rules: named checks with an enforcement, run together as one plan and reported in one shape."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.operators.layering import accepted, stale
from factloom.operators.matcher import Matcher
from factloom.operators.selection import Selection, Violations


@dataclass(frozen=True)
class Rule:
    """check gives the violations of one or several checks. An enforced rule fails a run, an advisory one warns.

    folder and but: the rule applies below folder, without the subtrees that override it.
    """

    id: str
    check: Callable[[], Violations | Sequence[Violations]]
    enforcement: str = "enforced"
    hint: str | None = None
    folder: str = ""
    but: tuple[str, ...] = ()


def select(rules: Sequence[Rule], only: Sequence[str] = (), skip: Sequence[str] = ()) -> list[Rule]:
    ids = [r.id for r in rules]
    if unknown := [x for x in (*only, *skip) if x not in ids]:
        raise ValueError(f"no rule has the id '{unknown[0]}'")
    if len(set(ids)) < len(ids):
        raise ValueError(f"two rules have the id '{next(i for i in ids if ids.count(i) > 1)}'")
    return [r for r in rules if (not only or r.id in only) and r.id not in skip]


@dataclass(frozen=True)
class Report:
    """events: rule_id, level, rule, name, path, line, column, hint. counts: rule_id, checked_count, violation_count."""

    events: DataFrame
    counts: DataFrame

    def failed(self) -> bool:
        return not self.events.where("level = 'error'").isEmpty()

    def warnings(self) -> DataFrame:
        """Rules that looked at nothing: they pass, but say so."""
        return self.counts.where("checked_count = 0").select("rule_id", F.lit("the rule matched no declarations").alias("message"))

    def scoped(self, *folders: str) -> "Report":
        inside, _ = paths.scope_directories(folders)
        return Report(self.events.where(paths.under(F.col("path"), inside)), self.counts)


def run(rules: Sequence[Rule], only: Sequence[str] = (), skip: Sequence[str] = (), baseline: DataFrame | None = None, strict: bool = False) -> Report:
    """All selected rules as one union, each with its own scan (check_all shares one); a baseline (rule, name, path) takes accepted rows away."""
    events = counts = None
    for r in select(rules, only, skip):
        checks = r.check()
        for v in [checks] if isinstance(checks, Violations) else checks:
            rows = v.erased()
            if r.folder or r.but:
                rows = rows.where(paths.under(F.col("path"), [r.folder]) & ~paths.under(F.col("path"), list(r.but)))
            level = "error" if r.enforcement == "enforced" or strict else "warning"
            rows = rows.select(F.lit(r.id).alias("rule_id"), F.lit(level).alias("level"), "rule", "name", "path", "line", "column", F.lit(r.hint).cast("string").alias("hint"))
            checked = v.counts().select(F.lit(r.id).alias("rule_id"), "checked_count")
            events = rows if events is None else events.unionByName(rows)
            counts = checked if counts is None else counts.unionByName(checked)
    if events is None:
        raise ValueError("no rule is selected")
    if baseline is not None:
        events = accepted(events, scoped_baseline(baseline), ("rule_id", "name", "path"))
    found = events.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("rule_id").agg(F.sum("checked_count").alias("checked_count")).join(found, "rule_id", "left")
    return Report(events, counts.select("rule_id", "checked_count", F.coalesce("n", F.lit(0)).alias("violation_count")))


def check_all(rows: Selection, checks: Mapping[str, Matcher], enforcement: Mapping[str, str] | None = None) -> Report:
    """Many rules over one table in one scan: each requirement is a column of the row, the failed ones are exploded. A
    further rule costs its expression, not another scan."""
    levels = enforcement or {}
    c = lambda n, kind: (F.col(n) if n else F.lit(None)).cast(kind)

    def failed(id_: str, m: Matcher):
        level = "error" if levels.get(id_, "enforced") == "enforced" else "warning"
        return F.when(~m.ok(), F.struct(F.lit(id_).alias("rule_id"), F.lit(level).alias("level"), F.lit(f"{rows.description} should {m.description()}").alias("rule")))

    r = rows.roles
    found = F.filter(F.array(*[failed(i, m) for i, m in checks.items()]), lambda x: x.isNotNull())
    events = rows.df.select(c(r.name, "string").alias("name"), c(r.path, "string").alias("path"), c(r.line, "bigint").alias("line"), c(r.column, "bigint").alias("column"), F.inline(found))
    totals = rows.df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~m.ok()).alias(f"r{k}") for k, m in enumerate(checks.values())])
    each = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.col("n").alias("checked_count"), F.col(f"r{k}").alias("violation_count")) for k, i in enumerate(checks)])
    shown = ["rule_id", "level", "rule", "name", "path", "line", "column"]
    return Report(events.select(*shown, F.lit(None).cast("string").alias("hint")), totals.select(F.inline(each)))


def scoped_baseline(baseline: DataFrame) -> DataFrame:
    """rule_id, name, path of a baseline's entries. An entry of a nested baseline (folder) has a path below that folder
    and accepts nothing elsewhere; an entry without path that leads out of its folder accepts nothing."""
    if "folder" not in baseline.columns:
        return baseline.select(F.col("rule").alias("rule_id"), "name", "path")
    folder = F.coalesce(F.rtrim(F.col("folder"), F.lit("/")), F.lit(""))
    inside = F.when((folder == "") | (folder == "."), F.col("path")).otherwise(F.concat(folder, F.lit("/"), F.col("path")))
    kept = baseline.where(~F.coalesce(F.col("path").rlike(r"(?:^|/)\.\.(?:/|$)"), F.lit(False)))
    return kept.select(F.col("rule").alias("rule_id"), "name", inside.alias("path"))


def record_baseline(report: Report) -> DataFrame:
    return report.events.select(F.col("rule_id").alias("rule"), "name", "path").distinct().orderBy("rule", "path", "name")


def stale_entries(baseline: DataFrame, report: Report) -> DataFrame:
    """Entries of a baseline that match no violation of a run without it."""
    return stale(scoped_baseline(baseline).withColumnRenamed("rule_id", "rule"), record_baseline(report))
