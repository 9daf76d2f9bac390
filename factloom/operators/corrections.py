"""Corrections of violations: an outcome and edits for each offender, and a plan that can be applied as a whole.

proposals is a table: rule, proposal (id), path, start, end (UTF-8 bytes), replacement. Edits that several proposals share
are one edit. Proposals whose edits overlap are rejected, all of them; so are those that leave a file that cannot be
read any more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.operators.edits import EditConflict, splice
from factloom.operators.selection import Violations
from factloom.session import cut

EDIT = "array<struct<path:string,start:int,end:int,replacement:string>>"
OUTCOMES = ("not_applicable", "satisfied", "violation", "unavailable", "undetermined")


def with_fix(violations: Violations, edits: Column, key: Sequence[str]) -> DataFrame:
    """Proposals of the offenders: rule, proposal (a hash of the offender's key), path, start, end, replacement. edits is
    an array of EDIT structs; an offender with a null or empty one proposes nothing."""
    rows = violations.offenders.select(F.lit(violations.rule).alias("rule"), F.xxhash64(*key).alias("proposal"), F.explode(edits.cast(EDIT)).alias("e"))
    return rows.select("rule", "proposal", "e.*")


def outcome(found: Column, edits: Column) -> Column:
    """Of one check: not_applicable where found is null, satisfied where it is false, violation with edits, else
    unavailable (a violation without a fix)."""
    return F.when(found.isNull(), "not_applicable").when(~found, "satisfied").when(F.size(F.coalesce(edits, F.array().cast(EDIT))) > 0, "violation").otherwise("unavailable")


def combined(outcomes: Column, edits: Column) -> Column:
    """STRUCT<outcome, edits> of several checks of one row, outcomes and edits being arrays of the same length: an
    undetermined one decides, then one unavailable, both without edits; else the edits are joined; without any edit
    the row is satisfied if a part is, else the check does not apply."""
    all_edits = F.flatten(F.transform(edits, lambda e: F.coalesce(e, F.array().cast(EDIT))))
    none = F.array().cast(EDIT)
    has = lambda o: F.array_contains(outcomes, o)
    state = F.when(has("undetermined"), "undetermined").when(has("unavailable"), "unavailable").when(F.size(all_edits) > 0, "violation").when(has("satisfied"), "satisfied").otherwise("not_applicable")
    return F.struct(state.alias("outcome"), F.when(state == "violation", all_edits).otherwise(none).alias("edits"))


def overlapping(edits: DataFrame) -> DataFrame:
    """Distinct edits (path, start, end, replacement) that overlap another one of their file, or touch an insertion."""
    order = [F.col("start"), F.col("end"), F.col("replacement")]
    w = Window.partitionBy("path").orderBy(*order)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    empty = F.col("start") == F.col("end")
    e = edits.select("path", "start", "end", "replacement").distinct().withColumn("_empty", empty)
    e = e.withColumn("_end", F.max("end").over(before)).withColumn("_in", F.max(F.when(F.col("_empty"), F.col("start"))).over(before))
    e = e.withColumn("_start", F.min("start").over(after)).withColumn("_out", F.min(F.when(F.col("_empty"), F.col("start"))).over(after))
    s, t = F.col("start"), F.col("end")
    earlier = (F.col("_end") > s) | ((F.col("_end") == s) & (F.col("_empty") | (F.col("_in") == s)))
    later = (F.col("_start") < t) | ((F.col("_start") == t) & (F.col("_empty") | (F.col("_out") == t)))
    hit = F.coalesce(earlier, F.lit(False)) | F.coalesce(later, F.lit(False))
    return e.where(hit).select("path", "start", "end", "replacement")


def _readable(text: str) -> bool:
    from factloom.sources.declarations import KINDS
    from factloom.sources.lexers import swift_tokens

    t = swift_tokens(text, KINDS)
    stack = []
    for x in t.texts:
        if x in ("(", "[", "{"):
            stack.append({"(": ")", "[": "]", "{": "}"}[x])
        elif x in (")", "]", "}") and (not stack or stack.pop() != x):
            return False
    return not stack and not t.errors


def _changes(readable: Callable[[str], bool]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text, edits in zip(b["path"], b["text"], b["edits"]):
                try:
                    new = splice(text, [(e["start"], e["end"], e["replacement"]) for e in edits])
                    problem = None if readable(new) else "the corrected source cannot be read"
                except (EditConflict, UnicodeDecodeError) as e:
                    new, problem = None, str(e)
                out.append((path, text, new if problem is None else None, problem))
            yield pd.DataFrame(out, columns=["path", "original", "text", "problem"])

    return run


def plan(files: DataFrame, proposals: DataFrame, scope: Sequence[str] = (), protected: Sequence[str] = (), readable: Callable[[str], bool] = _readable, max_rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """changes (path, original, text) and rejected (rule, proposal, reason).

    A proposal counts as a whole: it is rejected if one of its edits has no file, lies out of scope or in a protected
    file, or overlaps an edit of another one; then, round by round, if a file it edits cannot be read any more.
    """
    p = cut(proposals.distinct())
    known = files.select("path").distinct().withColumn("_known", F.lit(True))
    inside, _ = paths.scope_directories(scope)
    at = p.join(known, "path", "left")
    out = ~paths.under(F.col("path"), inside) if scope else F.lit(False)
    reason = F.when(F.col("_known").isNull(), "the file is not part of the codebase").when(out, "the file is outside the reported paths").when(F.col("path").isin(*protected) if protected else F.lit(False), "the file is protected")
    bad = at.withColumn("reason", reason).where("reason is not null").groupBy("rule", "proposal").agg(F.min("reason").alias("reason"))
    hits = p.join(overlapping(p), ["path", "start", "end", "replacement"], "left_semi").select("rule", "proposal").distinct().withColumn("reason", F.lit("the correction overlaps another replacement"))
    rejected = cut(bad.unionByName(hits.join(bad, ["rule", "proposal"], "left_anti")))
    for _ in range(max_rounds):
        active = p.join(rejected, ["rule", "proposal"], "left_anti")
        edits = active.select("path", "start", "end", "replacement").distinct().groupBy("path").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits"))
        done = cut(files.select("path", "text").join(edits, "path").mapInPandas(_changes(readable), "path string, original string, text string, problem string"))
        failed = done.where("problem is not null").select("path", "problem")
        if failed.isEmpty():
            return done.where("text <> original").select("path", "original", "text"), rejected
        more = active.join(failed, "path").groupBy("rule", "proposal").agg(F.concat(F.lit("cannot prepare the correction: "), F.min("problem")).alias("reason"))
        rejected = cut(rejected.unionByName(more))
    raise RuntimeError(f"the plan was not settled in {max_rounds} rounds")


def patch(changes: DataFrame) -> DataFrame:
    """path and diff, a unified patch of each changed file with three lines around each change."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import difflib

        for b in batches:
            diffs = ["".join(x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in difflib.unified_diff(o.splitlines(True), n.splitlines(True), f"a/{p}", f"b/{p}")) for p, o, n in zip(b["path"], b["original"], b["text"])]
            yield pd.DataFrame({"path": b["path"], "diff": diffs})

    return changes.mapInPandas(run, "path string, diff string")
