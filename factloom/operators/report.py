"""Report events in the usual formats; each event is one line, made where it lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.session import cut


def _flat(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n|\r|\n", " ")


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _property(c: Column) -> Column:
    return F.replace(F.replace(_escaped(c), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def _placed(path: Column, line: Column, column: Column | None, sep: str) -> Column:
    """path:line:column, as far as it is known; concat_ws leaves out what is null."""
    return F.concat_ws(sep, F.coalesce(path, F.lit("<unknown>")), line.cast("string"), *([F.when(line.isNotNull(), column.cast("string"))] if column is not None else []))


def _tail(df: DataFrame, quiet: bool) -> DataFrame:
    n = summary(df)
    many = lambda c, word: F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, F.lit(f" {word}")).otherwise(F.lit(f" {word}s")))
    return n.select(F.concat(F.lit("Checked "), many("n_rules", "rule"), F.lit(": "), many("n_violations", "violation"), F.lit(".")).alias("line")).where(F.lit(not quiet))


def _messages(events: DataFrame) -> Column:
    return F.coalesce(F.col("message"), F.lit(""))


def compiler_lines(events: DataFrame, rules: DataFrame | None = None, quiet: bool = True) -> DataFrame:
    """path:line:column: level: message, from path, line, column, level, message (and rule). rules (id, path, line,
    column): each rule that an event names is noted where it is declared. Unless quiet a summary ends the report."""
    lines = events.select(F.concat(_placed(F.col("path"), F.col("line"), F.col("column"), ":"), F.lit(": "), F.col("level"), F.lit(": "), _flat(_messages(events))).alias("line"))
    if rules is not None:
        note = F.concat(_placed(F.col("path"), F.col("line"), F.col("column"), ":"), F.lit(": note: rule '"), F.col("id"), F.lit("' is declared here"))
        lines = lines.unionByName(rules.join(events.select(F.col("rule").alias("id")).distinct(), "id", "left_semi").select(note.alias("line")))
    return lines.unionByName(_tail(events, quiet)) if not quiet else lines


def annotation_lines(events: DataFrame) -> DataFrame:
    """Workflow annotations; an event without a path or line is one without these properties."""
    where = F.concat_ws(",", F.concat(F.lit("file="), _property(F.col("path"))), F.concat(F.lit("line="), F.col("line").cast("string")))
    return events.select(F.concat(F.lit("::"), F.col("level"), F.when(where != "", F.concat(F.lit(" "), where)).otherwise(F.lit("")), F.lit("::"), _escaped(_messages(events))).alias("line"))


def _kind(events: DataFrame) -> Column:
    return F.coalesce(F.col("kind"), F.lit("violation")) if "kind" in events.columns else F.lit("violation")


def json_events(events: DataFrame) -> DataFrame:
    """One JSON object for each event; what is null is left out."""
    hint = F.col("hint") if "hint" in events.columns else F.lit(None).cast("string")
    return events.select(F.to_json(F.struct(_kind(events).alias("kind"), "level", "message", hint.alias("hint"), "path", "line", "column", F.col("rule").alias("ruleID"))).alias("line"))


def _location(uri: Column, line: Column, column: Column) -> Column:
    return F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine"), column.alias("startColumn")).alias("region")).alias("physicalLocation"))


def sarif_results(events: DataFrame) -> DataFrame:
    """SARIF 2.1.0 result objects of the events that are no diagnostics; sarif_log wraps them in a run."""
    own = events.where(_kind(events) != "diagnostic")
    place = F.array(_location(paths.uri(F.col("path")), F.col("line"), F.col("column")))
    return own.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))).alias("line"))


def _document(head: str, parts: list[tuple[DataFrame, str]], tail: DataFrame) -> DataFrame:
    """Lines that, read in order, are one JSON document: part INT, line. Elements stay where they are made; only the
    least of them, which takes no comma before it, is found by an aggregate."""
    spark = tail.sparkSession
    out = spark.createDataFrame([(0, "", head)], "part int, at string, line string")
    for n, (lines, after) in enumerate(parts):
        keyed = lines.select(F.concat(F.sha2("line", 256), F.lit("."), F.monotonically_increasing_id()).alias("at"), "line")
        keyed = cut(keyed)
        first = keyed.agg(F.min("at").alias("a")).scalar()
        out = out.unionByName(keyed.select(F.lit(2 * n + 1).alias("part"), "at", F.when(F.col("at") == first, F.col("line")).otherwise(F.concat(F.lit(","), F.col("line"))).alias("line")))
        out = out.unionByName(spark.createDataFrame([(2 * n + 2, "", after)], "part int, at string, line string"))
    out = out.unionByName(tail.select(F.lit(99).alias("part"), F.lit("").alias("at"), "line"))
    return out.orderBy("part", "at").select("part", "line")


def json_document(events: DataFrame, rules: DataFrame) -> DataFrame:
    """The whole JSON report as ordered lines: schemaVersion, rules (id, name, hint, level, path, line, column), events
    and summary."""
    declared = rules.select(F.to_json(F.struct("id", "name", "hint", "level", "path", "line", "column")).alias("line"))
    n = rules.agg(F.count(F.lit(1)).alias("checkedRules")).withColumn("violations", events.agg(F.count_if(_kind(events) == "violation").alias("v")).scalar())
    tail = n.select(F.concat(F.lit('"summary":'), F.to_json(F.struct("checkedRules", "violations")), F.lit("}")).alias("line"))
    return _document('{"schemaVersion":1,"rules":[', [(declared, '],"events":['), (json_events(events), "],")], tail)


def sarif_log(events: DataFrame, rules: DataFrame, tool: str = "factloom", version: str = "1") -> DataFrame:
    """The whole SARIF 2.1.0 log as ordered lines: one run with its rules, results, and diagnostics as notifications; an
    error among the diagnostics makes the run unsuccessful."""
    text = lambda c: F.struct(F.col(c).alias("text"))
    rule = F.struct("id", "name", text("name").alias("shortDescription"), F.when(F.col("hint").isNotNull(), text("hint")).alias("fullDescription"), F.struct("level").alias("defaultConfiguration"))
    notes = events.where(_kind(events) == "diagnostic")
    place = F.array(_location(paths.uri(F.col("path")), F.col("line"), F.col("column")))
    noted = notes.select(F.to_json(F.struct("level", text("message").alias("message"), place.alias("locations"))).alias("line"))
    ok = notes.agg((F.count_if(F.col("level") == "error") == 0).cast("string").alias("ok"))
    tail = ok.select(F.concat(F.lit('"executionSuccessful":'), "ok", F.lit("}]}]}")).alias("line"))
    head = '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"%s","version":"%s","rules":[' % (tool, version)
    return _document(head, [(rules.select(F.to_json(rule).alias("line")), ']}},"results":['), (sarif_results(events), '],"invocations":[{"toolExecutionNotifications":['), (noted, "],")], tail)


def markdown_lines(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("- **"), F.col("rule"), F.lit("** `"), _placed(F.col("path"), F.col("line"), None, ":"), F.lit("` "), _flat(_messages(events))).alias("line"))


def summary(events: DataFrame) -> DataFrame:
    return events.agg(F.countDistinct("rule").alias("n_rules"), F.count(F.lit(1)).alias("n_violations"))


FORMATS = {"compiler": compiler_lines, "annotations": annotation_lines, "json": json_events, "sarif": sarif_results, "markdown": markdown_lines}


def write_report(events: DataFrame, path: str, kind: str) -> None:
    FORMATS[kind](events).write.mode("errorifexists").text(path)
