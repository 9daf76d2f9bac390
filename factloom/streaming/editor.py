"""Editor events: open documents, debounced refreshes and rules that are evaluated again after changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_change(events: DataFrame) -> DataFrame:
    """uri, text, seq: of each open document the text of its last full change; closed and saved documents have none.

    Works on a stream (complete or update mode) and on a table.
    """
    g = events.where("uri is not null").groupBy("uri").agg(F.max_by(F.struct("event", "text", "seq"), "seq").alias("e"))
    return g.where(F.col("e.event").isin("open", "change")).select("uri", "e.text", "e.seq")


def debounced(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """One refresh for each burst: events of a key less than gap apart. Columns: key, opened, refresh_at, n_events.

    The session closes gap after its last event, which is when the timer of a debounce would fire. On a stream, set a
    watermark on the time first; then late events are dropped and state is bounded.
    """
    s = events.groupBy(F.col(key), F.session_window(F.col(at), gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return s.select(key, F.col("w.start").alias("opened"), F.col("w.end").alias("refresh_at"), "n_events")


def tumbling_counts(events: DataFrame, at: str, width: str, *keys: str) -> DataFrame:
    g = events.groupBy(F.window(F.col(at), width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_events"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n_events")


_STATE = "generation long, result string"
_OUT = "uri string, generation long, result string, changed boolean"


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    generation, result = state.get if state.exists else (-1, None)
    changed = False
    for b in batches:
        for g, r in zip(b["generation"], b["result"]):
            # Results of an older generation are dropped; equal results change nothing.
            if g > generation:
                changed = changed or r != result
                generation, result = int(g), r
    state.update((generation, result))
    yield pd.DataFrame({"uri": [key[0]], "generation": [generation], "result": [result], "changed": [changed]})


def newest_results(results: DataFrame) -> DataFrame:
    """A stream of (uri, generation, result): the newest generation of each uri, and whether its result is new.

    Late results of older generations are discarded; one small state for each uri.
    """
    return results.groupBy("uri").applyInPandasWithState(_newest, _OUT, _STATE, "update", "NoTimeout")


def affected_rules(changed: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Rules (rule, kind, path) whose recorded inputs hold a changed path: the file itself, or what lies under a folder.

    Folders become equi-joins over the changed paths' ancestors, so no pair of path and rule is compared.
    """
    parts = F.split("path", "/")
    up = changed.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path")).distinct()
    files = dependencies.where("kind = 'file'").join(changed.select("path").distinct(), "path", "left_semi")
    folders = dependencies.where("kind = 'descendants'").join(up, "path", "left_semi")
    return files.select("rule").unionByName(folders.select("rule")).distinct()


def interleaved(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """previous and next event of each key, as a token knows its neighbours."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("previous", F.lag(order[-1]).over(w)).withColumn("next", F.lead(order[-1]).over(w))


_GOOD = "generation long, result string, is_good boolean"


def _keep(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    generation, result, good = state.get if state.exists else (-1, None, False)
    for b in batches:
        for g, r, ok in sorted(zip(b["generation"], b["result"], b["parsed"]), key=lambda x: x[0]):
            if g > generation:
                # A text that does not parse leaves the last good result in place.
                generation, result, good = int(g), r if ok else result, bool(ok) or good
    state.update((generation, result, good))
    yield pd.DataFrame({"uri": [key[0]], "generation": [generation], "result": [result], "is_good": [good]})


def last_good_results(results: DataFrame) -> DataFrame:
    """A stream of (uri, generation, result, parsed): the newest result of each uri whose text parsed; later ones that did
    not only raise the generation."""
    return results.groupBy("uri").applyInPandasWithState(_keep, "uri string, generation long, result string, is_good boolean", _GOOD, "update", "NoTimeout")


def snapshot(old: DataFrame, new: DataFrame, open_: DataFrame) -> DataFrame:
    """What to publish: uri and diagnostics of all files that had, have or are open; those without any now come out empty.
    old and new: uri, diagnostics ARRAY; open_: uri."""
    kind = new.schema["diagnostics"].dataType
    all_ = old.select("uri").unionByName(new.select("uri")).unionByName(open_.select("uri")).where("uri is not null").distinct()
    return all_.join(new, "uri", "left").select("uri", F.coalesce("diagnostics", F.array().cast(kind)).alias("diagnostics"))


def utf16_column(line: "F.Column", byte_column: "F.Column") -> "F.Column":
    """The column in UTF-16 code units, from 0, of a column in UTF-8 bytes, from 1, on a line; beyond its end the end."""
    before = F.decode(F.substring(F.encode(line, "UTF-8"), F.lit(1), F.greatest(byte_column - 1, F.lit(0)).cast("int")), "UTF-8")
    return (F.length(before) + F.regexp_count(before, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("int")


def captured(inputs: DataFrame) -> DataFrame:
    """rule, kind, path: what rules read, once each, of (rule, kind, path); a rule with an input of another kind than file,
    descendants or marker cannot be kept and has no row."""
    known = inputs.where(F.col("kind").isin("file", "descendants", "marker") & F.col("path").isNotNull())
    loose = inputs.join(known, ["rule", "kind", "path"], "left_anti").select("rule").distinct()
    return known.select("rule", "kind", "path").distinct().join(loose, "rule", "left_anti")


def invalidated(results: DataFrame, changed: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Kept results (rule, ...) without those of rules that a change affects or whose inputs are not known."""
    kept = results.join(dependencies.select("rule").distinct(), "rule", "left_semi")
    return kept.join(affected_rules(changed, dependencies), "rule", "left_anti")
