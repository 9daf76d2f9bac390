"""Source files that do not parse, and functions paired with their documentation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import spread
from factloom.session import table

_FAULT = "file_id bigint, repository string, path string, lang string, language_mode string, ingested_at timestamp_ntz, text_hash bigint, valid boolean, line int, col int, message string, cause string"


def _faults(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from factloom.llm.grammars import check

    for b in batches:
        found = [check(t, lang) for t, lang in zip(b["text"], b["lang"])]
        out = b.drop(columns=["text"])
        out["valid"] = [x is None for x in found]
        for name in ("line", "col", "message", "cause"):
            out[name] = [getattr(x, name) if x else None for x in found]
        for name in ("line", "col"):
            out[name] = out[name].astype("Int32")
        yield out


def parse_faults(files: DataFrame) -> DataFrame:
    """One row for each file_id: whether its text is valid in its language, else line, col, message and cause.

    Each text is parsed where it is read (no text is shuffled, unless the scan has too few splits); then the rows of
    one file_id, of which some come twice, are reduced to the one that came in last (ties: by text hash). Files with
    null file_id, null or empty lang, or a language without grammar, and null texts, give no row; an empty text is valid but in JSON.
    """
    known = F.lower(F.trim("lang"))
    src = files.where("file_id is not null and text is not null").where(known.isin("swift", "json", "python", "c")).select(
        "file_id", "repository", "path", known.alias("lang"), "language_mode", F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"), F.xxhash64("text", known).alias("text_hash"), "text"
    )
    rows = spread(src).mapInPandas(_faults, _FAULT)
    last = F.max_by(F.struct("repository", "path", "lang", "language_mode", "valid", "line", "col", "message", "cause"), F.struct("ingested_at", "text_hash"))
    return rows.groupBy("file_id").agg(last.alias("r")).select("file_id", "r.*")


def p1_found(spark, sf_dir: str) -> DataFrame:
    return parse_faults(table(spark, sf_dir, "source_files")).where("not valid").select("file_id")


def p1_faults(spark, sf_dir: str) -> DataFrame:
    """As in parse_diagnostics: position, message and language mode of each file that does not parse, with the cause."""
    return parse_faults(table(spark, sf_dir, "source_files")).where("not valid").select("file_id", "path", "line", "col", "message", F.col("language_mode").alias("swift_language_mode"), "cause")


def p1_rates(spark, sf_dir: str) -> DataFrame:
    """Files and invalid files, in all and by cause, for each repository and language."""
    f = parse_faults(table(spark, sf_dir, "source_files"))
    by = [F.count_if(F.col("cause") == c).alias(f"n_{c}") for c in ("conflict", "truncated", "wrong_language", "syntax")]
    g = f.groupBy("repository", "lang").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"), *by)
    return g.withColumn("invalid_rate", F.col("n_invalid") / F.col("n_files"))


_KEY = "file_id bigint, ingested_at timestamp_ntz, text_hash bigint, line int, signature string"
_PAIR = _KEY + ", col int, name string, labels array<string>, names array<string>, documentation string, summary string, code string"


def _pairs(whole: bool):
    """whole: with the names, the comment and the code, which a search for the functions alone need not carry along."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from factloom.llm import docpairs
        from factloom.llm.grammars import valid_tokens

        names = [c.split(" ")[0] for c in (_PAIR if whole else _KEY).split(", ")]
        for b in batches:
            rows = []
            for file_id, at, h, text in zip(b["file_id"], b["ingested_at"], b["text_hash"], b["text"]):
                # The cheap test first: without a documentation comment there is no pair.
                if ("///" not in text and "/**" not in text) or (tokens := valid_tokens(text, "swift")) is None:
                    continue
                for f in docpairs.functions(text, tokens):
                    said = docpairs.plain_sentences(f.documentation)
                    if not docpairs.is_trivial(f.documentation, f.name, said):
                        more = (f.col, f.name, list(f.labels), list(f.names), f.documentation, said, f.code) if whole else ()
                        rows.append((file_id, at, h, f.line, f.signature, *more))
            yield pd.DataFrame(rows, columns=names)

    return run


def documented_functions(files: DataFrame, whole: bool = True) -> DataFrame:
    """Code-description pairs of the valid Swift files: one row for each documented function, see docpairs.

    Null file_ids and texts give no rows; of a file that comes twice with different texts the last text holds. Two
    functions of one signature on one line of a file are one row. whole false: only file_id, line and signature.
    """
    src = files.where("file_id is not null and text is not null").where(F.lower(F.trim("lang")) == "swift").select(
        "file_id", F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"), F.xxhash64("text").alias("text_hash"), "text"
    )
    rows = spread(src).mapInPandas(_pairs(whole), _PAIR if whole else _KEY)
    # The text that holds is settled on ids and hashes alone, and only for files that come with several texts.
    several = src.select("file_id", "ingested_at", "text_hash").groupBy("file_id").agg(F.max_by("text_hash", F.struct("ingested_at", "text_hash")).alias("held"), F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").select("file_id", "held")
    one = rows.dropDuplicates(["file_id", "text_hash", "line", "signature"])
    return one.join(several, "file_id", "left").where("held is null or held = text_hash").drop("held", "ingested_at", "text_hash")


def p2_found(spark, sf_dir: str) -> DataFrame:
    return documented_functions(table(spark, sf_dir, "source_files"), whole=False).select("file_id", "line", "signature")


def p2_pairs(spark, sf_dir: str) -> DataFrame:
    return documented_functions(table(spark, sf_dir, "source_files"))
