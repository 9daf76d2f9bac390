"""What documentation comments say about parameters and results, and positions in lines, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELDS = "Parameters?|Returns?|Throws|Note|Warning|Important|SeeAlso|Complexity|Precondition|Postcondition|Requires|Since|Todo|Version|Attention|Bug|Remark|Tip"


def documented_parameters(documentation: Column) -> Column:
    """The names of '- Parameter x:' and of the entries below '- Parameters:', in order; null comments have none."""
    doc = F.coalesce(documentation, F.lit(""))
    single = F.regexp_extract_all(doc, F.lit(r"-\s+[Pp]arameter\s+([\p{L}_][\p{L}\p{N}_]*)\s*:"), F.lit(1))
    block = F.regexp_extract(doc, r"(?s)-\s+[Pp]arameters:(.*)$", 1)
    nested = F.regexp_extract_all(F.regexp_replace(block, rf"(?m)^.*-\s+(?:{_FIELDS})\b.*$", ""), F.lit(r"(?m)^[\s/*]*-\s+([\p{L}_][\p{L}\p{N}_]*)\s*:"), F.lit(1))
    return F.concat(single, nested)


def documents_result(documentation: Column) -> Column:
    return F.coalesce(documentation.rlike(r"-\s+[Rr]eturns?\s*:"), F.lit(False))


def utf16_length(text: Column) -> Column:
    """Code units of UTF-16: what lies outside the basic plane counts twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
