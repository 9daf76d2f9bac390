"""Semantic versions as columns that sort by their precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def version_key(v: Column) -> Column:
    """A struct that compares as semantic versions do: a prerelease comes before its release, numbers before words,
    fewer fields before more; build metadata does not count. Null for what is no version."""
    part = lambda n: F.try_to_number(F.nullif(F.regexp_extract(v, _FORM, n), F.lit("")), F.lit("9" * 18)).cast("bigint")
    pre = F.regexp_extract(v, _FORM, 4)
    fields = F.transform(F.split(pre, r"\."), lambda x: F.struct((~x.rlike(r"^\d+$")).alias("word"), F.when(x.rlike(r"^\d{1,18}$"), x.cast("bigint")).alias("number"), x.alias("text")))
    return F.when(v.rlike(_FORM), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (pre == "").alias("release"), F.when(pre != "", fields).alias("fields")))


def _requirement(requirement: Column) -> tuple[Column, Column]:
    """Kind and rest of a requirement as manifests hold it, such as from:1.2.0."""
    return F.substring_index(requirement, ":", 1), F.regexp_extract(requirement, r"^[^:]*:(.*)$", 1)


def minimum_version(requirement: Column) -> Column:
    """The least version that a requirement allows, null for branches and revisions; of a range its lower bound."""
    kind, rest = _requirement(requirement)
    v = F.regexp_extract(rest, r"^\"?([0-9A-Za-z.+-]*?[0-9A-Za-z])(?:\"?\s*\.\.[.<].*|\"?)$", 1)
    return F.when(kind.isin("from", "exact", "upToNextMajor", "upToNextMinor", "range") & v.rlike(_FORM), v)


def major_version(requirement: Column) -> Column:
    return F.substring_index(minimum_version(requirement), ".", 1).try_cast("bigint")


def is_exact_version(requirement: Column) -> Column:
    return F.coalesce(_requirement(requirement)[0] == "exact", F.lit(False))


def allows(requirement: Column, version: Column) -> Column:
    """Whether a requirement takes a version; null for branches, revisions and what is no version. A prerelease of the
    next major or minor version lies below it, but is not taken."""
    kind, _ = _requirement(requirement)
    low, v = version_key(minimum_version(requirement)), version_key(version)
    same_major = v["major"] == low["major"]
    ok = F.when(kind == "exact", v == low).when(kind.isin("from", "upToNextMajor"), (v >= low) & same_major).when(kind == "upToNextMinor", (v >= low) & same_major & (v["minor"] == low["minor"]))
    return F.when(low.isNotNull() & v.isNotNull(), ok)
