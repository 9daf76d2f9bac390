"""Selections: rows of any table narrowed step by step, with a description of how; and the checks on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.functions import paths
from factloom.operators.matcher import Matcher, quoted, two_valued, whole_name


@dataclass(frozen=True)
class Roles:
    """The columns that filters and reports look at: the name, the root-relative path, the order, the place."""

    name: str = "name"
    path: str | None = "path"
    order: tuple[str, ...] = ("path", "seq")
    line: str | None = "line"
    column: str | None = "col"


@dataclass(frozen=True)
class NameFilter:
    """A filter as a value: kind is named, suffixed, prefixed, name_matching, excluding, under or outside."""

    kind: str
    values: tuple[str, ...]

    def __post_init__(self):
        if self.kind not in ("named", "suffixed", "prefixed", "name_matching", "excluding", "under", "outside"):
            raise ValueError(f"there is no filter '{self.kind}'")


@dataclass(frozen=True)
class Selection:
    df: DataFrame
    roles: Roles = field(default_factory=Roles)
    description: str = "rows"
    warnings: tuple[str, ...] = ()
    steps: tuple[tuple[str, DataFrame], ...] = ()

    def _with(self, df: DataFrame, clause: str) -> "Selection":
        text = f"{self.description} {clause}"
        return replace(self, df=df, description=text, steps=(*self.steps, (text, df)))

    def _name(self) -> Column:
        return F.col(self.roles.name)

    def _order(self, reverse: bool = False) -> list[Column]:
        return [F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_first() for c in self.roles.order]

    # Filters.

    def where(self, condition: Matcher | str) -> "Selection":
        if isinstance(condition, str):
            return self._with(self.df.where(two_valued(F.col(condition))), f"where {condition} is true")
        return self._with(self.df.where(condition.ok()), f"that {condition.description()}")

    def named(self, *names: str) -> "Selection":
        return self._with(self.df.where(two_valued(self._name().isin(*names))), f"named {quoted(names)}")

    def suffixed(self, *suffixes: str) -> "Selection":
        return self._with(self.df.where(_either([self._name().endswith(s) for s in suffixes])), f"suffixed {quoted(suffixes)}")

    def prefixed(self, *prefixes: str) -> "Selection":
        return self._with(self.df.where(_either([self._name().startswith(s) for s in prefixes])), f"prefixed {quoted(prefixes)}")

    def name_matching(self, pattern: str) -> "Selection":
        return self._with(self.df.where(two_valued(self._name().rlike(whole_name(pattern)))), f"with a name matching /{pattern}/")

    def excluding(self, *names: str) -> "Selection":
        """Rows without a name are left out as well."""
        return self._with(self.df.where(self._name().isNotNull() & ~self._name().isin(*names)), f"excluding {quoted(names)}")

    def under(self, *directories: str) -> "Selection":
        inside, bad = paths.scope_directories(directories)
        s = self._with(self.df.where(paths.under(F.col(self.roles.path), inside)), f"under {quoted(inside)}")
        return replace(s, warnings=(*s.warnings, *(f"'{d}' is outside the codebase root" for d in bad)))

    def outside(self, *directories: str) -> "Selection":
        inside, bad = paths.scope_directories(directories)
        s = self._with(self.df.where(F.col(self.roles.path).isNotNull() & ~paths.under(F.col(self.roles.path), inside)), f"outside {quoted(inside)}")
        return replace(s, warnings=(*s.warnings, *(f"'{d}' is outside the codebase root" for d in bad)))

    def filtering(self, filters: Sequence[NameFilter]) -> "Selection":
        """All of the filters, in order; without any the selection as it is."""
        s = self
        for f in filters:
            s = getattr(s, f.kind)(*f.values)
        return s

    # Order and size.

    def sorted(self, *keys: str, reverse: bool = False) -> "Selection":
        """Stable: rows of equal keys stay in the order they had."""
        by = [F.col(k).desc_nulls_last() if reverse else F.col(k).asc_nulls_first() for k in keys]
        return replace(self, df=self.df.orderBy(*by, *self._order()), roles=replace(self.roles, order=(*keys, *self.roles.order)))

    def reversed(self) -> "Selection":
        return replace(self, df=self.df.orderBy(*self._order(reverse=True)))

    def prefix(self, n: int) -> "Selection":
        if n < 0:
            raise ValueError("a prefix is not negative")
        return replace(self, df=self.df.orderBy(*self._order()).limit(n))

    def drop_first(self, n: int = 1) -> "Selection":
        if n < 0:
            raise ValueError("as many rows can't be left out")
        return replace(self, df=self.df.orderBy(*self._order()).offset(n))

    def prefix_while(self, condition: Matcher, by: Sequence[str] = ()) -> "Selection":
        """Rows before the first that fails, in each group of by. The group's first failing order key is one small
        aggregate joined back, so no group is sorted in one task."""
        key = F.struct(*self.roles.order)
        first = self.df.where(~condition.ok()).groupBy(*by).agg(F.min(key).alias("_stop"))
        df = self.df.join(first, list(by), "left") if by else self.df.withColumn("_stop", first.select("_stop").scalar())
        return replace(self, df=df.where(F.col("_stop").isNull() | (key < F.col("_stop"))).drop("_stop"))

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def first(self):
        rows = self.df.orderBy(*self._order()).limit(1).collect()
        return rows[0] if rows else None

    def __getitem__(self, index: int):
        """The row at an index from 0; outside the selection an error."""
        rows = self.df.orderBy(*self._order()).offset(index).limit(1).collect() if index >= 0 else []
        if not rows:
            raise IndexError(f"index {index} is out of range: {self.description}")
        return rows[0]

    def only(self):
        rows = self.df.limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"expected one element, found {'none' if not rows else 'more'}: {self.description}")
        return rows[0]

    def __iter__(self):
        return iter(self.df.orderBy(*self._order()).toLocalIterator())

    def __repr__(self) -> str:
        n = self.count()
        return f"{'1 element' if n == 1 else f'{n} elements'}: {self.description}"

    # Checks.

    def violations(self, of: Matcher | None = None, matching: Matcher | None = None, outside_paths: Sequence[str] | None = None) -> "Violations":
        if of is not None:
            return Violations(self.df.where(~of.ok()).withColumn("witness", of.witness()), f"{self.description} should {of.description()}", self.df, self.roles)
        if matching is not None:
            return Violations(self.df.where(matching.ok()).withColumn("witness", matching.witness()), f"{self.description} should not {matching.description()}", self.df, self.roles)
        ok = paths.matches_any(F.col(self.roles.path), outside_paths)
        return Violations(self.df.where(~ok).withColumn("witness", F.lit(None)), f"{self.description} should be in {quoted(outside_paths)}", self.df, self.roles)

    def inspect(self) -> DataFrame:
        """How many rows each step kept and left out."""
        out, before = None, None
        for n, (text, df) in enumerate(self.steps):
            row = df.agg(F.count(F.lit(1)).alias("selected")).select(F.lit(n).alias("step"), F.lit(text).alias("query"), "selected")
            out = row if out is None else out.unionByName(row)
        return out


    def inspect_rows(self, base: DataFrame, keys: Sequence[str]) -> DataFrame:
        """step, query, keys, selected: of each step the rows it was given and whether it kept them."""
        out, before = None, base.select(*keys)
        for n, (text, df) in enumerate(self.steps):
            kept = df.select(*keys).distinct().withColumn("_kept", F.lit(True))
            on = F.lit(True)
            for k in keys:
                on = on & before[k].eqNullSafe(kept[k])
            rows = before.join(kept, on, "left").select(F.lit(n).alias("step"), F.lit(text).alias("query"), *[before[k] for k in keys], F.col("_kept").isNotNull().alias("selected"))
            out = rows if out is None else out.unionByName(rows)
            before = df.select(*keys)
        return out


def _either(tests: list[Column]) -> Column:
    c = F.lit(False)
    for t in tests:
        c = c | t
    return two_valued(c)


@dataclass(frozen=True)
class Violations:
    """The rows that fail a check, what it requires, and the rows it looked at."""

    offenders: DataFrame
    rule: str
    checked: DataFrame
    roles: Roles = field(default_factory=Roles)

    def counts(self) -> DataFrame:
        """One row: checked_count, violation_count."""
        c = self.checked.agg(F.count(F.lit(1)).alias("checked_count"))
        v = self.offenders.agg(F.count(F.lit(1)).alias("violation_count"))
        return c.withColumn("violation_count", v.scalar())

    def filtering(self, condition: Column) -> "Violations":
        return replace(self, offenders=self.offenders.where(two_valued(condition)))

    def erased(self) -> DataFrame:
        """Offenders in one shape for all tables: rule, name, path, line, column. The place is that of the witness if it
        has one of its own, else the row's."""
        c = lambda n: F.col(n) if n else F.lit(None)
        seen = self.offenders.schema["witness"].dataType if "witness" in self.offenders.columns else None
        held = set(seen.names) if isinstance(seen, StructType) else set()

        def place(role: str | None, *names: str) -> Column:
            # Line and column belong together: a witness without a line has no place.
            own = next((F.col(f"witness.{n}") for n in names if n in held and "line" in held), None)
            return c(role) if own is None else F.when(F.col("witness.line").isNotNull(), own).otherwise(c(role))

        return self.offenders.select(
            F.lit(self.rule).alias("rule"), c(self.roles.name).cast("string").alias("name"), place(self.roles.path, "path").cast("string").alias("path"),
            place(self.roles.line, "line").cast("bigint").alias("line"), place(self.roles.column, "col", "column").cast("bigint").alias("column"),
        )


def manual(rule: str, offenders: DataFrame, checked: DataFrame, roles: Roles = Roles()) -> Violations:
    """Violations found by other means: offenders and the rows that were looked at."""
    return Violations(offenders if "witness" in offenders.columns else offenders.withColumn("witness", F.lit(None)), rule, checked, roles)


def combined(*checks: Violations) -> tuple[DataFrame, DataFrame]:
    """The offenders of several checks, and the sums of their counts."""
    rows, counts = checks[0].erased(), checks[0].counts()
    for c in checks[1:]:
        rows, counts = rows.unionByName(c.erased()), counts.unionByName(c.counts())
    return rows, counts.agg(F.sum("checked_count").alias("checked_count"), F.sum("violation_count").alias("violation_count"))
