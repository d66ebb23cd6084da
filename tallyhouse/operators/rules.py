"""Declarative validation: a rule set tags rows, splits them and counts violations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``valid`` is the SQL predicate of a good row, ``issue`` the label of a bad one."""

    name: str
    valid: str
    issue: str

    def holds(self) -> Column:
        # NULL counts as a failure, so every row lands on exactly one side of the split
        return F.coalesce(F.expr(self.valid), F.lit(False))


@dataclass(frozen=True)
class RuleSet:
    entity: str
    rules: tuple[Rule, ...]

    def passes(self) -> Column:
        return reduce(lambda a, b: a & b, [r.holds() for r in self.rules])

    def issues(self) -> Column:
        """All firing labels, ``"a, b"``; empty for a good row."""
        return F.concat_ws(", ", *[F.when(~r.holds(), r.issue) for r in self.rules])

    def first_issue(self, otherwise: str | None = None) -> Column:
        out = None
        for r in self.rules:
            out = F.when(~r.holds(), r.issue) if out is None else out.when(~r.holds(), r.issue)
        return out if otherwise is None else out.otherwise(otherwise)

    def tag(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"is_quarantined": ~self.passes(), "issue_type": self.issues()})

    def clean(self, df: DataFrame) -> DataFrame:
        """Rows that satisfy every rule (expect-or-drop)."""
        return df.filter(self.passes())

    def quarantine(self, df: DataFrame) -> DataFrame:
        """Rows that break a rule, with their labels."""
        return df.filter(~self.passes()).withColumn("issue_type", self.issues())

    def _counts(self) -> list[Column]:
        return [F.count_if(~r.holds()).alias(r.name) for r in self.rules]

    def violations(self, df: DataFrame) -> DataFrame:
        """(entity, rule, total_rows, violations) from one pass; no row is dropped."""
        counted = df.agg(F.count(F.lit(1)).alias("total_rows"), *self._counts())
        names = [r.name for r in self.rules]
        return counted.unpivot("total_rows", names, "rule", "violations").select(
            F.lit(self.entity).alias("entity"), "rule", "total_rows", "violations"
        )

    def observe(self, df: DataFrame, name: str | None = None) -> tuple[DataFrame, Observation]:
        """The same rows plus an observation that fills in when an action runs."""
        watch = Observation(name or f"{self.entity}_rules")
        return df.observe(watch, F.count(F.lit(1)).alias("total_rows"), *self._counts()), watch
