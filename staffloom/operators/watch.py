"""Counts that come with the write of a layer, so that its report needs no second scan.

A watch puts ``observe`` into the plan that is written.  Spark adds the counts up with the tasks of that write, and the report
is made of the few numbers that come back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from staffloom.names import c
from staffloom.operators.quality import REPORT_SCHEMA, WARNING, check_columns, check_types, counted_rules
from staffloom.specs import TableSpec

Rule = tuple[str, str, str, Column]


class Watch:
    """What is to be counted in some plans; ``report`` once they are written."""

    def __init__(self) -> None:
        self._seen: list[tuple[str, Sequence[tuple[str, str, str]], Observation]] = []
        self._known: list[DataFrame] = []

    def rules(self, df: DataFrame, source: str, rules: Sequence[Rule]) -> DataFrame:
        """``df``, with the rows counted that meet each (rule, column, severity, condition), and all rows."""
        observed = Observation()
        counts = [F.count_if(cond).alias(f"c{i}") for i, (*_, cond) in enumerate(rules)]
        self._seen.append((source, [rule[:3] for rule in rules], observed))
        return df.observe(observed, F.count(F.lit(1)).alias("rows"), *counts)

    def table(self, df: DataFrame, spec: TableSpec, list_severity: str = WARNING) -> DataFrame:
        """All checks of a spec but that of its key: columns and types now, rows as they are written.

        A list rule has the least and the greatest value outside the list as its sample.
        """
        self._known += [check_columns(df, spec), check_types(df, spec)]
        observed = Observation()
        rules = counted_rules(df, spec, list_severity)
        counts = [F.count_if(cond).alias(f"c{i}") for i, (*_, cond) in enumerate(rules)]
        for i, (rule, column, _, cond) in enumerate(rules):
            if rule == "not_allowed":
                bad = F.when(cond, c(column).cast("string"))
                counts += [F.min(bad).alias(f"least{i}"), F.max(bad).alias(f"most{i}")]
        self._seen.append((spec.name, [rule[:3] for rule in rules], observed))
        return df.observe(observed, F.count(F.lit(1)).alias("rows"), *counts)

    def changes(self, df: DataFrame, source: str, conditions: Mapping[str, Column]) -> DataFrame:
        """Rows that each cleaning rule is about to touch, counted with its own predicate."""
        return self.rules(df, source, [("changed", name, WARNING, cond) for name, cond in conditions.items()])

    def losses(self, df: DataFrame, source: str, steps: Mapping[str, Column]) -> DataFrame:
        """Rows about to be lost at each filter of a chain: at the first one whose keep-condition is not true."""
        kept, rules = F.lit(True), []
        for name, keep in steps.items():
            fails = ~F.coalesce(keep, F.lit(False))
            rules.append(("lost", name, WARNING, kept & fails))
            kept = kept & ~fails
        return self.rules(df, source, rules)

    def report(self, spark: SparkSession) -> DataFrame:
        """Findings with a count above zero.  Waits for the writes of all watched plans."""
        rows = []
        for source, rules, observed in self._seen:
            got = observed.get
            for i, (rule, column, severity) in enumerate(rules):
                sample = None
                if got.get(f"least{i}") is not None:
                    sample = ", ".join(dict.fromkeys((got[f"least{i}"], got[f"most{i}"])))
                if got[f"c{i}"]:
                    rows.append((source, rule, column, severity, got[f"c{i}"], sample))
        out = spark.createDataFrame(rows, REPORT_SCHEMA)
        for more in self._known:
            out = out.unionByName(more)
        return out

    def rows(self) -> dict[str, int]:
        """Rows written, by source; of several plans of a source, those of the last."""
        return {source: observed.get["rows"] for source, _, observed in self._seen}


