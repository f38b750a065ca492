"""Employee flags generated from the rule tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from staffloom.specs.rules import AgeRule, ContractRule


def age_flag(birth: Column, as_of: Column, rule: AgeRule) -> Column:
    """Does the person reach the age in the as-of year (or a later one)?  Uses years only."""
    return F.year(birth) == F.year(as_of) + F.lit(rule.year_offset - rule.age)


def contract_alert(modality: Column, years: Column, rule: ContractRule) -> Column:
    """Contract of the rule's type with service at or past its alert limit (three-valued)."""
    return (modality == rule.modality) & (years >= F.lit(rule.alert_years))
