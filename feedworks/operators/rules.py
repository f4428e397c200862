"""Declarative record checks.

A rule is a code and a condition under which a record earns that code. A NULL
condition does not fire. All fired codes of a row are first gathered as one
comma-separated text: for a good row that is the empty string, so routing is a
plain string comparison inside generated code, and arrays are only built for
rows that need one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedworks.functions.once import computed_once

ERRORS = "validation_errors"
# What kind of record a row stands for, where one pass checks several kinds.
LEVEL = "level"
_CODES = "__fired_codes"


@dataclass(frozen=True)
class Rule:
    code: str
    fires: Column

    def __post_init__(self):
        if not self.code or "," in self.code:
            raise ValueError(f"not a usable error code: {self.code!r}")


class Routed(NamedTuple):
    valid: DataFrame
    invalid: DataFrame


def fired_codes(rules: Sequence[Rule]) -> Column:
    """Distinct codes of the rules that fire, comma-separated, in rule order."""
    by_code: dict[str, list[Column]] = {}
    for rule in rules:
        by_code.setdefault(rule.code, []).append(rule.fires)
    marks = []
    for code, conditions in by_code.items():
        mark = F.when(conditions[0], F.lit(code))
        for condition in conditions[1:]:
            mark = mark.when(condition, F.lit(code))
        marks.append(mark)
    return F.concat_ws(",", *marks)


def _code_array(codes: Column) -> Column:
    nothing = F.array().cast("array<string>")
    return F.when(codes == "", nothing).otherwise(F.split(codes, ","))


def with_errors(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the error-code array; an empty array marks a valid row."""
    return (
        df.withColumn(_CODES, computed_once(fired_codes(rules)))
        .withColumn(ERRORS, _code_array(F.col(_CODES)))
        .drop(_CODES)
    )


def route(df: DataFrame, rules: Sequence[Rule]) -> Routed:
    """Split rows into those no rule fires on and the rest with their codes."""
    checked = df.withColumn(_CODES, computed_once(fired_codes(rules)))
    return Routed(
        valid=checked.filter(F.col(_CODES) == "").drop(_CODES),
        invalid=checked.filter(F.col(_CODES) != "")
        .withColumn(ERRORS, F.split(_CODES, ","))
        .drop(_CODES),
    )


def with_level_errors(
    df: DataFrame, rules: Mapping[str, Sequence[Rule]]
) -> DataFrame:
    """``with_errors`` by the rules of each row's ``LEVEL``, in one pass.

    ``df`` has one row for each record of each level, such as a line and the row
    decoded from it, so a record that is bad on two levels gives two bad rows.
    """
    codes = F.lit("")
    for level, own in rules.items():
        codes = F.when(F.col(LEVEL) == level, fired_codes(own)).otherwise(codes)
    return (
        df.withColumn(_CODES, computed_once(codes))
        .withColumn(ERRORS, _code_array(F.col(_CODES)))
        .drop(_CODES)
    )


def is_rejected() -> Column:
    return F.size(ERRORS) > 0


def is_accepted(level: str) -> Column:
    return (F.col(LEVEL) == level) & (F.size(ERRORS) == 0)
