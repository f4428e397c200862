"""Delimited text records: split, classify, decode by position."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedworks.functions.dates import parse_date
from feedworks.functions.once import computed_once
from feedworks.functions.text import clean


@dataclass(frozen=True)
class Field:
    """One positional field.

    With ``formats`` it decodes to a date called ``name`` and keeps the text it
    came from as ``<name>_raw``; with ``upper`` the text is upper-cased.
    """

    name: str
    position: int
    formats: tuple[str, ...] = ()
    upper: bool = False

    @property
    def text_name(self) -> str:
        return f"{self.name}_raw" if self.formats else self.name


def split_record(
    df: DataFrame, line: str = "raw_record", delimiter: str = "|"
) -> DataFrame:
    """Add ``fields``, ``record_type`` and ``field_count``.

    Records open with the delimiter, so the type is field 1. Trailing empty
    fields count.
    """
    fields = F.split(F.col(line), re.escape(delimiter), -1)
    return df.withColumn("fields", computed_once(fields)).withColumns(
        {
            "record_type": F.get("fields", F.lit(1)),
            "field_count": F.size("fields"),
        }
    )


def _text(field: Field) -> Column:
    value = clean(F.get("fields", F.lit(field.position)))
    return (F.upper(value) if field.upper else value).alias(field.text_name)


def decode(
    df: DataFrame, fields: Sequence[Field], keep: Sequence[str]
) -> DataFrame:
    """Typed columns from ``fields``, beside the ``keep`` columns."""
    dates = {
        field.name: parse_date(F.col(field.text_name), *field.formats)
        for field in fields
        if field.formats
    }
    decoded = df.select(*keep, *[_text(field) for field in fields])
    return decoded.withColumns(dates) if dates else decoded
