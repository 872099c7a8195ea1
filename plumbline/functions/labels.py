"""Label and path strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def en_dash(text: Column) -> Column:
    return F.translate(text, "-", "–")


def plain_dash(text: Column) -> Column:
    return F.translate(text, "–", "-")


def path_value(path: Column, key: str) -> Column:
    """The value of a ``KEY--value`` segment of a path; null if there is none."""
    found = F.regexp_extract(path, rf"(?:^|[/_]){key}--([^/_]*)", 1)
    return F.when(found != "", found)


def half_up(value: Column) -> Column:
    """The next multiple of one half."""
    return F.ceil(value * 2) / 2


def numeric(text: Column) -> Column:
    return text.rlike("^[0-9]+$")
