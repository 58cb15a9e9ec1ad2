"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def non_blank(value: Column) -> Column:
    """The value itself, or null where it is null or only white space."""
    return F.when(value.rlike(r"\S"), value)


def first_non_blank(*values: Column) -> Column:
    return F.coalesce(*[non_blank(v) for v in values])


def after_last_dot(value: Column) -> Column:
    return F.substring_index(value, ".", -1)


def prefixed(value: Column, *accepted: str, prefix: str) -> Column:
    """``value`` if it already starts with an accepted prefix, else with ``prefix``."""
    has = F.lit(False)
    for start in accepted:
        has = has | value.startswith(start)
    return F.when(has, value).otherwise(F.concat(F.lit(prefix), value))


def short_hash(*values: Column, length: int) -> Column:
    """Deterministic id text: the first hex digits of an md5 over the values."""
    return F.substring(F.md5(F.concat_ws("|", *values)), 1, length)


def evaluated_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` so that it is computed once per row.

    A plain column holding a parse is evaluated again for each filter pushed
    down on it; the output of a generator is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
