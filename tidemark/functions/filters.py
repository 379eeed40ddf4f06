"""Filters written as ``field`` or ``field__lookup`` names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOKUPS = {
    "exact": lambda c, v: c.isNull() if v is None else c == F.lit(v),
    "in": lambda c, v: c.isin(list(v)),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "range": lambda c, v: c.between(F.lit(v[0]), F.lit(v[1])),
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
    "contains": lambda c, v: c.contains(v),
    "startswith": lambda c, v: c.startswith(v),
    "endswith": lambda c, v: c.endswith(v),
}


def condition(filters: Mapping[str, object] | None, fields: Sequence[str]) -> Column:
    """The filters as one predicate; an unknown field or lookup is a ``ValueError``."""
    out = F.lit(True)
    for name, value in (filters or {}).items():
        field, _, lookup = name.partition("__")
        if field not in fields:
            raise ValueError(f"unknown field: {field}")
        if (lookup or "exact") not in LOOKUPS:
            raise ValueError(f"unknown lookup: {lookup}")
        out = out & LOOKUPS[lookup or "exact"](F.col(field), value)
    return out


def where(df: DataFrame, filters: Mapping[str, object] | None, fields: Sequence[str]) -> DataFrame:
    return df.where(condition(filters, fields)) if filters else df


def require_all(attrs: Mapping[str, object], keys: Sequence[str]) -> None:
    if set(attrs) != set(keys):
        raise ValueError(f"all of {sorted(keys)} must be given, and nothing else: {sorted(attrs)}")
