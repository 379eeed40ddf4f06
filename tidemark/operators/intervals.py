"""Algebra of closed intervals: column functions on their ends, and operators on tables of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def check(sd, ed) -> None:
    if sd > ed:
        raise ValueError(f"interval ends before it starts: {sd} > {ed}")


def same(sd: Column, ed: Column, other_sd: Column, other_ed: Column) -> Column:
    return sd.eqNullSafe(other_sd) & ed.eqNullSafe(other_ed)


def as_text(sd: Column, ed: Column) -> Column:
    return F.concat(F.lit("["), sd.cast("string"), F.lit(", "), ed.cast("string"), F.lit("]"))


def overlaps(sd: Column, ed: Column, other_sd: Column, other_ed: Column) -> Column:
    return (sd <= other_ed) & (ed >= other_sd)


def contains(sd: Column, ed: Column, point: Column) -> Column:
    return (point >= sd) & (point <= ed)


def includes(sd: Column, ed: Column, other_sd: Column, other_ed: Column) -> Column:
    return (sd <= other_sd) & (ed >= other_ed)


def intersection(sd: Column, ed: Column, other_sd: Column, other_ed: Column, least: Column) -> Column:
    """Struct (sd, ed) of the common part, null unless it is at least ``least`` long."""
    low, high = F.greatest(sd, other_sd), F.least(ed, other_ed)
    return F.when(high - low >= least, F.struct(low.alias("sd"), high.alias("ed")))


def difference(sd: Column, ed: Column, other_sd: Column, other_ed: Column, least: Column) -> Column:
    """Array of structs (sd, ed): the parts of the other interval that this one leaves out and that are at least ``least``
    long. Disjoint intervals are bridged: the gap between them counts as left out."""
    kind = F.struct(other_sd.alias("sd"), other_ed.alias("ed"))
    none = F.filter(F.array(kind), lambda _: F.lit(False))

    def part(low: Column, high: Column) -> Column:
        return F.when(high - low >= least, F.array(F.struct(low.alias("sd"), high.alias("ed")))).otherwise(none)

    inside = includes(sd, ed, other_sd, other_ed)
    around = includes(other_sd, other_ed, sd, ed)
    return F.when(inside, none).when(around, F.concat(part(other_sd, sd), part(ed, other_ed))).when(
        other_ed > ed, part(ed, other_ed)).when(other_sd < sd, part(other_sd, sd)).otherwise(none)


def sort_by_start(df: DataFrame, reverse: bool = False, sd: str = "sd", ed: str = "ed") -> DataFrame:
    return df.orderBy(*[(F.desc(c) if reverse else F.asc(c)) for c in (sd, ed)])


def coalesce(df: DataFrame, keys: Sequence[str], sd: str = "sd", ed: str = "ed") -> DataFrame:
    """Touching and overlapping intervals of each key merged."""
    by = [F.col(k) for k in keys] or [F.lit(0)]
    w = Window.partitionBy(*by).orderBy(sd, ed)
    reach = F.max(ed).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.when(F.col(sd) <= reach, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min(sd).alias(sd), F.max(ed).alias(ed)).drop("_island")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Pairs of overlapping intervals ``(sd, ed)`` and ``(other_sd, other_ed)``, whose ends are integers.

    Each interval is filed under the bins of ``width`` that it touches, and bins are joined by equality; a pair counts in
    the bin where its common part starts, so no pair comes twice and none is compared outside its bins.
    """
    def binned(df: DataFrame, sd: str, ed: str) -> DataFrame:
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(sd) / width).cast("long"), F.floor(F.col(ed) / width).cast("long"))))

    joined = binned(left, "sd", "ed").join(binned(right, "other_sd", "other_ed"), [*keys, "_bin"])
    first = F.floor(F.greatest("sd", "other_sd") / width)
    return joined.where(overlaps(F.col("sd"), F.col("ed"), F.col("other_sd"), F.col("other_ed")) & (F.col("_bin") == first)).drop("_bin")
