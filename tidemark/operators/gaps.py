"""Gaps in series, without laying out the grid: holes follow from the distance of neighbouring values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import timegrid as tg
from tidemark.operators import intervals


def holes(df: DataFrame, keys: Sequence[str], start: str, end: str, step_us: int, margin_us: int = 0, expected: DataFrame | None = None) -> DataFrame:
    """``(keys..., start, end)`` of the runs of missing values on the closed grid from ``start`` to ``end``, widened by
    ``margin_us`` on both sides.

    A key of ``expected`` without any row has the whole range, as it is; so has a table without keys and without rows. A key
    that has rows, but no value on the grid, misses the whole grid, widened.
    """
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    slot = tg.between_us(lo, F.col("ts"))
    on_grid = F.col("value").isNotNull() & F.col("ts").between(lo, hi) & (slot % step_us == 0)
    rows = df.where(on_grid).select(*keys, (slot / step_us).cast("long").alias("slot")).distinct()
    last = F.floor(tg.between_us(lo, hi) / step_us)
    by = [F.col(k) for k in keys] or [F.lit(0)]
    w = Window.partitionBy(*by).orderBy("slot")
    before = rows.select(*keys, (F.coalesce(F.lag("slot").over(w), F.lit(-1)) + 1).alias("a"), (F.col("slot") - 1).alias("b"))
    after = rows.groupBy(*keys).agg((F.max("slot") + 1).alias("a")).withColumn("b", last)
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(on_grid, 1)).alias("m"))
    if expected is not None and keys:
        wanted = expected.select(*keys, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"))
        counted = counted.unionByName(wanted).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    whole = counted.where("n > 0 and m = 0").select(*keys, F.lit(0).cast("long").alias("a"), last.alias("b"))
    if not keys:
        after = after.where("a is not null")
    runs = before.unionByName(after).unionByName(whole).where("a <= b")

    def at(slot: str, shift: int):
        return F.timestamp_add("MICROSECOND", F.col(slot) * step_us + shift, lo)

    found = runs.select(*keys, at("a", -margin_us).alias("start"), at("b", margin_us).alias("end"))
    return found.unionByName(counted.where("n = 0").select(*keys, lo.alias("start"), hi.alias("end")))


def check_completeness(df: DataFrame, keys: Sequence[str], start: str, end: str, step_us: int, margin_us: int | None = None, expected: DataFrame | None = None) -> DataFrame:
    """``holes`` with a ``message`` on each; they widen by one step where no margin is given."""
    margin_us = step_us if margin_us is None else margin_us
    found = holes(df, keys, start, end, step_us, margin_us, expected)
    named = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])
    seconds = F.lit(f"{margin_us / 1e6:g}")
    text = F.concat_ws(" ", named, F.lit("misses"), F.col("start").cast("string"), F.lit("to"), F.col("end").cast("string"), F.concat(F.lit("(holes widen by "), seconds, F.lit(" s)")))
    return found.withColumn("message", F.trim(text))


def missing_groups(df: DataFrame, key: str, start: str, end: str, step_us: int, expected: DataFrame) -> DataFrame:
    """``(sd, ed, prms)``: keys grouped by the intervals that they miss within the closed range.

    A key misses the head and tail of the range that its rows do not reach, if at least one step long, and its runs of
    nulls; touching intervals are merged. Keys without rows or with nulls only miss the whole range.
    """
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    rows = df.where(F.col("ts").between(lo, hi)).select(key, "ts", "value")
    live = rows.groupBy(key).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("value").alias("n")).where("n > 0")
    least = tg.step(step_us)
    edges = live.select(key, F.explode(intervals.difference(F.col("a"), F.col("b"), lo, hi, least)).alias("r")).select(key, "r.sd", "r.ed")
    w = Window.partitionBy(key).orderBy("ts")
    island = rows.withColumn("i", F.row_number().over(w)).where("value is null").withColumn("i", F.col("i") - F.row_number().over(w))
    runs = island.groupBy(key, "i").agg(F.min("ts").alias("sd"), F.max("ts").alias("ed")).drop("i").join(live.select(key), key, "left_semi")
    absent = expected.select(key).distinct().join(live.select(key), key, "left_anti").select(key, lo.alias("sd"), hi.alias("ed"))
    found = intervals.coalesce(edges.unionByName(runs).unionByName(absent), [key])
    return found.groupBy("sd", "ed").agg(F.sort_array(F.collect_list(key)).alias("prms"))
