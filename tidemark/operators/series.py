"""Operators on long series: DataFrames of ``(keys..., ts, value)``.

All windows and aggregations are by key, so work is spread over the series; a missing value is NULL (NaN becomes NULL on
ingest). Nothing here runs Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import timegrid as tg
from tidemark.spec import DuplicateChunkError, StoreSpec


def _by(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys] or [F.lit(0)]


def ingest(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """``(keys..., ts, value)`` with UTC instants and doubles: NaN becomes NULL, what is no time raises ``ValueError``."""
    kind = dict(df.dtypes).get(ts)
    if kind not in ("timestamp", "timestamp_ntz"):
        raise ValueError(f"{ts} must be a timestamp, it is {kind}")
    own = F.col(ts) if kind == "timestamp_ntz" else F.convert_timezone(None, F.lit("UTC"), F.col(ts).cast("timestamp_ntz"))
    return df.select(*keys, own.alias("ts"), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("value"))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not df.groupBy(*keys, "ts").count().where("count > 1").limit(1).isEmpty():
        raise DuplicateChunkError("timestamps repeat within a series")
    return df


def dense_regrid(df: DataFrame, spec: StoreSpec) -> DataFrame:
    """Every instant of the calendar periods from a series' first to its last value; samples off the grid are dropped."""
    keys = list(spec.keys)
    filled = df.where(F.col("value").isNotNull())
    ends = filled.groupBy(*keys).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    start = tg.chunk_bounds(tg.chunk_index(F.col("lo"), spec), spec)[0]
    end = tg.chunk_bounds(tg.chunk_index(F.col("hi"), spec), spec)[1]
    slots = ends.where(F.col("lo").isNotNull()).select(*keys, F.explode(tg.grid(start, end, spec)).alias("ts"))
    return slots.join(filled, [*keys, "ts"], "left").select(*keys, "ts", "value")


def with_chunk(df: DataFrame, spec: StoreSpec) -> DataFrame:
    return df.withColumn("chunk_index", tg.chunk_index(F.col("ts"), spec))


def pack(df: DataFrame, spec: StoreSpec) -> DataFrame:
    """Dense rows as chunks ``(keys..., chunk_index, start_ts, values)``. A chunk is one calendar period, so bounded."""
    rows = with_chunk(df, spec).groupBy(*spec.keys, "chunk_index").agg(
        F.min("ts").alias("start_ts"), F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("rows"))
    return rows.select(*spec.keys, "chunk_index", "start_ts", F.transform("rows", lambda r: r["value"]).alias("values"))


def pack_sparse(df: DataFrame, spec: StoreSpec) -> DataFrame:
    """What ``pack(dense_regrid(df))`` gives, without laying out the grid as rows: samples are shuffled once, by their chunk,
    and only arrays are filled up with nulls. Periods between a series' first and last value have a chunk of nulls."""
    from tidemark.spec import DAY

    keys = list(spec.keys)
    rows = with_chunk(df.where(F.col("value").isNotNull() & F.col("ts").isNotNull()), spec)
    start, end = tg.chunk_bounds(F.col("chunk_index"), spec)
    if spec.step_us < DAY:
        offset = tg.between_us(start, F.col("ts"))
        slots, size = F.when(offset % spec.step_us == 0, F.floor(offset / spec.step_us)), tg.between_us(start, end) / spec.step_us
    else:
        local, first = tg.to_local(F.col("ts"), spec.tz), tg.to_local(start, spec.tz)
        slots = F.when(F.date_trunc("day", local).cast("timestamp_ntz") == local, F.datediff(local.cast("date"), first.cast("date")))
        size = F.datediff(tg.to_local(end, spec.tz).cast("date"), first.cast("date"))
    placed = rows.select(*keys, "chunk_index", slots.cast("int").alias("slot"), "value")
    filled = placed.groupBy(*keys, "chunk_index").agg(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "value"))).alias("entries"))
    if keys:
        ends = filled.groupBy(*keys).agg(F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"))
    else:
        ends = filled.agg(F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high")).where("low is not null")
    chunks = ends.select(*keys, F.explode(F.sequence("low", "high")).alias("chunk_index")).join(filled, [*keys, "chunk_index"], "left")
    entries = F.coalesce("entries", F.array().cast("array<struct<slot:int,value:double>>"))
    free = F.array_except(F.sequence(F.lit(0), F.col("size") - 1), F.transform("entries", lambda e: e["slot"]))
    gaps = F.transform(free, lambda i: F.struct(i.alias("slot"), F.lit(None).cast("double").alias("value")))
    chunks = chunks.select(*keys, "chunk_index", start.alias("start_ts"), size.cast("int").alias("size"), entries.alias("entries"))
    return chunks.select(*keys, "chunk_index", "start_ts", F.transform(F.sort_array(F.concat("entries", gaps)), lambda e: e["value"]).alias("values"))


def unpack(chunks: DataFrame, spec: StoreSpec) -> DataFrame:
    """Rows ``(keys..., chunk_index, ts, value)`` of chunks; instants follow from the first one and the position."""
    from tidemark.spec import DAY

    rows = chunks.select(*spec.keys, "chunk_index", "start_ts", F.posexplode("values").alias("pos", "value"))
    if spec.step_us < DAY:
        ts = F.timestamp_add("MICROSECOND", F.col("pos").cast("long") * spec.step_us, F.col("start_ts"))
    else:
        ts = tg.to_utc(F.timestamp_add("DAY", F.col("pos"), tg.to_local(F.col("start_ts"), spec.tz)), spec.tz)
    return rows.select(*spec.keys, "chunk_index", ts.alias("ts"), "value")


def overlay(frames: Sequence[DataFrame], keys: Sequence[str], order_col: str = "ts") -> DataFrame:
    """Null-aware overlay: of the frames in turn, the first value that is not null; all their instants are kept."""
    tagged = [f.select(*keys, order_col, F.col("value").cast("double").alias("value"), F.lit(i).alias("prio")) for i, f in enumerate(frames)]
    rows = reduce(DataFrame.unionByName, tagged)
    return rows.groupBy(*keys, order_col).agg(F.expr("min_by(value, prio) FILTER (WHERE value IS NOT NULL)").alias("value"))


def join_safe(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``df`` joined with ``other`` on ``keys``, where null equals null; the keys of ``df`` stay."""
    names = {k: f"_other_{i}" for i, k in enumerate(keys)}
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return df.join(other.withColumnsRenamed(names), same, how).drop(*names.values())


def with_totals(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """``df`` with aggregates of each series as further columns. They are summed up before any shuffle and joined back, by a
    broadcast where there are few series, so that a long series is not gathered in one task."""
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*[t.alias(n) for n, t in totals.items()])))  # one row
    return join_safe(df, df.groupBy(*keys).agg(*[t.alias(n) for n, t in totals.items()]), keys, "inner")


def head_trim(df: DataFrame, by: Sequence[str], delay_us: int, order_col: str = "ts") -> DataFrame:
    """Rows from ``delay_us`` after the first of each series on."""
    return with_totals(df, by, _first=F.min(order_col)).where(F.col(order_col) >= F.col("_first") + tg.step(delay_us)).drop("_first")


def _descending(c: Column, kind: str) -> Column:
    """A column that orders the other way round; null stays null."""
    if kind in ("timestamp", "timestamp_ntz"):
        return -F.unix_micros(c.cast("timestamp"))
    if kind == "date":
        return -F.unix_date(c)
    if kind == "boolean":
        return ~c
    if kind in ("string", "binary"):  # the complement of each half byte, and a letter above them at the end
        return F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    return -c


def priority(df: DataFrame, order_by: Sequence[str], ties: Sequence[str] = ()) -> Column:
    """A struct whose smallest value comes first in ``order_by`` (``-`` for descending), nulls last, then by ``ties``."""
    kinds, parts = dict(df.dtypes), []
    for name in [*order_by, *ties]:
        c = F.col(name.removeprefix("-"))
        parts += [c.isNull(), _descending(c, kinds[name[1:]]) if name.startswith("-") else c]
    return F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)])


def combine_versions(df: DataFrame, combined_by: Sequence[str] = ("prm",), order_by: Sequence[str] = ("-version",), delay_us: int | None = None,
                     order_col: str = "ts", version_by: Sequence[str] = ("version",), metadata: Sequence[str] = ()) -> DataFrame:
    """Overlay of the versions of each group, in the order of ``order_by`` (``-`` for descending), of any kind of field.

    Versions that are equal in it follow each other by ``version_by``. ``metadata`` are columns to be carried along: those of
    the group's first version.
    """
    if delay_us is not None:
        df = head_trim(df, [*combined_by, *version_by], delay_us, order_col)
    there = [v for v in version_by if v in df.columns]
    order = priority(df, order_by, [v for v in there if v not in {o.removeprefix("-") for o in order_by}])
    rows = df.select(*combined_by, order_col, "value", order.alias("prio"), *[F.col(m).alias(f"_meta_{i}") for i, m in enumerate(metadata)])
    out = rows.groupBy(*combined_by, order_col).agg(F.expr("min_by(value, struct(prio, value)) FILTER (WHERE value IS NOT NULL)").alias("value"))
    if not metadata:
        return out
    first = F.min(F.struct("prio", *[f"_meta_{i}" for i in range(len(metadata))]))
    groups = rows.groupBy(*combined_by).agg(first.alias("first"))
    return join_safe(out, groups, combined_by, "inner").select(*combined_by, order_col, "value", *[F.col(f"first._meta_{i}").alias(m) for i, m in enumerate(metadata)])


def slice_half_open(df: DataFrame, start, end, order_col: str = "ts") -> DataFrame:
    return df.where((F.col(order_col) >= F.lit(start)) & (F.col(order_col) < F.lit(end)))


def slice_closed(df: DataFrame, start=None, end=None, order_col: str = "ts") -> DataFrame:
    if start is not None:
        df = df.where(F.col(order_col) >= F.lit(start))
    return df if end is None else df.where(F.col(order_col) <= F.lit(end))


def split_at(df: DataFrame, at, low=None, high=None, order_col: str = "ts") -> DataFrame:
    """Both closed halves, told apart by ``side``; the row at the split is in both."""
    if low is not None and low >= at or high is not None and high <= at:
        raise ValueError("the bounds must lie on both sides of the split")
    return slice_closed(df, low, at, order_col).withColumn("side", F.lit("left")).unionByName(
        slice_closed(df, at, high, order_col).withColumn("side", F.lit("right")))


def trim_null_edges(df: DataFrame, keys: Sequence[str], order_col: str = "ts") -> DataFrame:
    """Without the nulls before a series' first and after its last value; a series of nulls only is kept whole."""
    valid = F.when(F.col("value").isNotNull(), F.col(order_col))
    ends = with_totals(df, keys, _lo=F.min(valid), _hi=F.max(valid))
    return ends.where(F.col("_lo").isNull() | F.col(order_col).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def constant_runs(df: DataFrame, keys: Sequence[str], order_col: str = "ts") -> DataFrame:
    """``(keys..., start, end, value)`` of maximal runs of equal values; null equals null."""
    w = Window.partitionBy(*_by(keys)).orderBy(order_col)
    changed = F.when(F.row_number().over(w) == 1, 1).when(F.col("value").eqNullSafe(F.lag("value").over(w)), 0).otherwise(1)
    runs = df.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min(order_col).alias("start"), F.max(order_col).alias("end"), F.first("value").alias("value")).drop("_run")


def upsample(coarse: DataFrame, reference: DataFrame, keys: Sequence[str], order_col: str = "ts") -> DataFrame:
    """Coarse values on the reference's instants, in the shape of the reference.

    Each coarse sample at an instant of the reference starts a period. A row is reference / mean x coarse value, where the
    mean takes in the period and the first row of the next one; a mean of 0 gives the coarse value; rows before the first
    period are null.
    """
    ref = reference.select(*keys, order_col, F.col("value").alias("ref"))
    feat = coarse.where(F.col("value").isNotNull()).select(*keys, order_col, F.col("value").alias("feat"))
    w = Window.partitionBy(*_by(keys)).orderBy(order_col)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = ref.join(feat, [*keys, order_col], "left").withColumn("_period", F.sum(F.when(F.col("feat").isNotNull(), 1).otherwise(0)).over(run))
    rows = rows.withColumn("feat", F.last("feat", ignorenulls=True).over(run))
    periods = rows.where("_period > 0").groupBy(*keys, "_period").agg(
        F.sum(F.col("ref").cast("decimal(28,6)")).cast("double").alias("_sum"), F.count("ref").alias("_n"), F.min_by("ref", order_col).alias("_first"))
    nxt = F.lead("_first").over(Window.partitionBy(*_by(keys)).orderBy("_period"))
    periods = periods.withColumn("_next", nxt).select(
        *keys, "_period", ((F.col("_sum") + F.coalesce("_next", F.lit(0.0))) / F.nullif(F.col("_n") + F.when(F.col("_next").isNotNull(), 1).otherwise(0), F.lit(0))).alias("_mean"))
    value = F.when(F.col("_mean") == 0, F.col("feat")).otherwise(F.col("ref") / F.nullif(F.col("_mean"), F.lit(0.0)) * F.col("feat"))
    return rows.join(periods, [*keys, "_period"], "left").select(*keys, order_col, F.when(F.col("_period") > 0, value).alias("value"))


def normalize(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(value - min) / (max - min) of each series; null where a series is constant."""
    ends = with_totals(df, keys, _low=F.min("value"), _high=F.max("value"))
    scaled = (F.col("value") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    return ends.withColumn("value", scaled).drop("_low", "_high")


def min_frequency(df: DataFrame, keys: Sequence[str], order_col: str = "ts") -> DataFrame:
    """``(keys..., step_us)``: the smallest step between neighbouring instants, null for fewer than two."""
    w = Window.partitionBy(*_by(keys)).orderBy(order_col)
    return df.withColumn("_us", tg.between_us(F.lag(order_col).over(w), F.col(order_col))).groupBy(*keys).agg(F.min("_us").alias("step_us"))
