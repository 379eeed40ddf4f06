"""Operators on series, gaps and intervals, against hand-worked results and pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gaps, intervals, series
from tidemark.spec import DuplicateChunkError, StoreSpec

HOUR, DAY = 3_600_000_000, 86_400_000_000


def frame(spark, rows, schema="k string, ts string, value double"):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def numbered(spark, values, k="a"):
    return spark.createDataFrame([(k, i, v) for i, v in enumerate(values)], "k string, ts long, value double")


def values(df):
    return [r.value for r in df.orderBy("ts").collect()]


def random_series(seed: int, n: int = 500) -> pd.Series:
    rng = np.random.default_rng(seed)
    out = pd.Series(rng.standard_normal(n).round(3), index=pd.date_range("2024-01-01", periods=n, freq="h"))
    for at in rng.integers(0, n - 20, 4):
        out.iloc[at : at + rng.integers(1, 20)] = np.nan
    return out


def lifted(spark, s: pd.Series, k: str = "a"):
    return frame(spark, [(k, str(t), None if np.isnan(v) else float(v)) for t, v in s.items()])


def test_ingest_turns_nan_into_null_and_refuses_other_types(spark):
    out = series.ingest(frame(spark, [("a", "2024-01-01", float("nan")), ("a", "2024-01-02", 2.0)]), ["k"])
    assert values(out) == [None, 2.0]
    with pytest.raises(ValueError):
        series.ingest(numbered(spark, [1.0]), ["k"])
    with pytest.raises(DuplicateChunkError):
        series.check_unique(frame(spark, [("a", "2024-01-01", 1.0), ("a", "2024-01-01", 2.0)]), ["k"])


def test_overlay_takes_the_first_value_and_keeps_all_instants(spark):
    a, b = numbered(spark, [1.0, None, None]), numbered(spark, [9.0, 2.0, None, 4.0])
    assert values(series.overlay([a, b], ["k"])) == [1.0, 2.0, None, 4.0]
    assert values(series.overlay([a.limit(0), b], ["k"])) == [9.0, 2.0, None, 4.0]


@pytest.mark.parametrize("seed", [1, 2])
def test_overlay_and_trim_agree_with_pandas(spark, seed):
    a, b = random_series(seed), random_series(seed + 10).iloc[100:].shift(30, freq="h")
    want = a.combine_first(b)
    got = series.overlay([lifted(spark, a), lifted(spark, b)], ["k"]).orderBy("ts").toPandas()
    assert np.allclose(got["value"].astype(float), want.to_numpy(), equal_nan=True) and list(got["ts"]) == list(want.index)
    low, high = want.index[20], want.index[-20]
    cut = want[low:high]
    cut = cut[cut.first_valid_index() : cut.last_valid_index()]
    rows = series.slice_closed(series.overlay([lifted(spark, a), lifted(spark, b)], ["k"]), F.lit(str(low)).cast("timestamp_ntz"), F.lit(str(high)).cast("timestamp_ntz"))
    assert list(series.trim_null_edges(rows, ["k"]).orderBy("ts").toPandas()["ts"]) == list(cut.index)


def test_a_window_of_nulls_is_kept_whole(spark):
    assert values(series.trim_null_edges(numbered(spark, [None, None]), ["k"])) == [None, None]
    assert values(series.trim_null_edges(numbered(spark, [None, 1.0, None, 2.0, None]), ["k"])) == [1.0, None, 2.0]


def test_slices_and_splits(spark):
    df = numbered(spark, [0.0, 1.0, 2.0, 3.0])
    assert values(series.slice_half_open(df, 1, 3)) == [1.0, 2.0] and values(series.slice_closed(df, 1, 3)) == [1.0, 2.0, 3.0]
    halves = series.split_at(df, 2, 1, 3)
    assert values(halves.where("side = 'left'")) == [1.0, 2.0] and values(halves.where("side = 'right'")) == [2.0, 3.0]
    for low, high in ((2, None), (None, 2)):
        with pytest.raises(ValueError):
            series.split_at(df, 2, low, high)


def test_versions_combine_from_the_highest_down(spark):
    df = spark.createDataFrame([("p", 0, 1, 1.0), ("p", 0, 2, 2.0), ("p", 1, 1, 10.0), ("p", 1, 2, None), ("p", 1, 3, 30.0)], "prm string, version int, ts long, value double")
    assert values(series.combine_versions(df)) == [10.0, 2.0, 30.0]
    assert values(series.combine_versions(df, order_by=("version",))) == [1.0, 2.0, 30.0]


def test_versions_combine_by_fields_of_any_kind(spark):
    rows = [("p", "a", "2024-01-03", True, 1, 1.0), ("p", "ab", "2024-01-01", False, 1, 2.0), ("p", "b", None, None, 1, 3.0), ("p", None, "2024-01-02", True, 1, 4.0)]
    df = spark.createDataFrame(rows, "prm string, kind string, day string, flag boolean, ts long, value double").withColumn("day", F.col("day").cast("date"))
    def first(*by):
        return values(series.combine_versions(df, order_by=by, version_by=("kind",)))[0]
    assert [first("kind"), first("-kind"), first("day"), first("-day"), first("-flag", "-kind"), first("flag")] == [1.0, 3.0, 2.0, 1.0, 1.0, 2.0]
    times = df.withColumn("day", F.col("day").cast("timestamp_ntz"))
    assert values(series.combine_versions(times, order_by=("-day",), version_by=("kind",))) == [1.0]
    tied = df.withColumn("kind", F.lit("same")).withColumn("n", F.col("value").cast("int"))
    assert values(series.combine_versions(tied, order_by=("kind",), version_by=("n",))) == [1.0]
    assert values(series.combine_versions(df.where("kind in ('a', 'ab')"), order_by=("-kind",))) == [2.0]


def test_holes_of_empty_and_null_series(spark):
    lo, hi = "2024-01-01 00:00:00", "2024-01-01 05:30:00"
    none = frame(spark, [("a", lo, None), ("b", "2024-02-01 00:00:00", 1.0)])
    wanted = spark.createDataFrame([("a",), ("c",), (None,)], "k string")
    got = sorted((str(r.k), str(r.start), str(r.end)) for r in gaps.holes(none, ["k"], lo, hi, HOUR, HOUR, wanted).collect())
    whole, wide = (lo, hi), ("2023-12-31 23:00:00", "2024-01-01 06:00:00")
    assert got == [("None", *whole), ("a", *wide), ("b", *wide), ("c", *whole)]
    assert [(str(r.start), str(r.end)) for r in gaps.holes(none.limit(0).drop("k"), [], lo, hi, HOUR, HOUR).collect()] == [whole]
    assert [(str(r.start), str(r.end)) for r in gaps.holes(none.where("k = 'a'").drop("k"), [], lo, hi, HOUR).collect()] == [(lo, "2024-01-01 05:00:00")]
    one = frame(spark, [("a", "2024-01-01 01:00:00", 1.0)])
    said = gaps.check_completeness(one, ["k"], lo, "2024-01-01 03:00:00", HOUR).orderBy("start").collect()
    assert [(r.start.hour, r.end.hour) for r in said] == [(23, 1), (1, 4)] and said[1].message == "a misses 2024-01-01 01:00:00 to 2024-01-01 04:00:00 (holes widen by 3600 s)"


def test_delay_trims_the_head_of_each_version(spark):
    rows = [("p", 0, f"2024-01-0{i}", 1.0) for i in range(1, 6)] + [("p", 1, f"2024-01-0{i}", 2.0) for i in range(2, 6)]
    df = frame(spark, rows, "prm string, version int, ts string, value double")
    assert values(series.combine_versions(df, delay_us=DAY)) == [1.0, 2.0, 2.0, 2.0]
    assert values(series.combine_versions(df, delay_us=2 * DAY)) == [1.0, 2.0, 2.0]


def test_constant_runs(spark):
    got = series.constant_runs(numbered(spark, [1.0, 1.0, None, None, 1.0, 2.0, 2.0]), ["k"]).orderBy("start").collect()
    assert [(r.start, r.end, r.value) for r in got] == [(0, 1, 1.0), (2, 3, None), (4, 4, 1.0), (5, 6, 2.0)]


def test_upsampling_by_a_reference(spark):
    coarse = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 20.0), ("a", 99, 7.0)], "k string, ts long, value double")
    got = values(series.upsample(coarse, numbered(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ["k"]))
    assert got[0] is None and got[1:] == pytest.approx([20 / 3, 10, 16, 20, 24])
    flat = values(series.upsample(coarse, numbered(spark, [0.0] * 6), ["k"]))
    assert flat == [None, 10.0, 10.0, 20.0, 20.0, 20.0]


def test_normalise_and_smallest_step(spark):
    assert values(series.normalize(numbered(spark, [1.0, 3.0, None, 2.0]), ["k"])) == [0.0, 1.0, None, 0.5]
    assert values(series.normalize(numbered(spark, [4.0, 4.0]), ["k"])) == [None, None]
    df = frame(spark, [("a", "2024-01-01 00:00", 1.0), ("a", "2024-01-01 03:00", 1.0), ("a", "2024-01-01 04:00", 1.0), ("b", "2024-01-01", 1.0)])
    assert {r.k: r.step_us for r in series.min_frequency(df, ["k"]).collect()} == {"a": HOUR, "b": None}


def test_pack_and_unpack_give_the_same_rows(spark):
    spec = StoreSpec(("k",))
    dense = series.dense_regrid(lifted(spark, random_series(5, 2000)), spec)
    back = series.unpack(series.pack(dense, spec), spec).select("k", "ts", "value")
    assert back.exceptAll(dense).isEmpty() and dense.exceptAll(back).isEmpty()


@pytest.mark.parametrize("spec", [StoreSpec(("k",)), StoreSpec(("k",), tz="UTC", freq="30min"), StoreSpec(("k",), freq="1d"), StoreSpec(("k",), chunk_axis=("year",)), StoreSpec(())])
def test_sparse_packing_gives_the_same_chunks(spark, spec):
    a = random_series(6, 300)
    rows = lifted(spark, a).unionByName(frame(spark, [("a", "2024-04-05 10:00:07", 1.0), ("a", "2024-04-09 22:00:00", 3.0), ("b", "2023-10-28 22:00:00", 2.0), ("c", "2024-01-01", None)]))
    rows = rows if spec.keys else rows.where("k = 'a'").drop("k")
    want = series.pack(series.dense_regrid(rows, spec), spec)
    got = series.pack_sparse(rows, spec)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert series.pack_sparse(rows.limit(0), spec).isEmpty()


# Gaps.


def brute_holes(s: pd.Series, start: str, end: str):
    grid = s.reindex(pd.date_range(start, end, freq="h"))
    out, run = [], None
    for t, v in grid.items():
        if np.isnan(v):
            run = [run[0], t] if run else [t, t]
        elif run:
            out.append(tuple(run))
            run = None
    return out + ([tuple(run)] if run else [])


@pytest.mark.parametrize("seed", [3, 4])
def test_holes_agree_with_a_scan_of_the_grid(spark, seed):
    s = random_series(seed)
    start, end = "2023-12-31 20:00:00", "2024-01-25 00:00:00"
    got = gaps.holes(lifted(spark, s), ["k"], start, end, HOUR).orderBy("start").collect()
    assert [(pd.Timestamp(r.start), pd.Timestamp(r.end)) for r in got] == brute_holes(s, start, end)


def test_holes_by_day(spark):
    days = [f"2024-01-{d:02d}" for d in range(1, 12)]
    hole = {"b": [2, 3], "c": [2, 3, 5, 6, 7, 8]}
    df = frame(spark, [(k, d, None if i + 1 in hole.get(k, []) else 1.0) for k in "abc" for i, d in enumerate(days)])
    wanted = spark.createDataFrame([(k,) for k in "abcd"], "k string")
    got = gaps.holes(df, ["k"], days[0], days[-1], DAY, expected=wanted).collect()
    spans = sorted((r.k, r.start.day, r.end.day) for r in got)
    assert spans == [("b", 2, 3), ("c", 2, 3), ("c", 5, 8), ("d", 1, 11)]
    wide = gaps.holes(df.where("k = 'b'"), ["k"], days[0], days[-1], DAY, DAY).first()
    assert (wide.start.day, wide.end.day) == (1, 4)


def test_groups_of_keys_by_what_they_miss(spark):
    day = "2023-01-{:02d} 00:00:00"
    rows = [("p3", day.format(d), 3.0) for d in range(1, 31)] + [("p4", day.format(d), None if d == 5 else 4.0) for d in range(1, 31)]
    rows += [(k, f"2024-01-0{d} 00:00:00", 1.0) for k in ("p1", "p2") for d in range(1, 5)]
    wanted = spark.createDataFrame([(p,) for p in ("p1", "p2", "p3", "p4")], "k string")
    got = gaps.missing_groups(frame(spark, rows), "k", day.format(1), day.format(30), DAY, wanted).collect()
    assert sorted((r.sd.day, r.ed.day, r.prms) for r in got) == [(1, 30, ["p1", "p2"]), (5, 5, ["p4"])]


# Intervals.


def ends(spark, sd, ed, a, b):
    return spark.createDataFrame([(float(sd), float(ed), float(a), float(b))], "sd double, ed double, a double, b double")


@pytest.mark.parametrize(("own", "other", "least", "want"), [
    ((0, 5), (1, 4), 0, []), ((0, 5), (-1, 6), 0, [(-1, 0), (5, 6)]), ((0, 5), (-1, 3), 0, [(-1, 0)]), ((0, 5), (3, 6), 0, [(5, 6)]),
    ((0, 5), (8, 9), 0, [(5, 9)]), ((0, 5), (-2, -1), 0, [(-2, 0)]), ((0, 5), (-0.5, 6), 1, [(5, 6)]), ((0, 5), (0, 6), 1, [(5, 6)]),
])
def test_difference_table(spark, own, other, least, want):
    df = ends(spark, *own, *other)
    got = df.select(intervals.difference(F.col("sd"), F.col("ed"), F.col("a"), F.col("b"), F.lit(float(least))).alias("r")).first().r
    assert [(x.sd, x.ed) for x in got] == want


def test_intersection_overlap_and_membership(spark):
    def of(own, other, least=0.0):
        c = intervals.intersection(F.col("sd"), F.col("ed"), F.col("a"), F.col("b"), F.lit(least))
        r = ends(spark, *own, *other).select(c.alias("r")).first().r
        return r and (r.sd, r.ed)

    assert of((0, 5), (1, 4)) == (1, 4) and of((0, 5), (4, 5), 2.0) is None and of((-1, 3), (4, 6)) is None
    row = ends(spark, 0, 5, 5, 7).select(
        intervals.overlaps(F.col("sd"), F.col("ed"), F.col("a"), F.col("b")).alias("o"), intervals.includes(F.col("sd"), F.col("ed"), F.col("a"), F.col("b")).alias("i"),
        intervals.contains(F.col("sd"), F.col("ed"), F.lit(5.0)).alias("c")).first()
    assert (row.o, row.i, row.c) == (True, False, True)
    intervals.check(1, 1)
    with pytest.raises(ValueError):
        intervals.check(2, 1)


@pytest.mark.parametrize(("rows", "want"), [
    ([(0, 5), (-3, -2), (6, 7)], [(-3, -2), (0, 5), (6, 7)]), ([(-3, 5), (-4, -2), (6, 7)], [(-4, 5), (6, 7)]),
    ([(-3, 6), (-4, -2), (6, 7)], [(-4, 7)]), ([], []), ([(10, 20), (11, 12)], [(10, 20)]), ([(0, 10), (2, 3), (9, 11)], [(0, 11)]),
])
def test_coalescing(spark, rows, want):
    df = spark.createDataFrame(rows, "sd int, ed int")
    assert sorted(map(tuple, intervals.coalesce(df, []).select("sd", "ed").collect())) == want


def test_sorting_by_start(spark):
    df = spark.createDataFrame([(2, 3), (1, 9), (1, 2)], "sd int, ed int")
    assert [tuple(r) for r in intervals.sort_by_start(df).collect()] == [(1, 2), (1, 9), (2, 3)]
    assert [tuple(r) for r in intervals.sort_by_start(df, reverse=True).collect()] == [(2, 3), (1, 9), (1, 2)]


def test_overlap_join_agrees_with_all_pairs(spark):
    rng = np.random.default_rng(0)
    a = [(int(k), int(s), int(s + w)) for k, s, w in zip(rng.integers(0, 3, 60), rng.integers(-50, 200, 60), rng.integers(0, 40, 60), strict=True)]
    b = [(int(k), int(s), int(s + w)) for k, s, w in zip(rng.integers(0, 3, 60), rng.integers(-50, 200, 60), rng.integers(0, 40, 60), strict=True)]
    got = intervals.overlap_join(spark.createDataFrame(a, "k int, sd int, ed int"), spark.createDataFrame(b, "k int, other_sd int, other_ed int"), ["k"], 16)
    want = [(k, s, e, t, f) for k, s, e in a for q, t, f in b if k == q and s <= f and e >= t]
    assert sorted(map(tuple, got.select("k", "sd", "ed", "other_sd", "other_ed").collect())) == sorted(want)
