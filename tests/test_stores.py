"""The stores: reads, writes, errors, export and replication."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.sources import export, snapshot
from tidemark.sources.chunked import ChunkedStore
from tidemark.sources.keyed import KeyedStore
from tidemark.sources.snapshot import ConflictError
from tidemark.sources.versioned import VersionedStore
from tidemark.spec import DuplicateChunkError, StoreSpec
from tidemark.streaming.sync import SyncClient, stream_pull

KINDS = {"version": "int"}


def made(start: str, periods: int, seed: int = 0, freq: str = "h") -> pd.Series:
    return pd.Series(np.random.default_rng(seed).standard_normal(periods).round(4), index=pd.date_range(start, periods=periods, freq=freq))


def lifted(spark, s: pd.Series):
    pdf = pd.DataFrame({"ts": s.index.astype(str), "value": s.to_numpy(dtype=float)})
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def back(df) -> pd.Series:
    out = df.orderBy("ts").toPandas()
    return pd.Series(out["value"].to_numpy(dtype=float), index=pd.DatetimeIndex(out["ts"]))


def same(df, want: pd.Series) -> None:
    got = back(df).dropna()
    want = want.dropna()
    assert list(got.index) == list(want.index) and np.allclose(got.to_numpy(), want.to_numpy())


@pytest.fixture
def store(spark, tmp_path):
    return ChunkedStore(spark, str(tmp_path / "t"), StoreSpec(("version", "kind")), KINDS)


@pytest.mark.parametrize(("axis", "tz"), [(("year",), "Europe/Paris"), (("year", "month"), "Europe/Paris"), (("year", "month"), "UTC")])
def test_chunked_round_trip_and_bounds(spark, tmp_path, axis, tz):
    store = ChunkedStore(spark, str(tmp_path / "t"), StoreSpec(("version", "kind"), chunk_axis=axis, tz=tz), KINDS)
    a, key = made("2020-01-01", 3000), {"version": 1, "kind": "a"}
    a.iloc[480:600] = np.nan
    store.set(key, lifted(spark, a))
    same(store.get(key), a)
    assert store.max_ts() == a.last_valid_index().to_pydatetime()
    assert store.get({"version": 2, "kind": "a"}) is None
    low, high = dt.datetime(2020, 2, 3, tzinfo=dt.UTC), dt.datetime(2020, 2, 9, 5, tzinfo=dt.UTC)
    same(store.get(key, low, high), a["2020-02-03":"2020-02-09 05:00"])
    same(store.get(key, None, float("nan")), a)
    assert back(store.get(key)).index[0] == a.first_valid_index()
    with pytest.raises(DuplicateChunkError):
        store.set(key, lifted(spark, a))
    for bad in ({"version": 1}, {"version": 1, "kind": "a", "x": 2}):
        with pytest.raises(ValueError):
            store.get(bad)
    with pytest.raises(ValueError):
        store.set(key, lifted(spark, a), update=True, replace=True)
    with pytest.raises(ValueError):
        store.read_many({"nope": 1})


def test_pruning_reads_only_the_periods_asked_for(spark, store):
    store.set({"version": 1, "kind": "a"}, lifted(spark, made("2020-01-01", 24 * 100)))
    assert len(store.table.partitions()) == 4
    files = store.read_many({}, "2020-02-10", "2020-02-11").inputFiles()
    assert len({f.split("/_part=")[1].split("/")[0] for f in files}) == 1


def test_updates_replacements_and_tombstones(spark, store):
    key, other = {"version": 1, "kind": "a"}, {"version": 2, "kind": "b"}
    first, second, third = made("2022-01-01", 2500, 1), made("2022-03-01", 2000, 2), made("2022-05-01", 500, 3)
    second.iloc[50:90] = np.nan
    store.set(key, lifted(spark, first))
    store.set(other, lifted(spark, first))
    store.set(key, lifted(spark, second), update=True)
    want = second.combine_first(first)
    same(store.get(key), want)
    store.set(key, lifted(spark, third), replace=True)
    same(store.get(key), third)
    same(store.get(other), first)
    gone = store.chunks(deleted=True).where("is_deleted")
    assert gone.where("version = 1").count() >= 3 and gone.where("size(values) > 0").count() == 0
    with pytest.raises(DuplicateChunkError):
        store.set(key, lifted(spark, first))  # tombstones are in the way of a plain write
    store.set(key, lifted(spark, first), update=True)
    same(store.get(key), third.combine_first(first))
    store.set(key, lifted(spark, pd.Series([np.nan], index=[pd.Timestamp("2022-01-01")])), replace=True)
    same(store.get(key), third.combine_first(first))  # a series of nulls changes nothing


def test_bulk_write_reads_and_deletes(spark, store):
    rows = {(5, "e"): made("2023-01-01", 24, 1), (5, "f"): made("2023-02-01", 48, 2), (6, "e"): made("2024-01-01", 30, 3)}

    def many(which):
        out = None
        for v, k in which:
            one = lifted(spark, rows[v, k]).withColumns({"version": F.lit(v), "kind": F.lit(k)})
            out = one if out is None else out.unionByName(one)
        return out

    store.set_many(many(rows))
    same(store.read_many({"version": 5, "kind": "f"}), rows[5, "f"])
    assert store.read_many({"version__gte": 6}).where("value is not null").count() == 30
    assert [r.kind for r in store.iterate({"version": 5})][:1] == ["e"]
    assert store.max_ts({"version": 5}) == rows[5, "f"].index[-1].to_pydatetime()
    with pytest.raises(DuplicateChunkError):
        store.set_many(many([(5, "e")]))
    store.delete({"version": 5})
    assert store.get({"version": 5, "kind": "e"}) is None and store.chunks(deleted=True).where("version = 5").isEmpty()
    store.delete({"version": 6}, keep_tracking=True)
    assert store.get({"version": 6, "kind": "e"}) is None and not store.chunks(deleted=True).isEmpty()


def test_a_store_without_keys(spark, tmp_path):
    store = ChunkedStore(spark, str(tmp_path / "t"), StoreSpec(()))
    a, b = made("2020-01-01", 900, 1), made("2020-02-01", 100, 2)
    store.set({}, lifted(spark, a))
    store.set({}, lifted(spark, b), update=True)
    same(store.get({}), b.combine_first(a))
    store.set({}, lifted(spark, b), replace=True)
    same(store.get({}), b)


def test_options_of_a_table_cannot_change(spark, tmp_path):
    ChunkedStore(spark, str(tmp_path / "t"), StoreSpec(("k",))).set({"k": "a"}, lifted(spark, made("2020-01-01", 5)))
    with pytest.raises(ValueError):
        ChunkedStore(spark, str(tmp_path / "t"), StoreSpec(("k",), tz="UTC"))


def test_a_failed_write_leaves_the_old_state(spark, store):
    key = {"version": 1, "kind": "a"}
    a = made("2020-01-01", 100)
    store.set(key, lifted(spark, a))
    with pytest.raises(ValueError):
        store.set(key, lifted(spark, a).withColumn("ts", F.lit(5)), update=True)
    broken = store.table.read().withColumn("values", F.expr("array(cast(raise_error('stop') as double))"))
    with pytest.raises(Exception, match="stop"):
        store.table.write(broken, [2020 * 12])
    same(store.get(key), a)
    store.table.vacuum()
    same(store.get(key), a)


# Versions and user keys.


def pairs(spark, values: dict, k="ts"):
    return spark.createDataFrame([(str(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)), None if v is None else float(v)) for h, v in values.items()], "ts string, value double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))


def vals(df):
    return [r.value for r in df.orderBy("ts").collect()]


def test_versioned_store(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "v"))
    x, doubled = pairs(spark, {0: 1, 1: 2, 2: 3}), pairs(spark, {0: 2, 1: 4, 2: 6})
    store.set("p", x, 1)
    store.set("p", doubled, 1)
    assert vals(store.get("p", 1)) == [2, 4, 6] and store.count(1) == 1
    store.set("p", x, 1, versioning=True)
    store.set("q", x, 1, versioning=True)
    store.set("q", doubled, 1, versioning=True)
    store.set("q", x, 2)
    assert store.count(1) == 4 and store.count(2) == 1 and store.count(1, {"version": 1}) == 2
    assert vals(store.get("q", 1)) == [2, 4, 6] and vals(store.get("q", 1, version=0)) == [1, 2, 3]
    assert sorted({r.version for r in store.get("q", 1, combined=False).collect()}) == [0, 1]
    assert {r.prm for r in store.get_many(["p", "q", "absent"], 1).collect()} == {"p", "q"}
    store.set("z", pairs(spark, {0: None}), 1)
    assert store.get("z", 1).isEmpty()
    with pytest.raises(ValueError):
        store.set("q", x, 1)  # which of the versions?
    with pytest.raises(ValueError):
        store.set("q", x, 1, versioning=True, versioning_by=())
    with pytest.raises(ValueError):
        store.set("q", "no frame", 1)
    store.clear(["q"], 1, version=1)
    assert vals(store.get("q", 1)) == [1, 2, 3]
    store.clear_all(client_id=1)
    assert store.count(1) == 0 and store.count(2) == 1


def test_versions_by_attribute(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "v"), {"year": "int"})
    x, y = pairs(spark, {0: 1, 1: 2}), pairs(spark, {0: 5, 1: 6})
    for by, want in ((("prm",), [0, 1]), (("prm", "year"), [0, 0, 1])):
        store.clear_all()
        store.set("p", x, 1, True, by, {"year": 2024})
        store.set("p", y, 1, True, by, {"year": 2025})
        if len(by) > 1:
            store.set("p", y, 1, True, by, {"year": 2024})
        assert sorted(r.version for r in store.get("p", 1, combined=False).select("year", "version").distinct().collect()) == want
    got = store.get("p", 1, combined_by=("prm", "year"))
    assert got.select("year").distinct().count() == 2 and vals(got.where("year = 2024")) == [5, 6]


def test_holes_and_groups_of_a_versioned_store(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "v"))
    store.set("p", pairs(spark, {0: 1, 1: None, 2: 3, 3: 4}), 1)
    got = store.find_holes(1, "2024-01-01 00:00:00", "2024-01-01 03:00:00", "1h", ["p", "absent"]).collect()
    assert sorted((r.prm, r.start.hour, r.end.hour) for r in got) == [("absent", 0, 3), ("p", 1, 1)]
    assert store.find_holes(1, "2024-01-01 00:00:00", "2024-01-01 03:00:00", "1h", filters={"version": 0}).count() == 1
    groups, data = store.find_groups(1, ["p", "absent"], "2024-01-01 00:00:00", "2024-01-01 03:00:00", "1h")
    assert sorted((r.sd.hour, r.ed.hour, r.prms) for r in groups.collect()) == [(0, 3, ["absent"]), (1, 1, ["p"])] and data.count() == 4


def test_keyed_store(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "k"), {"year": "int", "kind": "string"})
    a, key = {"year": 2020, "kind": "a"}, pairs(spark, {0: 1, 1: 2, 2: 3})
    store.set(a, key)
    store.set({"year": 2020, "kind": "b"}, pairs(spark, {0: 10}))
    assert vals(store.get(a, flat=True)) == [1, 2, 3] and store.get({"year": 2020}).select("kind").distinct().count() == 2
    for attrs in ({"year": 2020}, {"year": 1}):
        with pytest.raises(ValueError):
            store.get(attrs, flat=True)
    new = pairs(spark, {2: 999, 3: 10})
    for call in (lambda: store.set(a, new), lambda: store.set(a, new, True, True), lambda: store.set(None, new), lambda: store.set({"year": 1}, new), lambda: store.set(a, [1])):
        with pytest.raises(ValueError):
            call()
    store.set(a, new, update=True)
    assert vals(store.get(a, flat=True)) == [1, 2, 999, 10]
    store.set(a, pairs(spark, {0: None}), replace=True)
    assert vals(store.get(a, flat=True)) == [1, 2, 999, 10]
    store.set(a, new, replace=True)
    assert vals(store.get(a, flat=True)) == [999, 10]
    store.clear({"kind": "a"})
    assert store.get({"kind": "a"}).isEmpty() and not store.get({"kind": "b"}).isEmpty()


def test_many_series_are_updated_and_replaced_at_once(spark, store):
    series = {(v, k): made("2020-01-10", 1500, 10 * v + len(k)) for v in (1, 2) for k in ("a", "bb")}

    def table(of):
        parts = [lifted(spark, s).withColumns({"version": F.lit(v), "kind": F.lit(k)}) for (v, k), s in of.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    store.set_many(table(series))
    new = {(1, "a"): made("2020-02-20", 400, 77), (2, "bb"): made("2020-05-01", 100, 78), (3, "c"): made("2020-01-01", 50, 79)}
    store.set_many(table(new), update=True)
    want = series | {k: (s.combine_first(series[k]) if k in series else s) for k, s in new.items()}
    for (v, k), s in want.items():
        same(store.get({"version": v, "kind": k}), s)
    short = {(1, "a"): made("2020-02-01", 100, 80), (2, "a"): made("2021-01-01", 100, 81)}
    store.set_many(table(short), replace=True)
    for (v, k), s in (want | short).items():
        same(store.get({"version": v, "kind": k}), s)
    with pytest.raises(ValueError):
        store.set_many(table(short), True, True)
    with pytest.raises(DuplicateChunkError):
        store.set_many(table(short))


def test_a_second_writer_is_refused(spark, tmp_path):
    spec = StoreSpec(("version", "kind"))
    one, two = (ChunkedStore(spark, str(tmp_path / "t"), spec, KINDS) for _ in (1, 2))
    s = lifted(spark, made("2020-01-01", 100))
    one.set({"version": 1, "kind": "a"}, s)
    with one.table.writing():
        stored = one.table.read()
        two.set({"version": 2, "kind": "b"}, s)
        with pytest.raises(ConflictError):
            one.table.write(stored, [2020 * 12])
    one.set({"version": 3, "kind": "c"}, s)
    assert {r.version for r in two.chunks().collect()} == {1, 2, 3}


def test_a_read_of_one_series_skips_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "GROUP_BYTES", 64 << 10)
    store = ChunkedStore(spark, str(tmp_path / "t"), StoreSpec(("k",), tz="UTC"), {"k": "int"})
    rows = spark.range(600 * 50).selectExpr("cast(id div 50 as int) as k", "timestampadd(HOUR, id % 50, timestamp_ntz'2020-01-01') as ts", "rand(1) as value")
    store.set_many(rows)
    (file,) = (tmp_path / "t").rglob("part-*.parquet")
    meta = pq.ParquetFile(file).metadata
    spans = [(meta.row_group(i).column(0).statistics.min, meta.row_group(i).column(0).statistics.max) for i in range(meta.num_row_groups)]
    assert len(spans) > 3 and sum(low <= 17 <= high for low, high in spans) == 1
    plan = store.get({"k": 17})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,17)" in plan and store.get({"k": 17}).count() == 50


def test_partitions_of_hashed_stores_can_grow(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "k"), {"n": "int"}, buckets=2)
    for n in range(5):
        store.set({"n": n}, pairs(spark, {0: n}))
    assert store.resize() == 2 and store.resize(7) == 7
    again = KeyedStore(spark, str(tmp_path / "k"), {"n": "int"})
    assert again.buckets == 7 and len(again.table.partitions()) > 2 and [vals(again.get({"n": n}, flat=True)) for n in range(5)] == [[n] for n in range(5)]
    again.set({"n": 3}, pairs(spark, {0: 30}), replace=True)
    assert vals(store.get({"n": 3}, flat=True)) == [30]
    versions = VersionedStore(spark, str(tmp_path / "v"), buckets=2)
    versions.set("p", pairs(spark, {0: 1}), 1)
    assert versions.resize(5) == 5 and vals(VersionedStore(spark, str(tmp_path / "v")).get("p", 1)) == [1]


def test_versions_carry_their_metadata(spark, tmp_path):
    stamp = "2024-05-0{} 00:00:00"
    store = VersionedStore(spark, str(tmp_path / "v"), {"kind": "string"})
    for day, (kind, points) in enumerate([("low", {0: 1, 1: 2}), ("high", {1: 20, 2: None}), ("mid", {2: 7})], 1):
        store.clock = F.lit(stamp.format(day)).cast("timestamp_ntz")
        store.set("p", pairs(spark, points), 1, True, attributes={"kind": kind})
    got = store.get("p", 1, order_by=("-kind",), metadata=True).orderBy("ts").collect()
    assert [r.value for r in got] == [1, 2, 7] and {(r.kind, r.version, r.client_id) for r in got} == {("mid", 2, 1)}
    assert {str(r.created_at) for r in got} == {stamp.format(3)}
    got = store.get("p", 1, order_by=("kind",), metadata=True).orderBy("ts").collect()
    assert [r.value for r in got] == [1, 20, 7] and {r.kind for r in got} == {"high"}
    assert [r.value for r in store.get("p", 1, order_by=("-created_at",)).orderBy("ts").collect()] == [1, 20, 7]
    store.clear(["p"], 1)
    store.set("p", pairs(spark, {0: 1}), 1)
    store.clock = F.lit(stamp.format(9)).cast("timestamp_ntz")
    store.set("p", pairs(spark, {0: 2}), 1)
    (row,) = store.get("p", 1, combined=False, metadata=True).collect()
    assert (str(row.created_at), str(row.last_modified), row.value) == (stamp.format(3), stamp.format(9), 2)


def test_nulls_are_exported_as_nothing(spark):
    df = pairs(spark, {0: 1, 1: None}).withColumn("kind", F.lit("a"))
    with zipfile.ZipFile(io.BytesIO(export.zip_bytes(df, ["kind"]))) as z:
        assert z.read("export_serie_0.csv").decode() == ";value\n2024-01-01 00:00:00;1.00000000\n2024-01-01 01:00:00;\n"


def test_export(spark, tmp_path):
    df = pairs(spark, {0: 1, 1: None}).withColumns({"year": F.lit(2020), "kind": F.lit("a")}).unionByName(pairs(spark, {0: 2.5}).withColumns({"year": F.lit(2020), "kind": F.lit("b")}))
    with zipfile.ZipFile(io.BytesIO(export.zip_bytes(df, ["year", "kind"]))) as z:
        assert sorted(z.namelist()) == ["content_summary.csv", "export_serie_0.csv", "export_serie_1.csv"]
        assert z.read("content_summary.csv").decode() == ";filename;year;kind\n0;export_serie_0.csv;2020;a\n1;export_serie_1.csv;2020;b\n"
        assert "2024-01-01 00:00:00;2.50000000" in z.read("export_serie_1.csv").decode()
    with pytest.warns(UserWarning):
        export.zip_bytes(df.limit(0), ["year", "kind"])
    with pytest.raises(ValueError):
        export.zip_bytes(df, ["year", "kind"], most_rows=1)
    export.write_csv(df, str(tmp_path / "csv"), ["year", "kind"])
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "csv")).count() == 3


# Replication.


class Clock:
    """Hands out later and later stamps."""

    def __init__(self, start: dt.datetime) -> None:
        self.now = start

    def tick(self, *stores) -> None:
        self.now += dt.timedelta(minutes=1)
        for s in stores:
            s.clock = F.lit(self.now).cast("timestamp_ntz")


@pytest.fixture
def ends(spark, tmp_path):
    spec = StoreSpec(("version", "kind"), sync=True)
    server, client = (ChunkedStore(spark, str(tmp_path / n), spec, KINDS) for n in ("server", "client"))
    clock = Clock(dt.datetime(2030, 1, 1))
    clock.tick(server)
    return server, client, clock


def state(store):
    return sorted((r.version, r.kind, r.chunk_index, r.is_deleted, str(r.values)) for r in store.chunks(deleted=True).collect())


def test_pulls_follow_the_feed(spark, ends):
    server, client, clock = ends
    for key, s in {(1, "A"): made("2025-01-01", 1500, 1), (2, "A"): made("2026-01-05", 500, 2), (2, "B"): made("1780-01-05", 300, 3)}.items():
        clock.tick(server)
        server.set({"version": key[0], "kind": key[1]}, lifted(spark, s), update=True)
    sync = SyncClient(server, client)
    fetched, deleted = sync.pull()
    assert fetched == server.chunks().count() and deleted == 0 and state(client) == state(server)
    assert client.last_updated() == server.last_updated()
    clock.tick(server)
    server.delete({"version": 1}, keep_tracking=True)
    fetched, deleted = sync.pull()
    assert deleted >= 2 and state(client) == state(server)
    clock.tick(server)
    server.set({"version": 2, "kind": "A"}, lifted(spark, made("2026-03-05", 100, 4)), replace=True)
    sync.pull()
    assert state(client) == state(server)
    assert sync.pull()[0] >= 1 and state(client) == state(server)  # the last stamp is read again, nothing changes


def test_filtered_pulls_keep_their_own_mark(spark, ends):
    server, client, clock = ends
    for kind in "AB":
        clock.tick(server)
        server.set({"version": 1, "kind": kind}, lifted(spark, made("2025-01-01", 24)), update=True)
    sync = SyncClient(server, client)
    assert sync.pull({"kind": "B"}) == (1, 0) and sync.pull({"kind": "A"}) == (1, 0)
    assert state(client) == state(server)


def test_a_pull_that_died_is_run_again(spark, ends, monkeypatch):
    server, client, clock = ends
    for kind in "AB":
        clock.tick(server)
        server.set({"version": 1, "kind": kind}, lifted(spark, made("2025-01-01", 24)), update=True)
    real, calls = client.import_, []

    def flaky(page):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("lost")
        real(page)

    monkeypatch.setattr(client, "import_", flaky)
    with pytest.raises(RuntimeError):
        SyncClient(server, client).pull(retries=0)
    assert client.chunks(deleted=True).isEmpty()
    assert SyncClient(server, client).pull(retries=1, pause=0.01) == (2, 0) and len(calls) == 3 and state(client) == state(server)


def test_import_refuses_bad_rows_and_older_stamps(spark, ends):
    server, client, clock = ends
    server.set({"version": 1, "kind": "A"}, lifted(spark, made("2025-01-01", 24 * 40)), update=True)
    good = server.chunks(deleted=True)
    with pytest.raises(ValueError):
        client.import_(good.drop("chunk_index"))
    with pytest.raises(ValueError):
        client.import_(good.withColumn("chunk_index", F.when(F.col("chunk_index") % 2 == 0, F.col("chunk_index"))))
    assert client.chunks(deleted=True).isEmpty()
    client.import_(good)
    client.import_(good.limit(0))
    assert state(client) == state(server)
    older = good.withColumns({"updated_at": F.lit("2000-01-01").cast("timestamp_ntz"), "values": F.array(F.lit(1.0))})
    client.import_(older)
    assert state(client) == state(server)
    assert client.export(good.select("version", "kind", "chunk_index")).count() == good.count()


def test_replicated_stores_refuse_untracked_changes(spark, ends, tmp_path):
    server, client, _ = ends
    x = lifted(spark, made("2025-01-01", 24))
    for call in (lambda: server.set({"version": 1, "kind": "A"}, x), lambda: server.set_many(x), lambda: server.delete({})):
        with pytest.raises(ValueError):
            call()
    plain = ChunkedStore(spark, str(tmp_path / "plain"), StoreSpec(("version", "kind")), KINDS)
    with pytest.raises(ValueError):
        SyncClient(server, plain)
    with pytest.raises(ValueError):
        plain.updates(dt.datetime(2000, 1, 1))


def test_feed_pages(spark, ends):
    server, _, clock = ends
    for v in (1, 2):
        clock.tick(server)
        server.set({"version": v, "kind": "A"}, lifted(spark, made("2025-01-01", 24 * 70)), update=True)
    everything = server.updates(dt.datetime(2000, 1, 1)).collect()
    assert len(everything) >= 6 and [r.updated_at for r in everything] == sorted(r.updated_at for r in everything)
    assert server.updates(dt.datetime(2000, 1, 1), limit=2, offset=3).collect() == everything[3:5]
    assert server.updates(dt.datetime(2000, 1, 1), offset=100, limit=5).collect() == []
    assert len(server.updates(clock.now).collect()) == len([r for r in everything if r.updated_at == clock.now])  # the bound is included


def test_streamed_pull(spark, ends, tmp_path):
    server, client, clock = ends
    feed, checkpoint = str(tmp_path / "feed"), str(tmp_path / "cp")
    server.set({"version": 1, "kind": "A"}, lifted(spark, made("2025-01-01", 24 * 40)), update=True)
    server.chunks(deleted=True).write.parquet(feed)
    stream_pull(spark, feed, client, checkpoint).awaitTermination()
    assert state(client) == state(server)
    clock.tick(server)
    server.delete({"chunk_index": 2025 * 12}, keep_tracking=True)
    server.chunks(deleted=True).where(F.col("updated_at") == F.lit(clock.now)).write.mode("append").parquet(feed)
    stream_pull(spark, feed, client, checkpoint).awaitTermination()
    assert state(client) == state(server) and any(x[3] for x in state(client))
    stream_pull(spark, feed, client, str(tmp_path / "again")).awaitTermination()  # the whole feed anew
    assert state(client) == state(server)
