"""A key-value store of series with versions: rows ``(client_id, prm, attributes..., version, ts, value)``.

Series are dealt into partitions by a hash of client and prm: a write reads and rewrites only the partitions of its series,
and a read that names its prms reads only those.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import filters as fl
from tidemark.functions import timegrid as tg
from tidemark.operators import gaps, series, states
from tidemark.sources.snapshot import BUCKET_BYTES, BUCKETS, SnapshotTable, bucket, buckets_of
from tidemark.spec import frequency_us


class VersionedStore:
    KEYS = ("client_id", "prm")

    #: Of each version of a series: when it was first stored, and last.
    STAMPS = ("created_at", "last_modified")

    def __init__(self, spark: SparkSession, path: str, attributes: Mapping[str, str] | None = None, buckets: int = BUCKETS, clock: Column | None = None) -> None:
        self.spark, self.attributes, self.clock = spark, dict(attributes or {}), clock
        self.fields = ["client_id", "prm", *self.attributes, "version"]
        kinds = ", ".join(f"{k} {v}" for k, v in self.attributes.items())
        text = "client_id int, prm string, " + (kinds + ", " if kinds else "") + "version int, ts timestamp_ntz, value double, created_at timestamp_ntz, last_modified timestamp_ntz, bucket int"
        self.table = SnapshotTable(spark, path, T._parse_datatype_string(text), "bucket", text, [*self.fields, "ts"])
        self.buckets = self.table.options().get("buckets", buckets)

    def _read(self, only: list[int] | None = None) -> DataFrame:
        return self.table.read(only).drop("bucket")

    def _write(self, df: DataFrame, replaced: list[int] | None) -> None:
        self.table.write(df.withColumn("bucket", bucket(self.KEYS, self.buckets)), replaced, {"buckets": self.buckets})

    def resize(self, buckets: int | None = None) -> int:
        """Deal the series into another number of partitions, by default so many that each stays small. Returns it."""
        with self.table.writing():
            self.buckets, before = buckets or max(self.buckets, -(-self.table.size() // BUCKET_BYTES)), self.buckets
            if self.buckets != before:
                self._write(self._read(), None)
        return self.buckets

    def _touched(self, df: DataFrame) -> list[int]:
        return buckets_of(df, self.KEYS, self.buckets)

    def _named(self, client_id: int, prms: Sequence[str]) -> list[int]:
        return self._touched(self.spark.createDataFrame([(client_id, p) for p in prms], "client_id int, prm string"))

    def _rows(self, client_id: int | None, filters: Mapping | None, prms: Sequence[str] | None = None) -> DataFrame:
        only = self._named(client_id, prms) if client_id is not None and prms is not None else None
        df = fl.where(self._read(only), filters, self.fields)
        if client_id is not None:
            df = df.where(F.col("client_id") == client_id)
        return df if prms is None else df.where(F.col("prm").isin(list(prms)))

    def get_many(self, prms: Sequence[str] | None, client_id: int, combined: bool = True, filters: Mapping | None = None, combined_by: Sequence[str] = ("prm",),
                 order_by: Sequence[str] = ("-version",), delay_us: int | None = None, version: int | None = None, metadata: bool = False) -> DataFrame:
        """Rows of the series of ``prms``; their versions overlaid within each group of ``combined_by``, or each on its own. With
        ``metadata`` the other fields and the stamps come along: of an overlay, those of its first version in ``order_by``."""
        df = self._rows(client_id, filters, prms)
        if version is not None:
            df = df.where(F.col("version") == version)
        groups = list(dict.fromkeys(["prm", *combined_by]))
        if combined:
            more = [c for c in [*self.fields, *self.STAMPS] if c not in groups] if metadata else []
            return series.combine_versions(df, groups, order_by, delay_us, version_by=[*self.attributes, "version"], metadata=more)
        if not metadata:
            df = df.drop(*self.STAMPS)
        if delay_us is not None:
            df = series.head_trim(df, [*self.fields], delay_us)
        return df

    def get(self, prm: str, client_id: int, **options) -> DataFrame:
        return self.get_many([prm], client_id, **options)

    def set_many(self, df: DataFrame, client_id: int, versioning: bool = False, versioning_by: Sequence[str] = ("prm",)) -> None:
        """Store ``df(prm, attributes..., ts, value)``. Series of nulls only are ignored. With versions each series becomes
        the next version of its ``versioning_by`` group; without, it takes the place of the only one that is there."""
        if not isinstance(df, DataFrame):
            raise ValueError("a DataFrame is stored, nothing else")
        if versioning and "prm" not in versioning_by:
            raise ValueError("versioning_by must hold prm")
        own = ["prm", *self.attributes]
        new = series.ingest(df, own).withColumn("client_id", F.lit(client_id).cast("int"))
        live = new.where("value is not null").select(*own).distinct()
        new = series.join_safe(new, live, own, "left_semi")
        touched = self._touched(live.withColumn("client_id", F.lit(client_id).cast("int")))
        if not touched:
            return
        now = self.clock if self.clock is not None else tg.now_utc()
        new = new.withColumn("last_modified", now)
        with self.table.writing():
            old = self._read(touched)
            mine = old.where(F.col("client_id") == client_id)
            if versioning:
                by = [c for c in own if c in versioning_by]
                nxt = states.next_versions(mine, by)
                new = series.join_safe(new, nxt, by, "left").withColumns({"version": F.coalesce("next_version", F.lit(0)), "created_at": now}).drop("next_version")
                return self._write(old.unionByName(new), touched)
            several = series.join_safe(mine, live, own, "left_semi").select(*own, "version").distinct().groupBy(*own).count().where("count > 1")
            if not several.limit(1).isEmpty():
                raise ValueError("a series with several versions cannot be set without a version")
            kept = mine.groupBy(*own, "version").agg(F.min("created_at").alias("created_at"))
            new = series.join_safe(new, kept, own, "left").withColumns({"version": F.coalesce("version", F.lit(0)), "created_at": F.coalesce("created_at", now)})
            rest = series.join_safe(old, live.withColumn("client_id", F.lit(client_id)), ["client_id", *own], "left_anti")
            self._write(rest.unionByName(new), touched)

    def set(self, prm: str, df: DataFrame, client_id: int, versioning: bool = False, versioning_by: Sequence[str] = ("prm",), attributes: Mapping | None = None) -> None:
        if not isinstance(df, DataFrame):
            raise ValueError("a DataFrame is stored, nothing else")
        extra = {k: F.lit((attributes or {}).get(k)).cast(v) for k, v in self.attributes.items()}
        self.set_many(df.withColumns({"prm": F.lit(prm), **extra}), client_id, versioning, versioning_by)

    def clear(self, prms: Sequence[str], client_id: int, version: int | None = None, filters: Mapping | None = None) -> None:
        gone = F.col("prm").isin(list(prms)) & (F.col("client_id") == client_id) & fl.condition(filters, self.fields)
        if version is not None:
            gone = gone & (F.col("version") == version)
        with self.table.writing():
            self._remove(gone, self._named(client_id, prms))

    def clear_all(self, client_id: int | None = None, filters: Mapping | None = None) -> None:
        gone = fl.condition(filters, self.fields)
        if client_id is not None:
            gone = gone & (F.col("client_id") == client_id)
        with self.table.writing():
            self._remove(gone, self._touched(self._read().where(gone)))

    def _remove(self, gone, touched: list[int]) -> None:
        self._write(self._read(touched).where(~F.coalesce(gone, F.lit(False))), touched)

    def count(self, client_id: int, filters: Mapping | None = None) -> int:
        """Stored series, each version counted."""
        return self._rows(client_id, filters).select(*self.fields).distinct().count()

    def find_holes(self, client_id: int, start: str, end: str, freq: str = "30min", prms: Sequence[str] | None = None, margin_us: int = 0, **options) -> DataFrame:
        data = self.get_many(prms, client_id, **options)
        wanted = self.spark.createDataFrame([(p,) for p in prms], "prm string") if prms is not None else None
        return gaps.holes(data, ["prm"], start, end, frequency_us(freq), margin_us, wanted)

    def find_groups(self, client_id: int, prms: Sequence[str], start: str, end: str, freq: str = "30min", **options) -> tuple[DataFrame, DataFrame]:
        """The keys by missing interval, and the data of those that have any in the range."""
        data = self.get_many(prms, client_id, **options)
        wanted = self.spark.createDataFrame([(p,) for p in prms], "prm string")
        lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
        inside = data.where(F.col("ts").between(lo, hi))
        live = inside.where("value is not null").select("prm").distinct()
        return gaps.missing_groups(data, "prm", start, end, frequency_us(freq), wanted), inside.join(live, "prm", "left_semi")
