"""A store of series under the user's own keys: rows ``(keys..., ts, value)``.

Series are dealt into partitions by a hash of their keys: a write reads and rewrites only the partition of its series, and
a read that names all keys reads only that one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import filters as fl
from tidemark.operators import series
from tidemark.sources.snapshot import BUCKET_BYTES, BUCKETS, SnapshotTable, bucket, buckets_of


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, keys: Mapping[str, str], buckets: int = BUCKETS) -> None:
        self.spark, self.keys, self.kinds = spark, list(keys), dict(keys)
        text = ", ".join([*(f"{k} {v}" for k, v in keys.items()), "ts timestamp_ntz", "value double", "bucket int"])
        self.table = SnapshotTable(spark, path, T._parse_datatype_string(text), "bucket", text, [*keys, "ts"])
        self.buckets = self.table.options().get("buckets", buckets)

    def _own(self, attrs: Mapping[str, object]) -> DataFrame:
        return self.spark.range(1).select(*[F.lit(attrs[k]).cast(self.kinds[k]).alias(k) for k in self.keys])

    def _read(self, only: list[int] | None = None) -> DataFrame:
        return self.table.read(only).drop("bucket")

    def _write(self, df: DataFrame, replaced: list[int] | None) -> None:
        self.table.write(df.withColumn("bucket", bucket(self.keys, self.buckets)), replaced, {"buckets": self.buckets})

    def resize(self, buckets: int | None = None) -> int:
        """Deal the series into another number of partitions, by default so many that each stays small. Returns it."""
        with self.table.writing():
            self.buckets, before = buckets or max(self.buckets, -(-self.table.size() // BUCKET_BYTES)), self.buckets
            if self.buckets != before:
                self._write(self._read(), None)
        return self.buckets

    def get(self, attrs: Mapping[str, object], flat: bool = False) -> DataFrame:
        """Rows of the series that match; with ``flat`` exactly one series, without its keys, else ``ValueError``."""
        only = buckets_of(self._own(attrs), self.keys, self.buckets) if set(attrs) == set(self.keys) else None
        found = fl.where(self._read(only), attrs, self.keys)
        if not flat:
            return found
        if found.select(*self.keys).distinct().limit(2).count() != 1:
            raise ValueError("not exactly one series matches")
        return found.select("ts", "value")

    def set(self, attrs: Mapping[str, object] | None, df: DataFrame, update: bool = False, replace: bool = False) -> None:
        """Store a series; one that is there is updated (new values over old ones), replaced, or an error."""
        if attrs is None or not isinstance(df, DataFrame):
            raise ValueError("attributes and a DataFrame are needed")
        if update and replace:
            raise ValueError("update or replace, not both")
        fl.require_all(attrs, self.keys)
        own = {k: F.lit(attrs[k]).cast(self.kinds[k]) for k in self.keys}
        new = series.ingest(df.withColumns(own), self.keys)
        if new.where("value is not null").limit(1).isEmpty():
            return
        with self.table.writing():
            match = fl.condition(attrs, self.keys)
            touched = buckets_of(self._own(attrs), self.keys, self.buckets)
            everything = self._read(touched)
            old, rest = everything.where(match), everything.where(~F.coalesce(match, F.lit(False)))
            if not old.limit(1).isEmpty():
                if not (update or replace):
                    raise ValueError("the series is there already")
                if update:
                    new = series.overlay([new, old], self.keys)
            self._write(rest.unionByName(new), touched)

    def clear(self, filters: Mapping[str, object] | None = None) -> None:
        match = F.coalesce(fl.condition(filters, self.keys), F.lit(False))
        with self.table.writing():
            touched = buckets_of(self._read().where(match), self.keys, self.buckets)
            self._write(self._read(touched).where(~match), touched)
