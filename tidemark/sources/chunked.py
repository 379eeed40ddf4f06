"""A store of regular series in calendar chunks.

A chunk is one row ``(keys..., chunk_index, start_ts, values, updated_at, is_deleted)`` and lives in the partition of its
calendar period. Reads list only the partitions of the periods asked for; writes rewrite only those that they touch.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import filters as fl
from tidemark.functions import timegrid as tg
from tidemark.operators import series, states
from tidemark.sources.snapshot import SnapshotTable
from tidemark.spec import DuplicateChunkError, StoreSpec

EPOCH = "2000-01-01 00:00:00"


class ChunkedStore:
    def __init__(self, spark: SparkSession, path: str, spec: StoreSpec, kinds: Mapping[str, str] | None = None, clock: Column | None = None) -> None:
        self.spark, self.spec, self.clock = spark, spec, clock
        kinds = dict(kinds or {})
        text = ", ".join([*(f"{k} {kinds.get(k, 'string')}" for k in spec.keys), "chunk_index int", "start_ts timestamp_ntz", "values array<double>", "updated_at timestamp_ntz", "is_deleted boolean"])
        self.kinds = {k: kinds.get(k, "string") for k in spec.keys}
        self.keys = list(spec.keys)
        self.table = SnapshotTable(spark, path, T._parse_datatype_string(text), "chunk_index", spec.signature(), [*spec.keys, "chunk_index"])

    # Reading.

    def _now(self) -> Column:
        return self.clock if self.clock is not None else tg.now_utc()

    def bound(self, at: object, last: bool = False) -> str | None:
        """A bound in UTC: text and naive times are local to the store, times with an offset are converted."""
        if at is None or at != at:
            return None
        import datetime as dt
        from zoneinfo import ZoneInfo

        if isinstance(at, str):
            at = dt.datetime.fromisoformat(at)
        if at.tzinfo is None:
            at = at.replace(tzinfo=ZoneInfo(self.spec.tz))
        return at.astimezone(dt.UTC).replace(tzinfo=None).isoformat(sep=" ")

    def _period(self, at: str) -> int:
        import datetime as dt
        from zoneinfo import ZoneInfo

        local = dt.datetime.fromisoformat(at).replace(tzinfo=dt.UTC).astimezone(ZoneInfo(self.spec.tz))
        return local.year if self.spec.chunk_axis == ("year",) else local.year * 12 + local.month - 1

    def chunks(self, start: str | None = None, end: str | None = None, deleted: bool = False) -> DataFrame:
        low = self._period(start) if start else None
        high = self._period(end) if end else None
        only = [int(p) for p in self.table.partitions() if (low is None or int(p) >= low) and (high is None or int(p) <= high)]
        df = self.table.read(only)
        return df if deleted else df.where(~F.col("is_deleted"))

    def read_many(self, filters: Mapping[str, object] | None = None, start=None, end=None, drop_bounds_na: bool = True) -> DataFrame:
        """Rows ``(keys..., ts, value)`` of all series that match, between the bounds, trimmed of nulls at their ends."""
        lo, hi = self.bound(start), self.bound(end)
        rows = series.unpack(fl.where(self.chunks(lo, hi), filters, self.keys), self.spec).drop("chunk_index")
        rows = series.slice_closed(rows, F.lit(lo).cast("timestamp_ntz") if lo else None, F.lit(hi).cast("timestamp_ntz") if hi else None)
        return series.trim_null_edges(rows, self.keys) if drop_bounds_na else rows

    def get(self, attrs: Mapping[str, object], start=None, end=None, drop_bounds_na: bool = True) -> DataFrame | None:
        """``(ts, value)`` of one series, or None if it has no chunk between the bounds."""
        fl.require_all(attrs, self.keys)
        if fl.where(self.chunks(self.bound(start), self.bound(end)), attrs, self.keys).limit(1).isEmpty():
            return None
        return self.read_many(attrs, start, end, drop_bounds_na).select("ts", "value")

    def iterate(self, filters: Mapping[str, object] | None = None, **options) -> Iterator[tuple]:
        """The rows of ``read_many``, series after series, a partition at a time on the driver."""
        return self.read_many(filters, **options).orderBy(*self.keys, "ts").toLocalIterator()

    def exists(self, filters: Mapping[str, object] | None = None) -> bool:
        return not fl.where(self.chunks(), filters, self.keys).limit(1).isEmpty()

    def max_ts(self, filters: Mapping[str, object] | None = None):
        """The last instant with a value, or None. Periods are looked at from the last one back, at first one, then twice as
        many each time, until one has a value."""
        match, periods, step = fl.condition(filters, self.keys), sorted(map(int, self.table.partitions()), reverse=True), 1
        while periods:
            some, periods, step = periods[:step], periods[step:], 2 * step
            rows = series.unpack(self.table.read(some).where(~F.col("is_deleted") & match), self.spec)
            if (found := rows.where("value is not null").agg(F.max("ts")).first()[0]) is not None:
                return found
        return None

    # Writing.

    def _chunked(self, df: DataFrame) -> DataFrame:
        rows = series.check_unique(series.ingest(df, self.keys), self.keys)
        return series.pack_sparse(rows, self.spec).withColumns({"updated_at": self._now(), "is_deleted": F.lit(False)})

    def _periods(self, df: DataFrame) -> list[int]:
        return [r[0] for r in df.select("chunk_index").distinct().collect()]  # calendar periods: few

    def set_many(self, df: DataFrame, update: bool = False, replace: bool = False) -> None:
        """Store ``df(keys..., ts, value)``, any number of series at once: add their chunks, none of which may be there; lay
        their values over the stored ones; or put them in the place of the stored series of the same keys."""
        if self.spec.sync and not (update or replace):
            raise ValueError("a replicated store takes updates or replacements")
        self._put(self._chunked(df), update, replace)

    def _put(self, new: DataFrame, update: bool, replace: bool) -> None:
        if update and replace:
            raise ValueError("update or replace, not both")
        on = [*self.keys, "chunk_index"]
        new = new.persist()
        try:
            with self.table.writing():
                touched = self._periods(new)
                if not touched:
                    return
                if replace:
                    stored = self.table.read()
                    if self.keys:
                        stored = stored.join(new.select(*self.keys).distinct(), self.keys, "left_semi")
                    touched = sorted({*touched, *self._periods(stored.where(~F.col("is_deleted")))})
                stored = self.table.read(touched)
                new = new.select(*stored.columns)
                if replace:
                    state = states.replace_chunks(stored, new, self.keys, self._now())
                elif update:
                    rest = stored.join(new.select(*on), on, "left_anti")
                    state = rest.unionByName(states.upsert_chunks(stored.where(~F.col("is_deleted")), new, self.keys))
                else:
                    if not stored.join(new.select(*on), on, "left_semi").limit(1).isEmpty():
                        raise DuplicateChunkError("a chunk is there already")
                    state = stored.unionByName(new)
                self.table.write(state, touched)
        finally:
            new.unpersist()

    def set(self, attrs: Mapping[str, object], df: DataFrame, update: bool = False, replace: bool = False) -> None:
        """Store one series, as ``set_many`` does many. All keys must be given."""
        if update and replace:
            raise ValueError("update or replace, not both")
        if self.spec.sync and not (update or replace):
            raise ValueError("a replicated store needs update or replace")
        fl.require_all(attrs, self.keys)
        self._put(self._chunked(df.withColumns({k: F.lit(attrs[k]).cast(self.kinds[k]) for k in self.keys}) if self.keys else df), update, replace)

    def delete(self, filters: Mapping[str, object] | None = None, keep_tracking: bool = False) -> None:
        """Remove chunks, or leave tombstones of them for replication."""
        if self.spec.sync and not keep_tracking:
            raise ValueError("a replicated store only deletes with tracking")
        match = fl.condition(filters, [*self.keys, "chunk_index"])
        with self.table.writing():
            touched = self._periods(self.table.read().where(match))
            stored = self.table.read(touched)
            self.table.write(states.soft_delete(stored, match, self._now()) if keep_tracking else stored.where(~F.coalesce(match, F.lit(False))), touched)

    # Replication.

    def last_updated(self, filters: Mapping[str, object] | None = None):
        found = fl.where(self.table.read(), filters, self.keys).agg(F.max("updated_at")).first()[0]
        if found is not None:
            return found
        return self.spark.range(1).select(tg.to_utc(F.lit(EPOCH).cast("timestamp_ntz"), self.spec.tz)).first()[0]

    def updates(self, since, filters: Mapping[str, object] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        if not self.spec.sync:
            raise ValueError("the store is not replicated")
        feed = states.change_feed(fl.where(self.table.read(), filters, self.keys), self.keys, since)
        feed = feed.offset(offset) if offset else feed
        return feed if limit is None else feed.limit(limit)

    def export(self, wanted: DataFrame) -> DataFrame:
        return states.export_chunks(self.table.read(), wanted, self.keys)

    def import_(self, incoming: DataFrame) -> None:
        """Merge chunks of another store: the one stamped last wins. Rows that lack a key column are refused as a whole."""
        needed = [f.name for f in self.table.schema]
        if missing := set(needed) - set(incoming.columns):
            raise ValueError(f"columns are missing: {sorted(missing)}")
        if not incoming.where(" or ".join(f"{c} is null" for c in [*self.keys, "chunk_index"])).limit(1).isEmpty():
            raise ValueError("a chunk lacks a key")
        incoming = incoming.select(*needed).withColumn("updated_at", F.coalesce("updated_at", self._now())).persist()
        try:
            with self.table.writing():
                if touched := self._periods(incoming):
                    self.table.write(states.latest_wins(self.table.read(touched), incoming, self.keys), touched)
        finally:
            incoming.unpersist()
