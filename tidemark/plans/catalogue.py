"""The registered queries of the core engine and their SQL equivalents.

Each query applies an operator to whole driver tables: EH, events summed by type and hour; UD, by user and day; LD,
quantities by return flag, line status and shipping date; EV, versions of user groups' hourly maxima.

Queries of the stores write a store into the shared folder (``spark.checkpoint.dir``) and read it again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import batches
from tidemark.functions import filters as fl
from tidemark.functions import timegrid as tg
from tidemark.operators import gaps, intervals, series, states
from tidemark.sources import export
from tidemark.sources.chunked import ChunkedStore
from tidemark.sources.keyed import KeyedStore
from tidemark.sources.versioned import VersionedStore
from tidemark.spec import StoreSpec
from tidemark.streaming.sync import SyncClient, feed_page

HOUR, DAY = 3_600_000_000, 86_400_000_000
START, END = "2024-01-01 00:00:00", "2024-01-30 23:00:00"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_CTE = """
with eh as (select event_type, date_trunc('hour', ts) as ts, cast(sum(cast(value as decimal(18,2))) as double) as value from events group by 1, 2),
ud as (select user_id, date_trunc('day', ts)::timestamp as ts, cast(sum(cast(value as decimal(18,2))) as double) as value from events group by 1, 2),
ld as (select l_returnflag, l_linestatus, l_shipdate as ts, sum(l_quantity) as value from lineitem group by 1, 2, 3),
ev as (select user_id % 20 as prm, cast(dense_rank() over (order by event_type) - 1 as int) as version, event_type, date_trunc('hour', ts) as ts, value from events),
evm as (select prm, version, event_type, ts, max(value) as value from ev group by all)
"""


def query(name: str, sql: str | None = None):
    def register(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = _CTE + sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _exact_sum(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def eh(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").groupBy("event_type", tg.truncated("hour", F.col("ts")).alias("ts")).agg(_exact_sum("value").alias("value"))


def ud(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").groupBy("user_id", tg.truncated("day", F.col("ts")).alias("ts")).agg(_exact_sum("value").alias("value"))


def ld(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", F.col("l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("value"))


def ev(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events")
    kinds = events.select("event_type").distinct()
    rank = kinds.withColumn("version", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int"))  # a handful of event types
    return events.join(F.broadcast(rank), "event_type").groupBy(
        (F.col("user_id") % 20).alias("prm"), "version", "event_type", tg.truncated("hour", F.col("ts")).alias("ts")).agg(F.max("value").alias("value"))


def _folder(spark: SparkSession) -> str:
    """A new folder for a store, where all executors see it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='tidemark-')).rstrip('/')}/store-{uuid.uuid4().hex}"


def _stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def ld_store(spark: SparkSession, d: str, sync: bool = False, rows: DataFrame | None = None, stamp: str = "2024-06-01 00:00:00") -> ChunkedStore:
    """A chunked store of LD."""
    store = ChunkedStore(spark, _folder(spark), StoreSpec(tuple(LD_KEYS), tz="UTC", freq="1d", sync=sync), clock=_stamp(stamp))
    store.set_many(ld(spark, d) if rows is None else rows, update=sync)
    return store


def eh_store(spark: SparkSession, rows: DataFrame) -> ChunkedStore:
    store = ChunkedStore(spark, _folder(spark), EH_UTC)
    store.set_many(rows)
    return store


def ev_store(spark: SparkSession, d: str) -> VersionedStore:
    """A versioned store of EV: each event type's series of a group is its next version, in the order of the types."""
    store, rows = VersionedStore(spark, _folder(spark), buckets=8), ev(spark, d).persist()
    for v in range((rows.agg(F.max("version")).first()[0] or 0) + 1):  # a handful of event types
        store.set_many(rows.where(F.col("version") == v).select(F.col("prm").cast("string").alias("prm"), "ts", "value"), 1, versioning=True)
    rows.unpersist()
    return store


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("prm", F.col("prm").cast("long"))


LD_KEYS = ["l_returnflag", "l_linestatus"]
LD_SERIES = [(flag, status) for flag in "ANR" for status in "FO"]
EH_UTC = StoreSpec(("event_type",), tz="UTC")
EH_PARIS = StoreSpec(("event_type",))
LD_DAILY = StoreSpec(tuple(LD_KEYS), tz="UTC", freq="1d")
LD_PARIS = StoreSpec(tuple(LD_KEYS))
LD_YEAR = StoreSpec(tuple(LD_KEYS), chunk_axis=("year",))

_GRID = "select event_type, unnest(generate_series({lo}, {hi}, interval 1 hour)) as ts from (select distinct event_type from eh)"


@query("dense_regrid_hourly", f", g as ({_GRID.format(lo="timestamp '2024-01-01'", hi="timestamp '2024-01-31 23:00:00'")}) select g.event_type, g.ts, eh.value from g left join eh using (event_type, ts)")
def _dense(spark, d):
    return series.dense_regrid(eh(spark, d), EH_UTC)


@query("dense_regrid_paris", f", g as ({_GRID.format(lo="timestamp '2023-12-31 23:00:00'", hi="timestamp '2024-01-31 22:00:00'")}) select g.event_type, g.ts, timezone('Europe/Paris', timezone('UTC', g.ts)) as local_ts, eh.value from g left join eh using (event_type, ts)")
def _dense_paris(spark, d):
    return series.dense_regrid(eh(spark, d), EH_PARIS).withColumn("local_ts", tg.to_local(F.col("ts"), "Europe/Paris"))


_LOCAL = "timezone('Europe/Paris', timezone('UTC', ts))"


@query("chunk_index_month", f" select cast(year({_LOCAL}) * 12 + month({_LOCAL}) - 1 as int) as chunk_index, count(*) as n, sum(value) as total from ld group by 1")
def _chunk_month(spark, d):
    return series.with_chunk(ld(spark, d), LD_PARIS).groupBy("chunk_index").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("chunk_index_year", f" select cast(year({_LOCAL}) as int) as chunk_index, count(*) as n, sum(value) as total from ld group by 1")
def _chunk_year(spark, d):
    return series.with_chunk(ld(spark, d), LD_YEAR).groupBy("chunk_index").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("chunk_pack", """, g as (select l_returnflag, l_linestatus, unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)) + interval 1 month - interval 1 day, interval 1 day)) as ts from ld group by 1, 2)
select l_returnflag, l_linestatus, cast(year(ts) * 12 + month(ts) - 1 as int) as chunk_index, min(ts) as start_ts, cast(count(*) as int) as slots, count(value) as filled, coalesce(sum(value), 0) as total from g left join ld using (l_returnflag, l_linestatus, ts) group by 1, 2, 3""")
def _pack(spark, d):
    chunks = series.pack(series.dense_regrid(ld(spark, d), LD_DAILY), LD_DAILY)
    live = F.filter("values", lambda v: v.isNotNull())
    return chunks.select(*LD_KEYS, "chunk_index", "start_ts", F.size("values").alias("slots"), F.size(live).cast("long").alias("filled"),
                         F.aggregate(live, F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("chunk_roundtrip", " select * from ld")
def _roundtrip(spark, d):
    chunks = series.pack(series.dense_regrid(ld(spark, d), LD_DAILY), LD_DAILY)
    return series.unpack(chunks, LD_DAILY).where("value is not null").select(*LD_KEYS, "ts", "value")


@query("range_read_closed", " select * from ld where ts >= timestamp '1997-03-10' and ts <= timestamp '1998-02-20'")
def _closed(spark, d):
    return ld_store(spark, d).read_many(None, "1997-03-10 00:00:00", "1998-02-20 00:00:00").where("value is not null")



@query("range_read_trim", """, g as (select event_type, unnest(generate_series(timestamp '2024-01-05', timestamp '2024-01-09 23:00:00', interval 1 hour)) as ts from (select distinct event_type from eh)),
n as (select g.event_type, g.ts, case when hour(g.ts) in (0, 1, 23) then null else eh.value end as value from g left join eh using (event_type, ts)),
b as (select *, min(case when value is not null then ts end) over (partition by event_type) as lo, max(case when value is not null then ts end) over (partition by event_type) as hi from n)
select event_type, ts, value from b where lo is null or ts between lo and hi""")
def _trim(spark, d):
    rows = eh(spark, d).withColumn("value", F.when(~F.hour("ts").isin(0, 1, 23), F.col("value")))
    return eh_store(spark, rows).read_many(None, "2024-01-05 00:00:00", "2024-01-09 23:00:00")



@query("slice_half_open", " select * from eh where ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-07'")
def _half(spark, d):
    return series.slice_half_open(eh(spark, d), F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-07").cast("timestamp_ntz"))


@query("split_point", " select *, 'left' as side from ud where ts <= timestamp '2024-01-15' union all select *, 'right' from ud where ts >= timestamp '2024-01-15'")
def _split(spark, d):
    return series.split_at(ud(spark, d), _stamp("2024-01-15 00:00:00"))



@query("yield_many", """, g as (select event_type, unnest(generate_series(timestamp '2024-01-02', timestamp '2024-01-25', interval 1 hour)) as ts from (select distinct event_type from eh where value > 150 and event_type in ('click', 'view', 'purchase'))),
r as (select g.event_type, g.ts, case when value > 150 then value end as value from g left join eh using (event_type, ts)),
b as (select *, min(case when value is not null then ts end) over (partition by event_type) as lo, max(case when value is not null then ts end) over (partition by event_type) as hi from r)
select event_type, ts, value from b where lo is null or ts between lo and hi""")
def _many(spark, d):
    store = eh_store(spark, eh(spark, d).withColumn("value", F.when(F.col("value") > 150, F.col("value"))))
    return store.read_many({"event_type__in": ["click", "view", "purchase"]}, "2024-01-02 00:00:00", "2024-01-25 00:00:00")



@query("max_horodate", " select event_type, max(ts) as max_ts from eh where value > 100 and event_type in ('click', 'purchase', 'view') group by 1")
def _max(spark, d):
    store = eh_store(spark, eh(spark, d).withColumn("value", F.when(F.col("value") > 100, F.col("value"))))
    found = [(k, store.max_ts({"event_type": k})) for k in ("click", "purchase", "view")]
    return spark.createDataFrame([(k, t) for k, t in found if t is not None], "event_type string, max_ts timestamp_ntz")



@query("overlay_two", """, a as (select * from eh where hour(ts) % 2 = 0), b as (select event_type, ts, value + 1000 as value from eh where hour(ts) % 3 = 0)
select coalesce(a.event_type, b.event_type) as event_type, coalesce(a.ts, b.ts) as ts, coalesce(a.value, b.value) as value from a full join b on a.event_type = b.event_type and a.ts = b.ts""")
def _overlay(spark, d):
    e = eh(spark, d)
    return states.upsert_rows(e.where(F.hour("ts") % 3 == 0).withColumn("value", F.col("value") + 1000), e.where(F.hour("ts") % 2 == 0), ["event_type"])


@query("overlay_many", """, u as (select 0 as prio, event_type, ts, case when hour(ts) % 4 = 0 then value end as value from eh union all select 1, event_type, ts, value * 2 from eh where hour(ts) % 2 = 0 union all select 2, event_type, ts, value * 4 from eh where hour(ts) % 3 = 0)
select event_type, ts, arg_min(value, prio) filter (where value is not null) as value from u group by 1, 2""")
def _overlays(spark, d):
    e, h = eh(spark, d), F.hour("ts")
    return series.overlay([e.withColumn("value", F.when(h % 4 == 0, F.col("value"))), e.where(h % 2 == 0).withColumn("value", F.col("value") * 2),
                           e.where(h % 3 == 0).withColumn("value", F.col("value") * 4)], ["event_type"])


@query("version_combine", " select prm, ts, arg_min(value, -version) filter (where value is not null) as value from evm group by 1, 2")
def _combine(spark, d):
    return series.combine_versions(ev(spark, d))


@query("version_combine_grouped", " select prm, version % 2 as attribute, ts, arg_min(value, -version) filter (where value is not null) as value from evm group by all")
def _combine_by(spark, d):
    return series.combine_versions(ev(spark, d).withColumn("attribute", F.col("version") % 2), ["prm", "attribute"])


@query("version_combine_delay", """, t as (select *, min(ts) over (partition by prm, version) as first from evm)
select prm, ts, arg_min(value, -version) filter (where value is not null) as value from t where ts >= first + interval 2 day group by 1, 2""")
def _combine_delay(spark, d):
    return series.combine_versions(ev(spark, d), delay_us=2 * DAY)


@query("version_exact", " select prm, version, ts, value from evm where version = 2 and prm in (3, 7)")
def _exact(spark, d):
    found = ev_store(spark, d).get_many(["3", "7"], 1, combined=False, version=2)
    return _numbered(found.select("prm", "version", "ts", "value"))



@query("next_version", " select prm, cast(max(version) + 1 as int) as next_version from evm group by 1")
def _next(spark, d):
    store, new = ev_store(spark, d), ev(spark, d).where("version = 0").select(F.col("prm").cast("string").alias("prm"), "ts", "value")
    store.set_many(new, 1, versioning=True)
    return _numbered(store.get_many(None, 1, combined=False).groupBy("prm").agg(F.max("version").alias("next_version")))



_HOLES = """, g as (select k, unnest(generate_series(timestamp '{lo}', timestamp '{hi}', interval 1 {unit})) as ts from (select distinct {key} as k from {frame})),
m as (select g.k, g.ts, row_number() over (partition by g.k order by g.ts) as n, f.value from g left join {frame} f on f.{key} = g.k and f.ts = g.ts),
i as (select k, ts, n - row_number() over (partition by k order by ts) as island from m where value is null)
select k as {key}, min(ts) - interval '{margin}' as "start", max(ts) + interval '{margin}' as "end" from i group by k, island"""


@query("holes_hourly", _HOLES.format(lo=START, hi=END, unit="hour", key="event_type", frame="eh", margin="0 hour"))
def _holes(spark, d):
    return gaps.holes(eh(spark, d), ["event_type"], START, END, HOUR)


@query("holes_daily_user", _HOLES.format(lo="2024-01-01 00:00:00", hi="2024-01-30 00:00:00", unit="day", key="user_id", frame="ud", margin="0 hour"))
def _holes_daily(spark, d):
    return gaps.holes(ud(spark, d), ["user_id"], "2024-01-01 00:00:00", "2024-01-30 00:00:00", DAY)


@query("holes_margin", _HOLES.format(lo=START, hi=END, unit="hour", key="event_type", frame="eh", margin="1 hour"))
def _holes_margin(spark, d):
    return gaps.holes(eh(spark, d), ["event_type"], START, END, HOUR, HOUR)


@query("const_runs", """, v as (select event_type, ts, cast(floor(value / 300) as double) as value from eh),
c as (select *, case when lag(value) over w is not distinct from value and row_number() over w > 1 then 0 else 1 end as n from v window w as (partition by event_type order by ts)),
r as (select *, sum(n) over (partition by event_type order by ts) as run from c)
select event_type, min(ts) as "start", max(ts) as "end", any_value(value) as value from r group by event_type, run""")
def _runs(spark, d):
    return series.constant_runs(eh(spark, d).withColumn("value", F.floor(F.col("value") / 300).cast("double")), ["event_type"])


@query("find_groups", """, u as (select distinct user_id from events),
r as (select user_id, ts, case when user_id % 3 = 0 and day(ts) % 7 = 0 then null else value end as value from ud where ts between timestamp '2024-01-01' and timestamp '2024-01-30'),
l as (select user_id, min(ts) as a, max(ts) as b from r group by 1 having count(value) > 0),
e as (select user_id, timestamp '2024-01-01' as sd, a as ed from l where a - timestamp '2024-01-01' >= interval 1 day union all select user_id, b, timestamp '2024-01-30' from l where timestamp '2024-01-30' - b >= interval 1 day),
n as (select *, row_number() over (partition by user_id order by ts) as i from r),
s as (select user_id, min(ts) as sd, max(ts) as ed from (select *, i - row_number() over (partition by user_id order by ts) as g from n where value is null) where user_id in (select user_id from l) group by user_id, g),
x as (select user_id, timestamp '2024-01-01' as sd, timestamp '2024-01-30' as ed from u where user_id not in (select user_id from l)),
al as (select * from e union all select * from s union all select * from x),
f as (select *, case when sd <= max(ed) over (partition by user_id order by sd, ed rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from al),
q as (select *, sum(n) over (partition by user_id order by sd, ed rows between unbounded preceding and current row) as g from f),
z as (select user_id, min(sd) as sd, max(ed) as ed from q group by user_id, g)
select sd, ed, string_agg(user_id::varchar, ',' order by user_id) as prms from z group by 1, 2""")
def _groups(spark, d):
    rows = ud(spark, d).withColumn("value", F.when(~((F.col("user_id") % 3 == 0) & (F.day("ts") % 7 == 0)), F.col("value")))
    found = gaps.missing_groups(rows, "user_id", "2024-01-01 00:00:00", "2024-01-30 00:00:00", DAY, _table(spark, d, "events"))
    return found.withColumn("prms", F.array_join(F.transform("prms", lambda x: x.cast("string")), ","))


_SPANS = """, o as (select o_custkey as k, o_orderkey as id, date_diff('day', date '1970-01-01', o_orderdate::date) as sd, date_diff('day', date '1970-01-01', o_orderdate::date) + o_orderkey % 90 as ed from orders),
p as (select a.k, a.id as a_id, b.id as b_id, a.sd, a.ed, b.sd as other_sd, b.ed as other_ed from o a join o b on a.k = b.k and a.id < b.id)
"""


def _spans(spark, d) -> DataFrame:
    o = _table(spark, d, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), day.alias("sd"), (day + F.col("o_orderkey") % 90).alias("ed"))


def _pairs(spark, d) -> DataFrame:
    """Overlapping intervals of each customer, by bins."""
    o = _spans(spark, d)
    other = o.select("k", F.col("id").alias("b_id"), F.col("sd").alias("other_sd"), F.col("ed").alias("other_ed"))
    return intervals.overlap_join(o.withColumnRenamed("id", "a_id"), other, ["k"], 128).where("a_id < b_id")


def _next_pairs(spark, d) -> DataFrame:
    """Each interval of a customer and the one that starts next, disjoint ones too."""
    w = Window.partitionBy("k").orderBy("sd", "ed", "id")
    return _spans(spark, d).select("k", F.col("id").alias("a_id"), "sd", "ed", F.lead("id").over(w).alias("b_id"), F.lead("sd").over(w).alias("other_sd"),
                                   F.lead("ed").over(w).alias("other_ed")).where("b_id is not null")


def _ends() -> tuple[Column, Column, Column, Column]:
    return F.col("sd"), F.col("ed"), F.col("other_sd"), F.col("other_ed")


@query("range_overlap", _SPANS + "select k, a_id, b_id from p where sd <= other_ed and ed >= other_sd")
def _overlap(spark, d):
    return _pairs(spark, d).select("k", "a_id", "b_id")



@query("range_includes", _SPANS + "select k, a_id, b_id from p where sd <= other_sd and ed >= other_ed")
def _includes(spark, d):
    return _pairs(spark, d).where(intervals.includes(*_ends())).select("k", "a_id", "b_id")


@query("range_intersection", _SPANS + "select k, a_id, b_id, greatest(sd, other_sd) as sd, least(ed, other_ed) as ed from p where least(ed, other_ed) - greatest(sd, other_sd) >= 5")
def _intersection(spark, d):
    x = _pairs(spark, d).withColumn("r", intervals.intersection(*_ends(), F.lit(5))).where("r is not null")
    return x.select("k", "a_id", "b_id", "r.sd", "r.ed")


@query("range_difference", _SPANS + """, p2 as (select k, id as a_id, sd, ed, lead(id) over w as b_id, lead(sd) over w as other_sd, lead(ed) over w as other_ed from o window w as (partition by k order by sd, ed, id)),
c as (select *, case when sd <= other_sd and ed >= other_ed then 0 when other_sd <= sd and other_ed >= ed then 3 when other_ed > ed then 2 when other_sd < sd then 1 else 0 end as c from p2 where b_id is not null)
select k, a_id, b_id, other_sd as sd, sd as ed from c where c in (1, 3) and sd - other_sd >= 1 union all select k, a_id, b_id, ed, other_ed from c where c in (2, 3) and other_ed - ed >= 1""")
def _difference(spark, d):
    x = _next_pairs(spark, d).withColumn("r", F.explode(intervals.difference(*_ends(), F.lit(1))))
    return x.select("k", "a_id", "b_id", "r.sd", "r.ed")



@query("range_combine", _SPANS + """, f as (select k, sd, ed, case when sd <= max(ed) over (partition by k order by sd, ed rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from o),
q as (select *, sum(n) over (partition by k order by sd, ed rows between unbounded preceding and current row) as g from f)
select k, min(sd) as sd, max(ed) as ed from q group by k, g""")
def _coalesce(spark, d):
    return intervals.coalesce(_spans(spark, d).select("k", "sd", "ed"), ["k"])


@query("upsample_reference", """, co as (select event_type, date_trunc('day', ts)::timestamp as ts, cast(count(*) as double) as feat from eh group by 1, 2),
r as (select eh.event_type, eh.ts, eh.value as ref, co.feat from eh left join co using (event_type, ts)),
p as (select *, sum(case when feat is not null then 1 else 0 end) over (partition by event_type order by ts) as period, last_value(feat ignore nulls) over (partition by event_type order by ts) as f from r),
a as (select event_type, period, cast(sum(cast(ref as decimal(28,6))) as double) as s, count(ref) as n, arg_min(ref, ts) as first from p where period > 0 group by 1, 2),
b as (select *, lead(first) over (partition by event_type order by period) as nxt from a),
m as (select event_type, period, (s + coalesce(nxt, 0)) / nullif(n + case when nxt is not null then 1 else 0 end, 0) as mean from b)
select p.event_type, p.ts, round(case when period > 0 then case when mean = 0 then f else ref / nullif(mean, 0) * f end end, 6) as value from p left join m using (event_type, period)""")
def _upsample(spark, d):
    e = eh(spark, d)
    coarse = e.groupBy("event_type", tg.truncated("day", F.col("ts")).alias("ts")).agg(F.count("*").cast("double").alias("value"))
    return series.upsample(coarse, e, ["event_type"]).withColumn("value", F.round("value", 6))


@query("normalize_minmax", " select event_type, ts, round((value - min(value) over w) / nullif(max(value) over w - min(value) over w, 0), 6) as value from eh window w as (partition by event_type)")
def _normalize(spark, d):
    return series.normalize(eh(spark, d), ["event_type"]).withColumn("value", F.round("value", 6))


@query("min_freq", " select l_returnflag, l_linestatus, min(us) as step_us from (select *, date_diff('microsecond', lag(ts) over (partition by l_returnflag, l_linestatus order by ts), ts) as us from ld) group by 1, 2")
def _min_freq(spark, d):
    return series.min_frequency(ld(spark, d), LD_KEYS)


@query("tz_convert", " select ts, timezone('Europe/Paris', timezone('UTC', ts)) as paris, timezone('America/New_York', timezone('UTC', ts)) as new_york from (select distinct ts from ld)")
def _convert(spark, d):
    days = ld(spark, d).select("ts").distinct()
    return days.select("ts", tg.to_local(F.col("ts"), "Europe/Paris").alias("paris"), tg.convert(F.col("ts"), "UTC", "America/New_York").alias("new_york"))


@query("localise_interval", """ select day::varchar as day, timezone('UTC', timezone('Europe/Paris', day::timestamp)) as first, timezone('UTC', timezone('Europe/Paris', day::timestamp + interval 1 day - interval 1 microsecond)) as last
from (select distinct ts::date as day from ld)""")
def _localise(spark, d):
    days = ld(spark, d).select(F.col("ts").cast("date").alias("day")).distinct()
    first, last = tg.localise_interval(F.col("day"), F.col("day"), "Europe/Paris")
    return days.select(F.col("day").cast("string").alias("day"), first.alias("first"), last.alias("last"))


_CHUNKS = """, ck as (select l_returnflag, l_linestatus, cast(year(ts) * 12 + month(ts) - 1 as int) as chunk_index, count(*) as n, sum(value) as total, timestamp '2024-01-01' + to_days(cast(month(min(ts)) as int)) as updated_at, false as is_deleted from ld group by 1, 2, 3)
"""


def _chunks(spark, d) -> DataFrame:
    packed = series.pack(ld(spark, d), LD_DAILY)
    stamp = F.timestamp_add("DAY", F.month("start_ts"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return packed.withColumns({"updated_at": stamp, "is_deleted": F.lit(False)})


def _digest(chunks: DataFrame) -> DataFrame:
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return chunks.select(*LD_KEYS, "chunk_index", F.size("values").cast("long").alias("n"), total.alias("total"), "updated_at", "is_deleted")


def _sums(chunks: DataFrame) -> DataFrame:
    """Values and their sum by chunk."""
    live = F.filter("values", lambda v: v.isNotNull())
    return chunks.select(*LD_KEYS, "chunk_index", F.size(live).cast("long").alias("n"), F.aggregate(live, F.lit(0.0), lambda a, v: a + v).alias("total")).where("n > 0 or is_deleted")


@query("upsert_state", """, a as (select l_returnflag, l_linestatus, ts, value * 2 as value from ld where month(ts) <= 3)
select coalesce(a.l_returnflag, b.l_returnflag) as l_returnflag, coalesce(a.l_linestatus, b.l_linestatus) as l_linestatus, coalesce(a.ts, b.ts) as ts, coalesce(a.value, b.value) as value
from a full join (select * from ld where day(ts) <= 20) b on a.l_returnflag = b.l_returnflag and a.l_linestatus = b.l_linestatus and a.ts = b.ts""")
def _upsert(spark, d):
    x = ld(spark, d)
    return states.upsert_rows(x.where(F.day("ts") <= 20), x.where(F.month("ts") <= 3).withColumn("value", F.col("value") * 2), LD_KEYS)


@query("replace_state", _CHUNKS + """select l_returnflag, l_linestatus, chunk_index, n, total, timestamp '2025-01-01' as updated_at, false as is_deleted from ck where l_returnflag = 'R' and chunk_index >= 1997 * 12
union all select l_returnflag, l_linestatus, chunk_index, 0, 0, timestamp '2025-01-01', true from ck where l_returnflag = 'R' and chunk_index < 1997 * 12 and l_linestatus in (select l_linestatus from ck where l_returnflag = 'R' and chunk_index >= 1997 * 12)
union all select * from ck where not (l_returnflag = 'R' and (chunk_index >= 1997 * 12 or l_linestatus in (select l_linestatus from ck where l_returnflag = 'R' and chunk_index >= 1997 * 12)))""")
def _replace(spark, d):
    old, now = _chunks(spark, d), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    new = old.where((F.col("l_returnflag") == "R") & (F.col("chunk_index") >= 1997 * 12)).withColumn("updated_at", now)
    return _digest(states.replace_chunks(old, new, LD_KEYS, now))


@query("soft_delete_state", _CHUNKS + """select l_returnflag, l_linestatus, chunk_index, case when chunk_index % 5 = 0 then 0 else n end as n, case when chunk_index % 5 = 0 then 0 else total end as total,
case when chunk_index % 5 = 0 then timestamp '2025-01-01' else updated_at end as updated_at, chunk_index % 5 = 0 as is_deleted from ck""")
def _soft_delete(spark, d):
    return _digest(states.soft_delete(_chunks(spark, d), F.col("chunk_index") % 5 == 0, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")))


@query("change_feed_page", _CHUNKS + "select l_returnflag, l_linestatus, chunk_index, updated_at, is_deleted from ck where updated_at >= timestamp '2024-01-07' order by updated_at, l_returnflag, l_linestatus, chunk_index limit 40 offset 25")
def _feed(spark, d):
    feed = states.change_feed(_chunks(spark, d), LD_KEYS, F.lit("2024-01-07 00:00:00").cast("timestamp_ntz"))
    return feed.offset(25).limit(40).select(*LD_KEYS, "chunk_index", "updated_at", "is_deleted")


@query("change_feed_keyset", _CHUNKS + """select l_returnflag, l_linestatus, chunk_index, updated_at, is_deleted from ck
where (updated_at, l_returnflag, l_linestatus, chunk_index) > (timestamp '2024-01-09', 'N', 'O', 23990) order by updated_at, l_returnflag, l_linestatus, chunk_index limit 50""")
def _keyset(spark, d):
    import datetime

    feed = states.change_feed(_chunks(spark, d), LD_KEYS, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    page = feed_page(feed, LD_KEYS, (datetime.datetime(2024, 1, 9), "N", "O", 23990), 50)
    return page.select(*LD_KEYS, "chunk_index", "updated_at", "is_deleted")


@query("latest_change", _CHUNKS + "select l_returnflag, l_linestatus, case when l_returnflag = 'R' and max(chunk_index) >= 1998 * 12 then timestamp '2024-03-01' else timestamp '2024-02-01' end as last_updated from ck group by 1, 2")
def _latest(spark, d):
    store, found = ld_store(spark, d, sync=True, stamp="2024-02-01 00:00:00"), []
    store.clock = _stamp("2024-03-01 00:00:00")
    store.delete({"l_returnflag": "R", "chunk_index__gte": 1998 * 12}, keep_tracking=True)
    for a, b in LD_SERIES:
        if store.exists({"l_returnflag": a, "l_linestatus": b}):
            found.append((a, b, store.last_updated({"l_returnflag": a, "l_linestatus": b})))
    return spark.createDataFrame(found, "l_returnflag string, l_linestatus string, last_updated timestamp_ntz")



@query("sync_merge", """, b as (select l_returnflag, l_linestatus, min(ts) as lo, max(ts) as hi from ld where day(ts) <= 10 and year(ts) = 1996 group by 1, 2),
p as (select l_returnflag, l_linestatus, cast(year(ts) * 12 + month(ts) - 1 as int) as chunk_index, ts, case when day(ts) <= 10 and year(ts) = 1996 then value + 1 else value end as value from ld),
q as (select l_returnflag, l_linestatus, unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), interval 1 month)) as m from ld group by 1, 2),
c as (select q.l_returnflag, q.l_linestatus, cast(year(q.m) * 12 + month(q.m) - 1 as int) as chunk_index from q),
t as (select c.*, count(p.value) as n, coalesce(sum(p.value), 0) as total from c left join p using (l_returnflag, l_linestatus, chunk_index) group by all)
select t.l_returnflag, t.l_linestatus, chunk_index, case when gone then 0 else n end as n, case when gone then 0 else total end as total,
case when gone then timestamp '2024-08-01' when chunk_index between year(lo) * 12 + month(lo) - 1 and year(hi) * 12 + month(hi) - 1 then timestamp '2024-07-01' else timestamp '2024-06-01' end as updated_at, gone as is_deleted
from (select *, l_returnflag = 'A' and chunk_index < 1996 * 12 as gone from t) t left join b on t.l_returnflag = b.l_returnflag and t.l_linestatus = b.l_linestatus""")
def _merge(spark, d):
    source, target = ld_store(spark, d, True), ChunkedStore(spark, _folder(spark), StoreSpec(tuple(LD_KEYS), tz="UTC", freq="1d", sync=True))
    client = SyncClient(source, target)
    client.pull()
    source.clock = _stamp("2024-07-01 00:00:00")
    source.set_many(ld(spark, d).where("day(ts) <= 10 and year(ts) = 1996").withColumn("value", F.col("value") + 1), update=True)
    source.clock = _stamp("2024-08-01 00:00:00")
    source.delete({"l_returnflag": "A", "chunk_index__lt": 1996 * 12}, keep_tracking=True)
    client.pull()
    return _sums(target.chunks(deleted=True)).join(target.chunks(deleted=True).select(*LD_KEYS, "chunk_index", "updated_at", "is_deleted"), [*LD_KEYS, "chunk_index"])



@query("export_join", _CHUNKS + "select * from ck where chunk_index % 6 = 1")
def _export(spark, d):
    c = _chunks(spark, d)
    return _digest(states.export_chunks(c, c.where(F.col("chunk_index") % 6 == 1), LD_KEYS))


@query("export_summary", " select cast(row_number() over (order by l_returnflag, l_linestatus) - 1 as int) as number, 'export_serie_' || (row_number() over (order by l_returnflag, l_linestatus) - 1)::varchar || '.csv' as filename, l_returnflag, l_linestatus from (select distinct l_returnflag, l_linestatus from ld)")
def _summary(spark, d):
    return export.summary(ld(spark, d), LD_KEYS)


@query("export_values", " select event_type, ts, printf('%.8f', value) as value from eh")
def _values(spark, d):
    return export.export_text(eh(spark, d))


@query("lookup_filters", """ select * from eh where event_type like 'c%' and value >= 50 and value < 400 and ts between timestamp '2024-01-02' and timestamp '2024-01-20'
union all select * from eh where event_type like '%w' and value is not null and value > 300""")
def _lookups(spark, d):
    e, f = eh(spark, d), ["event_type", "ts", "value"]
    import datetime

    a = fl.where(e, {"event_type__startswith": "c", "value__gte": 50, "value__lt": 400, "ts__range": (datetime.datetime(2024, 1, 2), datetime.datetime(2024, 1, 20))}, f)
    return a.unionByName(fl.where(e, {"event_type__endswith": "w", "value__isnull": False, "value__gt": 300}, f))


@query("row_count", " select prm, count(distinct version) as n from evm where prm >= 10 group by 1")
def _count(spark, d):
    store = ev_store(spark, d)
    return spark.createDataFrame([(p, store.count(1, {"prm": str(p)})) for p in range(10, 20)], "prm long, n long").where("n > 0")



@query("tombstone_filter", _CHUNKS + "select l_returnflag, l_linestatus, chunk_index, n, total from ck where chunk_index % 5 <> 0 and chunk_index between 1996 * 12 and 1998 * 12 + 5")
def _live(spark, d):
    store = ld_store(spark, d)
    for period in range(1990 * 12, 2001 * 12, 5):
        if str(period) in store.table.partitions():
            store.delete({"chunk_index": period}, keep_tracking=True)
    live = store.chunks("1996-01-01 00:00:00", "1998-06-30 00:00:00")
    return _sums(live)



@query("keyed_read", " select * from ld where l_returnflag = 'R'")
def _keyed(spark, d):
    store = KeyedStore(spark, _folder(spark), {"l_returnflag": "string", "l_linestatus": "string"}, buckets=8)
    for a, b in LD_SERIES:
        rows = ld(spark, d).where((F.col("l_returnflag") == a) & (F.col("l_linestatus") == b)).select("ts", "value")
        store.set({"l_returnflag": a, "l_linestatus": b}, rows)
    return store.get({"l_returnflag": "R"})



@query("multi_key_read", " select prm, ts, arg_min(value, -version) filter (where value is not null) as value from evm where prm in (1, 5, 11, 999) group by 1, 2")
def _multi(spark, d):
    return _numbered(ev_store(spark, d).get_many(["1", "5", "11", "999"], 1))



@query("head_trim", """, t as (select *, min(ts) over (partition by event_type) as first from eh)
select event_type, ts, value from t where ts >= first + interval 36 hour""")
def _head(spark, d):
    return series.head_trim(eh(spark, d), ["event_type"], 36 * HOUR)


@query("clear_versions", " select prm, version, event_type, ts, value from evm where not (prm in (1, 2, 3) and version = 3)")
def _clear(spark, d):
    store = ev_store(spark, d)
    store.clear(["1", "2", "3"], 1, version=3)
    kinds = ev(spark, d).select("version", "event_type").distinct()
    return _numbered(store.get_many(None, 1, combined=False)).join(F.broadcast(kinds), "version").select("prm", "version", "event_type", "ts", "value")  # one row an event type



@query("range_check_date", _SPANS + "select k, id, sd, ed from o where 10000 >= sd and 10000 <= ed")
def _check_date(spark, d):
    return _spans(spark, d).where(intervals.contains(F.col("sd"), F.col("ed"), F.lit(10000)))


@query("range_sort", _SPANS + "select sd, ed from o order by sd desc, ed desc limit 100")
def _sorted(spark, d):
    return intervals.sort_by_start(_spans(spark, d), reverse=True).limit(100).select("sd", "ed")



@query("chunk_pack_sparse", """, g as (select l_returnflag, l_linestatus, unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)) + interval 1 month - interval 1 hour, interval 1 hour)) as ts from ld group by 1, 2)
select l_returnflag, l_linestatus, cast(year(ts) * 12 + month(ts) - 1 as int) as chunk_index, min(ts) as start_ts, cast(count(*) as int) as slots, count(value) as filled, coalesce(sum(value), 0) as total from g left join ld using (l_returnflag, l_linestatus, ts) group by 1, 2, 3""")
def _pack_sparse(spark, d):
    chunks = series.pack_sparse(ld(spark, d), StoreSpec(tuple(LD_KEYS), tz="UTC"))
    live = F.filter("values", lambda v: v.isNotNull())
    return chunks.select(*LD_KEYS, "chunk_index", "start_ts", F.size("values").alias("slots"), F.size(live).cast("long").alias("filled"),
                         F.aggregate(live, F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("upsert_chunks", """, ck as (select l_returnflag, l_linestatus, cast(year(ts) * 12 + month(ts) - 1 as int) as chunk_index, ts, value from ld),
n as (select * from ck where day(ts) <= 10), b as (select l_returnflag, l_linestatus, min(chunk_index) as lo, max(chunk_index) as hi from n group by 1, 2),
o as (select ck.* from ck join b using (l_returnflag, l_linestatus) where day(ts) > 5 and chunk_index between lo and hi),
u as (select coalesce(n.l_returnflag, o.l_returnflag) as l_returnflag, coalesce(n.l_linestatus, o.l_linestatus) as l_linestatus, coalesce(n.chunk_index, o.chunk_index) as chunk_index, coalesce(n.value + 1, o.value) as value
from n full join o on n.l_returnflag = o.l_returnflag and n.l_linestatus = o.l_linestatus and n.ts = o.ts)
select l_returnflag, l_linestatus, chunk_index, count(*) as n, sum(value) as total from u group by 1, 2, 3""")
def _upsert_chunks(spark, d):
    x = ld(spark, d)
    new, old = (series.pack_sparse(p, LD_DAILY) for p in (x.where(F.day("ts") <= 10).withColumn("value", F.col("value") + 1), x.where(F.day("ts") > 5)))
    live = F.filter("values", lambda v: v.isNotNull())
    out = states.upsert_chunks(old, new, LD_KEYS)
    return out.select(*LD_KEYS, "chunk_index", F.size(live).cast("long").alias("n"), F.aggregate(live, F.lit(0.0), lambda a, v: a + v).alias("total")).where("n > 0")


@query("version_metadata", """, m as (select *, max(version) over (partition by prm) as top from evm)
select prm, ts, arg_min(value, -version) filter (where value is not null) as value, any_value(top) as version from m group by 1, 2""")
def _metadata(spark, d):
    return _numbered(ev_store(spark, d).get_many(None, 1, metadata=True).select("prm", "ts", "value", "version"))


@query("version_combine_text_order", " select prm, ts, arg_max(value, event_type) filter (where value is not null) as value from evm group by 1, 2")
def _text_order(spark, d):
    return series.combine_versions(ev(spark, d), order_by=("-event_type",))


@query("unversioned_set", " select prm, ts, cast(value * 2 as double) as value from evm where version = 1 and prm < 10 union all select prm, ts, value from evm where version = 1 and prm >= 10")
def _unversioned(spark, d):
    store, rows = VersionedStore(spark, _folder(spark), buckets=8), ev(spark, d).where("version = 1").select(F.col("prm").cast("string").alias("prm"), "ts", "value")
    store.set_many(rows, 1)
    store.set_many(rows.where("int(prm) < 10").withColumn("value", F.col("value") * 2), 1)  # in the place of what is there
    return _numbered(store.get_many(None, 1, combined=False).select("prm", "ts", "value"))


@query("clear_all_versions", " select prm, version, ts, value from evm where version <> 0")
def _clear_all(spark, d):
    store = ev_store(spark, d)
    store.clear_all(1, {"version": 0})
    return _numbered(store.get_many(None, 1, combined=False).select("prm", "version", "ts", "value"))


@query("keyed_update_clear", """, n as (select l_returnflag, l_linestatus, ts, value + 1 as value from ld where l_linestatus = 'F' and day(ts) <= 10)
select l_returnflag, l_linestatus, ts, coalesce(n.value, ld.value) as value from ld left join n using (l_returnflag, l_linestatus, ts) where l_linestatus = 'F' and l_returnflag <> 'N'""")
def _keyed_update(spark, d):
    store = KeyedStore(spark, _folder(spark), {"l_returnflag": "string", "l_linestatus": "string"}, buckets=8)
    for flag, status in LD_SERIES:
        own = {"l_returnflag": flag, "l_linestatus": status}
        rows = ld(spark, d).where((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status)).select("ts", "value")
        store.set(own, rows)
        if status == "F":
            store.set(own, rows.where("day(ts) <= 10").withColumn("value", F.col("value") + 1), update=True)
    store.clear({"l_returnflag": "N"})
    store.clear({"l_linestatus": "O"})
    return store.get({})


@query("bulk_update", """, n as (select l_returnflag, l_linestatus, ts, value + 1 as value from ld where day(ts) > 20)
select l_returnflag, l_linestatus, ts, coalesce(n.value, ld.value) as value from ld left join n using (l_returnflag, l_linestatus, ts)""")
def _bulk_update(spark, d):
    store = ld_store(spark, d)
    store.set_many(ld(spark, d).where("day(ts) > 20").withColumn("value", F.col("value") + 1), update=True)
    return store.read_many().where("value is not null")


@query("bulk_replace", " select * from ld where l_returnflag <> 'R' or year(ts) = 1996")
def _bulk_replace(spark, d):
    store = ld_store(spark, d)
    store.set_many(ld(spark, d).where("l_returnflag = 'R' and year(ts) = 1996"), replace=True)
    return store.read_many().where("value is not null")


@query("holes_all_null_margin", """, k as (select event_type, count(value) filter (where value > 1e12) as n from eh group by 1)
select event_type, timestamp '2023-12-31 23:00:00' as "start", timestamp '2024-01-31 00:00:00' as "end" from k where n = 0""")
def _holes_null(spark, d):
    return gaps.holes(eh(spark, d).withColumn("value", F.when(F.col("value") > 1e12, F.col("value"))), ["event_type"], START, END, HOUR, HOUR)


@query("holes_empty", """ select event_type, timestamp '2024-01-01' as "start", timestamp '2024-01-30 23:00:00' as "end" from (select distinct event_type from events)""")
def _holes_empty(spark, d):
    e = eh(spark, d)
    return gaps.holes(e.limit(0), ["event_type"], START, END, HOUR, HOUR, e)


@query("completeness_messages", _HOLES.format(lo=START, hi=END, unit="hour", key="event_type", frame="eh", margin="1 hour").replace("select k as event_type", "select *, event_type || ' misses ' || strftime(\"start\", '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(\"end\", '%Y-%m-%d %H:%M:%S') || ' (holes widen by 3600 s)' as message from (select k as event_type") + ")")
def _messages(spark, d):
    return gaps.check_completeness(eh(spark, d), ["event_type"], START, END, HOUR)


@query("export_null", " select event_type, ts, case when value > 100 then printf('%.8f', value) end as value from eh")
def _export_null(spark, d):
    return export.export_text(eh(spark, d).withColumn("value", F.when(F.col("value") > 100, F.col("value"))))


@query("store_exists", " select event_type, max(value) > 300 as there from eh where event_type in ('click', 'view', 'purchase') group by 1")
def _exists(spark, d):
    store = eh_store(spark, eh(spark, d).where("value > 300"))
    kinds = [r[0] for r in eh(spark, d).where(F.col("event_type").isin("click", "view", "purchase")).select("event_type").distinct().collect()]  # three at most
    return spark.createDataFrame([(k, store.exists({"event_type": k})) for k in kinds], "event_type string, there boolean")


@query("bounds_of_the_store", " select l_returnflag, l_linestatus, ts, value from ld where ts >= timezone('UTC', timezone('Europe/Paris', timestamp '1996-03-10')) and ts <= timestamp '1996-05-01 04:00:00'")
def _bounds(spark, d):
    import datetime

    store = ChunkedStore(spark, _folder(spark), LD_PARIS)
    store.set_many(ld(spark, d))
    return store.read_many(None, "1996-03-10 00:00:00", datetime.datetime(1996, 5, 1, 4, tzinfo=datetime.UTC)).where("value is not null")


@query("series_between_dates", " select l_returnflag, l_linestatus, date_trunc('hour', ts) as ts, value from ld where timezone('Europe/Paris', timezone('UTC', ts))::date = date '1997-06-01'")
def _local_day(spark, d):
    return ld(spark, d).where(tg.to_local(F.col("ts"), "Europe/Paris").cast("date") == F.lit("1997-06-01").cast("date"))


@query("feed_with_tombstones", _CHUNKS + """select l_returnflag, l_linestatus, chunk_index, gone as is_deleted, case when gone then timestamp '2024-09-01' else timestamp '2024-06-01' end as updated_at
from (select *, l_returnflag = 'N' and chunk_index >= 1997 * 12 as gone from ck)""")
def _feed_store(spark, d):
    store = ld_store(spark, d, sync=True)
    store.clock = _stamp("2024-09-01 00:00:00")
    store.delete({"l_returnflag": "N", "chunk_index__gte": 1997 * 12}, keep_tracking=True)
    return store.updates(_stamp("2000-01-01 00:00:00")).select(*LD_KEYS, "chunk_index", "is_deleted", "updated_at")


@query("export_import", " select * from ld where year(ts) = 1996")
def _import(spark, d):
    source, target = ld_store(spark, d, True), ChunkedStore(spark, _folder(spark), StoreSpec(tuple(LD_KEYS), tz="UTC", freq="1d", sync=True))
    wanted = source.updates(_stamp("2000-01-01 00:00:00")).where(F.col("chunk_index").between(1996 * 12, 1996 * 12 + 11))
    target.import_(source.export(wanted))
    return target.read_many().where("value is not null")


@query("hard_delete", " select * from ld where year(ts) <> 1996")
def _hard_delete(spark, d):
    store = ld_store(spark, d)
    store.delete({"chunk_index__range": (1996 * 12, 1996 * 12 + 11)})
    return store.read_many().where("value is not null")


@query("range_equality", _SPANS + "select k, count(*) filter (where sd = other_sd and ed = other_ed) as same, min('[' || sd || ', ' || ed || ']') as first from p where sd <= other_ed and ed >= other_sd group by 1")
def _equality(spark, d):
    same = F.count(F.when(intervals.same(*_ends()), 1))
    return _pairs(spark, d).groupBy("k").agg(same.alias("same"), F.min(intervals.as_text(F.col("sd"), F.col("ed"))).alias("first"))


@query("key_batches", " select user_id, cast(floor((row_number() over (order by user_id) - 1) / 50) as int) as batch from (select distinct user_id from events)")
def _batches(spark, d):
    return batches.key_batches(_table(spark, d, "events"), ["user_id"], 50)
