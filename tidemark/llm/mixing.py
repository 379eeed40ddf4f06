"""Mixing sources to target weights with hash-threshold histograms.

Words are summed by source and hash bucket. The running sum over a source's at most 4,096 buckets shows in which bucket
its budget runs out; only that bucket is refined, by the next 12 of 60 hash bits, until it holds one hash value. Documents
below the threshold are taken by a filter: nothing but the histograms is ever ordered.

A source's target of up to twice its size is ``base`` whole copies of it and a rest. The rest takes the documents below
the source's threshold; of the document (or of the rows with one id) at the threshold it takes just the words that are
missing, so that the words taken are the target, rounded, or up to one word less for each row that shares the threshold.

Nulls and edges: a null text has size 0; a null source is a source of its own and comes last; rows with one doc_id share
a hash and are taken alike; sources without words have target 0; a very long text is one row whose words are all counted; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, table

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Bits of the hash, and those that a level of histograms looks at.
BITS, STEP = 60, 12
#: Sources up to which their table is broadcast: 100,000 short rows are under 10 MB. Beyond it Spark joins by shuffle.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Targets of ``sizes(source, key, source_size)``: weights repeat over the ordered sources, excess is reshared.

    The resharing ends at a level: each target is level x weight or ``most`` x size. Ordered by size / weight the sources
    that stop at their bound come first, so that running sums give the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    bounded = sizes.withColumn("weight", weight).withColumn("bound", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = bounded.select(
        "*",
        F.coalesce(F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("spent"),
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("left"),
        (F.lit(share) * F.sum("source_size").over(everything)).alias("all"), F.row_number().over(order).alias("place"),
    ).withColumn("level", (F.col("all") - F.col("spent")) / F.col("left"))
    free = F.when(F.col("level") < F.col("bound") / F.col("weight"), F.struct("place", "level"))
    found = level.withColumn("level", F.min(free).over(everything)["level"])  # of the first source that does not stop at its bound
    return found.select(
        "source", "key", "source_size", F.coalesce(F.least("bound", F.col("level") * F.col("weight")), F.col("bound")).alias("target")
    )


def _thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source with a rest to take: ``(key, h, below, within)``, the hash at which it runs out, the words below it
    and at it; no row if the rest takes all. ``rows``: (key, h, size); ``goals``: (key, rest)."""
    found, open_, at = None, goals.withColumn("below", F.lit(0).cast("long")), 0
    while at < BITS:
        shift = BITS - at - STEP
        inside = rows.join(_small(open_), "key")
        if at:
            inside = inside.where(F.shiftright("h", BITS - at) == F.col("prefix"))
        histogram = inside.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("sum"), F.min("h").alias("low"), F.max("h").alias("high"),
            F.first("rest").alias("rest"), F.first("below").alias("below"),
        )
        until = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        boundary = histogram.withColumn("end", F.col("below") + F.sum("sum").over(until)).withColumn("start", F.col("end") - F.col("sum"))
        boundary = cut(boundary.where("start <= rest and rest < end"))
        done = boundary.where("low = high").select("key", F.col("low").alias("h"), F.col("start").alias("below"), F.col("sum").alias("within"))
        found = done if found is None else found.unionByName(done)
        open_ = boundary.where("low < high").select("key", "rest", F.col("start").alias("below"), F.col("bucket").alias("prefix"))
        if open_.isEmpty():
            break
        at += STEP
    return found


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _hash(doc_id: Column) -> Column:
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), _hash(F.col("doc_id")).alias("h"))
    return cut(rows.withColumn("key", _key(F.col("source"))))


def _plans(rows: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """What each source's documents need to know: ``(mix_key, mix_plan)``, one row for each source."""
    sizes = rows.groupBy("source", "key").agg(F.sum("size").alias("source_size"))
    goal = cut(targets(sizes, share, most, weights))
    goal = goal.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.floor(F.col("target") - F.col("base") * F.col("source_size") + 0.5).cast("long"))
    edge = _thresholds(rows.where("size > 0").select("key", "h", "size"), goal.where("rest > 0").select("key", "rest"))
    edge = edge.select(F.col("key").alias("edge_key"), F.col("h").alias("edge"), "below", "within")
    joined = goal.join(edge, F.col("key") == F.col("edge_key"), "left")
    return _small(cut(joined.select(F.col("key").alias("mix_key"), F.struct("source_size", "target", "base", "rest", "edge", "below", "within").alias("mix_plan"))))


def _taken(size: Column, h: Column, plan: Column) -> Column:
    """Words taken of a document: whole copies, and its share of the source's rest."""
    extra = (
        F.when(plan["rest"] <= 0, F.lit(0))
        .when(plan["edge"].isNull() | (h < plan["edge"]), size)
        .when(h == plan["edge"], F.call_function("div", size * (plan["rest"] - plan["below"]), plan["within"]))
        .otherwise(F.lit(0))
    )
    return (plan["base"] * size + extra).cast("long")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Rows ``(doc_id, size, source, source_size, target, taken)``, one for each row of ``docs(doc_id, text, source)``."""
    rows = _rows(docs)
    joined = rows.join(_plans(rows, share, most, weights), F.col("key") == F.col("mix_key"))
    return joined.select("doc_id", "size", "source", "mix_plan.source_size", "mix_plan.target", _taken(F.col("size"), F.col("h"), F.col("mix_plan")).alias("taken"))


def apply_mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mixed corpus, in the columns of ``docs``: a document taken more than once is as many rows, and the last copy of
    one taken in part ends after the words taken. Documents of which nothing is taken go. Texts are not shuffled: each row
    meets its source's plan."""
    plans, columns = _plans(_rows(docs), share, most, weights), docs.columns
    own = F.struct(*[F.col(c) for c in columns]).alias("mix_doc")
    rows = docs.select(own, _key(F.col("source").cast("string")).alias("key"), words(F.col("text")).alias("size"), _hash(F.col("doc_id")).alias("h"))
    taken = rows.join(plans, F.col("key") == F.col("mix_key")).select("mix_doc", "size", _taken(F.col("size"), F.col("h"), F.col("mix_plan")).alias("taken")).where("taken > 0")
    whole, rest = F.expr("taken div size"), F.expr("taken % size")
    kept = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    copies = taken.select("mix_doc", F.explode(kept).alias("keep"))
    head = F.expr("array_join(slice(regexp_extract_all(mix_doc.text, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0), 1, cast(keep as int)), '')")
    changed = {"text": head, "n_chars": F.length(head).cast("long")}

    def column(c: str) -> Column:
        old = F.col("mix_doc")[c]
        if c not in changed:
            return old.alias(c)
        return F.when(F.col("keep") < 0, old).otherwise(changed[c].cast(docs.schema[c].dataType)).alias(c)

    return copies.select(*map(column, columns))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
             2.0::double * source_size as bound from s),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(bound) over (order by bound / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
             / sum(weight) over (order by bound / weight, source nulls last rows between current row and unbounded following) as level,
             row_number() over (order by bound / weight, source nulls last) as place from w),
t as (select source, source_size, coalesce(least(bound, weight * (select arg_min(level, place) from l where level < bound / weight)), bound) as target from l),
g as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as base from t),
r as (select *, cast(floor(target - base * source_size + 0.5) as bigint) as rest from g),
j as (
  select d.doc_id, d.size, r.source_size, r.target, r.base, r.rest,
         cast(sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row) as bigint) as upto,
         cast(sum(d.size) over (partition by d.source, d.h) as bigint) as within
  from d join r on d.source is not distinct from r.source)
select doc_id, size, source_size, target,
       cast(base * size + case when rest <= 0 then 0 when upto <= rest then size when upto - within >= rest then 0
                               else size * (rest - (upto - within)) // within end as bigint) as taken
from j
"""
