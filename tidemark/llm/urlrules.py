"""URL rules by a sort-merge range join.

A host is written label by label from the right, each label ended by a byte that UTF-8 never has, so that a rule's host
and all its subdomains are one interval of keys; below it, a path prefix is an interval as well. Intervals of prefixes are
nested or apart. In the order of keys each interval has an opening and a closing event, which carry the top of the stack
of open intervals after them (the interval itself; the nearest one around it). A point's innermost interval is then the
stack top at the last event before it, and the rest of the stack follows from each interval's link to the one around it.

The sweep is run over ranges of keys. A range starts from the stack top that the last event of all earlier ranges left;
there is one such row for each range. Points are distinct keys, so that a host with a third of all pages is one point.

The first sweep finds each distinct host's stack of rule hosts, the second the longest fitting path below each of them;
pages whose host has no rule do not enter it. Longest: by characters of host and path together, then of the host; of rules
equal in both the blocking one wins.

Nulls and edges: a null url or one without ``://`` has empty host and path and gets the default verdict; rules with a null
host, path or action are ignored; empty tables of pages or rules work; repeated pages are judged each; a very long url is a
long key. Only
``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, table

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Parts that the paths of a host are spread over.
SALT = 32
#: Verdict on pages without a fitting rule: the list is a block list with exceptions.
DEFAULT = "allow"


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``(host, path, action)`` rows as a DataFrame."""
    rows = [F.struct(*(F.lit(x).cast("string").alias(c) for c, x in zip(("host", "path", "action"), r, strict=True))) for r in rules]
    typed = F.array(*rows).cast("array<struct<host:string,path:string,action:string>>")
    return spark.range(1).select(F.inline(typed))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, as the rules see them."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lowered(host), F.lit("")), F.coalesce(path, F.lit(""))


def lowered(host: Column) -> Column:
    """A host in lower case: A-Z only, in urls and in rules."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_key(host: Column) -> Column:
    """Bytes of the labels from the right, 0xFE after each."""
    labels = F.transform(F.reverse(F.split(host, r"\.", -1)), lambda x: F.concat(F.hex(x), F.lit("FE")))
    return F.unhex(F.array_join(labels, ""))


def innermost(points: DataFrame, intervals: DataFrame, bins: int | None = None) -> DataFrame:
    """For each distinct ``points(k)`` the ``lo`` of the innermost of ``intervals(lo, around)`` that begins ``k``, or empty.

    An interval holds the keys that begin with ``lo``; ``around`` is the ``lo`` of the nearest interval around it, or null.
    """
    spark = points.sparkSession
    bins = bins or int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.unhex(F.lit(""))
    events = intervals.select(F.col("lo").alias("k"), F.lit(0).alias("kind"), F.col("lo").alias("top")).unionByName(
        intervals.select(F.concat("lo", F.unhex(F.lit("FF"))).alias("k"), F.lit(0).alias("kind"), F.coalesce("around", none).alias("top"))
    )
    rows = events.unionByName(points.select("k", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("top")))
    # Written once: the number of a row's range must not change when a lost part is made again.
    rows = cut(rows.repartitionByRange(bins, "k").withColumn("bin", F.spark_partition_id()))
    last = rows.where("kind = 0").groupBy("bin").agg(F.max_by("top", "k").alias("top"))
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    size = (rows.agg(F.max("bin")).first()[0] or 0) + 1
    carry = spark.range(0, size, 1, 1).select(F.col("id").cast("int").alias("carry_bin")).join(last, F.col("carry_bin") == F.col("bin"), "left")
    carry = carry.select("carry_bin", F.last("top", ignorenulls=True).over(earlier.orderBy("carry_bin")).alias("before"))
    swept = Window.partitionBy("bin").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacked = rows.join(F.broadcast(carry), F.col("bin") == F.col("carry_bin"))  # one row for each range
    top = F.coalesce(F.last("top", ignorenulls=True).over(swept), F.col("before"), none)
    return stacked.select("k", "kind", top.alias("lo")).where("kind = 1").select("k", "lo")


def _nested(intervals: DataFrame) -> DataFrame:
    """``intervals(lo)`` with the nearest other one around each, by an equi-join on the prefixes of each rule's key."""
    own = intervals.select("lo").distinct()
    prefixes = own.select("lo", F.explode(F.expr("sequence(1, octet_length(lo) - 1)")).alias("n")).select(
        "lo", F.expr("substring(lo, 1, n)").alias("prefix")
    )
    around = prefixes.join(own.select(F.col("lo").alias("prefix")), "prefix").groupBy("lo").agg(
        F.max_by("prefix", F.octet_length("prefix")).alias("around"),
        F.sort_array(F.collect_list("prefix")).alias("chain"),  # at most as many as the key has bytes
    )
    return own.join(around, "lo", "left").withColumn("chain", F.coalesce("chain", F.array().cast("array<binary>")))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Rows ``(page_id, host, path, rule, verdict)``, one for each row of ``pages(page_id, url)``."""
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    own = rules.where("host is not null and path is not null and action is not null").select(
        lowered(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "action"
    ).groupBy("rule_host", "rule_path").agg(F.max(F.col("action") == "block").alias("blocks"))
    own = cut(own.withColumn("host_lo", host_key(F.col("rule_host"))).withColumn("lo", F.concat("host_lo", F.unhex(F.lit("FD")), F.col("rule_path").cast("binary"))))

    hosts = rows.select("host").distinct().withColumn("k", host_key(F.col("host")))
    host_nest = cut(_nested(own.select(F.col("host_lo").alias("lo"))))
    stacks = innermost(hosts.select("k"), host_nest.select("lo", "around")).where(F.octet_length("lo") > 0)
    stacks = stacks.join(host_nest.select("lo", "chain"), "lo").select("k", F.concat(F.array("lo"), F.col("chain")).alias("stack"))
    ruled = cut(hosts.join(stacks, "k").select("host", "stack"))

    # A host may have a third of all paths: they are spread over SALT parts, each with the host's stack.
    spread = ruled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    paths = rows.select("host", "path").distinct().withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int"))
    pairs = paths.join(spread, ["host", "salt"]).select("host", "path", F.explode("stack").alias("host_lo"))
    pairs = cut(pairs.withColumn("k", F.concat("host_lo", F.unhex(F.lit("FD")), F.col("path").cast("binary"))).distinct())
    tops = innermost(pairs.select("k").distinct(), _nested(own.select("lo")).select("lo", "around")).where(F.octet_length("lo") > 0)
    fits = pairs.join(tops, "k").join(own.select("lo", "rule_host", "rule_path", "blocks"), "lo")
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("m"), "blocks", "rule_host", "rule_path")).alias("best")
    )
    verdicts = cut(best.select(
        F.col("host").alias("best_host"), F.col("path").alias("best_path"),
        F.concat("best.rule_host", "best.rule_path").alias("rule"), F.when(F.col("best.blocks"), "block").otherwise("allow").alias("verdict"),
    ))
    found = rows.join(verdicts, (F.col("host") == F.col("best_host")) & (F.col("path") == F.col("best_path")), "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op2_urlrules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


ORACLE_SQL = r"""
with r(rule_host, rule_path, action) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u as (select row_number() over () as n, page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select p.n, r.rule_host || r.rule_path as rule, r.action, row_number() over (partition by p.n order by length(rule_host) + length(rule_path) desc, length(rule_host) desc) as k
      from p join r on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path))
select p.page_id, p.host, p.path, m.rule, coalesce(m.action, 'allow') as verdict from p left join m on p.n = m.n and m.k = 1
"""
