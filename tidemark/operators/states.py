"""State changes of chunk tables, as functions from the old and the new table to the next one.

A chunk table has ``(keys..., chunk_index, start_ts, values, updated_at, is_deleted)``. Long tables have ``ts, value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New values over old ones; an old value stays where the new one is null or absent."""
    on = [*keys, "ts"]
    a, b = new.select(*on, F.col("value").alias("new_value")), old.select(*on, F.col("value").alias("old_value"))
    return a.join(b, on, "full").select(*on, F.coalesce("new_value", "old_value").alias("value"))


def upsert_chunks(live: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` with the live values where its own are null. Chunks of a period have the same grid, so arrays are laid over
    each other slot by slot and nothing is unpacked."""
    on = [*keys, "chunk_index"]
    joined = new.join(live.select(*on, F.col("values").alias("_old")), on, "left")
    merged = F.when(F.col("_old").isNull(), F.col("values")).otherwise(F.zip_with("values", "_old", lambda a, b: F.coalesce(a, b)))
    return joined.withColumn("values", merged).select(*new.columns)


def tombstones(chunks: DataFrame, updated_at) -> DataFrame:
    """``chunks`` as deleted ones: empty, stamped, kept in the change feed."""
    return chunks.withColumns({"values": F.array().cast("array<double>"), "is_deleted": F.lit(True), "updated_at": updated_at})


def replace_chunks(old: DataFrame, new: DataFrame, keys: Sequence[str], updated_at) -> DataFrame:
    """The new chunks, tombstones of all other chunks of the same series, and the other series as they were."""
    touched = new.select(*keys).distinct()
    rest = old.join(new.select(*keys, "chunk_index"), [*keys, "chunk_index"], "left_anti")
    if not keys:
        return new.unionByName(tombstones(rest, updated_at))
    gone = tombstones(rest.join(touched, list(keys), "left_semi"), updated_at)
    return new.unionByName(gone).unionByName(rest.join(touched, list(keys), "left_anti"))


def soft_delete(chunks: DataFrame, which, updated_at) -> DataFrame:
    """Chunks for which ``which`` holds become tombstones."""
    live = which & ~F.col("is_deleted")
    return chunks.withColumns({
        "values": F.when(live, F.array().cast("array<double>")).otherwise(F.col("values")),
        "updated_at": F.when(live, updated_at).otherwise(F.col("updated_at")),
        "is_deleted": F.col("is_deleted") | F.coalesce(which, F.lit(False)),
    })


def latest_wins(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (keys, chunk_index) the row stamped last; of equal stamps the incoming one. A deletion of an unknown chunk is
    ignored. Applying the same feed again changes nothing."""
    on = [*keys, "chunk_index"]
    columns = stored.columns
    rows = stored.withColumn("_in", F.lit(0)).unionByName(incoming.select(*columns).withColumn("_in", F.lit(1)))
    w = Window.partitionBy(*on)
    ranked = rows.withColumns({
        "_known": F.max(F.when((F.col("_in") == 0) | ~F.col("is_deleted"), 1).otherwise(0)).over(w),
        "_n": F.row_number().over(w.orderBy(F.desc("updated_at"), F.desc("_in"))),
    })
    return ranked.where("_n = 1 and _known = 1").select(*columns)


def change_feed(chunks: DataFrame, keys: Sequence[str], since) -> DataFrame:
    """Metadata of all chunks stamped at ``since`` or later, tombstones included, in feed order. Values are not read."""
    return chunks.where(F.col("updated_at") >= F.lit(since)).select(*keys, "chunk_index", "start_ts", "updated_at", "is_deleted").orderBy(
        "updated_at", *keys, "chunk_index")


def export_chunks(chunks: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The chunks named by ``wanted(keys..., chunk_index)``."""
    return chunks.join(wanted.select(*keys, "chunk_index").distinct(), [*keys, "chunk_index"])


def next_versions(df: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """``(keys..., next_version)``: one more than the largest version."""
    return df.groupBy(*keys).agg((F.max(version) + 1).cast("int").alias("next_version"))
