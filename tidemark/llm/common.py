"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts may be long, so batches stay small: memory per Python worker is this many texts.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one if the session
    runs in this process alone, as in tests; else an error, since executors could not read each other's folders."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if not current:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(current := tempfile.mkdtemp(prefix="tidemark-"))
    return current.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: lineage ends here, lost executors do not matter."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, which by default hold 10,000 texts of any length."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from: crc32 of the id's decimal text divides by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: Column) -> DataFrame:
    """One row ``(doc_id, y)`` for each labelled id of ``labels`` that ``fold`` allows and ``docs`` may have.

    Null ids and null labels are left out; an id labelled twice counts once, with its largest label.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).where(fold).groupBy("doc_id").agg(F.max("y").alias("y"))


def sample_ids(rows: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` rows of each class, those whose hashed ids are smallest: the same ones in every run."""
    parts = [
        rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for y in (0, 1)
    ]
    return parts[0].unionByName(parts[1])
