"""Tables whose partitions are replaced as a whole and switched at once.

A write puts the new partitions into a directory of its own and then a manifest, which lists where each partition of the
table lives now. The newest manifest that was committed is the table: readers see the old or the new state, a write that
dies leaves the old one. Partitions that a write does not touch are neither read nor copied.

Writers take turns: within ``writing()`` all reads are of one state, and the commit is refused with ``ConflictError`` if another
writer has committed meanwhile, so that no rows are lost; the call can be made again. The last step is a rename that must not
replace a file, which file systems do at once; a store of objects needs a table of its own for manifests.

Rows are sorted by their keys within files, so that a read of one series skips the row groups of others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Partitions of a new table that is dealt out by a hash of its keys, and bytes of one above which their number should grow.
BUCKETS, BUCKET_BYTES = 64, 1 << 30
#: Bytes of a row group.
GROUP_BYTES = 8 << 20


class ConflictError(RuntimeError):
    """Another writer has committed since this one read the table."""


def bucket(keys: Iterable[str], buckets: int = BUCKETS) -> Column:
    """The partition of a series: a hash of its keys."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def buckets_of(df: DataFrame, keys: Iterable[str], buckets: int = BUCKETS) -> list[int]:
    """The partitions that the series of ``df`` lie in: at most ``buckets``."""
    return [r[0] for r in df.select(bucket(keys, buckets).alias("bucket")).distinct().collect()]



class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition: str | None = None, signature: str = "", sort: Sequence[str] = ()) -> None:
        self.spark, self.path, self.schema, self.partition, self.signature, self.sort = spark, path.rstrip("/"), schema, partition, signature, list(sort)
        self._pinned: tuple[int, dict] | None = None
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda p: hadoop.Path(f"{self.path}/{p}" if p else self.path)
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        kept = self._manifest()[1]
        if kept and kept.get("signature", signature) != signature:
            raise ValueError("the table was written with other options")

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path("manifests")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n) for n in names if n.isdigit())

    @contextmanager
    def writing(self) -> Iterator[None]:
        """Reads until the end are of the state at the beginning, on which a write then has to build. Calls may be nested."""
        if self._pinned is not None:
            yield
            return
        self._pinned = self._newest()
        try:
            yield
        finally:
            self._pinned = None

    def _manifest(self) -> tuple[int, dict]:
        return self._pinned if self._pinned is not None else self._newest()

    def options(self) -> dict:
        """What was written beside the partitions."""
        return self._manifest()[1].get("options", {})

    def size(self) -> int:
        """Bytes of all partitions."""
        return sum(self._fs.getContentSummary(self._path(d)).getLength() for d in self.partitions().values())

    def _newest(self) -> tuple[int, dict]:
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        stream = self._fs.open(self._path(f"manifests/{numbers[-1]}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return numbers[-1], json.loads(text)

    def partitions(self) -> dict[str, str]:
        """Directory of each partition; a table without partitions has one under the empty name."""
        return self._manifest()[1].get("parts", {})

    def read(self, only: Iterable[int] | None = None) -> DataFrame:
        """The table, or its partitions ``only``: others are not even listed."""
        parts = self.partitions()
        if only is not None:
            wanted = {str(x) for x in only}
            parts = {k: v for k, v in parts.items() if k in wanted}
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        columns = [f.name for f in self.schema]
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{d}" for d in parts.values())).select(*columns)

    def write(self, df: DataFrame, replaced: Iterable[int] | None = None, options: dict | None = None) -> None:
        """``df`` as the new state of the partitions ``replaced`` (default: of the whole table)."""
        number, kept = self._manifest()
        parts = dict(kept.get("parts", {})) if replaced is not None else {}
        target = f"data/{number + 1}-{self.spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
        df = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in self.schema])
        if self.partition:
            # The partition column stays in the files as well, so that a partition can be read by its own path.
            # Rebalanced, not hash-partitioned: adaptive execution splits a partition of many series over several tasks and files.
            dealt = df.withColumn("_part", df[self.partition]).hint("rebalance", "_part").sortWithinPartitions("_part", *self.sort)
            dealt.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).partitionBy("_part").parquet(f"{self.path}/{target}")
            for gone in replaced or ():
                parts.pop(str(gone), None)
            for status in self._fs.listStatus(self._path(target)):
                name = status.getPath().getName()
                if name.startswith("_part="):
                    parts[name[6:]] = f"{target}/{name}"
        else:
            df.write.mode("overwrite").parquet(f"{self.path}/{target}")
            parts = {"": target}
        staged = self._path(f"manifests/.{number + 1}-{uuid.uuid4().hex[:8]}.tmp")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps({"signature": self.signature, "options": kept.get("options", {}) | (options or {}), "parts": parts}).encode()))
        out.close()
        done = self._path(f"manifests/{number + 1}")
        if self._fs.exists(done) or not self._fs.rename(staged, done):
            self._fs.delete(staged, False)
            raise ConflictError("another writer has committed meanwhile")
        if self._pinned is not None:
            self._pinned = self._newest()

    def vacuum(self) -> None:
        """Remove what the newest manifest does not name."""
        number, kept = self._manifest()
        used = {d.split("/")[1] for d in kept.get("parts", {}).values()}
        if self._fs.exists(self._path("data")):
            for status in self._fs.listStatus(self._path("data")):
                if status.getPath().getName() not in used:
                    self._fs.delete(status.getPath(), True)
        for n in self._numbers():
            if n != number:
                self._fs.delete(self._path(f"manifests/{n}"), False)
