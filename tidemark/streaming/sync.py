"""Incremental replication: pulls of a change feed, in pages or as a stream.

A pull starts from the target's own last stamp under the same filters, inclusive, and merges all since then at once with
latest-wins, so that a pull that died is simply run again, by itself after a pause if the source or a commit failed. Where a
feed has to be carried in pages, they go on from the last (stamp, keys, period) that was read, not by an offset, so that
rows stamped anew meanwhile are not skipped.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import filters as fl
from tidemark.operators import states
from tidemark.sources.chunked import ChunkedStore

log = logging.getLogger(__name__)


def feed_page(feed: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next ``size`` rows of a feed after the position ``(updated_at, keys..., chunk_index)``."""
    order = ["updated_at", *keys, "chunk_index"]
    if after is not None:
        position = F.struct(*[F.lit(v).cast(dict(feed.dtypes)[c]).alias(c) for c, v in zip(order, after, strict=True)])
        feed = feed.where(F.struct(*order) > position)
    return feed.orderBy(*order).limit(size)


class SyncClient:
    """Pulls from ``source`` into ``target``; both must be replicated stores."""

    def __init__(self, source: ChunkedStore, target: ChunkedStore) -> None:
        if not (source.spec.sync and target.spec.sync):
            raise ValueError("both stores must be replicated")
        self.source, self.target = source, target

    def pull(self, filters: Mapping[str, object] | None = None, retries: int = 3, pause: float = 1.0) -> tuple[int, int]:
        """(chunks fetched, tombstones fetched) since the target's last stamp, all merged in one write. What fails is tried
        ``retries`` times more, after ``pause`` seconds, twice as many each time."""
        for left in range(retries, -1, -1):
            try:
                return self._pull(filters)
            except ValueError:
                raise
            except Exception:
                if not left:
                    raise
                log.warning("a pull failed, %d tries left", left, exc_info=True)
                time.sleep(pause * 2 ** (retries - left))
        raise AssertionError

    def _pull(self, filters: Mapping[str, object] | None) -> tuple[int, int]:
        since = self.target.last_updated(filters)
        news = fl.where(self.source.table.read(), filters, self.source.keys).where(F.col("updated_at") >= F.lit(since))
        n, gone = news.agg(F.count("*"), F.count(F.when(F.col("is_deleted"), 1))).first()
        if n:
            self.target.import_(news)
        return n - gone, gone


def stream_pull(spark: SparkSession, feed_path: str, target: ChunkedStore, checkpoint: str, filters: Mapping[str, object] | None = None, once: bool = True) -> StreamingQuery:
    """A stream that merges appended change files (chunk rows, tombstones included) into ``target``.

    A batch that is delivered again merges to the same state.
    """
    def merge(batch: DataFrame, _: int) -> None:
        newest = states.latest_wins(batch.limit(0), fl.where(batch, filters, target.keys), target.keys)
        gone = fl.where(batch, filters, target.keys).where("is_deleted")
        target.import_(newest.unionByName(gone.join(newest.select(*target.keys, "chunk_index"), [*target.keys, "chunk_index"], "left_anti")))

    stream = spark.readStream.schema(target.table.schema).parquet(feed_path)
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
