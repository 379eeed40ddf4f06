"""Nearest neighbours with randomly rotated one-bit codes.

After Gao and Long, "RaBitQ" (2024). A vector, less the mean of all, is turned at random into a space of ``BITS`` dimensions
or more and each component keeps its sign: a packed code, with three scalars, the vector's distance from the mean, the inner
product of code and turned vector, and the number of ones. A query's turned vector is rounded to ``PLANES`` bits a component,
so that its inner product with a code is a weighted count of common bits. From that follow an estimate of the squared
distance and its error.

Codes lie in a table of their own; vectors are only read by id. Each block of queries (its size is fixed, so what is
broadcast is bounded) passes over the codes twice. First each task keeps the k smallest estimates of a query, of which the k
smallest are measured exactly: the largest of these distances bounds the k-th neighbour's. Then all vectors whose distance
may be smaller, by ``BOUND`` standard errors, are fetched and ranked by their exact distances. None is left out by a cap.

Nulls and edges: vectors that are null, zero, hold a null or non-finite component, or have no id take no part, nor do
those of another length than the most common one. Equal distances go to the smaller vec_id. A repeated query id is one
query, its smallest vector; rows with the query's id are its own and no candidates; other repeated rows are candidates
each. Fewer candidates than k give all of them, an empty table none. Very long vectors take codes as long; columns with
clashing names are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, table

#: Queries of a block (16 MB at 64 dimensions), and codes that a task looks at at once.
QUERY_BLOCK, CODES = 32768, 8192
#: Bits of a code at least, a multiple of 64; bits of a query's components; standard errors in the bound of an estimate.
BITS, PLANES, BOUND = 512, 4, 2.0


def rotation(dimensions: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """A matrix of orthonormal rows, ``dimensions`` x (bits, or the next multiple of 64 to hold the dimensions)."""
    bits = max(bits, -(-dimensions // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dimensions)))
    return (q * np.sign(np.diag(r))).T


def _turned(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rest = vectors - mean
    norm = np.sqrt((rest * rest).sum(axis=1))
    return norm, (rest / np.maximum(norm, 1e-300)[:, None]) @ turn


def encode(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits (a row of bytes), distance from the mean, and inner product of code and direction of each vector."""
    norm, turned = _turned(vectors, mean, turn)
    return np.packbits(turned > 0, axis=1, bitorder="little"), norm, np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])


@dataclass
class Queries:
    """Queries ready to be compared with codes: distances from the mean, the bit planes of the turned components (queries x
    planes x words), their lowest value and step, and their sums."""

    norm: np.ndarray
    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> Queries:
        norm, turned = _turned(vectors, mean, turn)
        low = turned.min(axis=1)
        step = (turned.max(axis=1) - low) / ((1 << PLANES) - 1)
        level = np.rint((turned - low[:, None]) / np.maximum(step, 1e-300)[:, None]).astype(np.uint8)
        planes = np.stack([np.packbits(level >> j & 1, axis=1, bitorder="little").view(np.uint64) for j in range(PLANES)], axis=1)
        return Queries(norm, planes, low, step, turned.sum(axis=1))


class Codes:
    """A batch of codes, words by rows."""

    def __init__(self, bits: np.ndarray, norm: np.ndarray, inner: np.ndarray) -> None:
        self.words = np.ascontiguousarray(bits.view(np.uint64).T)
        self.norm, self.inner, self.bits = norm, np.maximum(inner, 1e-6), bits.shape[1] * 8
        self.ones = np.bitwise_count(self.words).sum(axis=0, dtype=np.int64)

    def compare(self, queries: Queries, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the squared distances of all codes to a query, and their standard errors."""
        common = np.zeros(len(self.norm))
        for j in range(PLANES):
            common += np.bitwise_count(self.words & queries.planes[i, j][:, None]).sum(axis=0, dtype=np.uint32) * float(1 << j)
        inside = queries.low[i] * self.ones + queries.step[i] * common
        root = np.sqrt(self.bits)
        cosine = (2 * inside - queries.total[i]) / root / self.inner
        rounding = 2 / root * queries.step[i] * np.sqrt(self.ones / 12) / self.inner
        error = np.sqrt(np.maximum(0, 1 - self.inner**2) / self.inner**2 / max(1, self.bits - 1) + rounding**2)
        both = 2 * self.norm * queries.norm[i]
        return self.norm**2 + queries.norm[i] ** 2 - both * cosine, both * error


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


@dataclass
class Index:
    """The usable ``vectors(vec_id, v)``, their ``codes(vec_id, bits, norm, inner)``, the mean and the rotation."""

    vectors: DataFrame
    codes: DataFrame
    mean: np.ndarray
    turn: np.ndarray


def index(vectors: DataFrame, bits: int = BITS, seed: int = 7) -> Index:
    """The index of all usable rows of ``vectors(vec_id, embedding)``. Only the codes are written."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 1
    rows = rows.where(F.size("v") == d)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(d), 0
        for batch in batches:
            if len(batch):
                total += np.array(batch["v"].tolist()).sum(axis=0)
                n += len(batch)
        yield pd.DataFrame({"s": [total], "n": [n]})

    parts = rows.select("v").mapInPandas(summed, "s array<double>, n long").select(F.posexplode("s").alias("pos", "s"), "n")
    found = {r["pos"]: r["s"] / max(1, r["n"]) for r in parts.groupBy("pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}  # one row a dimension
    mean, turn = np.array([found.get(i, 0.0) for i in range(d)]), rotation(d, bits, seed)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                code, norm, inner = encode(np.array(batch["v"].tolist()), mean, turn)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "bits": [b.tobytes() for b in code], "norm": norm, "inner": inner})

    return Index(rows, cut(rows.mapInPandas(of, "vec_id long, bits binary, norm double, inner double")), mean, turn)


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, Codes]]:
    def made(held: list[pd.DataFrame]) -> tuple[np.ndarray, Codes]:
        frame = pd.concat(held, ignore_index=True)
        bits = np.frombuffer(b"".join(frame["bits"]), dtype=np.uint8).reshape(len(frame), -1)
        return frame["vec_id"].to_numpy(dtype=np.int64), Codes(bits, frame["norm"].to_numpy(), frame["inner"].to_numpy())

    held: list[pd.DataFrame] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= CODES:
            yield made(held)
            held = []
    if held:
        yield made(held)


def _best(codes: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    """Of each query the ``k`` ids of each task whose estimates are smallest: ``(query_id, vec_id, estimate)``."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _, queries, _ = sent.value
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(own)
        for ids, batch in _batches(batches):
            for q in range(len(own)):
                estimate, _ = batch.compare(queries, q)
                estimate[ids == own[q]] = np.inf
                near = np.argpartition(estimate, min(k, len(ids)) - 1)[:k]
                near = near[np.isfinite(estimate[near])]
                both = np.concatenate([best[q][0], ids[near]]), np.concatenate([best[q][1], estimate[near]])
                order = np.lexsort(both)[:k]
                best[q] = both[0][order], both[1][order]
        yield pd.DataFrame({"query_id": np.repeat(own, [len(b[0]) for b in best]), "vec_id": np.concatenate([np.zeros(0, dtype=np.int64), *(b[0] for b in best)]),
                            "estimate": np.concatenate([np.zeros(0), *(b[1] for b in best)])})

    return codes.mapInPandas(of, "query_id long, vec_id long, estimate double")


def _survivors(codes: DataFrame, sent: Broadcast, bound: float) -> DataFrame:
    """``(query_id, vec_id)`` of all codes whose distance may be within the query's limit."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _, queries, limits = sent.value
        for ids, batch in _batches(batches):
            for q in range(len(own)):
                estimate, error = batch.compare(queries, q)
                near = ids[(estimate - bound * error <= limits[q]) & (ids != own[q])]
                if len(near):
                    yield pd.DataFrame({"query_id": np.full(len(near), own[q]), "vec_id": near})

    return codes.mapInPandas(of, "query_id long, vec_id long").distinct()


def _measured(pairs: DataFrame, vectors: DataFrame, sent: Broadcast) -> DataFrame:
    """``(query_id, vec_id, score)``: the exact distances of ``pairs(query_id, vec_id)``."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, exact, _, _ = sent.value
        for batch in batches:
            if len(batch):
                gap = np.array(batch["v"].tolist()) - exact[np.searchsorted(own, batch["query_id"].to_numpy())]
                yield pd.DataFrame({"query_id": batch["query_id"], "vec_id": batch["vec_id"], "score": np.sqrt((gap * gap).sum(axis=1))})

    return vectors.join(pairs.select("query_id", "vec_id"), "vec_id").select("query_id", "vec_id", "v").mapInPandas(of, "query_id long, vec_id long, score double")


def _first(rows: DataFrame, k: int, by: str) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(by, "vec_id")))
    return ranked.where(F.col("rank") <= k)


def candidates(found: Index, block: pd.DataFrame, k: int, bound: float = BOUND) -> tuple[DataFrame, Broadcast]:
    """The pairs ``(query_id, vec_id)`` to be reranked for a block of queries ``(vec_id, v)``, and the broadcast they need."""
    context = found.codes.sparkSession.sparkContext
    block = block.sort_values("vec_id")
    own = block["vec_id"].to_numpy(dtype=np.int64)
    exact = np.array(block["v"].tolist(), dtype=float).reshape(len(block), len(found.mean))
    queries = Queries.of(exact, found.mean, found.turn)
    sent = context.broadcast((own, exact, queries, None))
    nearest_ = _first(_best(found.codes, sent, k), k, "estimate").select("query_id", "vec_id").distinct()
    worst = _first(_measured(nearest_, found.vectors, sent), k, "score").groupBy("query_id").agg(F.max("score").alias("far"), F.count("*").alias("n"))
    far = {r["query_id"]: r["far"] for r in worst.where(F.col("n") >= k).collect()}  # one row a query of the block
    sent.destroy()
    limits = np.array([far.get(i, np.inf) for i in own.tolist()]) ** 2 * (1 + 1e-9)
    sent = context.broadcast((own, exact, queries, limits))
    return _survivors(found.codes, sent, bound), sent


def nearest(vectors: DataFrame, queries: Column, k: int = 10, bound: float = BOUND, block: int = QUERY_BLOCK, bits: int = BITS) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: the ``k`` nearest of all other vectors for the rows that ``queries`` picks."""
    found = index(vectors, bits)
    asked = cut(found.vectors.where(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-asked.count() // block))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    out = None
    for b in range(blocks):
        pairs, sent = candidates(found, asked.where(part == b).toPandas(), k, bound)
        one = _first(_measured(pairs, found.vectors, sent), k, "score").select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            one = cut(one)
            sent.destroy()
        out = one if out is None else out.unionByName(one)
    return out


def op7_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
