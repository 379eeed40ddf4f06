"""SimHash near-duplicates, found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most two bits
have, by the pigeonhole principle, a cyclic pair of segments (i, i+1) of which the first agrees and the second differs in
one bit at most. The second is padded to 23 bits and decoded with the perfect binary Golay code: the codeword nearest to
one of the two (at most 3 bits off) lies within 4 bits of the other. So one side is filed under the index of its nearest
codeword and the other asks under the indices of all codewords within 4 bits (one or six): every link shares a key of the
agreeing segment and a 12-bit index. Keys are joined and the distance is verified.

A key under which more than ``DENSE`` fingerprints are filed is split by the third segment, which two bits at most may
change: filed under the codeword nearest to it, asked under all within 5 bits, again 12 bits more of key. With 46 bits the
number of documents crowds no key, only fingerprints that are much alike do. Those of a key that is crowded even then
would give pairs with the square of their number; they go another exact way: each is filed under itself and its 64 one-bit
neighbours, and two fingerprints share one of these midpoints just if they differ in at most two bits. A midpoint has at
most 65 fingerprints, all of them linked, and only a star of them is kept.

Nulls and edges: a null text counts as empty, a text without words has fingerprint zero and is linked like any other. Whole
texts are hashed, a very long one as one row. A row without doc_id keeps its fingerprint and gets the component of that
fingerprint's other rows, or null if it has none. Repeated ids stay repeated rows. Other columns of the input are not looked
at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small_batches, table
from tidemark.llm.components import connected_components

SEED = 42
#: (lowest bit, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code.
GENERATOR = 0xC75
#: Fingerprints filed under one key, above which it is split, and those of a split key take the midpoint way.
DENSE = 32
#: Bits that a codeword may be off: of a segment with one error, and of one with two.
NEAR, FAR = 4, 5


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Unsigned SimHash of one text: a bit is 1 if set in over half the hashes of its word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return of_hashes(np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8"))


def of_hashes(hashes: np.ndarray) -> int:
    """Unsigned SimHash of shingles by their hashes; zero without any."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, width: int = 3, text: str = "text", to: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a signed 64-bit column."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(to, of(F.col(text).cast("binary")))


def _remainder(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - 11)
    return v


class Golay:
    """Tables of the (23, 12) code: syndromes of 23-bit vectors and the error patterns of weight at most 5 for each."""

    def __init__(self) -> None:
        powers = [_remainder(1 << bit) for bit in range(23)]
        def table(low: int, bits: int) -> np.ndarray:
            out = np.zeros(1 << bits, dtype=np.int64)
            for bit in range(bits):
                out[1 << bit : 2 << bit] = out[: 1 << bit] ^ powers[low + bit]
            return out

        self.low, self.high = table(0, 12), table(12, 11)
        patterns: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(FAR + 1):
            for bits in combinations(range(23), weight):
                e, s = 0, 0
                for bit in bits:
                    e |= 1 << bit
                    s ^= powers[bit]
                patterns[s].append(e)
        most = max(map(len, patterns))
        self.errors = np.array([p + [-1] * (most - len(p)) for p in patterns], dtype=np.int64)  # the lightest first
        self.weights = np.where(self.errors < 0, 24, np.bitwise_count(self.errors))

    def nearest(self, v: np.ndarray) -> np.ndarray:
        """Index of the codeword nearest to each vector."""
        return (v ^ self.errors[self._syndrome(v), 0]) >> 11

    def near(self, v: np.ndarray, bits: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
        """All (position in v, index) of codewords within ``bits`` of 4 or 5."""
        syndrome = self._syndrome(v)
        at, which = np.nonzero(self.weights[syndrome] <= bits)
        return at, (v[at] ^ self.errors[syndrome[at], which]) >> 11

    def _syndrome(self, v: np.ndarray) -> np.ndarray:
        return self.low[v & 0xFFF] ^ self.high[v >> 12]


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def _segments(bits: np.ndarray) -> list[np.ndarray]:
    return [((bits >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]


def third_keys(keys: np.ndarray, fps: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position, index of the codeword) of the segment that each row's key says nothing of."""
    code, which = golay(), ((keys >> 40) + 2) % 3
    third = np.choose(which, _segments(fps.view(np.uint64)))
    return code.near(third, FAR) if probe else (np.arange(len(fps)), code.nearest(third))


def segment_keys(fps: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of each signed fingerprint: three filing keys, or three to eighteen asking keys."""
    code, out = golay(), []
    bits = fps.view(np.uint64)
    parts = _segments(bits)
    for i in range(3):
        same, fuzzy = parts[i], parts[(i + 1) % 3]
        if probe:
            at, index = code.near(fuzzy)
        else:
            at, index = np.arange(len(fps)), code.nearest(fuzzy)
        out.append((at, np.int64(i) << 40 | same[at] << 12 | index))
    return np.concatenate([a for a, _ in out]), np.concatenate([k for _, k in out])


def _grouped(at: np.ndarray, keys: np.ndarray, n: int) -> pa.ListArray:
    """The keys of each of n rows."""
    ends = np.concatenate(([0], np.bincount(at, minlength=n).cumsum())).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[np.argsort(at, kind="stable")]))


def _keys(fps: DataFrame) -> DataFrame:
    """Rows ``(fp, files, asks)``: the filing and the asking keys of each fingerprint, made in one pass."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            sides = [_grouped(*segment_keys(own, probe), len(own)) for probe in (False, True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides], names=["fp", "files", "asks"])

    return fps.select("fp").mapInArrow(of, "fp long, files array<long>, asks array<long>")


def _midpoint_links(fps: DataFrame) -> DataFrame:
    """A star for each midpoint: ``fps`` are distinct, so that no midpoint has more than 65 of them."""
    flips = F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {bit})") for bit in range(64)])
    filed = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    stars = filed.groupBy("mid").agg(F.min("fp").alias("fp_a"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return stars.select("fp_a", F.explode("fps").alias("fp_b")).where("fp_a <> fp_b").distinct()


def _split(rows: DataFrame) -> DataFrame:
    """``rows(key, fp, probe)`` with the third segment's codewords, ``more``."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for probe in (False, True):
                side = batch[batch["probe"] == probe]
                keys, own = side["key"].to_numpy(dtype=np.int64), side["fp"].to_numpy(dtype=np.int64)
                at, more = third_keys(keys, own, probe)
                yield pd.DataFrame({"key": keys[at], "more": more, "fp": own[at], "probe": np.full(len(at), probe)})

    return rows.select("key", "fp", "probe").mapInPandas(of, "key long, more long, fp long, probe boolean")


def _near(filed: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that share a key and differ in two bits at most, once for each key that they share. Either of two fingerprints asks
    for what the other is filed under, so that the lesser one's filing is enough."""
    pairs = filed.withColumnRenamed("fp", "fp_a").join(asked.withColumnRenamed("fp", "fp_b"), keys).where("fp_a < fp_b")
    return pairs.where(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= 2).select("fp_a", "fp_b")


def fingerprint_links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Rows ``(fp_a, fp_b)`` whose components are those of "differs in at most two bits" on the distinct ``fps(fp)``; a link may
    be several rows."""
    found = cut(_keys(fps))
    filed, asked = (found.select("fp", F.explode(side).alias("key")) for side in ("files", "asks"))
    hot = cut(filed.groupBy("key").count().where(F.col("count") > dense).select("key"))
    if hot.isEmpty():
        return _near(filed, asked, ["key"])
    links = _near(filed.join(hot, "key", "left_anti"), asked.join(hot, "key", "left_anti"), ["key"])
    sides = F.expr("concat(transform(files, k -> struct(k AS key, false AS probe)), transform(asks, k -> struct(k AS key, true AS probe)))")
    both = cut(_split(found.select("fp", F.inline(sides)).join(hot, "key", "left_semi")))
    filed, asked = both.where("not probe").drop("probe"), both.where("probe").drop("probe")
    keys = ["key", "more"]
    crowds = cut(filed.groupBy(*keys).count().where(F.col("count") > dense).select(*keys))
    if crowds.isEmpty():
        return links.unionByName(_near(filed, asked, keys))
    links = links.unionByName(_near(filed.join(crowds, keys, "left_anti"), asked.join(crowds, keys, "left_anti"), keys))
    crowded = both.join(crowds, keys, "left_semi").select("fp").distinct()
    return links.unionByName(_midpoint_links(crowded))


def near_duplicates(docs: DataFrame, width: int = 3, dense: int = DENSE) -> DataFrame:
    """Rows ``(doc_id, fp, component_id)``, one for each row of ``docs(doc_id, text)``.

    Documents link when their fingerprints differ in at most two bits; component_id is the smallest doc_id reachable.
    """
    rows = with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width)
    rows = cut(rows.select("doc_id", "fp"))
    reps = cut(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = cut(fingerprint_links(reps.select("fp"), dense))
    ends = links.join(reps.select(F.col("fp").alias("fp_a"), F.col("rep").alias("a")), "fp_a").join(
        reps.select(F.col("fp").alias("fp_b"), F.col("rep").alias("b")), "fp_b"
    )
    components = connected_components(ends.select("a", "b"))
    classes = reps.join(components, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return rows.join(cut(classes), F.col("fp") == F.col("class_fp"), "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the one with the smallest doc_id, all columns as they were.

    A stage that removes documents goes by five-word shingles and a Jaccard similarity of 0.8. Golay keys of five-word fingerprints
    find the nearest; no radius of fingerprints gives all (the README has the figures), so the shingles' minima find the rest; see
    ``nearcopies``.
    """
    from tidemark.llm import nearcopies

    return nearcopies.keep_one(docs)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
