"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The first candidates are SimHash fingerprints of the sets that differ in two bits at most, found by the Golay keys of
``simhash``. Many pairs of that similarity differ in more bits, so bands of minima find the rest.

Each set of shingle hashes has 160 minima of seeded permutations, in 32 bands of five (Broder, 1997). Two sets of
similarity s agree in one band at least with probability 1 - (1 - s^5)^32: all but three of a million at 0.8. Sets that
share a band, or near fingerprints, are compared by their exact similarity, so nothing is linked that is less alike; equal
sets are one node.

The pairs of a band that more than ``DENSE`` different sets share would grow with the square of their number, be it a group
of copies or texts that have a frequent passage in common. There each set is first compared with one pivot, the most
central member: that of the most and fullest crowded bands, next to which edited copies of one text lie. Components of the
links found so far make most of the other pairs needless. As long as a round leaves clearly fewer components in the bands, the
most central member outside of each band's largest component is the next pivot. What is left then is to compare a set with
the members of the band that are in another component, unless both are in the band's largest one, and in the first crowded
band that the two share. Within the join, before a pair becomes a row, it has to pass a bound that loses nothing: odd sketches
(Mitzenmacher, Pagh and Pham, 2014) of two sets differ in no more bits than the sets differ in shingles, whatever they have in
common. So only pairs of about 0.8 or more come out of a crowded band and are compared exactly, and no member is left out.

Nulls and edges: words are as in simhash; a text of fewer than five words is one shingle, texts without words are equal
to each other. Rows without doc_id stay and remove nothing. Of each component the row with the smallest doc_id stays; of
repeated ids those with different texts are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small_batches
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import fingerprint_links, of_hashes

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Different sets in one band, above which they are compared with pivots first.
DENSE = 32
#: Share of the components in crowded bands that a round of pivots has to leave at most for another round.
SHRINK = 0.5
#: Sets whose names are broadcast to find their texts; for more the texts are shuffled.
FEW = 200_000
#: 64-bit words of a bitmap.
MAP = 32
SEED = 42
_rng = np.random.default_rng(SEED)
_FLIP, _FACTOR = _rng.integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
_FACTOR |= np.uint64(1)
_MIX = _rng.integers(0, 1 << 64, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 1 << 64, BANDS, dtype=np.uint64)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted different hashes of a text's word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        found = [b" ".join(words)]
    else:
        found = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in found), dtype=np.uint64))


def node(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def bands(hashes: np.ndarray) -> np.ndarray:
    """Keys of the bands of a set's minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 1024):
            np.minimum(least, ((hashes[at : at + 1024, None] ^ _FLIP) * _FACTOR).min(axis=0), out=least)
        keys = least.reshape(BANDS, ROWS)
        keys = ((keys ^ keys >> np.uint64(31)) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND
        keys = (keys ^ keys >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return keys.view(np.int64)


def _nodes(text: Column) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([node(shingles(t)) for t in texts], dtype="int64")

    return of(text.cast("binary"))


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64)))


def _sketches(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, node, size, fp, bands)``."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, fps, keys = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                names.append(node(found))
                sizes.append(len(found))
                fps.append(of_hashes(found))
                keys.append(bands(found) if len(found) else np.zeros(0, dtype=np.int64))
            prints = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), prints, _lists(keys)], names=["doc_id", "node", "size", "fp", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(of, "doc_id long, node long, size long, fp long, bands array<long>")


def _pairs(left: DataFrame, right: DataFrame, condition: str, maps: bool = False, once: bool = False) -> DataFrame:
    """Different pairs ``(a, b)``, a < b, of members of the same band whose sizes, and bitmaps if they have them, allow the
    similarity; ``once``: only from the first crowded band that both are in."""
    conditions = [F.expr(condition), F.expr(f"least(l.size, r.size) >= {SIMILARITY} * greatest(l.size, r.size)")]
    if maps:  # |x xor y| <= (1 - SIMILARITY) / (1 + SIMILARITY) (|x| + |y|) = (|x| + |y|) / 9
        bits = " + ".join(f"bit_count(l.m{i} ^ r.m{i})" for i in range(MAP))
        conditions.append(F.expr(f"({bits}) * {round(10 * (1 + SIMILARITY))} <= {round(10 * (1 - SIMILARITY))} * (l.size + r.size)"))
    if once:
        conditions.append(F.expr("array_min(array_intersect(l.crowds, r.crowds)) = l.key"))
    near = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & reduce(and_, conditions))
    return near.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def _alike(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` whose sets have a similarity of SIMILARITY or more."""
    pairs = cut(pairs)
    sets = _sets(cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps.select("node", "rep"), "node")), docs)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    # |x and y| / |x or y| >= SIMILARITY, without a division.
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("m"))
    return cut(both.where(F.col("n") * 10 >= (F.col("m") - F.col("n")) * round(10 * SIMILARITY)).select("a", "b"))


def _texts(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, text)`` of the documents with the ids of ``nodes(node, rep)``, which are written already."""
    nodes = nodes.select("node", "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    if nodes.count() <= FEW:  # their size is not known to the planner, which would shuffle all texts for some of them
        nodes = F.broadcast(nodes)
    return texts.join(nodes, F.col("doc_id") == F.col("rep")).select("node", "text")


def _sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, hashes)`` of the ``nodes(node, rep)``, worked out anew from the text of the document that stands for each."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([node(s) for s in found], pa.int64()), batch.column(0), _lists([s.view(np.int64) for s in found])], names=["own", "node", "hashes"])

    sets = _texts(nodes, docs).mapInArrow(of, "own long, node long, hashes array<long>")
    return cut(sets.where("own = node").select("node", "hashes").dropDuplicates(["node"]))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Odd sketch: whether an odd number of the set's hashes falls on each bit, as signed 64-bit words."""
    at = ((hashes >> np.uint64(17)) % np.uint64(64 * MAP)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * MAP) & 1 == 1, bitorder="little").view(np.int64)


def _mapped(keys: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """``keys`` with the bitmaps m0, m1, ... of their nodes' sets, their crowded keys, and how many rows these have."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([node(s) for s in found], pa.int64()), batch.column(0), _lists([bitmap(s) for s in found])], names=["own", "node", "map"])

    nodes = keys.groupBy("node").agg(F.sum("n").alias("central"), F.collect_list("key").alias("crowds"))
    nodes = cut(nodes.join(reps.select("node", "rep"), "node"))
    keys = keys.join(nodes.drop("rep"), "node")
    maps = _texts(nodes, docs).mapInArrow(of, "own long, node long, map array<long>")
    maps = maps.where("own = node").dropDuplicates(["node"]).select("node", *[F.col("map")[i].alias(f"m{i}") for i in range(MAP)])
    return cut(keys.join(maps, "node"))


def near_prints(reps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of nodes by near fingerprints: the least node of each fingerprint with the others that have
    it, and with the least ones of the fingerprints that Golay keys find within two bits."""
    fps = cut(reps.where("size > 0").groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    same = reps.join(fps.where("n > 1"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = fingerprint_links(fps.select("fp")).join(fps.select(F.col("fp").alias("fp_a"), F.col("first").alias("a")), "fp_a").join(
        fps.select(F.col("fp").alias("fp_b"), F.col("first").alias("b")), "fp_b")
    return same.unionByName(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def links(docs: DataFrame, sketches: DataFrame, dense: int = DENSE) -> DataFrame:
    """Pairs ``(a, b)`` of nodes whose components are those of "similarity is SIMILARITY or more"."""
    reps = cut(sketches.groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("size", "fp", "bands")]))
    keys = reps.select("node", "size", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keys = cut(keys.join(shared, "key"))
    few, many = keys.where(F.col("n") <= dense), keys.where(F.col("n") > dense)
    first = _pairs(few, few, "l.node < r.node").unionByName(near_prints(reps)).distinct()
    if many.isEmpty():
        return _alike(first, docs, reps)
    many = _mapped(many, reps, docs)
    found = _alike(first.unionByName(_pairs(many, _central(many), "l.node <> r.node", True)).distinct(), docs, reps)
    before = None
    while True:
        left, kinds = _open(many, found)
        rest = left.where("own <> main")
        if not kinds or before and kinds > SHRINK * before:
            break
        before = kinds
        found = cut(found.unionByName(_alike(_pairs(left, _central(rest), "l.own <> r.own", True), docs, reps)))
    if not kinds:
        return found
    return found.unionByName(_alike(_pairs(rest, left, "l.own <> r.own and (r.own = r.main or l.node < r.node)", True, True), docs, reps))


def _central(many: DataFrame) -> DataFrame:
    """The most central member of each band."""
    return cut(many.groupBy("key").agg(F.max_by(F.struct(*[c for c in many.columns if c != "key"]), F.struct("central", "node")).alias("p")).select("key", "p.*"))


def _open(many: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """The rows of bands whose members are not all linked, with their components and the band's largest one, and the number
    of further components in all bands."""
    known = connected_components(found)
    many = many.join(known, "node", "left").withColumn("own", F.coalesce("component", "node")).drop("component")
    most = many.groupBy("key", "own").count().groupBy("key").agg(F.max_by("own", F.struct("count", "own")).alias("main"), F.count("*").alias("kinds"))
    most = cut(most.where("kinds > 1"))
    return cut(many.join(most, "key")), most.agg(F.sum(F.col("kinds") - 1)).first()[0] or 0


def first_of_each(docs: DataFrame, rows: DataFrame, edges: DataFrame, named: Column) -> DataFrame:
    """Of each component of ``rows(doc_id, node)`` under ``edges(a, b)`` the row of ``docs`` with the smallest doc_id.

    named: the node of a row of ``docs``, only worked out where ids repeat. Rows without doc_id stay.
    """
    components = connected_components(edges)
    least = rows.groupBy("node").agg(F.min("doc_id").alias("id")).join(components, "node", "left")
    kept = cut(least.groupBy(F.coalesce("component", "node").alias("c")).agg(F.min(F.struct("id", "node")).alias("k")).select(
        F.col("k.id").alias("kept_id"), F.col("k.node").alias("kept_node")))
    twice = cut(rows.groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("n")).where("n > 1").select("kept_id"))
    none = docs.where("doc_id is null")
    if twice.isEmpty():
        return docs.join(kept.select("kept_id"), docs["doc_id"] == F.col("kept_id"), "left_semi").unionByName(none)
    once = kept.join(twice, "kept_id", "left_anti").select("kept_id")
    stay = docs.join(once, docs["doc_id"] == F.col("kept_id"), "left_semi").unionByName(none)
    again = docs.join(twice, docs["doc_id"] == F.col("kept_id"), "left_semi").withColumn("_node", named)
    again = again.join(kept, (again["doc_id"] == F.col("kept_id")) & (F.col("_node") == F.col("kept_node")), "left_semi")
    return stay.unionByName(again.dropDuplicates(["doc_id", "_node"]).drop("_node"))


def keep_one(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were."""
    small_batches(docs.sparkSession)
    sketches = cut(_sketches(docs))
    return first_of_each(docs, sketches.select("doc_id", "node"), links(docs, sketches, dense), _nodes(F.col("text")))
