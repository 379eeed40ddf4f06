"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut at every 1,024th; the rest of it is cut into pieces of at most 256. The pieces of some hundreds of
documents are parted into the smallest number of windows that could hold them by the largest differencing method: two
partial partitions with the largest spreads are merged so that their imbalances oppose each other. As long as the fullest
window exceeds the capacity, their number rises by one. Windows come out near equal, so nearly all padding is the rounding
of their number.

Everything happens in one pass over the documents of a partition: no shuffle, and memory for one group of pieces.
Sequence ids hold the partition's number, so they are unique, and a part that is made again gets the same ones.

Nulls and edges: a null or empty text is one piece, the end id; a row without doc_id is packed with a null doc_id; repeated
ids are packed each; special tokens' strings are ordinary text; a very long text is encoded whole, in one task; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, table

CAPACITY = 1024
#: Longest piece of a document's rest, and documents whose rests are packed together.
PIECE, GROUP = 256, 512
TOKENIZER = "byte_bpe_50k.json"
#: Words whose ids a worker remembers, and the letters of the longest one that it does.
REMEMBERED, LETTERS = 400_000, 64
_RUN = re.compile(r"\s\s")
#: How a byte-level vocabulary writes a space.
SPACE = "\u0120"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Words(dict):
    """Ids of words with the space before them, for at most REMEMBERED words in two generations.

    When this one has half of them it becomes the old one, and a word that the old one knows moves on as it is met again: so
    frequent words are encoded once, only rare ones are forgotten. New words are encoded many as one text, in which each
    word's first id is the only one that begins with a space; a word may hold other white space inside.
    """

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.old: dict[str, bytes] = {}
        vocabulary = tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True

    def of(self, words: list[str]) -> list[bytes]:
        """The ids of each of some different words."""
        ids = list(map(self.get, words))
        gaps = [at for at, i in enumerate(ids) if i is None]
        found = self._met([words[at] for at in gaps])
        for at in gaps:
            ids[at] = found[words[at]]
        return ids

    def _met(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that this generation lacks, which it learns."""
        old = self.old
        found = {w: old[w] for w in words if w in old}
        new = [w for w in words if w not in found and 0 < len(w) <= LETTERS and w == w.strip()]
        ids = _ids(self.tokenizer, "".join(" " + w for w in new))
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) == len(new):
            raw, bounds = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            found.update((w, raw[a:b]) for w, a, b in zip(new, bounds, bounds[1:], strict=False))
        half = REMEMBERED // 2
        if len(self) + len(found) > half:
            self.old = dict(self)
            self.clear()
        self.update(found if len(found) <= half else islice(found.items(), half))
        found.update((w, _ids(self.tokenizer, " " + w).tobytes()) for w in words if w not in found)
        return found


def _ids(tokenizer, text: str) -> np.ndarray:
    """Ids alone: without the offsets that take ``encode`` as long again."""
    return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")


class Encoder:
    """Ids (little-endian unsigned 32-bit) of texts by a ``tokenizers`` file.

    The usual byte-level pre-tokenizer never joins a word to the space after it. A text whose white space comes one character at
    a time is thus the same as its first word and, one after the other, its further words with the spaces before them, whose
    ids are remembered. Texts with longer white space, and those for any other file, are encoded whole.
    """

    def __init__(self, path: str | None = None) -> None:
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        kind, after = spec["pre_tokenizer"] or {}, spec["post_processor"] or {"type": "ByteLevel"}
        by_word = not spec["normalizer"] and after["type"] == "ByteLevel" and all(kind.get(k) == v for k, v in usual.items()) and all(t["special"] for t in spec["added_tokens"])
        self.words = _Words(self.tokenizer) if by_word else None

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.words is None:
            return list(map(self.whole, texts))
        plain = [not _RUN.search(t) for t in texts]
        further = iter(self._further([t for t, p in zip(texts, plain, strict=True) if p]))
        return [self.whole(t.split(" ", 1)[0]) + next(further) if p else self.whole(t) for t, p in zip(texts, plain, strict=True)]

    def _further(self, texts: list[str]) -> list[bytes]:
        """The ids of all words of each text but its first. Python sees each different word of the texts once."""
        parted = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = parted.offsets.to_numpy().astype(np.int64)
        later = np.ones(bounds[-1], dtype=bool)
        later[bounds[:-1]] = False
        words = parted.flatten().filter(pa.array(later)).dictionary_encode()
        which = words.indices.to_numpy()
        ids = self.words.of(words.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts, each = lengths.cumsum() - lengths, lengths[which]
        ends = np.concatenate(([0], each.cumsum()))
        places = np.repeat(starts[which] - ends[:-1], each) + np.arange(ends[-1])
        flat, ends = np.frombuffer(b"".join(ids), dtype="<u4")[places], ends[bounds - np.arange(len(bounds))]
        return [flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]

    def whole(self, text: str) -> bytes:
        return _ids(self.tokenizer, text).tobytes()


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: positions in ``sizes`` by window. A partial partition lists its filled windows, fullest first."""
    if not sizes:
        return []
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)] if windows > 1 else [(0, 0, [])]
    if windows == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = len(a) + len(b) - windows
        if both <= 0:
            merged = list(heapq.merge(a, b, key=lambda x: -x[0]))
        else:  # the emptiest windows of the one meet those of the other, least with largest
            tail = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - both :], reversed(b[len(b) - both :]), strict=True)]
            merged = sorted([*a[: len(a) - both], *b[: len(b) - both], *tail], key=lambda x: -x[0])
        count += 1
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, count, merged))
    out = []
    for _, tree in heap[0][2]:
        items, todo = [], [tree]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += node
            else:
                items.append(node)
        out.append(items)
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their number rises while the fullest exceeds it."""
    n = -(-sum(sizes) // capacity)
    while True:
        parted = difference(sizes, n)
        if all(sum(sizes[i] for i in w) <= capacity for w in parted):
            return parted
        n += 1


def pieces(ids: bytes, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces: whole windows, then its rest in short ones."""
    n = len(ids) // 4
    full = n - n % capacity
    starts = [*range(0, full, capacity), *range(full, n, piece)]
    ends = [*starts[1:], n]
    return [(s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for s, e in zip(starts, ends, strict=True)]


def pack(docs: DataFrame, tokenizer_file: str | None = None, capacity: int = CAPACITY, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in sequences of at most ``capacity`` ids."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer_file).encode, TaskContext.get().partitionId()
        number, rests, waiting = task << 32, [], 0

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        def packed() -> list[tuple]:
            nonlocal number
            rows = []
            for window in windows([r[2] for r in rests], capacity):
                offset = 0
                for i in sorted(window):
                    rows.append((*rests[i], number, offset))
                    offset += rests[i][2]
                number += 1
            rests.clear()
            return rows

        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                for start, length, crc in pieces(ids, capacity):
                    if length == capacity:
                        rows.append((doc_id, start, length, crc, n, number, 0))
                        number += 1
                    else:
                        rests.append((doc_id, start, length, crc, n))
                waiting += 1
                if waiting >= group:
                    rows += packed()
                    waiting = 0
            yield emit(rows)
        if rests:
            yield emit(packed())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, SCHEMA)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
