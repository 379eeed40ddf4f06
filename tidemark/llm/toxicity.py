"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary documents, spell out each word: they give a letter's likelihood after the four before
it (a word begins and ends at a boundary). Both discount their counts and back off to one interpolated Kneser-Ney model of
all documents. A class's count of a sequence is only kept where it exceeds what the shared model expects in that class by
a margin and some standard errors; the mass of all others goes to the shared model. So rare expressions are as likely in
both models as the shared counts have it, and ordinary words weigh next to nothing however long a text is.

A text's score is its log-likelihood under the toxic model less that under the ordinary one, each over all its letters and
divided by their number, calibrated to a probability.

The shared counts are of all documents, labelled or not, and are summed up where the data is; only those that the sample's
sequences need are fetched. The classes' counts are fitted on a bounded sample: of each class at most ``FIT_ROWS`` labelled
documents with the smallest hashed ids, out of three of the five folds; ``CALIBRATION_ROWS`` from a fourth fold calibrate
the score. The fifth fold is never learned from; the constants below were chosen on the other four (``toxicity_choice``).
A document counts a word once, so that repeated lines do not pass for usage. The broadcast model is bounded by the sample's
distinct five-letter sequences: one that no class has seen is as likely in both models but for their backoff weights.

Nulls and edges: a null text is an empty one, and a text without words gets the score of no evidence. A very long text is
read whole; a task holds one batch of texts, its words, and the counts of at most ``COUNTED`` words and one text's. Rows without
doc_id are scored and not held out. Without any usable labels, or with one class only, every score is the label's base
rate (0 if there are none). An id labelled twice counts with its largest label; an empty table gives no rows. Labels,
lang, source and doc_id are no inputs of a score; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import logit
from tidemark.llm.common import cut, held_out, labelled, sample_ids, small_batches, table

FIT_ROWS, CALIBRATION_ROWS = 6000, 3000
#: Letters of the longest sequences.
ORDER = 5
#: A letter's bits in a sequence's key. Code points are told apart modulo 4,094; 1 is the boundary, 0 none.
BITS = 12
_LETTERS = (1 << BITS) - 2
#: Discounts of a class's counts and of the shared ones.
DISCOUNT, SHARED_DISCOUNT = 0.75, 0.75
#: What a class's count must exceed its expectation by: a share of it, its standard errors, and a number.
MARGIN, ERRORS, LEAST = 0.2, 2.0, 3.0
#: Evidence a letter is multiplied with this before calibration.
SCALE = 1000.0
#: Distinct words that a worker counts before it passes their sequences on.
COUNTED = 200_000
#: Words whose ratio a worker remembers.
REMEMBERED = 400_000
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def keys_of(found: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the sequences of ``order`` letters that end at each letter and at the boundary after each word, word
    after word, and where each word's begin."""
    pad = "\1" * (order - 1)
    padded = "".join(f"{pad}{w}\1" for w in found)
    letters = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letters = np.where(letters == 1, 1, 2 + letters % _LETTERS)
    keys = np.zeros(len(letters), dtype=np.int64)
    for back in range(order):
        keys[back:] |= letters[: len(letters) - back] << BITS * back
    lengths = np.array([len(w) + 1 for w in found], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    given = np.arange(len(found)) * (order - 1) + starts  # the boundaries before a word are given
    keep = np.ones(len(letters), dtype=bool)
    for i in range(order - 1):
        keep[given + i] = False
    return keys[keep], starts


def sums(found: dict[str, int], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the words' sequences and how often they come, each word as often as ``found`` says."""
    keys, _ = keys_of(list(found), order)
    times = np.repeat(np.fromiter(found.values(), dtype=np.int64, count=len(found)), [len(w) + 1 for w in found])
    own, at = np.unique(keys, return_inverse=True)
    return own, np.bincount(at, times, minlength=len(own)).astype(np.int64)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


@dataclass
class Model:
    """Sorted keys and log ratios of the sequences seen, and of the histories' backoff weights. beta: the calibration."""

    grams: tuple[np.ndarray, np.ndarray] | None
    backs: tuple[np.ndarray, np.ndarray] | None
    beta: np.ndarray
    known: dict[str, float] = field(default_factory=dict)

    def word_ratios(self, found: list[str]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each word's spelling."""
        if not found:
            return np.zeros(0)
        keys, starts = keys_of(found)
        total = np.zeros(len(keys))
        hit, place = _found(self.grams[0], keys)
        total[hit] = self.grams[1][place[hit]]
        rest = np.nonzero(~hit)[0]
        hit, place = _found(self.backs[0], keys[rest] >> BITS)
        total[rest[hit]] = self.backs[1][place[hit]]
        return np.add.reduceat(total, starts)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each whole text, divided by its letters."""
        if self.grams is None:
            return np.zeros(len(texts))
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = words(text)
            if new := list({w for w in found if w not in self.known}):
                self.known.update(zip(new, self.word_ratios(new).tolist(), strict=True))
            if found:
                out[i] = sum(map(self.known.__getitem__, found)) / (sum(map(len, found)) + len(found))
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        return np.arcsinh(SCALE * self.evidence(texts))[:, None]

    def score(self, texts: list[str | None]) -> np.ndarray:
        return logit.probability(logit.value(self.features(texts), self.beta))


def sequences(rows: DataFrame) -> DataFrame:
    """Rows ``(gram, n0, n1)``: sequences of ORDER letters in the words of ``rows(y, text)``, by class y; a document counts
    a word once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())

        def passed() -> Iterator[pa.RecordBatch]:
            for y in (0, 1):
                if found[y]:
                    keys, n = sums(found[y])
                    none = np.zeros_like(n)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(x) for x in ((none, n) if y else (n, none)))], names=["gram", "n0", "n1"])
                    found[y].clear()

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[y].update(set(words(text)))
                if len(found[y]) > COUNTED:
                    yield from passed()
        yield from passed()

    counted = rows.select(F.col("y").cast("int").alias("y"), F.col("text").cast("string").alias("text")).mapInArrow(count, "gram long, n0 long, n1 long")
    return counted.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def shared_levels(counts: DataFrame, wanted: DataFrame) -> list[pd.DataFrame]:
    """For the ``wanted(gram)`` and their endings down to one letter ``(n, total, kinds)`` by gram, the longest first: its
    count, that of its history, and how many letters follow the history. Counts are of all of ``counts(gram, n)``; those of
    endings are continuation counts, the number of letters that come before them."""
    out, counts = [], cut(counts)
    for order in range(ORDER, 0, -1):  # wanted is bounded by the sample
        history, ending = F.shiftright("gram", BITS), F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))
        totals = counts.groupBy(history.alias("history")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        own = counts.join(F.broadcast(wanted), "gram").select("gram", "n", history.alias("history"))
        out.append(totals.join(F.broadcast(own), "history").select("gram", "n", "total", "kinds").toPandas().set_index("gram"))
        counts = counts.groupBy(ending.alias("gram")).agg(F.count("*").alias("n"))
        wanted = wanted.select(ending.alias("gram")).distinct()
    return out


def local_levels(grams: np.ndarray, n: np.ndarray, order: int = ORDER) -> list[pd.DataFrame]:
    """What ``shared_levels`` gives of counts that are at hand."""
    out, level = [], pd.Series(n, index=grams)
    for k in range(order, 0, -1):
        at, _ = pd.factorize(level.index.to_numpy() >> BITS)
        n = level.to_numpy(dtype=float)
        out.append(pd.DataFrame({"n": n, "total": np.bincount(at, n)[at], "kinds": np.bincount(at)[at]}, index=level.index))
        level = pd.Series(1, index=level.index.to_numpy() & (1 << BITS * (k - 1)) - 1).groupby(level=0, sort=False).sum()
    return out


def interpolated(levels: list[pd.DataFrame]) -> pd.Series:
    """Kneser-Ney likelihoods of the first of ``levels``; below single letters all are as likely."""
    below = None
    for k, level in enumerate(reversed(levels)):
        n, total, kinds = (level[c].to_numpy(dtype=float) for c in ("n", "total", "kinds"))
        shorter = 1 / (1 << BITS) if below is None else below.reindex(level.index.to_numpy() & (1 << BITS * k) - 1).to_numpy()
        below = pd.Series((n - SHARED_DISCOUNT + SHARED_DISCOUNT * kinds * shorter) / total, index=level.index)
    return below


def smooth(grams: pd.DataFrame, shared: pd.Series) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Log ratios of the classes' likelihoods, and of their backoff weights, from ``(gram, n0, n1)`` and the shared
    likelihoods."""
    grams = grams.sort_values("gram")
    keys, below = grams["gram"].to_numpy(), shared.reindex(grams["gram"]).to_numpy()
    at, histories = pd.factorize(keys >> BITS)  # in the order of the keys, so sorted too
    p, back = [], []
    for n in (grams["n0"].to_numpy(dtype=float), grams["n1"].to_numpy(dtype=float)):
        total = np.bincount(at, n)
        expected = total[at] * below
        own = n > expected * (1 + MARGIN) + ERRORS * np.sqrt(expected) + LEAST
        kept = np.where(own, n - DISCOUNT, 0)
        left = np.where(total > 0, 1 - np.bincount(at, kept) / np.maximum(total, 1), 1.0)
        p.append(kept / np.maximum(total, 1)[at] + left[at] * below)
        back.append(left)
    return (keys, np.log(p[1] / p[0])), (histories, np.log(np.maximum(back[1], 1e-9) / np.maximum(back[0], 1e-9)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    small_batches(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = cut(labelled(docs, labels, "toxic", ~held_out(F.col("doc_id"))).where("y in (0, 1)"))
    known = {int(r["y"]): r["count"] for r in rows.groupBy("y").count().collect()}
    base = known.get(1, 0) / max(1, sum(known.values()))
    nothing = Model(None, None, np.array([0.0, np.log(max(base, 1e-9) / max(1 - base, 1e-9))]))
    if len(known) < 2:
        return nothing
    picked = sample_ids(rows.where(fold != 1), fit_rows).withColumn("part", F.lit(0)).unionByName(
        sample_ids(rows.where(fold == 1), calibration_rows).withColumn("part", F.lit(1)))
    picked = picked.select(F.col("doc_id").alias("picked_id"), "y", "part")
    # Bounded: at most twice fit_rows + calibration_rows ids.
    sample = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(cut(picked)), F.col("doc_id") == F.col("picked_id")).select("y", "part", "text"))
    own = cut(sequences(sample.where("part = 0")))
    grams = own.toPandas()
    if not len(grams):
        return nothing
    shared = interpolated(shared_levels(sequences(docs.select(F.lit(0).alias("y"), "text")).select("gram", F.col("n0").alias("n")), own.select("gram")))
    model = Model(*smooth(grams, shared), np.zeros(2))
    return _calibrated(model, sample.where("part = 1"), known)


def _calibrated(model: Model, sample: DataFrame, known: dict[int, int]) -> Model:
    """Logistic regression on the calibration sample, whose classes weigh as they do among all labelled rows."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(sent.value.features(texts.tolist())))

    rows = sample.select("y", of("text").alias("x")).toPandas()
    if rows["y"].nunique() < 2:
        rows = pd.DataFrame({"y": [0, 1], "x": [[0.0], [2.0]]})
    y = rows["y"].to_numpy()
    weight = np.where(y == 1, known[1] / max(1, (y == 1).sum()), known[0] / max(1, (y == 0).sum()))
    x = np.array(rows["x"].tolist())
    scale = np.maximum(x.std(axis=0), 1e-9)
    beta = logit.fit(x / scale, y, weight * len(y) / weight.sum())
    model.beta = np.concatenate([beta[:-1] / scale, beta[-1:]])
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``toxic_score``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(sent.value.score([t if isinstance(t, str) else None for t in texts]))

    return docs.withColumn("toxic_score", of(F.col("text").cast("string")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``(doc_id, held_out, score, predicted)``, one for each row of ``docs(doc_id, text)``."""
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"),
                       (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted to be toxic."""
    return scored(docs, fit(docs, labels)).where("toxic_score < 0.5").select(*docs.columns)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
