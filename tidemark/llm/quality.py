"""Quality classifier by co-training.

Two views of a document: its text (hashed words, and shares of letters, capitals, digits, symbols, repeated words, lines and
so on), and its page metadata (language, source, declared length, lines). A logistic classifier is fitted on each view of a
labelled sample. Over some rounds each gives the unlabelled documents it is surest of, as many of a class as its share, as
pseudo-labelled examples to the other. In the end both are calibrated on a fold of their own and combined, and all
documents are scored.

Every unlabelled document is judged by both views in every round, where it is: the views' features are worked out once, and
a round is a pass over them that leaves each task's surest ones. Bounds, all parameters: ``FIT_ROWS`` labelled documents of
each class, ``CALIBRATION_ROWS`` of each for calibration, those with the smallest hashed ids, and ``PER_ROUND``, the examples
that a view gives in a round (and no more than a tenth of the labelled sample, so that labels outweigh them). Rows whose crc32(doc_id) divides by 5 are held out from all of them.

Nulls and edges: null text, lang, source or n_chars are values of their own (an empty text, an empty name, length 0);
rows without doc_id are scored and not held out. Without labels of both classes every score is the base rate (1 if there
are no labels, so that nothing is rejected unjudged). Of equally sure documents those with the smaller hashed id are given.
Repeated rows are scored each; whole texts are read, a very long one as one row; an empty table gives no rows; columns with
clashing names are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import logit
from tidemark.llm.common import cut, held_out, labelled, sample_ids, small_batches, table

FIT_ROWS, CALIBRATION_ROWS = 5000, 2000
ROUNDS, PER_ROUND, SURE = 4, 300, 0.9
#: Examples of a round as a share of the labelled sample, at most; weight of one.
GROWTH, GIVEN = 0.1, 0.5
BINS = 12
#: Measured features of the text, those of the metadata, and buckets of hashed words.
TEXT, META, WORDS = 14, 4, 256
_NAMES = 16


def text_features(text: str | None) -> tuple[list[float], np.ndarray]:
    """Measures of a text, and by bucket the root of its words' share, in 255ths."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    bytes_ = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digits = bytes_[65:91].sum(), bytes_[97:123].sum(), bytes_[48:58].sum()
    high = bytes_[128:].sum()
    space = bytes_[32] + bytes_[9:14].sum()
    words = raw.split()
    found = Counter(words)
    k = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    symbols = n - upper - lower - digits - high - space
    plain = bytes_[46] + bytes_[44]
    measures = [
        (upper + lower + high) / n, upper / max(1, upper + lower), digits / n, (symbols - plain) / n, plain / k, bytes_[124] / k, bytes_[33] / k,
        (n - space) / k, len(found) / k ** 0.75, sum(map(eq, words, words[1:])) / k, len(set(zip(words, words[1:], strict=False))) / k,
        len(set(lines)) / max(1, len(lines)), np.log1p(k), (bytes_[35] + bytes_[36] + bytes_[37] + bytes_[38] + bytes_[42]) / k,
    ]
    buckets = np.fromiter(map(zlib.crc32, found), dtype=np.int64, count=len(found)) % WORDS
    shares = np.bincount(buckets, np.fromiter(found.values(), dtype=float, count=len(found)), minlength=WORDS) / k
    return measures, np.rint(255 * np.sqrt(shares)).astype(np.uint8)


def meta_features(lang: str | None, source: str | None, n_chars: float, lines: float) -> list[float]:
    def name(x: str | None) -> float:
        return float(zlib.crc32((x or "").encode()) % _NAMES)

    return [name(lang), name(source), np.log1p(max(0.0, n_chars)), np.log1p(max(0.0, n_chars) / max(1.0, lines))]


def _columns(docs: DataFrame) -> list[Column]:
    text = F.col("text").cast("string")
    return [text.alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
            F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)).alias("n_chars"),
            F.coalesce(F.length(text) - F.length(F.translate(text, "\n", "")) + 1, F.lit(0)).cast("double").alias("n_lines")]


def features(batch: pd.DataFrame) -> np.ndarray:
    """Both views of a batch of (text, lang, source, n_chars, n_lines): the text's measures, the metadata, the words."""
    out = np.zeros((len(batch), TEXT + META + WORDS), dtype=np.float32)
    for i, (t, a, b, c, d) in enumerate(zip(batch["text"], batch["lang"], batch["source"], batch["n_chars"], batch["n_lines"], strict=True)):
        measures, words = text_features(t if isinstance(t, str) else None)
        out[i, :TEXT] = measures
        out[i, TEXT : TEXT + META] = meta_features(a if isinstance(a, str) else None, b if isinstance(b, str) else None, c, d)
        out[i, TEXT + META :] = words
    return out


def _packed(x: np.ndarray) -> tuple[list, list[bytes]]:
    return list(x[:, : TEXT + META]), [w.tobytes() for w in x[:, TEXT + META :].astype(np.uint8)]


def _unpacked(batch: pd.DataFrame) -> np.ndarray:
    if not len(batch):
        return np.zeros((0, TEXT + META + WORDS), dtype=np.float32)
    words = np.frombuffer(b"".join(batch["w"]), dtype=np.uint8).reshape(len(batch), WORDS)
    return np.hstack([np.array(batch["x"].tolist(), dtype=np.float32), words.astype(np.float32)])


@dataclass
class View:
    """One classifier: each measure is cut into bins at the sample's quantiles, and a bin has a weight, as has each bucket."""

    edges: list[np.ndarray]
    beta: np.ndarray

    @staticmethod
    def bins(x: np.ndarray) -> list[np.ndarray]:
        return [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)).astype(np.float32) for c in x.T]

    def _places(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        start = 0
        for c, e in zip(x.T, self.edges, strict=False):
            yield start, np.searchsorted(e, c, side="right"), len(e) + 1
            start += len(e) + 1

    def design(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for _, place, size in self._places(x):
            one = np.zeros((len(x), size))
            one[np.arange(len(x)), place] = 1.0
            parts.append(one)
        return np.hstack([*parts, x[:, len(self.edges) :] / 255])

    def value(self, x: np.ndarray) -> np.ndarray:
        out, end = np.full(len(x), self.beta[-1]), 0
        for start, place, size in self._places(x):
            out += self.beta[start + place]
            end = start + size
        return out + x[:, len(self.edges) :] @ (self.beta[end:-1] / 255)


@dataclass
class Model:
    views: list[View]
    beta: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.views:
            return np.full(len(x), logit.probability(self.beta[-1:])[0])
        return logit.probability(logit.value(self.calibrated(x), self.beta))

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip(v.value(part), -12, 12) for v, part in zip(self.views, split(x), strict=True)])


def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's view, words last, and the metadata's."""
    return np.hstack([x[:, :TEXT], x[:, TEXT + META :]]), x[:, TEXT : TEXT + META]


#: What a view gives: from both views and by view the ids given to it so far, the ids, features and labels of its examples.
Pick = Callable[[list[View], list[set[int]]], list[tuple[list[int], np.ndarray, np.ndarray]]]


def co_train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pick: Pick | None, rounds: int = ROUNDS) -> list[View]:
    """Both views' classifiers after ``rounds`` of exchanging pseudo-labels."""
    parts = split(x)
    edges = [View.bins(parts[0][:, :TEXT]), View.bins(parts[1])]
    ids: list[set[int]] = [set(), set()]
    given = [(np.zeros((0, x.shape[1]), dtype=np.float32), np.zeros(0)) for _ in (0, 1)]
    views: list[View] = []

    def fitted(v: int) -> View:
        view = View(edges[v], views[v].beta if views else np.zeros(0))
        design = view.design(np.vstack([parts[v], split(given[v][0])[v]]))
        view.beta = logit.fit(design, np.concatenate([y, given[v][1]]), np.concatenate([weight, np.full(len(given[v][1]), GIVEN)]), start=view.beta if len(view.beta) else None)
        return view

    views = [fitted(0), fitted(1)]
    for _ in range(rounds if pick else 0):
        for v, (own, rows, marks) in enumerate(pick(views, ids)):
            ids[1 - v] |= set(own)
            given[1 - v] = np.vstack([given[1 - v][0], rows]), np.concatenate([given[1 - v][1], marks])
        views = [fitted(0), fitted(1)]
    return views


def surest(views: list[View], x: np.ndarray, ids: np.ndarray, order: np.ndarray, known: list[set[int]], share: float, per_round: int, sure: float) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
    """(view, label, rows, probabilities of the label) of the rows that a view gives next: the surest, ties by ``order``."""
    for v, part in enumerate(split(x)):
        p = logit.probability(views[v].value(part))
        new = ~np.isin(ids, list(known[1 - v])) if known[1 - v] else np.ones(len(ids), dtype=bool)
        for mark, certain, of in ((1.0, p, share), (0.0, 1 - p, 1 - share)):
            rows = np.nonzero(new & (certain >= sure))[0]
            rows = rows[np.lexsort((order[rows], -certain[rows]))][: int(np.ceil(per_round * of))]
            yield v, mark, rows, certain[rows]


def pick_from(pool: DataFrame, share: float, per_round: int = PER_ROUND, sure: float = SURE) -> Pick:
    """Picks from all of ``pool(doc_id, x, w)``: each task leaves its surest rows, and of those the surest are taken."""
    def pick(views: list[View], given: list[set[int]]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        sent = pool.sparkSession.sparkContext.broadcast((views, given))

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, taken = sent.value
            best: dict[tuple[int, float], pd.DataFrame] = {}
            for batch in batches:
                x = _unpacked(batch)
                for v, mark, rows, p in surest(own, x, batch["doc_id"].to_numpy(), batch["h"].to_numpy(), taken, share, per_round, sure):
                    if len(rows):
                        some = batch.iloc[rows].assign(view=v, mark=mark, p=p)
                        some = pd.concat([best[v, mark], some]) if (v, mark) in best else some
                        best[v, mark] = some.sort_values(["p", "h", "doc_id"], ascending=[False, True, True]).head(int(np.ceil(per_round * (share if mark else 1 - share))))
            yield from best.values()

        found = pool.select("doc_id", "h", "x", "w").mapInPandas(of, "doc_id long, h long, x array<float>, w binary, view long, mark double, p double")
        place = F.row_number().over(Window.partitionBy("view", "mark").orderBy(F.desc("p"), "h", "doc_id"))
        most = {mark: int(np.ceil(per_round * part)) for mark, part in ((1.0, share), (0.0, 1 - share))}
        best = found.withColumn("place", place).where(F.col("place") <= F.when(F.col("mark") == 1, most[1.0]).otherwise(most[0.0])).where(F.col("place") <= max(most.values()))
        best = best.toPandas().sort_values(["view", "mark", "place"], ascending=[True, False, True])  # at most twice per_round rows
        own = [best[best["view"] == v] for v in (0, 1)]
        return [(x["doc_id"].tolist(), _unpacked(x), x["mark"].to_numpy(dtype=float)) for x in own]

    return pick


def seen(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, x, w)``: the features of every row of ``docs``."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, w = _packed(features(batch.to_pandas()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32())), pa.array(w, pa.binary())], names=["doc_id", "x", "w"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_columns(docs)).mapInArrow(of, "doc_id long, x array<float>, w binary")


def known(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``seen(docs)``, written once, with ``y``, the label of the rows that may be learned from, and null for all others."""
    marks = labelled(docs, labels, "quality", ~held_out(F.col("doc_id"))).where("y in (0, 1)")
    return cut(seen(docs).join(marks, "doc_id", "left"))


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS, per_round: int = PER_ROUND) -> Model:
    """The model of ``rows``, which ``known`` made."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    marks = rows.where("y is not null").select("doc_id", "y").distinct()
    count = {int(r["y"]): r["count"] for r in marks.groupBy("y").count().collect()}
    base = count.get(1, 0) / sum(count.values()) if count else 1.0
    nothing = Model([], np.array([np.log(max(base, 1e-9) / max(1 - base, 1e-9))]))
    if len(count) < 2:
        return nothing
    picked = sample_ids(marks.where(fold != 1), fit_rows).withColumn("part", F.lit(0)).unionByName(
        sample_ids(marks.where(fold == 1), calibration_rows).withColumn("part", F.lit(1)))
    # Bounded: at most twice fit_rows + calibration_rows ids.
    found = rows.drop("y").join(F.broadcast(picked), "doc_id").toPandas().sort_values("doc_id", kind="stable")
    x, y, part = _unpacked(found), found["y"].to_numpy(dtype=float), found["part"].to_numpy()

    def weights(which: np.ndarray) -> np.ndarray:
        own = y[which]
        raw = np.where(own == 1, count.get(1, 0) / max(1, (own == 1).sum()), count.get(0, 0) / max(1, (own == 0).sum()))
        return raw * len(own) / max(raw.sum(), 1e-9)

    first, second = part == 0, part == 1
    if len(set(y[first])) < 2:
        return nothing
    weight = weights(first)
    pool = rows.where(F.col("doc_id").isNotNull() & F.col("y").isNull() & ~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    per_round = min(per_round, int(np.ceil(GROWTH * first.sum())))
    views = co_train(x[first], y[first], weight, pick_from(pool, float((weight * y[first]).sum() / weight.sum()), per_round))
    model = Model(views, np.array([1.0, 0.0, 0.0]))
    if len(set(y[second])) == 2:
        model.beta = logit.fit(model.calibrated(x[second]), y[second], weights(second))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``quality_score``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for text, lang, source, n_chars, n_lines in batches:
            batch = pd.DataFrame({"text": text, "lang": lang, "source": source, "n_chars": n_chars, "n_lines": n_lines})
            yield pd.Series(sent.value.score(features(batch)))

    return docs.withColumn("quality_score", of(*_columns(docs)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``(doc_id, held_out, score, predicted)``: score is the probability of good quality."""
    rows = known(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(fit(rows))

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, w in batches:
            yield pd.Series(sent.value.score(_unpacked(pd.DataFrame({"x": x, "w": w}))))

    found = rows.select("doc_id", of("x", "w").alias("quality_score"))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"),
                        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted to be of low quality."""
    return scored(docs, fit(known(docs, labels))).where("quality_score >= 0.5").select(*docs.columns)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
