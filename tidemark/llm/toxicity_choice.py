"""How the constants of the toxicity models were chosen: ``python -m tidemark.llm.toxicity_choice TABLES``.

Cross-validation on the labelled documents of the folds 1 to 4 (crc32 of the doc_id modulo 5). Those of fold 0 are dropped
before anything else, so that their labels choose nothing. The shared counts are of all texts, which has no labels.
"""

from __future__ import annotations

import itertools
import sys
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from tidemark.llm import toxicity

#: The values that were tried.
GRID = {"MARGIN": (0.2, 0.3, 0.5), "ERRORS": (2.0, 3.0, 4.0), "LEAST": (1.0, 3.0)}
#: Recall is measured where this share of the ordinary documents would be taken for toxic.
FALSE_POSITIVES = 0.005


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def auc(score: np.ndarray, y: np.ndarray) -> float:
    rank, n1 = pd.Series(score).rank().to_numpy(), y.sum()
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)))


def main(tables: str) -> None:
    docs, labels = (pd.read_parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.merge(labels.dropna(subset=["toxic"]), on="doc_id")
    rows = rows.assign(fold=rows["doc_id"].map(fold)).query("fold != 0").reset_index(drop=True)
    y, folds = rows["toxic"].to_numpy(dtype=int), rows["fold"].to_numpy()
    everything, found = Counter(), [Counter(toxicity.words(t)) for t in rows["text"]]
    for text in docs["text"]:
        everything.update(set(toxicity.words(text)))
    shared = toxicity.interpolated(toxicity.local_levels(*toxicity.sums(everything)))
    counted = {}
    for v in (1, 2, 3, 4):
        by_class = (Counter(), Counter())
        for i in np.nonzero(folds != v)[0]:
            by_class[y[i]].update(found[i].keys())
        own = [pd.Series(n, index=keys) for keys, n in map(toxicity.sums, by_class)]
        counted[v] = pd.DataFrame({"n0": own[0], "n1": own[1]}).fillna(0).rename_axis("gram").reset_index()
    for values in itertools.product(*GRID.values()):
        for name, value in zip(GRID, values, strict=True):
            setattr(toxicity, name, value)
        score = np.zeros(len(rows))
        for v, grams in counted.items():
            model = toxicity.Model(*toxicity.smooth(grams, shared), np.zeros(2))
            score[folds == v] = model.evidence(rows["text"][folds == v].tolist())
        limit = np.sort(score[y == 0])[int((1 - FALSE_POSITIVES) * (y == 0).sum())]
        print(dict(zip(GRID, values, strict=True)), f"AUC {auc(score, y):.4f}, recall {(score[y == 1] > limit).mean():.3f}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
