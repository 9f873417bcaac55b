"""Toxicity by a chain of linear classifiers over words and beginnings of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import over_texts, short_batches

WORD = re.compile(r"\w+").findall
BINS = 1 << 22


def word_features(word: str) -> tuple[int, ...]:
    """Bins of a word, and of its first four and five characters where it has more."""
    return tuple(xxhash.xxh32_intdigest(k + word[:n]) % BINS for k, n in (("w", None), ("4", 4), ("5", 5)) if n is None or len(word) > n)


class KnownFeatures(dict):
    """The places of a word's features among known ones; emptied when it holds very many words."""

    def __init__(self, known: np.ndarray):
        super().__init__()
        self.place = {int(b): i for i, b in enumerate(known)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        out = self[word] = tuple(self.place[b] for b in word_features(word) if b in self.place)
        return out


@dataclass
class Linear:
    """A logistic model on which bins a text has and on the chances of earlier categories."""

    bins: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def chance(self, rows: np.ndarray, places: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        z = np.bincount(rows, self.weights[places], n) + self.bias + before @ self.earlier
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _chosen(row: np.ndarray, feature: np.ndarray, y: np.ndarray, most: int, least_z: float) -> np.ndarray:
    """Features whose log odds of the category differ from the rest's by at least least_z deviations, at most so many."""
    size = int(feature.max(initial=-1)) + 1
    p, q = np.bincount(feature[y[row]], minlength=size) + 0.5, np.bincount(feature[~y[row]], minlength=size) + 0.5
    a, b = y.sum() + 1, (~y).sum() + 1
    z = (np.log(p / (a - p)) - np.log(q / (b - q))) / np.sqrt(1 / p + 1 / q + 1 / (a - p) + 1 / (b - q))
    order = np.argsort(-np.abs(z), kind="stable")[:most]
    return np.sort(order[np.abs(z[order]) >= least_z])


def fit_linear(row: np.ndarray, feature: np.ndarray, bins: np.ndarray, y: np.ndarray, before: np.ndarray, *, most: int = 1000, least_z: float = 3.0, ridge: float = 2e-5, turns: int = 150) -> Linear:
    """row, feature: which texts have which features; bins: each feature's bin; before: earlier categories' chances. A category that all texts or none have gets its share as its chance."""
    n, k = len(y), before.shape[1]
    share = (y.sum() + 0.5) / (n + 2)
    if not 0 < y.sum() < n:
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(k), float(np.log(share / (1 - share))))
    chosen = _chosen(row, feature, y, most, least_z)
    place = np.full(int(feature.max(initial=-1)) + 2, -1)
    place[chosen] = np.arange(len(chosen))
    at = place[feature]
    row, at = row[at >= 0], at[at >= 0]
    # steps by the inverse of a bound on each weight's curvature, with momentum
    w, m = np.r_[np.zeros(len(chosen) + k), np.log(share / (1 - share))], np.zeros(len(chosen) + k + 1)
    length = np.bincount(row, minlength=n) + k + 1
    bound = np.r_[np.bincount(at, length[row], len(chosen)), (before.T @ length) + 1e-3, length.sum()] / (4 * n) + ridge
    bound = np.maximum(bound, bound.max() * 1e-4)
    ahead = w.copy()
    for t in range(turns):
        z = np.bincount(row, ahead[:-1][at], n) + before @ ahead[len(chosen) : -1] + ahead[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.r_[np.bincount(at, error[row], len(chosen)), before.T @ error, error.sum()] / n
        slope[:-1] += ridge * ahead[:-1]
        new = ahead - slope / bound
        ahead, w = new + t / (t + 3) * (new - w), new
    return Linear(bins[chosen], w[: len(chosen)], w[len(chosen) : -1], float(w[-1]))


def _known(model: Linear, bins: np.ndarray, row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = {int(b): i for i, b in enumerate(model.bins)}
    at = np.array([place.get(int(b), -1) for b in bins], np.int64)[feature]
    return row[at >= 0], at[at >= 0]


def best_threshold(chance: np.ndarray, y: np.ndarray) -> float:
    """Halfway between two chances of unseen texts, where F1 is greatest; of equal ones the widest gap. A half if all or none are positive."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-chance, kind="stable")
    c, hits = chance[order], np.cumsum(y[order])
    gap = c - np.r_[c[1:], 0]
    f1 = np.where(gap > 0, 2 * hits / (np.arange(1, len(c) + 1) + y.sum()), -1)
    at = np.lexsort((-gap, -np.round(f1, 9)))[0]
    return float(np.clip(c[at] - gap[at] / 2, 0.05, 0.95))


def fit_chain(texts: list[np.ndarray], labels: np.ndarray, folds: int = 3) -> tuple[list[Linear], float]:
    """One model for each column of labels, and a threshold for the last. Later ones learn from chances that models of the other folds gave the earlier categories."""
    n = len(texts)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in texts])
    feature = np.concatenate(texts) if n else np.zeros(0, np.int32)
    often = np.bincount(feature, minlength=BINS) >= 3
    row, feature = row[often[feature]], feature[often[feature]]
    bins, feature = np.flatnonzero(often), (np.cumsum(often, dtype=np.int32) - 1)[feature]
    fold = np.arange(n) % folds
    before, chain = np.zeros((n, 0)), []
    for y in labels.T:
        chain.append(fit_linear(row, feature, bins, y, before))
        unseen = np.zeros(n)
        for f in range(folds):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(inside) and len(outside):
                number = np.zeros(n, np.int64)
                number[inside] = np.arange(len(inside))
                use = fold[row] != f
                model = fit_linear(number[row[use]], feature[use], bins, y[inside], before[inside])
                r, at = _known(model, bins, row[~use], feature[~use])
                unseen[outside] = model.chance(r, at, n, before)[outside]
        before = np.c_[before, unseen]
    return chain, best_threshold(before[:, -1], labels[:, -1])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(np.array([b for w in set(WORD((t.as_py() or "").lower())) for b in word_features(w)], np.int32)).tobytes() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[1:]], ["found", *batch.schema.names[1:]])


def learn_chain(documents: DataFrame, labels: DataFrame, categories: dict[str, Column], *, id_col: str, text_col: str, most_rows: int, seed: int) -> tuple[list[Linear], float]:
    """A chain fitted on some most_rows labelled rows, drawn by a hash of the id. Equal texts count once."""
    named = labels.select(F.col(id_col).alias("_id"), *[c.alias(f"_c{i}") for i, c in enumerate(categories.values())]).dropna()
    share = min(1.0, most_rows / max(1, named.count()))
    drawn = named.where(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20))
    text = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null")
    kinds = "found binary, " + ", ".join(f"_c{i} boolean" for i in range(len(categories)))
    # at most some most_rows rows of a number and a few flags
    rows = text.join(F.broadcast(drawn), "_id").drop("_id").mapInArrow(_featured, kinds).toPandas()
    rows = rows.sort_values(list(rows.columns)).drop_duplicates("found")
    rows = rows.iloc[np.random.Generator(np.random.Philox(key=[seed, 1])).permutation(len(rows))]
    return fit_chain([np.frombuffer(b, np.int32) for b in rows["found"]], rows[[f"_c{i}" for i in range(len(categories))]].to_numpy(bool).reshape(len(rows), len(categories)))


def _scored(batches: Iterator[pa.RecordBatch], chain: list[Linear]) -> Iterator[pa.RecordBatch]:
    known = np.unique(np.concatenate([m.bins for m in chain]))
    of, features = [np.searchsorted(known, m.bins) for m in chain], KnownFeatures(known)
    weights = [np.zeros(len(known)) for _ in chain]
    for w, at, m in zip(weights, of, chain, strict=True):
        w[at] = m.weights
    for batch in batches:
        found = [{i for w in set(WORD((t.as_py() or "").lower())) for i in features[w]} for t in batch.column(1)]
        row, at = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.array([i for x in found for i in x], np.int64)
        before = np.zeros((len(found), 0))
        for m, w in zip(chain, weights, strict=True):
            before = np.c_[before, Linear(known, w, m.earlier, m.bias).chance(row, at, len(found), before)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.round(c, 9)) for c in before.T]], ["doc_id", *[f"c{i}" for i in range(len(chain))]])


def label_categories() -> dict[str, Column]:
    """What the table of labels tells, in the order of the chain. The last one decides."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def classify_toxicity(documents: DataFrame, labels: DataFrame, *, categories: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None, most_rows: int = 8_000, seed: int = 3, carry: bool = False) -> DataFrame:
    """doc_id, p_<category> for each category, toxic (the last one's chance is threshold or more) and kept (not toxic). With carry, document, a struct of all columns, in place of doc_id.

    categories: names and conditions on labels, in the order of the chain; by default low quality, then toxicity. Each
    is a logistic model on the words of a text and the beginnings of words; it also gets the chances that the models
    before gave, learned from out-of-fold ones of three folds. It is fitted on some most_rows labelled rows, the only ones
    gathered, with 150 turns on the at most 1,000 features, found in three of these texts or more, whose log odds differ
    most. Without a threshold, the one with the best F1 over their out-of-fold chances is taken.

    A null text has no words and is judged by the bias alone. Labels with a null are not learned from. Without labels,
    or with one kind only, all have the same chance, below the threshold if there are no positive ones. Rows that repeat
    are judged alike. An empty table gives an empty table. Other columns are not read. No shuffle; a task holds an Arrow
    batch.
    """
    short_batches(documents.sparkSession)
    categories = categories or label_categories()
    chain, found = learn_chain(documents, labels, categories, id_col=id_col, text_col=text_col, most_rows=most_rows, seed=seed)
    threshold = found if threshold is None else threshold
    out = over_texts(documents, lambda it: _scored(it, chain), ", ".join(f"c{i} double" for i in range(len(chain))), id_col=id_col, text_col=text_col, carry=carry)
    toxic = F.col(f"c{len(chain) - 1}") >= threshold
    return out.select(out.columns[0], *[F.col(f"c{i}").alias(f"p_{name}") for i, name in enumerate(categories)], toxic.alias("toxic"), (~toxic).alias("kept"))
