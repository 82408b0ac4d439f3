"""Toxicity by a classifier chain of linear models.

The categories are judged one after the other; each later model gets the earlier categories' probabilities as further
features. In training those are out-of-fold predictions, so that a later model sees them as good as they'll be on new
documents. Features are words and word beginnings, which catches forms of a word that the labels never show.

Fitting takes a bounded sample: at most ``SAMPLE`` labelled documents, taken by a hash of their ids. The models are
tables of at most ``FEATURES`` weights, so every document is judged where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowatlas.llm.common import stable

#: Labelled documents for fitting, features of a model, least documents with a feature, folds, beginnings' lengths.
SAMPLE, FEATURES, LEAST, FOLDS, BEGINNINGS = 8192, 1024, 4, 4, (4, 5, 6)
#: Steps and ridge of the logistic fit.
STEPS, RIDGE = 150, 1e-3
_STRIP = re.compile(r"^\W+|\W+$")
REMEMBERED = 300_000


def features_of(word: str) -> list[str]:
    """The word without signs at its ends, and its beginnings."""
    word = _STRIP.sub("", word).lower()
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)] if word else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last one the intercept) of a ridge logistic regression by accelerated gradient steps.

    The steps run on centred features: the intercept and common features then don't hold back the others.
    """
    mean = x.mean(0)
    x = np.concatenate((x - mean, np.ones((len(x), 1), np.float32)), axis=1).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):  # the largest eigenvalue sets the step
        v = x.T @ (x @ v)
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 1 / (0.26 * top / len(x) + RIDGE)
    w = z = np.zeros(x.shape[1], np.float32)
    for i in range(STEPS):
        new = z - step * (x.T @ (_sigmoid(x @ z) - y) / len(x) + RIDGE * z)
        z, w = new + (i / (i + 3)) * (new - w), new
    return np.append(w[:-1], w[-1] - w[:-1] @ mean)


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The border of the best F1 between out-of-fold probabilities, halfway to the next lower one; 0.5 without either kind."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = 0  # equal probabilities stay on one side
    best = int(f1.argmax())
    lower = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + lower) / 2)


def fit_chain(x: np.ndarray, targets: np.ndarray, folds: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
    """One weight vector and cut per category; later ones have a weight for each earlier category before the intercept."""
    chain, cuts = [], []
    for k in range(targets.shape[1]):
        y = targets[:, k].astype(np.float32)
        chain.append(logistic(x, y))
        apart = np.zeros(len(x), np.float32)
        for f in range(FOLDS):
            rest = folds != f
            if rest.any() and (~rest).any():
                w = logistic(x[rest], y[rest])
                apart[~rest] = _sigmoid(x[~rest] @ w[:-1] + w[-1])
        cuts.append(best_cut(apart, y))
        x = np.concatenate((x, apart[:, None]), axis=1)
    return chain, cuts


def select_features(rows: list[np.ndarray], names: list[str], targets: np.ndarray, size: int) -> np.ndarray:
    """Ids of the features that tell most about any category, by how far their counts are from independence."""
    if not names:
        return np.empty(0, np.int64)
    flat, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n = len(targets)
    there = np.bincount(flat, minlength=len(names)).astype(float)
    worth = np.zeros(len(names))
    for k in range(targets.shape[1]):
        share = targets[:, k].mean()
        expected = there * share
        found = np.bincount(flat, weights=targets[of, k], minlength=len(names))
        worth = np.maximum(worth, (found - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9) * (n / np.maximum(n - there, 1)))
    worth[there < LEAST] = -1
    order = np.argsort(-worth, kind="stable")
    return order[:size][worth[order[:size]] >= 0]


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], *, sample: int = SAMPLE, size: int = FEATURES) -> tuple[list[str], list[np.ndarray], list[float]]:
    """(features, weights per category, cuts): fitted in one task on the bounded sample."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), *[F.col(c).cast("double").alias(c) for c in categories]).dropna().groupBy("_id").agg(*[F.max(c).alias(c) for c in categories])
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    # one row per id, combined before it is sent: the task that fits gets at most ``sample`` rows
    rows = rows.groupBy("_id", *categories).agg(F.min("_text").alias("_text"))

    def run(table: pa.Table) -> pa.Table:
        frame = table.to_pandas().sort_values("_id")
        ids: dict[str, int] = {}
        memory: dict[str, np.ndarray] = {}
        found = []
        for t in frame["_text"]:  # texts in the order of their ids, so features are numbered alike each time
            words = sorted(set(t.split()))
            for w in words:
                if w not in memory:
                    memory[w] = np.array([ids.setdefault(f, len(ids)) for f in features_of(w)], np.int32)
            found.append(np.unique(np.concatenate([memory[w] for w in words])) if words else np.empty(0, np.int32))
        targets = frame[categories].to_numpy(float)
        every = list(ids)
        chosen_ids = select_features(found, every, targets, size)
        names = [every[i] for i in chosen_ids]
        at = np.full(len(every), -1)
        at[chosen_ids] = np.arange(len(chosen_ids))
        x = np.zeros((len(found), len(names)), np.float32)
        for i, features in enumerate(found):
            hits = at[features]
            x[i, hits[hits >= 0]] = 1
        chain, cuts = fit_chain(x, targets, np.arange(len(found)) % FOLDS)
        return pa.table({"features": pa.array([names] * len(chain), pa.list_(pa.string())), "weights": pa.array([w.astype(float).tolist() for w in chain], pa.list_(pa.float64())), "cut": pa.array(cuts, pa.float64()), "k": pa.array(range(len(chain)), pa.int32())})

    fitted = stable(rows.withColumn("_one", F.lit(1)).groupBy("_one").applyInArrow(run, "features array<string>, weights array<double>, cut double, k int")).orderBy("k").collect()
    if not fitted:
        return [], [np.zeros(k + 1) for k in range(len(categories))], [0.5] * len(categories)
    return list(fitted[0]["features"]), [np.array(r["weights"]) for r in fitted], [r["cut"] for r in fitted]


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], *, target: str = "toxic", **options) -> DataFrame:
    """One row per document: doc_id, p_<category> for each of the chain, and ``target`` (boolean).

    The cut is that of the best F1 among the out-of-fold probabilities of the fitted sample.

    Labels with a null are left out; a document with several labels has a category if any says so. Of rows that repeat a
    doc_id, one text (the first in order) is fitted on. Null and empty
    texts get the models' base rates. Rows that repeat a doc_id are judged each. Without labels every probability is
    one half and nothing is toxic. An empty table gives no rows; further columns are ignored.
    """
    names, chain, cuts = fit(docs, labels, categories, **options)
    shared = docs.sparkSession.sparkContext.broadcast((names, chain))
    columns = [f"p_{c}" for c in categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, chain = shared.value
        at = {f: i for i, f in enumerate(names)}
        memory: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = np.zeros((batch.num_rows, len(chain)))
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = set((text or "").split())
                if len(memory) > REMEMBERED:
                    memory.clear()
                hits: set[int] = set()
                for w in words:
                    ids = memory.get(w)
                    if ids is None:
                        ids = memory[w] = tuple(at[f] for f in features_of(w) if f in at)
                    if ids:
                        hits.update(ids)
                on = np.fromiter(hits, np.int64, len(hits))
                for k, w in enumerate(chain):
                    out[i, k] = w[on].sum() + w[len(names) : len(names) + k] @ out[i, :k] + w[-1]
                    out[i, k] = 1 / (1 + np.exp(-np.clip(out[i, k], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, k]) for k in range(len(chain)))], names=["doc_id", *columns])

    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in columns))
    return judged.withColumn(target, F.col(f"p_{target}") > cuts[categories.index(target)])
