"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other: each model sees the words of a text and the
probabilities of all earlier categories. In training those probabilities are out of fold,
so later models learn from what earlier ones say about texts that they haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlake.llm.quality import held_out, labelled_sample
from hostlake.llm.runtime import staged, table

#: Labelled rows that the chain learns from, words that it looks at, and folds.
SAMPLE, WORDS, FOLDS = 8000, 400, 5
#: The chain of the query. The labels hold one category of toxicity and a mark of quality: poor texts first, then toxic ones, then those that are both.
CATEGORIES = ("poor", "toxic", "toxic_and_poor")
EDGES = ".,;:!?\"'()[]{}<>*_-…«»“”¡¿"


def words_of(text: str | None) -> set[str]:
    return {w.strip(EDGES) for w in (text or "").lower().split()}


@dataclass(frozen=True)
class Chain:
    """Weights per category: intercept, words, then the earlier categories."""

    categories: tuple[str, ...]
    words: dict[str, int]
    weights: tuple[np.ndarray, ...]

    def features(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.words)))
        known = self.words.keys()
        for i, t in enumerate(texts):
            for w in words_of(t) & known:
                x[i, self.words[w]] = 1
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column per category."""
        done = np.zeros((len(x), 0))
        for w in self.weights:
            done = np.column_stack([done, _sigmoid(np.column_stack([x, done]) @ w[1:] + w[0])])
        return done


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Logistic regression by Newton steps; the first weight is the intercept, which isn't penalised."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    p = (y.sum() + 0.5) / (len(y) + 1)
    w[0] = np.log(p / (1 - p))
    if not len(y) or y.min() == y.max():
        return w
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        q = _sigmoid(a @ w)
        move = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + np.diag(penalty), a.T @ (y - q) - penalty * w)
        w = w + move
        if np.abs(move).max() < 1e-4:
            break
    return w


def fit_chain(x: np.ndarray, targets: np.ndarray, folds: np.ndarray, columns: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Weights of a chain for the columns of ``targets`` in order; ``folds`` numbers the fold of every row.

    ``columns`` tells which columns of ``x`` may be looked at where a fold is left out, and under -1 by the models themselves (all without it).
    """
    columns = columns or dict.fromkeys([-1, *folds.tolist()], np.arange(x.shape[1]))
    done = np.zeros((len(x), 0))
    out = []
    for y in targets.T:
        out.append(fit_linear(np.column_stack([x[:, columns[-1]], done]), y))
        apart = np.zeros(len(x))
        for f in np.unique(folds).tolist():
            seen = np.column_stack([x[:, columns[f]], done])
            w = fit_linear(seen[folds != f], y[folds != f])
            apart[folds == f] = _sigmoid(seen[folds == f] @ w[1:] + w[0])
        done = np.column_stack([done, apart])
    return tuple(out)


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Chain:
    """The chain from a bounded sample of labelled texts outside the held-out part.

    The words are those whose share of toxic and other texts differs most; counted by Spark, only the best ``WORDS`` reach the
    driver. They are chosen anew without each fold, so that a probability out of fold doesn't know its text through
    them either. Texts without a mark of quality count as good. Without labels every text scores 0.5 or less.
    """
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    sample = staged(labelled_sample(docs, labels, "toxic", ~held_out(), limit, ("quality",)).withColumn("fold", fold))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, f, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some = sorted(words_of(t))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([y] * len(some), pa.int32()), pa.array([f] * len(some), pa.int32())], names=["word", "y", "fold"])

    sizes = {(r["y"], r["fold"]): r["count"] for r in sample.groupBy("y", "fold").count().collect()}
    counted = staged(sample.select(F.col("y").cast("int").alias("y"), "fold", "text").mapInArrow(spread, "word string, y int, fold int").groupBy("word", "fold").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")))

    def chosen(without: int) -> list[str]:
        bad, good = (sum(n for (label, f), n in sizes.items() if label == y and f != without) for y in (1, 0))
        summed = counted.where(F.col("fold") != without).groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        p, q = (F.col("bad") + 0.5) / (bad + 1.0), (F.col("good") + 0.5) / (good + 1.0)
        pooled = (F.col("bad") + F.col("good") + 1.0) / (bad + good + 2.0)
        scored = summed.where(F.col("bad") + F.col("good") >= 3).withColumn("gap", F.abs(p - q) / F.sqrt(pooled * (1 - pooled)))
        return [r["word"] for r in scored.orderBy(F.desc("gap"), "word").limit(WORDS).select("word").collect()]

    choices = {f: chosen(f) for f in (-1, *range(FOLDS))}
    every = {w: i for i, w in enumerate(dict.fromkeys(w for f in choices for w in choices[f]))}
    blank = Chain(CATEGORIES, every, ())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = blank.features(batch.column(4).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([np.flatnonzero(r) for r in x], pa.list_(pa.int64()))], names=["doc_id", "y", "quality", "fold", "on"])

    columns = sample.select(F.col("doc_id").cast("long"), F.col("y").cast("int"), F.coalesce(F.col("quality").cast("int"), F.lit(1)).alias("quality"), "fold", "text")
    rows = sorted(tuple(r) for r in columns.mapInArrow(encode, "doc_id long, y int, quality int, fold int, on array<long>").toLocalIterator())
    x = np.zeros((len(rows), len(every)))
    for i, r in enumerate(rows):
        x[i, r[4]] = 1
    y, good, folds = (np.array([r[k] for r in rows], float) for k in (1, 2, 3))
    targets = np.column_stack([1 - good, y, y * (1 - good)])
    places = {f: np.array([every[w] for w in choices[f]], np.int64) for f in choices}
    return Chain(CATEGORIES, {w: i for i, w in enumerate(choices[-1])}, fit_chain(x, targets, folds, places))


def toxicity_scores(docs: DataFrame, chain: Chain, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``p_<category>`` of the whole text for every row; null counts as empty, ids may be null or repeat."""
    names = [*keep, *(f"p_{c}" for c in chain.categories)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                p = chain.probabilities(chain.features(batch.column(len(keep))[at : at + 512].to_pylist()))
                yield pa.RecordBatch.from_arrays([*(c[at : at + 512] for c in batch.columns[: len(keep)]), *(pa.array(c.copy()) for c in p.T)], names=names)

    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(n, T.DoubleType()) for n in names[len(keep) :])])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(each, schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity_scores(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("*", held_out().alias("held_out"), (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"))


QUERIES = {"op3_toxicity": op3_toxicity}
