"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlake.llm.runtime import table

#: Labelled rows that a model learns from, at most; the ones with the smallest hash of their id.
SAMPLE = 20_000

#: Statistics of a text, in this order.
STATISTICS = (
    "n_bytes", "n_words", "mean_word", "max_word", "distinct_words", "upper", "digits", "punctuation", "symbols", "non_ascii",
    "spaces", "n_lines", "mean_line", "distinct_lines", "short_lines", "exclamations", "bars", "repeated_symbols", "sentence_ends", "top_word",
    "capital_words", "one_letter_words",
)


def _classes() -> np.ndarray:
    """Rows of weights that turn a byte histogram into counts of character classes."""
    byte = np.arange(256)
    text = [chr(b) if b < 128 else "" for b in byte]
    rows = [
        [c.isupper() for c in text], [c.isdigit() for c in text], [c in ".,;:!?'\"()-" and c != "" for c in text],
        [c in "#$%&*+/<=>@[\\]^_`{|}~" and c != "" for c in text], byte >= 128, [c in " \t\n\r\x0b\x0c" and c != "" for c in text],
        byte == ord("!"), byte == ord("|"), [c in ".!?" and c != "" for c in text],
    ]
    return np.array(rows, float).T


CLASSES = _classes()


def statistics(data: bytes) -> np.ndarray:
    """The STATISTICS of a whole text given as UTF-8; all zero for an empty one."""
    n = len(data)
    if not n:
        return np.zeros(len(STATISTICS))
    upper, digits, punct, symbols, wide, spaces, bang, bars, ends = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ CLASSES
    words = data.split()
    lines = data.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    spans = np.fromiter(map(len, lines), np.int64, len(lines))
    k = max(len(words), 1)
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    raw = np.frombuffer(data, np.uint8)
    same = raw[1:] == raw[:-1]
    letters = (raw | 32) - 97 < 26
    return np.array([
        np.log1p(n), np.log1p(len(words)), sizes.mean() if len(words) else 0, np.log1p(sizes.max(initial=0)), len(kinds) / k,
        upper / n, digits / n, punct / n, symbols / n, wide / n, spaces / n, np.log1p(len(lines)), np.log1p(n / len(lines)),
        len(set(lines)) / len(lines), (spans < 20).mean(), bang / k, bars / k, (same & ~letters[1:]).sum() / n, ends / k,
        max(kinds.values(), default=0) / k, sum(w[:1].isupper() for w in words) / k, (sizes == 1).sum() / k,
    ])


@dataclass(frozen=True)
class Trees:
    """A boosted ensemble flattened into arrays: node i of tree t is row t * nodes + i.

    Inner nodes have a feature, a threshold (left when value <= threshold) and the number of
    their left child, the right one follows it; leaves point to themselves.
    """

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    nodes: int
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches; all rows walk all trees level by level."""
        roots = np.arange(len(self.feature) // self.nodes) * self.nodes
        at = np.broadcast_to(roots, (len(x), len(roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            inner = f >= 0
            right = x[rows, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(inner, self.left[at] + right, at)
        return self.start + self.value[at].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -500, 500)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, smooth: float = 1.0, least: int = 5) -> Trees:
    """Logistic boosting on binned features.

    Every level builds one histogram of gradients and hessians per node, feature and bin and takes the best split.
    Without rows, or with one class only, the ensemble is the (smoothed) log odds alone.
    """
    n, width = x.shape
    p = (y.sum() + 0.5) / (n + 1.0)
    start = float(np.log(p / (1 - p)))
    nodes = 2 ** (depth + 1) - 1
    if not n or y.min() == y.max():
        rounds = 0
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(1) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], 1) if n else np.zeros((0, width), int)
    flat = binned + np.arange(width) * bins
    margin = np.full(n, start)
    features, thresholds, lefts, values = [], [], [], []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = y - prob, prob * (1 - prob)
        feature, threshold, left, value = np.full(nodes, -1), np.zeros(nodes), np.arange(nodes), np.zeros(nodes)
        at, level, used = np.zeros(n, np.int64), [0], 1
        for deep in range(depth + 1):
            size = len(level)
            slot = np.full(nodes, -1)
            slot[level] = np.arange(size)
            own = slot[at]
            live = np.flatnonzero(own >= 0)
            key = (own[live, None] * (width * bins) + flat[live]).ravel()
            shape = (size, width, bins)
            G = np.bincount(key, np.repeat(g[live], width), size * width * bins).reshape(shape)
            H = np.bincount(key, np.repeat(h[live], width), size * width * bins).reshape(shape)
            N = np.bincount(key, minlength=size * width * bins).reshape(shape)
            total_g, total_h, total_n = G[:, 0].sum(1), H[:, 0].sum(1), N[:, 0].sum(1)
            value[level] = rate * total_g / (total_h + smooth)
            if deep == depth:
                break
            gl, hl, nl = G.cumsum(2), H.cumsum(2), N.cumsum(2)
            tg, th, tn = (v[:, None, None] for v in (total_g, total_h, total_n))
            gain = gl**2 / (hl + smooth) + (tg - gl) ** 2 / (th - hl + smooth) - tg**2 / (th + smooth)
            gain[(nl < least) | (tn - nl < least)] = -np.inf
            for f in range(width):
                gain[:, f, len(edges[f]) :] = -np.inf
            best = gain.reshape(size, -1).argmax(1)
            following = []
            for s, node in enumerate(level):
                f, b = divmod(int(best[s]), bins)
                if gain[s, f, b] <= 1e-9:
                    continue
                feature[node], threshold[node], left[node] = f, edges[f][b], used
                following += [used, used + 1]
                used += 2
            if not following:
                break
            f = feature[at]
            inner = (f >= 0) & (own >= 0)
            at = np.where(inner, left[at] + (x[np.arange(n), np.maximum(f, 0)] > threshold[at]), at)
            level = following
        margin += value[at]
        inner = feature >= 0
        value[inner] = 0
        features.append(feature)
        thresholds.append(threshold)
        lefts.append(left + len(lefts) * nodes)
        values.append(value)
    if not features:
        return Trees(start, np.full(1, -1), np.zeros(1), np.zeros(1, int), np.zeros(1), 1, 0)
    return Trees(start, *(np.concatenate(c) for c in (features, thresholds, lefts, values)), nodes, depth)


def with_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``stats`` (array<double>) of every whole text; null counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py() or b"") for t in batch.column(len(keep)).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(stats, pa.list_(pa.float64()))], names=[*keep, "stats"])

    one = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return one.mapInArrow(each, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, keep: F.Column, limit: int, further: tuple[str, ...] = ()) -> DataFrame:
    """Texts and 0/1 labels (``y``), and ``further`` labels, of at most ``limit`` labelled rows for which ``keep`` holds.

    Rows with a null id or label, or a label other than 0 and 1, are left out; of repeated ids the smallest label counts.
    Of documents that repeat an id the smallest text counts. The choice follows a hash of the id, so it is the same in every run and does not lean on any column.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & keep)
        .groupBy("doc_id")
        .agg(F.min(target).alias("y"), *(F.min(c).alias(c) for c in further))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"), *(F.min(c).alias(c) for c in further))


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Trees:
    """Trees learnt from the statistics of a bounded sample of labelled documents outside the held-out part."""
    sample = labelled_sample(docs, labels, "quality", ~held_out(), limit)
    rows = sorted((r.doc_id, r.y, r.stats) for r in with_statistics(sample, keep=("doc_id", "y")).toLocalIterator())
    x = np.array([r[2] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return fit_trees(x, np.array([r[1] for r in rows], float))


def quality_scores(docs: DataFrame, model: Trees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``score`` (0 to 1, the chance of label 1) and the ``stats`` behind it, for every row.

    Null and empty texts have all statistics zero and are scored like any other; ids may be null or repeat.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary())
            for at in range(0, batch.num_rows, 1024):
                stats = [statistics(t.as_py() or b"") for t in texts[at : at + 1024]]
                score = model.scores(np.array(stats))
                yield pa.RecordBatch.from_arrays([*(c[at : at + 1024] for c in batch.columns[: len(keep)]), pa.array(score), pa.array(stats, pa.list_(pa.float64()))], names=[*keep, "score", "stats"])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(each, schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
