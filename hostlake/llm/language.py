"""Language identification by mixtures: every text is explained as a blend of languages.

Models are letter trigram likelihoods per language. Expectation-maximisation finds the
proportions of the languages in a text; the set of languages is the one with the best
likelihood after a penalty per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlake.llm.quality import held_out
from hostlake.llm.runtime import small_batches, table

#: Texts per language that a model learns from, at most; those with the smallest hash of their id.
SAMPLE = 3000
#: Parts of a language that are sampled apart.
PARTS = 64
#: Cells that trigrams are hashed to.
CELLS = 1 << 16
#: Letters of a text that are looked at together; counts of slices add up.
SLICE = 1 << 20
UNKNOWN = "und"

_FOLD = np.zeros(0x3000, np.uint32)
_FOLD[[c for c in range(0x3000) if chr(c).isalpha()]] = [c for c in range(0x3000) if chr(c).isalpha()]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram cells of the letters of a text (runs of other characters count as one gap) and their counts."""
    total: dict[int, int] | None = None
    cells = counts = np.empty(0, np.int64)
    for at in range(0, len(text), SLICE):
        code = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if code.max(initial=0) < len(_FOLD):
            letter = _FOLD[code]
        else:
            kinds, back = np.unique(code, return_inverse=True)
            letter = np.array([c if chr(c).isalpha() else 0 for c in kinds.tolist()], np.uint32)[back]
        letter = np.concatenate([[0], letter, [0]]).astype(np.uint32)
        letter = letter[(letter > 0) | np.concatenate([[True], letter[:-1] > 0])]
        if len(letter) < 3:
            continue
        h = (letter[:-2] * np.uint32(0x9E3779B1)) ^ (letter[1:-1] * np.uint32(0x85EBCA77)) ^ (letter[2:] * np.uint32(0xC2B2AE3D) >> np.uint32(3))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        some, n = np.unique((h >> np.uint32(16)) % np.uint32(CELLS), return_counts=True)
        if not len(cells):
            cells, counts = some.astype(np.int64), n
        else:
            total = dict(zip(cells.tolist(), counts.tolist(), strict=True)) if total is None else total
            for c, k in zip(some.tolist(), n.tolist(), strict=True):
                total[c] = total.get(c, 0) + k
    if total is not None:
        cells, counts = np.array(list(total), np.int64), np.array(list(total.values()))
    return cells, counts


@dataclass(frozen=True)
class Model:
    """Languages by code point and the likelihood of every cell under each (cells x languages)."""

    languages: tuple[str, ...]
    likelihood: np.ndarray


def fit_languages(docs: DataFrame, keep: F.Column, text: str = "text", lang: str = "lang", limit: int = SAMPLE, smooth: float = 0.1) -> Model:
    """Trigram likelihoods from a bounded sample of each language's texts for which ``keep`` holds.

    Rows with null text or language are left out. A sample reaches the driver as counts per language and cell only.
    """
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "t"))
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & keep)
    bounded = (
        known.select(F.col(lang).alias("lang"), F.xxhash64("doc_id").alias("h"), F.xxhash64(text).alias("t"))
        .distinct()
        .withColumn("part", F.pmod("h", F.lit(PARTS)))
        .withColumn("n", nth("lang", "part"))  # parts of a language are cut to the limit first, so that at most PARTS times it meet in a task
        .where(F.col("n") <= limit)
        .withColumn("n", nth("lang"))
        .where(F.col("n") <= limit)
        .select("lang", "h", "t")
    )
    chosen = known.select(F.col(lang).alias("lang"), F.xxhash64("doc_id").alias("h"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).join(F.broadcast(bounded), ["lang", "h", "t"])
    chosen = chosen.groupBy("lang", "h", "t").agg(F.min("text").alias("text"))  # rows that repeat count once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells, n = trigrams(body)
                np.add.at(totals.setdefault(name, np.zeros(CELLS, np.int64)), cells, n)
        for name, n in totals.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used), pa.array(n[used])], names=["lang", "cell", "n"])

    counted = chosen.select("lang", "text").mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    languages = tuple(sorted(set(rows["lang"])))
    place = {name: i for i, name in enumerate(languages)}
    table_of = np.full((CELLS, len(languages)), smooth)
    if len(rows):
        table_of[rows["cell"], rows["lang"].map(place)] += rows["n"]
    return Model(languages, table_of / table_of.sum(0))


def _em(p: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions after ``rounds`` of expectation-maximisation, and their log-likelihood."""
    pi, total = start, n.sum()
    for _ in range(rounds):
        share = p * pi
        pi = (n / share.sum(1)) @ share / total
        pi = np.maximum(pi, 1e-12)
        pi /= pi.sum()
    return pi, float(n @ np.log(p @ pi))


def infer(model: Model, text: str | None, rounds: int = 12, penalty: float = 4.0) -> dict[str, float]:
    """Languages of a text and their proportions, largest first; empty for a text without letters.

    Candidate sets are the languages in order of their proportion in the full mixture, cut after
    one, two and so on. A further language must raise the log-likelihood by ``penalty`` times
    the log of the number of trigrams.
    """
    cells, n = trigrams(text or "")
    if not len(cells) or not model.languages:
        return {}
    p, k = model.likelihood[cells], len(model.languages)
    full, _ = _em(p, n, np.full(k, 1 / k), rounds)
    order = np.argsort(-full, kind="stable")
    price = penalty * np.log(max(n.sum(), 2))
    best, worth = np.ones(1), float(n @ np.log(p[:, order[0]]))
    for size in range(2, k + 1):
        if full[order[size - 1]] < 0.02:
            break
        some = order[:size]
        pi, fit = _em(p[:, some], n, full[some] / full[some].sum(), rounds)
        if fit - price * (size - 1) > worth:
            best, worth = pi, fit - price * (size - 1)
    shares = dict(zip((model.languages[i] for i in order), best.tolist(), strict=False))
    return dict(sorted(shares.items(), key=lambda kv: -kv[1]))


def language_mixtures(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred`` (the language with the largest share, ``und`` without letters),
    ``score`` (that share, 0 for ``und``) and ``mixture`` (a map of all shares) for every row.

    Whole texts are read; null counts as empty. Ids may repeat or be null. A model without
    languages (no labelled text) predicts ``und`` throughout.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [infer(model, t) for t in batch.column(len(keep)).to_pylist()]
            top = [next(iter(f.items()), (UNKNOWN, 0.0)) for f in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([t[0] for t in top], pa.string()), pa.array([min(t[1], 1.0) for t in top], pa.float64()), pa.array([list(f.items()) for f in found], pa.map_(pa.string(), pa.float64()))],
                names=[*keep, "lang_pred", "score", "mixture"],
            )

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(each, schema)


def known_language_only(docs: DataFrame) -> DataFrame:
    """``docs`` without the texts that have no letters or no language with at least half of the text.

    Models come from a sample of the stage's own input; where no text has a language nothing is rejected.
    """
    small_batches(docs.sparkSession)
    model = fit_languages(docs, F.lit(True))
    if not model.languages:
        return docs
    schema = docs.schema
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [next(iter(infer(model, t).values()), 0.0) >= 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(each, schema)


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(parts=4, part=2)
    return language_mixtures(docs, fit_languages(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language": op7_language}
