"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed as toxic; all other text is unlabelled and may be toxic too. With the
class prior pi, the risk of a classifier is  pi E_P[l(+)] + (E_U[l(-)] - pi E_P[l(-)]), where the bracket
estimates the risk on negatives. It is kept from going below zero: when it does, a step is taken to raise
it again, so the model can't gain by calling confirmed positives negative. The model is linear over the
distinct words of a text and their beginnings.

Training uses bounded samples (POSITIVES, UNLABELLED, FEATURES); they don't grow with the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import arrow_schema, map_arrow, materialise, table

POSITIVES, UNLABELLED, FEATURES = 4000, 9000, 4096
THRESHOLD = 0.7
STEMS = (4, 5, 6)
REMEMBERED = 250_000
_word = re.compile(r"\w+").findall


def features_of(word: str) -> list[str]:
    """The word and its beginnings; stems are marked, so that a short word isn't the stem of a long one."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def distinct_words(text: str | None) -> set[str]:
    return set(_word((text or "").lower()))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: CRC-32 of the id as text leaves 1 modulo 3. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def held_out_id(doc_id) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 3 == 1


def _forward(weights: np.ndarray, bias: float, idx: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return bias + np.bincount(row, weights[idx], minlength=rows)


def nn_pu_fit(pos: list[np.ndarray], unl: list[np.ndarray], dims: int, prior: float, steps: int = 400, rate: float = 0.15, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative risk estimator with the logistic loss. Rows are arrays of feature numbers (repeats count)."""
    weights, bias = np.zeros(dims), 0.0
    packs = []
    for rows in (pos, unl):
        idx = np.concatenate(rows) if rows else np.empty(0, np.int64)
        packs.append((idx.astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)))
    m, v, mb, vb = np.zeros(dims), np.zeros(dims), 0.0, 0.0
    for step in range(1, steps + 1):
        zp, zu = (_forward(weights, bias, *p) for p in packs)
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -40, 40))), 1 / (1 + np.exp(-np.clip(zu, -40, 40)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # gradients of the losses by the margin: l(+) gives s - 1, l(-) gives s
        if negative >= 0:
            gp, gu = prior * (sp - 1) / len(zp) - prior * sp / len(zp), su / len(zu)
        else:
            gp, gu = prior * sp / len(zp), -su / len(zu)
        grad = np.bincount(packs[0][0], gp[packs[0][1]], minlength=dims) + np.bincount(packs[1][0], gu[packs[1][1]], minlength=dims) + decay * weights
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        weights -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return weights, float(bias)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """(id, p, words): distinct words of the sampled training rows, p = 1 for confirmed ones; and the class prior."""
    own = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = own.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    by_hash = F.xxhash64("_i")
    pos = own.where("toxic = 1").select(F.col("doc_id").alias("_i")).orderBy(by_hash, "_i").limit(POSITIVES).withColumn("_p", F.lit(1))
    unl = docs.where(~held_out(id_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_i")).orderBy(by_hash, "_i").limit(UNLABELLED).withColumn("_p", F.lit(0))
    ids = materialise(pos.unionAll(unl), "sample", narrow=True)
    rows = docs.select(F.col(id_col).alias("_d"), F.col(text_col).cast("string").alias("_t"))
    rows = rows.join(F.broadcast(ids), F.col("_d") == F.col("_i")).select("_p", "_t")  # at most POSITIVES + UNLABELLED ids
    schema = "p int, words array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(distinct_words(t.as_py())) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(words, pa.list_(pa.string()))], schema=arrow_schema(schema))

    return materialise(map_arrow(rows, run, schema), "words"), min(0.9, max(1e-3, rate or 0.0))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, n_pos, n_unl) from (p, words): how many rows of a task have each feature; a feature counts once a row."""
    shape = arrow_schema("f string, n_pos long, n_unl long")
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def told() -> pa.RecordBatch:
        names = list({**counts[1], **counts[0]})
        made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[p][f] for f in names], pa.int64()) for p in (1, 0))], schema=shape)
        for c in counts:
            c.clear()
        return made

    for batch in batches:
        for p, words in zip(*(c.to_pylist() for c in batch.columns)):
            counts[p].update({f for w in words or [] for f in features_of(w)})
            if len(counts[0]) + len(counts[1]) > REMEMBERED:
                yield told()
    yield told()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], float]:
    """Feature weights and bias. No confirmed positive among the training rows: no weights, and a score below one half for all.

    Labels count only if the CRC-32 rule lets their row train. Repeated labels: toxic if any says so; null labels don't count.
    """
    sample, prior = _sample(docs, labels, id_col, text_col)
    sizes = {r["p"]: r["n"] for r in sample.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return {}, -2.0
    counted = map_arrow(sample.select("p", "words"), _count_features, "f string, n_pos long, n_unl long")
    share = counted.groupBy("f").agg((F.sum("n_pos") / sizes[1]).alias("in_p"), (F.sum("n_unl") / sizes[0]).alias("in_u"), F.sum("n_pos").alias("n"))
    share = materialise(share, "share")
    # a feature speaks for the class if positives have it at least twice as often as text at large, by
    # more than three standard deviations of the share that chance would give it; the gain ranks them
    lift = F.col("in_p") - 2 * F.col("in_u")
    chance = F.sqrt((F.col("in_u") + 1 / sizes[1]) / sizes[1])
    chosen = share.where((F.col("n") >= 2) & (lift > 0) & (F.col("in_p") - F.col("in_u") > 3 * chance)).orderBy(F.desc(lift), "f").limit(FEATURES).select("f")
    # text at large has a feature at least pi times as often as positives do: an upper bound on pi, should labels be richer
    spread = 2 * F.sqrt((F.col("in_u") + 1 / sizes[0]) / sizes[0])
    found = share.join(chosen, "f").select("f", F.when(F.col("n") >= 0.05 * sizes[1], (F.col("in_u") + spread) / F.col("in_p")).alias("bound")).collect()
    names = sorted(r["f"] for r in found)
    if not names:
        return {}, -2.0
    prior = max(1e-3, min([prior, *(r["bound"] for r in found if r["bound"] is not None)]))
    number = {f: k for k, f in enumerate(names)}
    sides: dict[int, list[np.ndarray]] = {0: [], 1: []}
    numbers = sample.sparkSession.sparkContext.broadcast(number)
    schema = "p int, f array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = numbers.value
        for batch in batches:
            found = [[own[f] for w in words.as_py() or [] for f in features_of(w) if f in own] for words in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int32()))], schema=arrow_schema(schema))

    for r in map_arrow(sample.select("p", "words"), run, schema).collect():
        sides[r["p"]].append(np.array(r["f"], np.int64))
    weights, bias = nn_pu_fit(sides[1], sides[0], len(names), prior)
    return {f: float(w) for f, w in zip(names, weights) if w}, bias


class _WordWeights(dict):
    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        value = sum(self.weights.get(f, 0.0) for f in features_of(word))
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def scorer(spark, model: tuple[dict[str, float], float]):
    """A column function: probability that a text is toxic. Null or empty text gets the score of no words at all."""
    shipped = spark.sparkContext.broadcast(model)  # at most FEATURES weights

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shipped.value
        own = _WordWeights(weights)
        for chunk in texts:
            z = np.array([bias + sum(map(own.__getitem__, distinct_words(t))) for t in chunk], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) per row of docs, repeated ones too. Other columns are ignored."""
    score = scorer(docs.sparkSession, train(docs, labels, id_col, text_col))
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(F.col(text_col).cast("string")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows predicted as toxic; the columns stay as they are."""
    score = scorer(docs.sparkSession, train(docs, labels, id_col, text_col))
    return docs.where(score(F.col(text_col).cast("string")) < THRESHOLD)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
