"""Mixing to target weights by soft membership.

A classifier, trained on a bounded sample of a labelled table, gives every document posteriors over
domains. With tokens n_d, posteriors p_d and wanted domain totals T, rates r_d >= lower (zero or more) minimise

    1/2 | W' (sum_d r_d n_d p_d - T) / N |^2  +  ridge/2 sum_d (n_d / N) (r_d - 1)^2

where W W' is the inverse of the posteriors' second moments (so that domains that look alike don't slow it down),
by accelerated projected gradient. In the metric weighted by n_d / N the gradient of document d needs only its
own posteriors and the K residuals, so an iteration is one pass over a narrow table (tokens and posteriors) that
adds up K numbers. A document's rate follows from the list of residuals so far by replaying the steps: nothing is
kept between passes but those lists, a few numbers each, and a lost task is just run again.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_schema, map_arrow, materialise, table

#: Labelled rows that the classifier is trained on at most; hashed features.
LABELLED, DIMS = 3000, 4096
#: Weight of the pull to a rate of one; the share of its wanted total by which a domain may be off; passes at most.
RIDGE, TOLERANCE, ITERATIONS = 1e-5, 1e-3, 200
_log = logging.getLogger(__name__)


def features(text: str | None) -> np.ndarray:
    """Shares of the hashed byte trigrams of the text; zeros for fewer than three bytes."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(DIMS)
    key = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(2654435761)
    return np.bincount(key >> np.uint32(32 - DIMS.bit_length() + 1), minlength=DIMS) / (len(raw) - 2)


@dataclass
class DomainModel:
    names: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def classify(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, posteriors) of each text; no trigrams: the prior."""
        tokens, logits = [], []
        for text in texts:
            tokens.append(len((text or "").split()))
            logits.append(features(text) @ self.weights + self.bias)
        z = np.array(logits).reshape(len(tokens), len(self.names))
        if len(z):
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
        return np.array(tokens, np.int64), z


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 200, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by Adam on all rows."""
    x = x.astype(np.float32)
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(classes), np.zeros(classes)
    hot = np.eye(classes)[y]
    for step in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = ((p - hot) / len(x)).astype(np.float32)
        g, gb = x.T @ d + decay * w, d.sum(axis=0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w.astype(float), b


def train_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DomainModel:
    """A classifier of text into the domains of labelled (id, domain). Null ids or domains don't count; no labelled rows: one domain."""
    by_hash = F.xxhash64("id")
    sample = labelled.where("id is not null and domain is not null").groupBy("id").agg(F.min("domain").alias("domain"))
    texts = docs.select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("_t"))
    ids = sample.join(docs.select(F.col(id_col).alias("_i")), F.col("id") == F.col("_i"), "left_semi").orderBy(by_hash, "id").limit(LABELLED)
    ids = materialise(ids, "labelled", narrow=True)
    rows = texts.join(F.broadcast(ids), F.col("_i") == F.col("id")).select("domain", "_t")  # at most LABELLED ids
    schema = "domain string, at binary, share binary"  # as numbers in rows they would take ten times the memory here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, shares = [], []
            for t in batch.column(1):
                share = features(t.as_py())
                at = share.nonzero()[0]
                ats.append(at.astype("<i4").tobytes())
                shares.append(share[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ats, pa.binary()), pa.array(shares, pa.binary())], schema=arrow_schema(schema))

    found = map_arrow(rows, run, schema).collect()
    found.sort(key=lambda r: (r["domain"], bytes(r["at"]), bytes(r["share"])))
    names = sorted({r["domain"] for r in found}) or ["all"]
    if len(names) == 1:
        return DomainModel(names, np.zeros((DIMS, 1)), np.zeros(1))
    x = np.zeros((len(found), DIMS), np.float32)
    for k, r in enumerate(found):
        x[k, np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["share"], "<f4")
    number = {n: k for k, n in enumerate(names)}
    return DomainModel(names, *fit_softmax(x, np.array([number[r["domain"]] for r in found]), len(names)))


def memberships(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, tokens, posteriors) per row of docs: the narrow table that the fit reads."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, tokens long, posteriors array<double>"
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x domains

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            tokens, p = own.classify(t.as_py() for t in batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), lists], schema=arrow_schema(schema))

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return map_arrow(src, run, schema).withColumnRenamed("id", id_col)


@dataclass
class Plan:
    """What gives the rate of any document: the matrix that posteriors are weighted by, step, and the residuals of the iterations; and the totals reached."""

    weight: np.ndarray
    step: float
    ridge: float
    lower: float
    residuals: list[np.ndarray]
    reached: np.ndarray | None = None

    def rates(self, posteriors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rate, extrapolated rate where the next residual is to be taken) after the steps so far."""
        q = posteriors @ self.weight
        r = np.full(len(q), max(1.0, self.lower))
        y, t = r, 1.0
        for e in self.residuals:
            new = np.maximum(self.lower, y - self.step * (q @ e + self.ridge * (y - 1)))
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, r, t = new + (t - 1) / t2 * (new - r), new, t2
        return r, y


def _totals(members: DataFrame, of) -> np.ndarray:
    """Sum over all rows of a vector of few numbers, added up per task and then in one small aggregation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                p = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                part = of(batch.column(0).to_numpy().astype(float), p)
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], schema=arrow_schema("v array<double>"))

    rows = map_arrow(members.select("tokens", "posteriors"), run, "v array<double>").select(F.posexplode("v").alias("k", "x"))
    return np.array([r["s"] for r in sorted(rows.groupBy("k").agg(F.sum("x").alias("s")).collect())])


def fit_rates(members: DataFrame, shares: np.ndarray | None = None, temper: float = 0.7, lower: float = 0.0, keep_all: bool = False) -> tuple[Plan, np.ndarray, np.ndarray]:
    """(plan, present totals, wanted totals). shares: wanted share of each domain; None: present shares to the power temper.

    keep_all: wanted totals are scaled up until no domain has to shrink. No tokens at all: every rate is 1, or the lower bound.
    It ends when every domain is within TOLERANCE of its wanted total, or when none moves by a tenth of that any more: then the
    targets can't be met by these documents, plan.reached has the closest totals found, and the domains that are off are logged.
    """
    def first(n: np.ndarray, p: np.ndarray) -> np.ndarray:
        k = p.shape[1]
        return np.concatenate([n @ p, np.einsum("d,di,dj->ij", n, p, p).ravel(), [k]])

    sums = _totals(members, first)
    if not len(sums) or not sums[:-1].any():
        return Plan(np.zeros((1, 1)), 0.0, 0.0, lower, [], np.zeros(1)), np.zeros(1), np.zeros(1)
    k = int(round((np.sqrt(4 * (len(sums) - 1) + 1) - 1) / 2))
    present, gram = sums[:k], sums[k : k + k * k].reshape(k, k)
    total = present.sum()
    want = np.asarray(shares, float) if shares is not None else (present / total) ** temper
    want = want / want.sum()
    wanted = want * total
    if keep_all:
        wanted *= (present[wanted > 0] / wanted[wanted > 0]).max()
    root = np.linalg.cholesky(gram / total + 1e-9 * np.eye(k))
    plan = Plan(np.linalg.inv(root).T, 1 / (1 + RIDGE), RIDGE, lower, [])
    goal = wanted / total
    scale = np.where(goal > 0, goal, 1.0)  # a domain that is to vanish is measured by all tokens
    last = None
    while True:
        def ahead(n: np.ndarray, p: np.ndarray, plan: Plan = plan) -> np.ndarray:
            r, y = plan.rates(p)
            return np.concatenate([(n * y) @ p, (n * r) @ p])

        got = _totals(members, ahead) / total
        off = np.abs(got[k:] - goal) / scale
        still = last is not None and (np.abs(got[k:] - last) / scale).max() < TOLERANCE / 10
        if off.max() < TOLERANCE or still or len(plan.residuals) == ITERATIONS:
            break
        last = got[k:]
        plan.residuals.append((got[:k] - goal) @ plan.weight)
    plan.reached = got[k:] * total
    for d in (off >= TOLERANCE).nonzero()[0]:
        _log.warning("domain %d: %.6g tokens wanted, %.6g reached after %d passes", d, wanted[d], plan.reached[d], len(plan.residuals))
    return plan, present, wanted


def target_shares(names: list[str], targets: dict[str, float] | None) -> np.ndarray | None:
    """Wanted shares in the order of names. Domains that targets leaves out are to vanish; unknown ones are an error."""
    if targets is None:
        return None
    if unknown := sorted(set(targets) - set(names)):
        raise ValueError(f"no such domains: {', '.join(unknown)}; there are {', '.join(names)}")
    shares = np.array([float(targets.get(n, 0.0)) for n in names])
    if not np.isfinite(shares).all() or (shares < 0).any() or not shares.sum() > 0:
        raise ValueError("target weights must be zero or more, and one of them above zero")
    return shares / shares.sum()


def mix(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", temper: float = 0.7, targets: dict[str, float] | None = None) -> DataFrame:
    """(id_col, n_tokens, domain, posteriors, rate, domain_wanted, domain_reached) per row of docs, repeated ones too.

    targets: weight of each domain, by its name in labelled; None: present shares to the power temper. domain is the most likely
    one, domain_wanted and domain_reached are its token totals over all rows, as wanted and as these rates expect them; null text
    counts as empty: no tokens, the prior as posteriors. Other columns are ignored; an empty table gives no rows.
    """
    model = train_domains(docs, labelled, id_col, text_col)
    shares = target_shares(model.names, targets)
    members = materialise(memberships(docs, model, id_col, text_col), "members")
    plan, _, wanted = fit_rates(members, shares, temper)

    @F.pandas_udf("double")
    def rate(posteriors: pd.Series) -> pd.Series:
        return pd.Series(plan.rates(np.stack(posteriors))[0] if len(posteriors) else [], dtype=float)

    at = F.array_position("posteriors", F.array_max("posteriors")).cast("int")
    # a value for each domain; a table without tokens has one total for all
    each = lambda values: F.element_at(F.array(*(F.lit(values[k if len(values) > 1 else 0]) for k in range(len(model.names)))), at)
    return members.select(
        id_col, F.col("tokens").alias("n_tokens"), each(model.names).alias("domain"), "posteriors", rate("posteriors").alias("rate"),
        each([float(x) for x in wanted]).alias("domain_wanted"), each([float(x) for x in plan.reached]).alias("domain_reached"),
    )


def repeat_to_targets(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", temper: float = 0.9, targets: dict[str, float] | None = None) -> DataFrame:
    """docs with each row as often as its rate says; columns stay as they are.

    targets as in mix. Rates are one or more and totals are scaled up until no domain shrinks: mixing drops no document (so a domain
    without a weight keeps its own, which is logged). The part of a rate behind the point becomes one more copy where a hash of the id is below it.
    """
    spark = docs.sparkSession
    model = train_domains(docs, labelled, id_col, text_col)
    shares = target_shares(model.names, targets)
    members = materialise(memberships(docs, model, id_col, text_col), "members")
    plan, _, _ = fit_rates(members, shares, temper, lower=1.0, keep_all=True)
    shipped = spark.sparkContext.broadcast((model, plan))

    @F.pandas_udf("double")
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, steps = shipped.value
        for chunk in texts:
            yield pd.Series(steps.rates(own.classify(chunk)[1])[0] if len(chunk) else [], dtype=float)

    part = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor(rate(F.col(text_col).cast("string")) + part).cast("int")
    name = "_copy"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).drop(name)


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, domain) from the labels table: language and quality."""
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).withColumnRenamed("doc_id", "_l")
    lang = docs.select(F.col("doc_id").alias("_d"), F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("_g"))
    return lang.join(own, F.col("_d") == F.col("_l")).select(F.col("_d").alias("id"), F.concat_ws(":", "_g", F.col("q").cast("string")).alias("domain"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")))
