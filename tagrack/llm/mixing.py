"""Mixing sources to target weights with soft membership.

A classifier fitted on a labelled table gives every document a posterior over
domains. Rates r >= 0, one per document, are then fitted so that the expected
tokens of each domain, sum of rate * tokens * posterior, meet the targets:
projected gradient for the least squares of A r - T over all documents,
starting at rate 1. Each step needs the domain totals of all documents, one
distributed sum of a handful of numbers, and moves every rate where it lies.
With the rates weighed by tokens the step of a document depends on its
posterior only, and documents of equal posterior get equal rates. The residual is
measured in the inverse of the domains' small Gram matrix, so a scarce domain
moves as fast as a dominant one. Steps go on until every domain is within
``TOLERANCE`` of its target, or, where no rates meet the targets, until the
residual stands still; it is logged.

DataFrame and pyspark.ml functions only; no Python runs on the executors.

Mixing only ever repeats: rates there are at least 1 and every row keeps a copy.
Domains without a wish keep their share of the tokens, and the token budget is
raised until rates of at least 1 meet the targets.

Defined cases. Null and empty texts have no tokens and get the rate their
posterior gives them. Rows without a usable label are not learnt from. Without two
labelled domains the posterior is 1 for the only one; without any, and for an
empty table, every rate is 1. Targets of domains the classifier does not know
are dropped and the others scaled up. A domain without tokens cannot be met;
its residual stays. Repeated rows and null ids get rates like any other.
"""

from __future__ import annotations

import logging
from functools import reduce
from json import dumps

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_share, text_or_empty, written

# Documented bound: the classifier is fitted on about this many labelled rows.
MAX_TRAINING_ROWS = 10_000
FEATURES = 1 << 12
STEPS_PER_WRITE = 15
TOLERANCE = 1e-4
# Where a block of steps lowers the residual by less than this share, it stands still.
LEAST_GAIN = 1e-2
# First raise of the token budget over the least one; later raises double it.
RAISE = 0.25
_LOG = logging.getLogger(__name__)


def words(text_col: str = "text") -> Column:
    return F.split(F.lower(text_or_empty(text_col)), r"[\x20\x09-\x0D]+")


def n_tokens(text_col: str = "text") -> Column:
    """White-space separated words."""
    return F.size(F.filter(F.split(text_or_empty(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


class Posteriors:
    """Multinomial logistic regression over hashed words."""

    def __init__(self, labelled: DataFrame, text_col: str, max_training_rows: int):
        rows = labelled.where("domain is not null")
        self.hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_words", outputCol="_features")
        self.domains = sorted(r["domain"] for r in rows.select("domain").distinct().collect())
        self.model = None
        if len(self.domains) > 1:
            rows = written(rows.select("domain", words(text_col).alias("_words")), "mixing_rows")
            rows = self.hashing.transform(rows)
            order = StringIndexer(inputCol="domain", outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
            self.model = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=25, regParam=0.01,
                                            family="multinomial", predictionCol="", rawPredictionCol="",
                                            probabilityCol="_p").fit(order.transform(rows))

    def add(self, docs: DataFrame, text_col: str) -> DataFrame:
        if self.model is None:
            return docs.withColumn("posterior", F.array(*[F.lit(1.0) for _ in self.domains]))
        scored = self.model.transform(self.hashing.transform(docs.withColumn("_words", words(text_col))))
        return scored.withColumn("posterior", vector_to_array("_p")).drop("_words", "_features", "_p")


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


Step = tuple[float, list[float]]  # momentum, push by domain


def _moved(rate: Column, prev: Column, beta: Column, pull: Column, least: float) -> Column:
    """One projected step."""
    return F.greatest(F.lit(float(least)), rate + beta * (rate - prev) - pull)


def rate_of(posterior: Column, steps: list[Step], start: float = 1.0, least: float = 0.0) -> Column:
    """The rate to which the steps lead a document of this posterior, so whole
    rows get their rates where they lie."""
    if not steps:
        return F.lit(float(start))
    taken = F.from_json(F.lit(dumps([{"beta": b, "push": p} for b, p in steps])), "array<struct<beta:double,push:array<double>>>")
    pull = lambda at, s: F.aggregate(F.zip_with(at["of"], s["push"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    # the posterior travels in the state: inside the lambda it would be computed at every step
    first = F.struct(F.lit(float(start)).alias("rate"), F.lit(float(start)).alias("prev"), posterior.alias("of"))
    return F.aggregate(taken, first, lambda at, s: F.struct(
        _moved(at["rate"], at["prev"], s["beta"], pull(at, s), least).alias("rate"), at["rate"].alias("prev"), at["of"].alias("of")))["rate"]


def fit_rates(docs: DataFrame, targets: list[float], start: float = 1.0) -> tuple[DataFrame, list[float]]:
    """Adds ``rate`` to rows with ``tokens`` and ``posterior``; also returns the
    expected domain totals reached. ``targets`` are token totals by domain."""
    fitted, reached, _ = fit_steps(docs, targets, start)
    return fitted, reached


def fit_steps(docs: DataFrame, targets: list[float], start: float = 1.0, least: float = 0.0) -> tuple[DataFrame, list[float], list[Step]]:
    """``fit_rates`` with no rate under ``least``, and the steps taken.

    Momentum steps of projected gradient, restarted when the residual grows; in
    the metric of the inverse Gram matrix a step of length 1 never overshoots.
    """
    d = range(len(targets))
    p = [F.col("posterior")[i] for i in d]
    total = lambda rate: [F.sum(F.col("tokens") * rate * p[i]) for i in d]
    inverse = _inverse(_gram(docs, len(targets)))
    docs = docs.withColumn("rate", F.lit(float(start))).withColumn("_prev", F.lit(float(start)))
    if not inverse.any():
        return docs.drop("_prev"), [0.0 for _ in d], []
    steps: list[Step] = []
    now = [float(x or 0.0) for x in docs.agg(*total(F.col("rate"))).first()]
    was, beta, t = now, 0.0, 1.0
    norm = lambda x: float((np.subtract(x, targets) @ inverse @ np.subtract(x, targets)).clip(0) ** 0.5)
    block = norm(now)
    while missed(now, targets) > TOLERANCE:
        ahead = [a + beta * (a - b) for a, b in zip(now, was, strict=True)]  # totals are linear in the rates
        push = [float(x) for x in inverse @ np.subtract(ahead, targets)]
        steps.append((beta, push))
        moved = _moved(F.col("rate"), F.col("_prev"), F.lit(beta), _sum([p[i] * F.lit(push[i]) for i in d]), least)
        docs = docs.withColumns({"rate": moved, "_prev": F.col("rate")})
        if len(steps) % STEPS_PER_WRITE == 0:
            docs = written(docs, "rates")  # cuts the chain of steps
        after = [float(x or 0.0) for x in docs.agg(*total(F.col("rate"))).first()]
        if norm(after) > norm(now):
            t, beta = 1.0, 0.0
        else:
            nxt = (1 + (1 + 4 * t * t) ** 0.5) / 2
            t, beta = nxt, (t - 1) / nxt
        was, now = now, after
        if len(steps) % STEPS_PER_WRITE == 0:
            if norm(now) > (1 - LEAST_GAIN) * block:
                break
            block = norm(now)
    return docs.drop("_prev"), now, steps


def missed(reached: list[float], targets: list[float]) -> float:
    """Largest residual of a domain as a share of its target; of a target of 0,
    as a share of all."""
    return max((abs(a - b) / (b if b > 0 else max(sum(targets), 1.0)) for a, b in zip(reached, targets, strict=True)), default=0.0)


def _gram(docs: DataFrame, n: int) -> np.ndarray:
    """Token-weighed products of the domains' posteriors."""
    p = [F.col("posterior")[i] for i in range(n)]
    got = docs.agg(*[F.sum(F.col("tokens") * p[i] * p[j]) for i in range(n) for j in range(n)]).first()
    return np.array([float(x or 0.0) for x in got]).reshape(n, n)


def _inverse(gram: np.ndarray) -> np.ndarray:
    """Pseudo-inverse, with the domains scaled to equal size first; a domain
    without tokens gets zeros."""
    size = np.sqrt(np.diag(gram))
    scale = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
    return np.linalg.pinv(gram * np.outer(scale, scale), rcond=1e-9, hermitian=True) * np.outer(scale, scale)


def fit(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], text_col: str = "text", id_col: str = "doc_id",
        max_training_rows: int = MAX_TRAINING_ROWS) -> tuple[Posteriors, DataFrame, list[Step]]:
    """The classifier, one row per document (doc_id, tokens, posterior, rate), and
    the steps that led to the rates."""
    known = bounded_share(labelled.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull())
                          .groupBy("doc_id").agg(F.min("domain").alias("domain")), "doc_id", max_training_rows, 2)
    known = known.withColumnRenamed("doc_id", "_labelled")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most about max_training_rows ids and names: a bounded broadcast
    train = written(plain.join(F.broadcast(known), F.col("doc_id") == F.col("_labelled")).select("domain", "text"), "labelled")
    model = Posteriors(train, "text", max_training_rows)
    rows = model.add(plain.withColumn("tokens", n_tokens("text").cast("double")), "text")
    rows = written(rows.select("doc_id", "tokens", "posterior"), "posteriors")
    names = model.domains
    if not names:
        return model, rows.withColumn("rate", F.lit(1.0)), []
    have = [float(x or 0.0) for x in rows.agg(*[F.sum(F.col("tokens") * F.col("posterior")[i]) for i in range(len(names))]).first()]
    share = shares(names, have, weights)
    fewest = max([h / s for h, s in zip(have, share, strict=True) if s > 0], default=0.0)
    # without bounds the rate is budget * (posterior . slope), so its least value says how far to raise the budget
    slope = [float(x) for x in _inverse(_gram(rows, len(names))) @ share]
    low = rows.where("tokens > 0").agg(F.min(_sum([F.col("posterior")[i] * F.lit(x) for i, x in enumerate(slope)]))).first()[0]
    extra = RAISE if not low or low <= 0 else min(RAISE, max(0.0, 1 / (low * fewest) - 1))
    first = was = None
    while True:
        targets = [fewest * (1 + extra) * s for s in share]
        fitted, reached, steps = fit_steps(rows, targets, least=1.0)
        off = missed(reached, targets)
        _LOG.log(logging.INFO if off <= TOLERANCE else logging.WARNING, "mixing: domains %s reached %s of targets %s in %d steps",
                 names, reached, targets, len(steps))
        first = first or (fitted, steps)
        if off <= TOLERANCE or not steps:
            return model, fitted, steps
        if was is not None and off > 0.98 * was:
            # no budget meets the targets: the residual stays
            return model, *first
        was, extra = off, 2 * max(extra, RAISE / 2)


def shares(names: list[str], have: list[float], weights: dict[str, float]) -> list[float]:
    """Target share by domain: the present one without a wish, the rest as wished."""
    total, wished = sum(have) or 1.0, sum(weights.get(x, 0.0) for x in names) or 1.0
    free = sum(h for x, h in zip(names, have, strict=True) if x in weights) / total
    out = [free * weights[x] / wished if x in weights else h / total for x, h in zip(names, have, strict=True)]
    return [x / (sum(out) or 1.0) for x in out]


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], text_col: str = "text",
        id_col: str = "doc_id", max_training_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, tokens, domains, posterior, rate of every document.

    ``labelled`` has (doc_id, domain); ``weights`` the wished share of tokens by
    domain, to which the domains without a wish add their present share. No rate
    is under 1, so mixing raises scarce domains and drops no row.
    """
    model, fitted, _ = fit(docs, labelled, weights, text_col, id_col, max_training_rows)
    return fitted.select("doc_id", F.col("tokens").cast("long").alias("tokens"),
                         F.array(*[F.lit(x) for x in model.domains]).cast("array<string>").alias("domains"), "posterior", "rate")


def copies(rate: Column, id_col: Column) -> Column:
    """Whole copies for a rate: its integer part, and one more with the
    probability of the fraction, drawn by a hash of the id."""
    draw = F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate + 1e-9) + (draw < rate + 1e-9 - F.floor(rate + 1e-9)).cast("long")).cast("int")


def resample(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``docs`` with every row repeated as its rate says, all columns as they came.
    No text is shuffled: the rate follows from the row's own posterior."""
    model, _, steps = fit(docs, labelled, weights)
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_did"), F.col("text").cast("string").alias("_text"))
    rows = model.add(rows, "_text").select("_row", "_did", rate_of(F.col("posterior"), steps, least=1.0).alias("_rate"))
    times = F.array_repeat(F.lit(1), copies(F.col("_rate"), F.col("_did")))
    return rows.select("_row", F.explode(times).alias("_again")).select("_row.*")
