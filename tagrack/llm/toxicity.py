"""Toxicity by weak supervision.

Many voters look at a text: lists of insults, words and word beginnings that
the labelled rows show to be telling, and a few patterns. A generative label
model estimates how often each voter fires on toxic and on clean texts and how
voters depend on each other given the class; dependent voters share their
weight. Its posterior, not the raw label, trains a linear classifier, which
scores every text.

Defined cases. A null or empty text scores the classifier's intercept; a text
without letters likewise. Several label rows of one document count as toxic if
any is. Null labels, and labels of unknown documents, are ignored. Without a
labelled row of each class every score is 0. Null ids are never learnt from but
are scored. Empty tables give no rows; extra columns do no harm.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_share, crc_mod, small_batches, written

# Documented bounds of fitting: about this many labelled rows, of which the most telling
# words and beginnings vote, and the most telling features are the classifier's.
MAX_TRAINING_ROWS = 20_000
MAX_VOTERS = 300
MAX_FEATURES = 3_000
STEMS = range(4, 9)
HELD_OUT_FOLD, FOLDS = 0, 5
# Common insults and slurs of contempt, one voter per list.
LEXICONS = {
    "people": "idiot moron loser clown imbecile fool jerk scum creep pig rat",
    "qualities": "stupid dumb pathetic worthless disgusting useless ugly vile repulsive",
    "things": "trash garbage rubbish filth crap vermin",
    "german": "dumm idiotin trottel dreck arsch widerlich abschaum versager",
    "french": "imbécile stupide ordure crétin connard minable répugnant",
    "spanish": "idiota estúpido basura imbécil asqueroso inútil patético",
}
_WORD = re.compile(r"[^\W\d_]+")
_FLUSH = 400_000


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _names(word: str) -> list[str]:
    """The word itself and its beginnings, marked with a hyphen."""
    return [word, *(word[:n] + "-" for n in STEMS if n < len(word))]


def _patterns(words: set[str], text: str) -> list[str]:
    hits = [name for name, listed in _LISTS.items() if words & listed]
    out = [f"list:{name}" for name in hits]
    if len(set().union(*(_LISTS[h] & words for h in hits))) > 1:
        out.append("list:several")
    if text.count("!") > 2 and hits:
        out.append("pattern:shouted")
    return out


_LISTS = {name: frozenset(words.split()) for name, words in LEXICONS.items()}


def _features(text: str | None) -> set[str]:
    words = words_of(text)
    out = set(_patterns(words, text or ""))
    for w in words:
        out.update(_names(w))
    return out


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    by = Counter(), Counter()

    def flush():
        names = list(by[0].keys() | by[1].keys())
        out = pd.DataFrame({"name": names, "clean": [by[0][x] for x in names], "toxic": [by[1][x] for x in names]})
        by[0].clear(), by[1].clear()
        return out

    for pdf in frames:
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            by[toxic].update(_features(text))
            if len(by[0]) + len(by[1]) > _FLUSH:
                yield flush()
    if by[0] or by[1]:  # an empty frame would have no column types
        yield flush()


def _vectors(vocabulary: dict[str, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"toxic": pdf["toxic"], "ids": [
                sorted(vocabulary[x] for x in _features(t) if x in vocabulary) for t in pdf["text"]]})
    return run


@dataclass
class Model:
    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = -np.inf

    def scores(self, texts) -> list[float]:
        if not self.vocabulary:
            return [0.0] * len(texts)
        known: dict[str, tuple[int, ...]] = {}
        out = []
        for text in texts:
            words = words_of(text)
            hit = {self.vocabulary[x] for x in _patterns(words, text or "") if x in self.vocabulary}
            for w in words:
                ids = known.get(w)
                if ids is None:
                    if len(known) > _FLUSH:
                        known.clear()
                    ids = known[w] = tuple(self.vocabulary[x] for x in _names(w) if x in self.vocabulary)
                if ids:
                    hit.update(ids)
            z = self.intercept + self.weights[sorted(hit)].sum()
            out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
        return out


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of toxic per row, and each voter's weight.

    ``votes`` is rows x voters, 1 where a voter fires. EM over firing rates
    given the class, the given label being one more voter of estimated
    accuracy. A voter's weight is one over one plus its positive correlations
    with the other voters inside the classes.
    """
    votes = votes.astype(np.float32)
    post = np.where(labels == 1, 0.95, 0.05)
    weight = np.ones(votes.shape[1])
    for _ in range(rounds):
        mass = max(post.sum(), 1e-9), max((1 - post).sum(), 1e-9)
        rate = [(post @ votes + 0.1) / (mass[0] + 1), ((1 - post) @ votes + 0.1) / (mass[1] + 1)]
        # votes less what the classes explain, in place: this is the largest array here
        spread = votes - (rate[1] + post[:, None].astype(np.float32) * (rate[0] - rate[1]).astype(np.float32)).astype(np.float32)
        cov = (spread.T @ spread).astype(float) / len(votes)
        del spread
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = cov / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + np.maximum(corr, 0).sum(axis=1))
        gold = np.clip((post @ (labels == 1) + (1 - post) @ (labels == 0)) / len(labels), 0.6, 0.99)
        odds = np.log(mass[0] / mass[1]) + np.where(labels == 1, 1, -1) * np.log(gold / (1 - gold))
        odds = odds + votes @ (weight * np.log(rate[0] / rate[1]))  # a voter that does not fire abstains
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, weight


def logistic(rows: np.ndarray, cols: np.ndarray, target: np.ndarray, width: int, steps: int = 400,
             ridge: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and intercept for a 0/1 matrix given by its ones; targets are
    probabilities. Adam over all rows, deterministic."""
    n = len(target)
    w, mean, square = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    base = np.clip(target.mean(), 1e-4, 1 - 1e-4)
    w[width] = np.log(base / (1 - base))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], n) + w[width], -30, 30)))
        err = p - target
        grad = np.append(np.bincount(cols, err[rows], width), err.sum()) + ridge * np.append(w[:width], 0)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        w -= 0.1 / (1 + t / 100) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return w[:width], float(w[width])


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
        max_training_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Fit on labelled rows outside the held-out fold, about
    ``max_training_rows`` of them, chosen by a hash of the id."""
    known = (labels.where("toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
             .where((crc_mod("doc_id", FOLDS) != HELD_OUT_FOLD) & F.col("doc_id").isNotNull()))
    known = bounded_share(known, "doc_id", max_training_rows, 4).withColumnRenamed("doc_id", "_labelled")
    # at most about max_training_rows pairs of numbers, so the broadcast is bounded
    train = written(small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
                    .join(F.broadcast(known), F.col("_id") == F.col("_labelled")).select("text", "toxic"), "toxic_rows")
    size = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    clean, toxic = size.get(0, 0), size.get(1, 0)
    if not clean or not toxic:
        return Model()

    seen = (train.mapInPandas(_counts, "name string, clean long, toxic long")
            .groupBy("name").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    z = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    telling = (seen.where("toxic + clean >= 3").select("name", odds.alias("odds"), z.alias("z"))
               .orderBy(F.abs("z").desc(), "name").limit(MAX_FEATURES).collect())
    vocabulary = {r["name"]: i for i, r in enumerate(telling)}
    voters = [i for i, r in enumerate(telling) if r["odds"] > 1.0 and r["z"] > 2.5][:MAX_VOTERS]
    matrix = train.mapInPandas(_vectors(vocabulary), "toxic int, ids array<int>").toPandas()
    rows = np.repeat(np.arange(len(matrix)), matrix["ids"].map(len))
    cols = np.concatenate([*matrix["ids"], np.zeros(0, int)]).astype(int)
    labels_ = matrix["toxic"].to_numpy()
    place = np.full(len(vocabulary), -1)
    place[voters] = np.arange(len(voters))
    fired = place[cols] >= 0
    votes = np.zeros((len(matrix), len(voters)), np.float32)
    votes[rows[fired], place[cols[fired]]] = 1
    post, _ = label_model(votes, labels_)
    weights, intercept = logistic(rows, cols, post, len(vocabulary))
    return Model(vocabulary, weights, intercept)


def score_column(model: Model, text: Column) -> Column:
    """Score of every whole text, 0 to 1; higher is likelier toxic."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts), dtype=float)
    return score(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    scored = docs.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT_FOLD).alias("held_out"),
                         score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, all columns as they came."""
    model = fit(docs, labels)
    rows = docs.select(F.struct("*").alias("_row"), score_column(model, F.col("text")).alias("_score"))
    return rows.where("_score < 0.5").select("_row.*")
