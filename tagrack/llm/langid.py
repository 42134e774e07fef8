"""Language identification, words first.

A known word is scored by its log frequency in each language. An unseen word
falls back to its character n-grams: the longest order at which any of its
n-grams is known, then shorter ones, gives the mean log frequency of the known
n-grams. A text's score is the sum over its words.

Words are runs of letters, lower-cased. The model keeps words and n-grams that
make up at least ``LEAST_SHARE`` of their kind, so it has a fixed greatest size
whatever the corpus.

Defined cases. A null text, or one without a letter, is ``und`` with score 0.
Rows with null language, null id or null text are not learnt from; without any training
row every text is ``und``. Ties go to the alphabetically first language. Repeated rows
are predicted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_share, crc_mod, small_batches, written

# Documented bounds: word and n-gram frequencies come from about this many labelled
# rows, and a word or n-gram below this share of every language's is left out of the model.
MAX_TRAINING_ROWS = 30_000
LEAST_SHARE = 1 / 1_000_000
ORDERS = (5, 4, 3, 2, 1)
HELD_OUT_FOLD, FOLDS = 2, 4
SMOOTH = 0.2
_WORD = re.compile(r"[^\W\d_]+")
_FLUSH = 500_000
_CACHE = 200_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters, of Unicode's letter categories only, lower-cased."""
    out = []
    for w in _WORD.findall((text or "").lower()):
        if w.isalpha():
            out.append(w)
        else:  # fractions, powers and numbers in circles stand among what \w takes
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def grams(word: str, n: int) -> list[str]:
    """Character n-grams with the word's ends marked by a space."""
    padded = f" {word} " if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, Counter] = defaultdict(Counter)

    def flush() -> pd.DataFrame:
        rows = []
        for lang, counted in held.items():
            parts: Counter = Counter()
            for word, n in counted.items():
                for order in ORDERS:
                    for g in grams(word, order):
                        parts[(order, g)] += n
            rows += [(lang, 0, w, n) for w, n in counted.items()]
            rows += [(lang, order, g, n) for (order, g), n in parts.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["lang", "kind", "item", "n"])

    for pdf in frames:
        for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
            held[lang].update(words_of(text))
        if sum(map(len, held.values())) > _FLUSH:
            yield flush()
    if held:  # an empty frame would have no column types
        yield flush()


class Model:
    """Log frequencies: ``table`` rows by ``index[(kind)][item]``, one column per language."""

    def __init__(self, langs: list[str], items: list[tuple[int, str]], table: np.ndarray):
        self.langs = langs
        self.index: dict[int, dict[str, int]] = defaultdict(dict)
        for i, (kind, item) in enumerate(items):
            self.index[kind][item] = i
        self.table = table

    def unseen(self, word: str) -> np.ndarray:
        for order in ORDERS:
            known = [i for g in grams(word, order) if (i := self.index[order].get(g)) is not None]
            if known:
                return self.table[known].mean(axis=0)
        return np.zeros(len(self.langs))

    def predict(self, texts: Iterator[str | None]) -> Iterator[tuple[str, float]]:
        known, base = self.index[0], len(self.table)
        memory: dict[str, int] = {}
        rows = np.vstack([self.table, np.zeros((_CACHE, len(self.langs)))]) if self.langs else None
        for text in texts:
            words = words_of(text)
            if not words or rows is None:
                yield "und", 0.0
                continue
            ids = []
            for w in words:
                i = known.get(w)
                if i is None and (i := memory.get(w)) is None:
                    if len(memory) == _CACHE:
                        ids = [self._sum(rows, ids)]
                        memory.clear()
                    i = memory[w] = base + len(memory)
                    rows[i] = self.unseen(w)
                ids.append(i)
            score = self._sum(rows, ids)
            best = int(np.argmax(score))
            yield self.langs[best], float(1 / np.exp(score - score[best]).sum())

    @staticmethod
    def _sum(rows: np.ndarray, ids: list) -> np.ndarray:
        """Sum of rows; an earlier partial sum may stand first."""
        if ids and isinstance(ids[0], np.ndarray):
            return ids[0] + rows[ids[1:]].sum(axis=0)
        return rows[ids].sum(axis=0)


def fit(docs: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS) -> Model:
    train = small_batches(docs).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        "lang is not null and text is not null and doc_id is not null").where(crc_mod("doc_id", FOLDS) != HELD_OUT_FOLD)
    train = bounded_share(train, "doc_id", max_training_rows, 1)
    counts = written(train.select("lang", "text").mapInPandas(_count, "lang string, kind int, item string, n long")
                     .groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")), "lang_counts")
    totals = {(r["kind"], r["lang"]): r["n"] for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for _, lang in totals})
    if not langs:
        return Model([], [], np.zeros((0, 0)))
    # an item stays if it reaches LEAST_SHARE within one of its languages, so a
    # kind has at most languages / LEAST_SHARE items and a rare language keeps its words
    least = F.element_at(F.create_map(*[x for (k, lang), n in sorted(totals.items())
                                        for x in (F.lit(f"{k} {lang}"), F.lit(n * LEAST_SHARE))]), F.concat_ws(" ", "kind", "lang"))
    by = counts.withColumn("often", F.col("n") >= least).groupBy("kind", "item").agg(
        F.sum("n").alias("n"), F.max("often").alias("often"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    rows = by.where(F.col("often") & (F.col("n") >= 2)).select(
        "kind", "item", *[F.coalesce(F.col("by")[x], F.lit(0)).cast("double").alias(f"n{i}") for i, x in enumerate(langs)]).toPandas()
    rows = rows.sort_values(["kind", "item"], ignore_index=True)
    table = rows[[f"n{i}" for i in range(len(langs))]].to_numpy(float)
    kinds = rows["kind"].to_numpy()
    for kind in sorted(set(kinds.tolist())):
        here = kinds == kind
        total = np.array([totals.get((kind, x), 0) for x in langs], float)
        table[here] = np.log((table[here] + SMOOTH) / (total + SMOOTH * max(here.sum(), 1)))
    return Model(langs, list(zip(kinds.tolist(), rows["item"], strict=True)), table)


def predict_language(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = list(sent.value.predict(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [x for x, _ in out], "score": [s for _, s in out]})

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInPandas(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    out = predict_language(docs, fit(docs))
    return out.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT_FOLD).alias("held_out"), "lang_pred", "score")
