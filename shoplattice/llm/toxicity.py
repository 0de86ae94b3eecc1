"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another; each model also sees the probabilities of the categories before it.
While it is fitted, those are out-of-fold predictions, made by models that had not seen the row, so that a later model
learns how far an earlier one can be trusted: neither their weights nor their grams come from rows of its fold. Folds go by
the text, so copies of a text share one.

Features: character grams of words, chosen by how strongly they go with a category among the training rows,
each counted once per text, and a few measures of form. At most ``MAX_TRAINING`` labelled documents are used to fit
(a documented bound, taken by hash of doc_id, so that the choice doesn't depend on the order of rows); everything is
scored.

Defined results: null and empty texts have no grams and are scored by their form; a null label keeps the row out of that
category's fit; a category without both kinds of labelled rows gets their share (0 without rows) as its probability for
every text; of repeated label rows the smallest values count, of several texts with one doc_id the smallest;
repeated documents come back repeated; columns other than doc_id, text and the labels are not read.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplattice.llm.common import id_and_text, slices
from shoplattice.session import materialise

MAX_TRAINING = 20_000
FEATURES = 1500
FOLDS = 3
#: A gram has to occur in this many training rows.
LEAST_ROWS = 5
FORM = 5
_FLUSH = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def grams(word: str) -> set[str]:
    """The whole word and its runs of 4 to 6 characters, with its ends marked."""
    marked = f"<{word}>"
    return {marked} | {marked[at:at + size] for size in (4, 5, 6) for at in range(len(marked) - size + 1)}


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def form(text: str) -> list[float]:
    """Share of symbols, capitals, digits and repeated words, and the logarithm of the number of words; all in [0, 2]."""
    n = max(1, len(text))
    symbols = sum(map(text.count, "#*$%&|<>!"))
    capitals = len(text) - len(text.translate(_NO_CAPITALS))
    digits = len(text) - len(text.translate(_NO_DIGITS))
    words = text.split()
    return [symbols / n * 4, min(1.0, capitals / n), digits / n, 1 - len(set(words)) / max(1, len(words)), np.log1p(len(words)) / 6]


_NO_CAPITALS, _NO_DIGITS = dict.fromkeys(range(65, 91)), dict.fromkeys(range(48, 58))


@dataclass
class Chain:
    """``features``: gram to column; ``models``: a weight for each gram, measure, earlier category and the constant."""
    categories: list[str]
    features: dict[str, int]
    models: list[np.ndarray] = field(default_factory=list)

    def probabilities(self, columns: list[int], measures: list[float]) -> list[float]:
        known: list[float] = []
        for weights in self.models:
            n = len(self.features)
            odds = weights[columns].sum() + weights[n:n + FORM] @ measures + weights[n + FORM:-1] @ known + weights[-1]
            known.append(float(1 / (1 + np.exp(-np.clip(odds, -35, 35)))))
        return known


def fit_linear(rows: np.ndarray, columns: np.ndarray, n_features: int, dense: np.ndarray, truth: np.ndarray, rounds: int = 300, ridge: float = 2e-4) -> np.ndarray:
    """Logistic regression over sparse grams (pairs row, column) and dense columns, by full-batch gradient steps with
    adaptive rates. Rows with an unknown truth (NaN) don't count."""
    known = ~np.isnan(truth)
    if not known.any() or truth[known].min() == truth[known].max():
        share = np.clip(truth[known].mean() if known.any() else 0.0, 1e-9, 1 - 1e-9)
        weights = np.zeros(n_features + dense.shape[1] + 1)
        weights[-1] = np.log(share / (1 - share))
        return weights
    n = len(truth)
    weights = np.zeros(n_features + dense.shape[1] + 1)
    weights[-1] = np.log(truth[known].mean() / (1 - truth[known].mean()))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        odds = np.bincount(rows, weights[columns], n) + dense @ weights[n_features:-1] + weights[-1]
        error = np.where(known, 1 / (1 + np.exp(-np.clip(odds, -35, 35))) - truth, 0) / known.sum()
        slope = np.concatenate([np.bincount(columns, error[rows], n_features), dense.T @ error, [error.sum()]])
        slope[:-1] += ridge * weights[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        weights -= 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-9)
    return weights


def fit_chain(categories: list[str], features: dict[str, int], texts: list[tuple[list[int], list[float], int]], truth: np.ndarray,
              chosen: list[set[int]] | None = None) -> Chain:
    """``texts``: columns, measures and fold of each row; ``truth``: row by category, NaN where unknown; ``chosen``: for each
    fold the columns that were chosen without its rows (none given: the features), which may lie behind the features."""
    chain = Chain(categories, features)
    n, size = len(texts), len(features)
    rows = np.repeat(np.arange(n), [len(t[0]) for t in texts])
    columns = np.array([c for t in texts for c in t[0]], np.int64)
    dense = np.array([t[1] for t in texts], float).reshape(n, FORM)
    folds = np.array([t[2] for t in texts])
    width = max([size, *(1 + max(some, default=-1) for some in chosen or [])])
    own = columns < size
    apart = [np.isin(columns, np.array(sorted(some), np.int64)) for some in chosen] if chosen else [own] * FOLDS
    for at in range(len(categories)):
        target = truth[:, at]
        outside = np.zeros(n)
        for fold in range(FOLDS):
            some, those = rows[apart[fold]], columns[apart[fold]]
            weights = fit_linear(some, those, width, dense, np.where(folds == fold, np.nan, target))
            odds = np.bincount(some, weights[those], n) + dense @ weights[width:-1] + weights[-1]
            outside = np.where(folds == fold, 1 / (1 + np.exp(-np.clip(odds, -35, 35))), outside)
        chain.models.append(fit_linear(rows[own], columns[own], size, dense, target))
        dense = np.column_stack([dense, outside])
    return chain


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, str], most: int = MAX_TRAINING) -> DataFrame:
    """doc_id, text, ``__fold`` and a column of 0, 1 or null for each category, of at most ``most`` labelled documents."""
    known = labels.select("doc_id", *(F.expr(value).cast("double").alias(name) for name, value in categories.items())).where("doc_id is not null")
    each = known.groupBy("doc_id").agg(*(F.min(name).alias(name) for name in categories))
    chosen = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = id_and_text(docs).join(F.broadcast(chosen), "doc_id")  # ``most`` short rows
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), *(F.min(name).alias(name) for name in categories))
    return rows.withColumn("__fold", F.crc32(F.coalesce("text", F.lit(""))) % FOLDS)


def _counted(training: DataFrame, categories: list[str]) -> DataFrame:
    """gram, ``__fold``, ``__n`` rows with it, and for each category the rows with it and the label."""
    names = ["__n", *categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [[Counter() for _ in names] for _ in range(FOLDS)]

        def out(fold: int) -> pa.RecordBatch:
            grams_seen = list(counts[fold][0])
            batch = pa.RecordBatch.from_arrays([
                pa.array(grams_seen, pa.string()), pa.array([fold] * len(grams_seen), pa.int64()),
                *(pa.array([c[g] for g in grams_seen], pa.int64()) for c in counts[fold])], ["gram", "__fold", *names])
            for c in counts[fold]:
                c.clear()
            return batch

        for batch in batches:
            marks = [batch.column(c).to_pylist() for c in categories]
            for nth, (text, fold) in enumerate(zip(batch.column("text").to_pylist(), batch.column("__fold").to_pylist())):
                found = {g for word in words_of(text or "") for g in grams(word)}
                counts[fold][0].update(found)
                for count, mark in zip(counts[fold][1:], marks):
                    if mark[nth]:
                        count.update(found)
                if len(counts[fold][0]) > _FLUSH:
                    yield out(fold)
        yield from map(out, range(FOLDS))

    schema = ", ".join(["gram string", "__fold bigint", *(f"`{c}` bigint" for c in names)])
    counted = training.select("text", "__fold", *categories).mapInArrow(run, schema)
    return counted.groupBy("gram", "__fold").agg(*(F.sum(c).alias(c) for c in names))


def _chosen(training: DataFrame, categories: list[str]) -> tuple[dict[str, int], int, list[set[int]]]:
    """The FEATURES grams of each category with the largest log odds over their standard error: chosen from all rows (the
    first columns, with their number), and for each fold the columns chosen from the rows outside it."""
    sums = ["__n", *categories]
    sizes = training.groupBy("__fold").agg(F.count("*").alias("__n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in categories)).collect()  # a row a fold
    counted = materialise(_counted(training, categories), "toxic-grams")
    columns: dict[str, int] = {}

    def pick(without: int | None) -> set[int]:
        size = {c: sum(r[c] for r in sizes if r["__fold"] != without) for c in sums}
        each = (counted if without is None else counted.where(F.col("__fold") != without)).groupBy("gram").agg(*(F.sum(c).alias(c) for c in sums))
        each = each.where(F.col("__n") >= LEAST_ROWS)
        picked = set()
        for c in categories:
            with_label, others = F.col(c) + 0.5, F.col("__n") - F.col(c) + 0.5
            odds = F.log(with_label / (size[c] + 1)) - F.log(others / (size["__n"] - size[c] + 1))
            strength = odds / F.sqrt(1 / with_label + 1 / others)
            for row in each.select("gram", strength.alias("z")).where("z > 3").orderBy(F.desc("z"), "gram").limit(FEATURES).collect():
                picked.add(columns.setdefault(row["gram"], len(columns)))
        return picked

    own = len(pick(None))
    return columns, own, [pick(fold) for fold in range(FOLDS)]


class _Columns:
    """Feature columns of texts: all features are looked for at once in a text's distinct words."""

    def __init__(self, features: dict[str, int]):
        self.automaton = ahocorasick.Automaton()
        for gram, column in features.items():
            self.automaton.add_word(gram, column)
        self.automaton.make_automaton()

    def of(self, text: str) -> list[int]:
        if not len(self.automaton):
            return []
        return sorted({column for _, column in self.automaton.iter(f"<{'><'.join(words_of(text))}>")})


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], most: int = MAX_TRAINING) -> Chain:
    """The chain over ``categories``, in their order (name: SQL expression over ``labels``, 0 or 1)."""
    names = list(categories)
    training = materialise(training_rows(docs, labels, categories, most), "toxic-training")
    every, own, chosen = _chosen(training, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Columns(every)
        for batch in slices(batches):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([memory.of(t) for t in texts], pa.list_(pa.int64())), pa.array([[float(x) for x in form(t)] for t in texts], pa.list_(pa.float64())),
                batch.column("__fold"), *(batch.column(c) for c in names)], ["doc_id", "__columns", "__measures", "__fold", *names])

    kind = training.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, __columns array<bigint>, __measures array<double>, __fold bigint, " + ", ".join(f"`{c}` double" for c in names)
    rows = sorted(training.select("doc_id", "text", "__fold", *names).mapInArrow(run, schema).collect(), key=lambda r: r["doc_id"])  # ``most`` rows
    truth = np.array([[np.nan if r[c] is None else r[c] for c in names] for r in rows], float).reshape(len(rows), len(names))
    features = {gram: column for gram, column in every.items() if column < own}
    return fit_chain(names, features, [(r["__columns"], r["__measures"], r["__fold"]) for r in rows], truth, chosen)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with ``toxicity``, a struct of one probability for each category; a column of docs of this name is left
    out. The chain is sent along; its size is bounded by the features."""
    names = [c for c in docs.columns if c != "toxicity"]
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    kind = pa.struct([(c, pa.float64()) for c in chain.categories])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        memory = _Columns(chain.features)
        for batch in slices(batches):
            rows = [dict(zip(chain.categories, chain.probabilities(memory.of(text or ""), form(text or "")))) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, kind)], [*names, "toxicity"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    inner = ", ".join(f"`{c}`: double" for c in chain.categories)
    return docs.select(*names).mapInArrow(run, f"{schema}, toxicity struct<{inner}>")
