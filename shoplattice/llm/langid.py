"""Language spans of mixed-language text: script ranges narrow the candidates, then Viterbi over per-word scores.

Learned from texts with a known language: per language, hashed runs of one to three characters of all words (a fixed number of bins, so
the model's size depends on the languages alone) and the scripts its letters use. A word's candidates are the languages
that use its script; its score under each is the sum of its grams' log-likelihoods. The best path over the words pays a
penalty for each change of language, so that single odd words don't split a span.

Defined results: null text and text without letters is ``und`` with score 0; ties go to the language that sorts first;
without a single learned language every text is ``und``; repeated rows come back repeated; only doc_id, text and, for
learning, lang are read.
"""
from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplattice.llm.common import slices

BINS = 1 << 15
SWITCH_PENALTY = 6.0
UNKNOWN = "und"
#: Share of a language's letters that a script needs to count as one of the language's scripts.
SCRIPT_SHARE = 0.001
WORD_MEMORY = 150_000
_CELLS = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")

# First and last code point of script ranges.
SCRIPTS: tuple[tuple[str, int, int], ...] = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x2FA1F),
)
_NAMES = sorted({name for name, _, _ in SCRIPTS}) + ["other"]


_FIRST, _LAST, _SCRIPT = (np.array(c) for c in zip(*sorted((first, last, _NAMES.index(name)) for name, first, last in SCRIPTS)))
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def scripts(words: list[str]) -> np.ndarray:
    """The script of each word's first letter."""
    points = np.array([ord(w[0]) for w in words], np.int64)
    at = np.maximum(np.searchsorted(_FIRST, points, side="right") - 1, 0)
    return np.where((points >= _FIRST[at]) & (points <= _LAST[at]), _SCRIPT[at], len(_NAMES) - 1)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all words' runs of one to three characters, with the words' ends marked, and the word of each bin."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    word, stop = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(points))
    bins, owners, run = [], [], np.zeros(len(points), np.uint64)
    for size in (1, 2, 3):
        run = run[:len(points) - size + 1] + points[size - 1:] * _MIX[size - 1]
        inside = place[:len(run)] + size <= stop[:len(run)]
        bins.append(((run[inside] * _MIX[0] + np.uint64(size)) * _MIX[1] >> np.uint64(40)).astype(np.int64) % BINS)
        owners.append(word[:len(run)][inside])
    return np.concatenate(bins), np.concatenate(owners)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return [w for w in _WORD.findall((text or "").lower()) if w.isascii() or any(map(str.isalpha, w))]


@dataclass(frozen=True)
class Model:
    """``weights``: log-likelihood by bin and language; ``uses``: by script and language, whether the language uses it."""
    languages: list[str]
    weights: np.ndarray
    uses: np.ndarray


def learn(labelled: DataFrame) -> Model:
    """The model of all rows of ``labelled`` (text, lang). Each task adds up its own bins, of which there are at most BINS
    for a language, before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        bins: dict[str, np.ndarray] = {}

        def add(lang: str) -> None:
            words, n = list(seen[lang]), np.fromiter(seen[lang].values(), np.int64, len(seen[lang]))
            if words:
                total = bins.setdefault(lang, np.zeros(BINS + len(_NAMES)))
                at, owner = grams(words)
                total[:BINS] += np.bincount(at, n[owner], BINS)
                total[BINS:] += np.bincount(scripts(words), n * np.array([len(w) for w in words]), len(_NAMES))
            seen[lang].clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts = seen.setdefault(lang, Counter())
                counts.update(words_of(text))
                if len(counts) > WORD_MEMORY:
                    add(lang)
        for lang in seen:
            add(lang)
        for lang, total in bins.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at].astype(np.int64))], ["lang", "bin", "n"])

    counted = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null").mapInArrow(run, "lang string, bin bigint, n bigint")
    rows = counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()  # BINS rows a language at most
    languages = sorted({row["lang"] for row in rows})
    total = np.zeros((BINS + len(_NAMES), len(languages)))
    for row in rows:
        total[row["bin"], languages.index(row["lang"])] = row["n"]
    counts, letters = total[:BINS], total[BINS:]
    weights = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BINS)) if languages else counts
    uses = letters > SCRIPT_SHARE * letters.sum(0)
    return Model(languages, weights.astype(np.float32), uses)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Score of each word under each language, the best one zero. Languages that don't use the word's script fall behind
    all that do; a script that no language uses decides nothing."""
    at, owner = grams(words)
    counts = np.bincount(owner, minlength=len(words))
    means = np.column_stack([np.bincount(owner, model.weights[at, lang], len(words)) for lang in range(len(model.languages))]) / counts[:, None]
    scores = means * np.minimum(counts, 12)[:, None]
    can = model.uses[scripts(words)]
    barred = ~can & can.any(1)[:, None]
    scores = np.where(barred, np.where(can, scores, np.inf).min(1, keepdims=True) - 20, scores)
    return (scores - scores.max(1, keepdims=True)).astype(np.float32)


def best_paths(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word of several texts at once: ``scores`` is text by word by language, zero past the end."""
    texts, longest, languages = scores.shape
    stays = np.zeros((longest, texts, languages), bool)
    leaders = np.zeros((longest, texts), np.int16)
    value = scores[:, 0].astype(np.float64)
    for at in range(1, longest):
        leader = value.argmax(1)
        change = value[np.arange(texts), leader] - penalty
        stay = value >= change[:, None]
        stays[at], leaders[at] = stay, leader
        value = np.where(stay, value, change[:, None]) + scores[:, at]
    path = np.zeros((texts, longest), np.int16)
    now = value.argmax(1)
    for at in range(longest - 1, -1, -1):
        path[:, at] = now
        now = np.where(stays[at][np.arange(texts), now], now, leaders[at])
    return path


def label(texts: list[str | None], model: Model) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, its share of the letters, and the spans (first word, words, language) of each text."""
    number: dict[str, int] = defaultdict(count().__next__)
    rows = [[number[w] for w in words_of(text)] for text in texts] if model.languages else [[] for _ in texts]
    found: list = [(UNKNOWN, 0.0, [])] * len(texts)
    if not number:
        return found
    words = list(number)
    table, sizes = word_scores(words, model), np.array([len(w) for w in words])
    order = sorted((n for n in range(len(texts)) if rows[n]), key=lambda n: len(rows[n]))
    while order:
        longest = len(rows[order[-1]])
        several = order[-max(1, _CELLS // (longest * len(model.languages))):]
        del order[-len(several):]
        block = np.zeros((len(several), longest, len(model.languages)), np.float32)
        for place, n in enumerate(several):
            block[place, :len(rows[n])] = table[rows[n]]
        paths = best_paths(block, np.array([len(rows[n]) for n in several]), SWITCH_PENALTY)
        for place, n in enumerate(several):
            path = paths[place, :len(rows[n])]
            weight = np.bincount(path, sizes[rows[n]], len(model.languages))
            starts = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
            spans = [(int(a), int(b - a), model.languages[path[a]]) for a, b in zip(starts, np.append(starts[1:], len(path)))]
            found[n] = (model.languages[int(weight.argmax())], float(weight.max() / weight.sum()), spans)
    return found


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters in spans of that language) and ``spans`` of every whole text. The
    model is sent along; it has BINS rows and a column for each language, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2500):
            found = label(part.column("text").to_pylist(), shared.value)
            spans = [[{"first_word": a, "words": n, "lang": lang} for a, n, lang in spans] for _, _, spans in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, kind)],
                                             ["doc_id", "lang_pred", "score", "spans"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<first_word:int,words:int,lang:string>>")
