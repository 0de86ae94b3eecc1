"""Quality rules as weak supervision.

Each rule votes ``+`` (good) or ``-`` (bad) on a document, or abstains (``0``). Expectation-maximisation over the counted
vote patterns estimates how often each rule is right, and a document's posterior probability of being good decides,
instead of the demand that every rule passes. The patterns number at most 3 to the power of the rules, whatever the
input, so only their counts reach the driver; votes and counts cover all documents.

Defined results: null, empty and blank texts have no words and fail the base rules; repeated rows come back repeated; an
empty table gives no rows; columns other than doc_id and text are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplattice.llm.common import id_and_text, slices, utf8
from shoplattice.session import materialise

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
RULES = ("length", "word_size", "symbols", "duplicate_lines", "repeated_words", "capitals", "sentence_ends", "marks", "variety")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_NOT_STARTS = _SPACES + bytes(range(0x80, 0xC0))
_CAPITALS, _SMALL = bytes(range(65, 91)), bytes(range(97, 123))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_ENDS = (b".", b"!", b"?", b'"', b":")
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words that the text holds twice or more, the first included."""
    starts = len(words) - window + 1
    if starts < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = sum(hashes[at:at + starts] * np.uint64(_MIX[at % 5] + np.uint64(2 * (at // 5))) for at in range(window))
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # equal windows have equal hashes
    number = dict(zip(dict.fromkeys(words), count()))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    code = ids[:starts]
    for at in range(1, window):  # exact: each step numbers the distinct windows of one word more
        code = np.unique(code * len(number) + ids[at:at + starts], return_inverse=True)[1]
    twice = (np.bincount(code) > 1)[code]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def _size(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def _vote(good: bool, bad: bool) -> str:
    return "-" if bad else "+" if good else "0"


def judge(text: bytes) -> tuple[int, int, int, int, int, str]:
    """The five measures and one vote per rule, in the order of RULES."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _NOT_STARTS))
    symbols = _size(text, SYMBOLS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    twice = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    big, small, marks = _size(text, _CAPITALS), _size(text, _SMALL), _size(text, _MARKS)
    ended = sum(line.rstrip().endswith(_ENDS) for line in lines)
    distinct = len(set(words))
    votes = (
        _vote(n >= 50, n < 10),
        _vote(3 * n <= chars <= 10 * n, n == 0 or chars < 2 * n or chars > 15 * n),
        _vote(100 * symbols <= n, 10 * symbols > n),
        _vote(twice == 0, 10 * twice > 3 * len(lines)),
        _vote(20 * repeated <= n, 5 * repeated > n),
        _vote(10 * big <= big + small, 2 * big > big + small),
        _vote(2 * ended >= len(lines) > 0, 10 * ended < len(lines)),
        _vote(10 * marks <= chars, 4 * marks > chars),
        _vote(10 * distinct >= 3 * n > 0, n >= 50 and 10 * distinct < n),
    )
    return n, chars, symbols, twice, repeated, "".join(votes)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and ``votes`` of every whole text."""
    names = ["doc_id", *MEASURES, "votes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            judged = list(zip(*map(judge, utf8(batch.column("text"))))) or [[]] * 6
            columns = [pa.array(list(c), pa.int64()) for c in judged[:5]] + [pa.array(list(judged[5]), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    source = id_and_text(docs)
    counts = ", ".join(f"{name} bigint" for name in MEASURES)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {counts}, votes string")


def estimate(patterns: list[tuple[str, int]], rounds: int = 1000) -> tuple[float, list[float], dict[str, float]]:
    """Share of good documents, accuracy of each rule and posterior of each vote pattern, by expectation-maximisation
    until nothing changes (``rounds`` at most).

    Each rule has a rate of good votes, bad votes and abstentions among good documents, and another among bad ones; rules
    err independently. So a rule that approves of nearly everything says little, and one that seldom rejects good
    documents says much when it rejects. The start takes documents without a bad vote for good ones and halves the belief
    with every bad vote. A rule's accuracy is the share of its votes that agree with the posterior; rules that reject more
    of the good documents than of the bad ones keep the same rate for both, so that no rule turns into its opposite."""
    if not patterns:
        return 0.5, [], {}
    weight = np.array([n for _, n in patterns], float)
    votes = np.array([["+-0".index(v) for v in pattern] for pattern, _ in patterns])
    cast = np.eye(3)[votes]  # pattern, rule, kind of vote
    posterior = 0.95 * 0.5 ** (votes == 1).sum(1)
    for _ in range(rounds):
        share = float(np.clip((weight * posterior).sum() / weight.sum(), 0.05, 0.95))
        rates = []
        for belief in (posterior, 1 - posterior):
            total = np.einsum("p,prk->rk", weight * belief, cast) + np.array([1.0, 1.0, 1.0])
            rates.append(total / total.sum(1, keepdims=True))
        good, bad = rates
        turned = good[:, 1] > bad[:, 1]
        bad = np.where(turned[:, None], good, bad)
        odds = np.log(share / (1 - share)) + (cast * np.log(good / bad)).sum((1, 2))
        before, posterior = posterior, 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        if np.abs(posterior - before).max() < 1e-9:
            break
    agreed = weight @ np.where(votes == 0, posterior[:, None], np.where(votes == 1, 1 - posterior[:, None], 0))
    accuracy = (agreed + 0.5) / (weight @ (votes < 2) + 1)
    return share, accuracy.tolist(), {pattern: float(p) for (pattern, _), p in zip(patterns, posterior)}


def score(docs: DataFrame, at_least: float = 0.5) -> DataFrame:
    """The measures with base_failed, ``posterior`` and ``kept``: not base_failed and a posterior of ``at_least``."""
    spark = docs.sparkSession
    measured = materialise(measure(docs), "quality")
    counted = measured.groupBy("votes").count().orderBy("votes").collect()  # at most 3 ** len(RULES) patterns
    posteriors = estimate([(row["votes"], row["count"]) for row in counted])[2]
    known = spark.createDataFrame(list(posteriors.items()), "votes string, posterior double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.join(F.broadcast(known), "votes").select(
        "doc_id", *MEASURES, failed.alias("base_failed"), (~failed & (F.col("posterior") >= at_least)).alias("kept"), "votes", "posterior")
