"""Byte-level BPE with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is a token as a whole. Tier two: the other
pre-tokens are merged with a heap of adjacent pairs over doubly linked bytes.

Ids travel as packed little-endian unsigned 32-bit integers, so a document's ids are one binary value. A word seen before
in a task is answered from a bounded memory of words; the text itself is never cut to a prefix.

Defined results: null or empty text has no ids; repeated rows come back repeated; a null doc_id stays null; columns other
than doc_id and text are not read.
"""
from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from shoplattice.llm.common import id_and_text, slices

#: Words remembered per task before the memory starts anew.
WORD_MEMORY = 400_000
_TWO_SPACES = re.compile(r"\s\s")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of every line of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash by displacement: n keys on n slots, one probe and one comparison per lookup.

    Keys are dealt into small buckets. Buckets with several keys, largest first, search a displacement that puts all
    their keys on free slots; a bucket with one key names a free slot directly (stored below zero).
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = max(1, len(keys))
        self.slots, self.buckets = n, max(1, n // 3)
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        self.shift = [0] * self.buckets
        dealt: dict[int, list[int]] = {}
        for index, key in enumerate(keys):
            dealt.setdefault(xxhash.xxh64_intdigest(key) % self.buckets, []).append(index)
        taken = np.zeros(n, bool)
        alone = []
        for bucket, members in sorted(dealt.items(), key=lambda item: -len(item[1])):
            if len(members) == 1:
                alone.append((bucket, members[0]))
                continue
            shift = 1
            while True:
                places = [xxhash.xxh64_intdigest(keys[m], shift) % n for m in members]
                if len(set(places)) == len(places) and not taken[places].any():
                    break
                shift += 1
            self.shift[bucket] = shift
            for member, place in zip(members, places):
                taken[place] = True
                self.keys[place], self.values[place] = keys[member], values[member]
        for (bucket, member), place in zip(alone, np.flatnonzero(~taken).tolist()):
            self.shift[bucket] = -place - 1
            self.keys[place], self.values[place] = keys[member], values[member]

    def get(self, key: bytes) -> int | None:
        shift = self.shift[xxhash.xxh64_intdigest(key) % self.buckets]
        if shift == 0:
            return None
        place = -shift - 1 if shift < 0 else xxhash.xxh64_intdigest(key, shift) % self.slots
        return self.values[place] if self.keys[place] == key else None


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``piece``: of all adjacent pairs, the one of the lowest rank (then the leftmost) merges first."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(ranks[pair], at, at + 2) for at in range(n - 1) if (pair := piece[at:at + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, left, stop = heapq.heappop(heap)
        middle = end[left]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts has changed since
        end[left], end[middle] = stop, 0
        if stop < n:
            before[stop] = left
            if (rank := ranks.get(piece[left:end[stop]])) is not None:
                heapq.heappush(heap, (rank, left, end[stop]))
        if (previous := before[left]) >= 0 and (rank := ranks.get(piece[previous:stop])) is not None:
            heapq.heappush(heap, (rank, previous, stop))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at:end[at]]])
        at = end[at]
    return ids


class _Memory(dict):
    """Packed ids of words, each with the same text put before it."""

    def __init__(self, encoder: "Encoder", prefix: str):
        super().__init__()
        self.encoder, self.prefix = encoder, prefix

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORD_MEMORY:
            self.clear()
        packed = self[word] = self.encoder.pieces(self.prefix + word)
        return packed


class Encoder:
    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash, pattern: str):
        self.ranks, self.whole = ranks, whole
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.first, self.spaced = _Memory(self, ""), _Memory(self, " ")
        self.newline = self.pieces("\n")

    def pieces(self, text: str) -> bytes:
        """Every match of the pattern by itself: a whole token, or else its merged bytes."""
        ids: list[int] = []
        for match in self.split.findall(text):
            piece = match.encode()
            known = self.whole.get(piece)
            if known is None:
                ids += merge_bytes(piece, self.ranks)
            else:
                ids.append(known)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Packed ids. A white space between two other characters always begins a pre-token, so texts without white
        space beside white space are looked up word by word; the others go through the pattern as a whole."""
        if _TWO_SPACES.search(text):
            return self.pieces(text)
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(self.first[words[0]] + b"".join(map(self.spaced.__getitem__, words[1:])))
        return self.newline.join(lines)


@functools.lru_cache(maxsize=2)
def lookup(path: str) -> tuple[dict[bytes, int], PerfectHash]:
    """Both tiers of a rank file, built once by the driver; their size is that of the file, whatever the input."""
    ranks = read_ranks(path)
    return ranks, PerfectHash(list(ranks), list(ranks.values()))


_ENCODERS: list[tuple[object, str, Encoder]] = []


def encoder_for(vocabulary: tuple[dict[bytes, int], PerfectHash], pattern: str) -> Encoder:
    """The encoder of this Python worker, which keeps its word memory from task to task."""
    for held, held_pattern, encoder in _ENCODERS:
        if held is vocabulary and held_pattern == pattern:
            return encoder
    _ENCODERS[:] = [(vocabulary, pattern, Encoder(*vocabulary, pattern))]
    return _ENCODERS[0][2]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` (packed) of every whole text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(lookup(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary.value, pattern)
        for batch in slices(batches):
            ids = [encoder.encode(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    source = id_and_text(docs)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with the column ``decoded``: the tokens' bytes, joined. Null ids decode to nothing."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    names = [field.name for field in encoded.schema if field.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b""] * (max(vocabulary.value.values()) + 1)
        for token, rank in vocabulary.value.items():
            table[rank] = token
        for batch in slices(batches):
            texts = [b"".join(map(table.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.binary())], [*names, "decoded"])

    kept = encoded.select(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "decoded binary"])
    return kept.mapInArrow(run, schema)
