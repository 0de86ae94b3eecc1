"""Removal of later copies of word windows, counted exactly in super-k-mers dealt by minimiser.

The minimiser of a window of words is the leftmost of its word grams with the least hash; equal windows have equal
minimisers at equal places. Consecutive windows whose minimiser is the same gram form a super-k-mer and travel as one
packed string to the bucket of that gram, where the windows of all strings are sorted: the first of each run of equal
windows is kept, the others are later copies.

Equal super-k-mers are collapsed before any text moves (by a 64-bit hash under the minimiser's 64 bits): only the first
of them, by document and place, stands in its bucket, and every window of the others is a later copy. Minimisers with a
single super-k-mer are left out at once, and those with a single string need no bucket. A minimiser with more than ``GROUP`` different strings never goes to one task: its
windows are dealt by their whole words instead and only their first places are kept, combined before the shuffle.

Defined results: null text has no words; texts shorter than a window lose nothing; rows with equal doc_id are versions of
one document, so a place in one is compared with the places in the others, and the same place in both is kept in both;
rows with a null doc_id come after all others and are versions of one document; repeated rows come back repeated.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplattice.llm.common import slices, utf8
from shoplattice.session import materialise

WINDOW, GRAM = 20, 7
#: Different strings of a minimiser that one task sorts, some 200 bytes each.
GROUP = 4096
_LAST = (1 << 63) - 1
_SLAB, _PLACE = 1 << 18, (1 << 20) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CODES, _ROWS = 400_000, 2000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Hashes(dict):
    """Hashes of words seen before, a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CODES:
            self.clear()
        number = self[word] = xxhash.xxh64_intdigest(word)
        return number


def super_kmers(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a text's word hashes, a slab at a time: minimiser, first window and number of windows of each super-k-mer."""
    width = window - gram + 1
    for begin in range(0, len(hashes) - window + 1, _SLAB):
        part = hashes[begin:begin + _SLAB + window - 1]
        keys = np.zeros(len(part) - gram + 1, np.uint64)
        for at in range(gram):
            keys = keys * _ODD + part[at:at + len(keys)]
        keys ^= keys >> np.uint64(29)
        keys *= np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(32)
        least = (keys & np.uint64(~_PLACE & (1 << 64) - 1)) | np.arange(len(keys), dtype=np.uint64)
        reach = 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[:-(width - reach)], least[width - reach:])
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        yield keys[(least[first] & np.uint64(_PLACE)).astype(np.int64)].view(np.int64), first + begin, np.diff(np.append(first, len(least)))


def _ends(words: list[bytes]) -> list[int]:
    """Where each word ends in the words joined by one space."""
    return (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()


def _packed(joined: bytes, ends: list[int], first: int, windows: int, window: int) -> bytes:
    return joined[ends[first - 1] + 1 if first else 0:ends[first + windows + window - 2]]


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows of equal did are one document, those of equal tag too are repeated rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("did"), F.hash(text).alias("tag"), text.alias("text"))


def _compressed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and the text as ``__packed``, so that a shuffle of texts stays below the size of the stored table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            packed = pa.array([squeeze.compress(text) for text in utf8(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), packed], [*columns, "__packed"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, "text").mapInArrow(run, f"{schema}, __packed binary")


def _members(numbered: DataFrame, window: int, gram: int) -> DataFrame:
    """did, tag, ``place`` (first window and, in its low byte, the number of windows), key (minimiser), body (hash of the
    string) of every super-k-mer."""
    names = ["did", "tag", "place", "key", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in slices(batches):
            columns: list[list[np.ndarray]] = [[] for _ in names]
            for did, tag, text in zip(batch.column("did").to_pylist(), batch.column("tag").to_pylist(), utf8(batch.column("text"))):
                words = _WORD.findall(text)
                if len(words) < window:
                    continue
                joined, ends = b" ".join(words), _ends(words)
                for keys, first, count in super_kmers(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), window, gram):
                    bodies = [xxhash.xxh64_intdigest(_packed(joined, ends, a, n, window)) for a, n in zip(first.tolist(), count.tolist())]
                    for column, values in zip(columns, (np.full(len(keys), did, np.int64), np.full(len(keys), tag, np.int32), first << 8 | count, keys,
                                                        np.array(bodies, np.uint64).view(np.int64))):
                        column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names)

    return numbered.mapInArrow(run, "did bigint, tag int, place bigint, key bigint, body bigint")


def _start(place: str) -> Column:
    return F.shiftright(place, 8)


def _strings(numbered: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """key, body, m, did, ``start`` and ``content`` (words joined by one space) of each class's first super-k-mer."""
    wanted = classes.groupBy("did", "tag").agg(F.collect_list(F.struct("key", "body", "m", "place")).alias("wanted"))
    texts = _compressed(numbered, ["did", "tag"]).groupBy("did", "tag").agg(F.any_value("__packed").alias("packed"))
    names = ["key", "body", "m", "did", "start", "content"]
    types = [pa.int64()] * 5 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        for batch in slices(batches, 100):
            rows = []
            for did, packed, found in zip(batch.column("did").to_pylist(), batch.column("packed").to_pylist(), batch.column("wanted").to_pylist()):
                words = _WORD.findall(loosen.decompress(packed))
                joined, ends = b" ".join(words), _ends(words)
                for one in found:
                    start = one["place"] >> 8
                    rows.append((one["key"], one["body"], one["m"], did, start, _packed(joined, ends, start, one["place"] & 255, window)))
                if len(rows) >= _ROWS:
                    yield _batch(rows, names, types)
                    rows = []
            yield _batch(rows, names, types)

    return texts.join(wanted, ["did", "tag"]).mapInArrow(run, "key bigint, body bigint, m bigint, did bigint, start bigint, content binary")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def windows(content: bytes, window: int) -> list[bytes]:
    """The windows of a packed string, in order."""
    words = content.split(b" ")
    return [b" ".join(words[at:at + window]) for at in range(len(words) - window + 1)]


def later_windows(strings: list[tuple[int, int, bytes]], window: int) -> list[int]:
    """Of a bucket's strings (did, start, content): a mask for each, with a bit for every window that occurs earlier."""
    places = sorted((text, did, start + at, number, at) for number, (did, start, content) in enumerate(strings) for at, text in enumerate(windows(content, window)))
    masks, text, first = [0] * len(strings), None, None
    for now, did, start, number, at in places:
        if now != text:
            text, first = now, (did, start)
        elif (did, start) != first:
            masks[number] |= 1 << at
    return masks


def _sorted_buckets(strings: DataFrame, window: int) -> DataFrame:
    """key, body, ``mask`` of the strings with windows that occur earlier, a bucket in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bucket, rows = None, {}, []

        def close() -> None:
            for body, mask in zip(bucket, later_windows(list(bucket.values()), window)):
                if mask:
                    rows.append((key, body, mask))

        for batch in batches:
            for now, body, *string in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "did", "start", "content"))):
                if now != key:
                    close()
                    key, bucket = now, {}
                bucket[body] = string
            if len(rows) >= _ROWS:
                yield _batch(rows, ["key", "body", "mask"], [pa.int64()] * 3)
                rows = []
        close()
        yield _batch(rows, ["key", "body", "mask"], [pa.int64()] * 3)

    dealt = strings.select("key", "body", "did", "start", "content").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key bigint, body bigint, mask bigint")


def _dealt_windows(strings: DataFrame, window: int) -> DataFrame:
    """As ``_sorted_buckets`` for frequent minimisers: their windows are dealt one by one."""
    names, types = ["key", "body", "at", "did", "start", "text"], [pa.int64()] * 5 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _batch([(key, body, at, did, start + at, text) for key, body, did, start, content in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "did", "start", "content")))
                          for at, text in enumerate(windows(content, window))], names, types)

    single = materialise(strings.mapInArrow(run, "key bigint, body bigint, at bigint, did bigint, start bigint, text binary"), "frequent-windows")
    place = F.struct("did", "start")
    firsts = materialise(single.groupBy("text").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("text", "first"), "frequent-firsts")
    later = single.join(firsts, "text").where(place > F.col("first"))
    return later.groupBy("key", "body").agg(F.bit_or(F.expr("shiftleft(1L, cast(at as int))")).alias("mask"))


def later_copies(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """did, tag and ``copies``: super-k-mers with later copies of windows, each as its first window (from bit 24 on), the number
    of its windows (8 bits) and the mask of those that occur earlier (16 bits)."""
    if not 0 < window - gram < 16:
        raise ValueError("a super-k-mer holds at most 16 windows")
    numbered = _numbered(docs)
    every = materialise(_members(numbered, window, gram), "super-kmers")
    several = materialise(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-minimisers")
    members = materialise(every.join(several, "key", "left_semi"), "shared-super-kmers")
    first = F.min(F.struct("did", "place", "tag"))
    classes = members.groupBy("key", "body").agg(first.alias("first"), (F.count("*") > 1).alias("copied"))
    keys = classes.groupBy("key").agg(F.count("*").alias("m"))
    classes = materialise(classes.join(keys, "key").select("key", "body", "m", "copied", "first.*"), "super-kmer-classes")
    strings = _strings(numbered, classes.where("m > 1"), window)
    if classes.where(F.col("m") > GROUP).isEmpty():
        masks = _sorted_buckets(strings, window)
    else:
        strings = materialise(strings, "super-kmer-strings")
        masks = _sorted_buckets(strings.where(F.col("m") <= GROUP), window).union(_dealt_windows(strings.where(F.col("m") > GROUP), window))
    masks = masks.withColumnRenamed("mask", "found")
    chosen = classes.join(masks, ["key", "body"], "left").where("copied or found is not null").select(
        "key", "body", F.col("did").alias("first_did"), _start("place").alias("first_start"), F.coalesce("found", F.lit(0)).alias("found"))
    chosen = materialise(chosen, "super-kmer-masks")  # so that both sides are dealt for the join, which may then split a hot class
    windows_ = F.col("place").bitwiseAND(255)
    is_first = (F.col("did") == F.col("first_did")) & (_start("place") == F.col("first_start"))
    mask = F.when(is_first, F.col("found")).otherwise(F.expr("shiftleft(1L, cast(place & 255 as int)) - 1"))
    copies = members.join(chosen, ["key", "body"]).select("did", "tag", (
        F.shiftleft(_start("place"), 24).bitwiseOR(F.shiftleft(windows_, 16)).bitwiseOR(mask)).alias("copy"), mask.alias("mask"))
    return copies.where("mask <> 0").groupBy("did", "tag").agg(F.collect_set("copy").alias("copies"))


def cut(words: list[bytes], copies: list[int], window: int) -> tuple[bytes, int]:
    """The words left, joined by one space, and the number of words in later copies."""
    edges = np.zeros(len(words) + 1, np.int64)
    for copy in copies:
        start, mask = copy >> 24, copy & 0xFFFF
        while mask:
            at = (mask & -mask).bit_length() - 1
            edges[start + at] += 1
            edges[start + at + window] -= 1
            mask &= mask - 1
    gone = np.cumsum(edges[:-1]) > 0
    return b" ".join(word for word, out in zip(words, gone.tolist()) if not out), int(gone.sum())


def remove_later_copies(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` without text and with ``cut``, a struct of ``kept`` (the words left, joined by one space, as bytes), n_words
    and n_removed; a column of docs that has this name is left out."""
    names = [c for c in docs.columns if c not in ("cut", "text")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(*names, text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("__did"), F.hash(text).alias("__tag"))
    found = later_copies(docs, window, gram).select(F.col("did").alias("__did"), F.col("tag").alias("__tag"), F.col("copies").alias("__copies"))
    joined = _compressed(keyed, [*names, "__did", "__tag"]).join(materialise(found, "later-copies"), ["__did", "__tag"], "left").select(*names, "__packed", "__copies")
    kind = pa.struct([("kept", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            rows = []
            for packed, copies in zip(batch.column("__packed").to_pylist(), batch.column("__copies").to_pylist()):
                words = _WORD.findall(loosen.decompress(packed))
                kept, removed = cut(words, copies, window) if copies else (b" ".join(words), 0)
                rows.append({"kept": kept, "n_words": len(words), "n_removed": removed})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, kind)], [*names, "cut"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return joined.mapInArrow(run, f"{schema}, cut struct<kept: binary, n_words: bigint, n_removed: bigint>")


def sql(window: int = WINDOW) -> str:
    """The same for the query's columns, in SQL over ``documents``."""
    return rf"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        wins AS (SELECT doc_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS win
                 FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window})),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, rank() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM wins) WHERE nth > 1),
        gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + {window})) AS p FROM later) GROUP BY doc_id),
        kept AS (SELECT doc_id, w, coalesce(p, []) AS p FROM d LEFT JOIN gone USING (doc_id))
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_removed,
          sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(p, i)), ' ')) AS kept_sha256
        FROM kept"""
