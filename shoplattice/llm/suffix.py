"""Removal of repeated byte strings with an enhanced suffix array over sampled anchors.

Every string of ``repeat`` bytes has an anchor: the leftmost of its byte grams with the least hash. Equal strings have
equal anchors at equal places, so only the suffixes that start at anchors are sorted (about one byte in 150), and
strings can only be equal if their anchors share a key. A frame is an anchor with all strings it stands for.

Equal frames are collapsed by hash before any text moves. Of the different frames of a key, the suffixes to the right of
the anchor are sorted, their common-prefix intervals come from a stack scan, and at each interval the extensions to the
left are compared where they differ: of two frames with R bytes in common to the right and L to the left, L + R bytes
repeat. Each frame keeps its widest extents; the union of the strings is always one stretch, because all hold the anchor.

A key with more than ``GROUP`` different frames never goes to one task: its frames are cut into blocks of strings that
start close together, dealt by the bytes all strings of the block share; a block's key that is still as frequent is cut
into single strings, which need only be counted. No case is capped or dropped.

Defined results: null text is empty; texts shorter than ``repeat`` have no repeats; repeated rows repeat each other;
matches never cross documents; rows with a null doc_id take part like others.

``repeat_groups`` gives the repeats themselves: each group's string with all its occurrences.

With ``words``, passages of so many words are found in the same way whatever their bytes: each word becomes a code of
``CODE`` bytes, and strings of ``words`` codes are looked for in the coded texts. A match between two codes would need a
code's bytes to agree by chance, so a passage of one word less isn't taken.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplattice.llm.common import slices, utf8
from shoplattice.session import materialise

REPEAT = 400
GRAM = 100
#: Different frames of one key that a task scans at once, of 400 to 700 bytes each.
GROUP = 2048
#: Starts of the strings in one block of a frequent key.
BLOCK = 32
#: Bytes that stand for a word, and words of the gram that anchors a passage.
CODE = 8
WORD_GRAM = 13
_WORD = re.compile(rb"\S+")
_CODES = 400_000
_SLAB = 1 << 18
_PLACE = (1 << 20) - 1
_ODD = 0x9E3779B97F4A7C15
_ROWS = 2000


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = _SLAB + 2048
    up, down = np.full(size, _ODD, np.uint64), np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down), np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def frames(text: bytes, repeat: int = REPEAT, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors in order, a slab of the text at a time: key, position, bytes to its left and from it on in its frame."""
    up, down, table = _powers()
    width = repeat - gram + 1
    for begin in range(0, len(text) - repeat + 1, _SLAB):
        part = np.frombuffer(text, np.uint8, min(_SLAB + repeat - 1, len(text) - begin), begin)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * up[:len(part)], out=total[1:])
        keys = (total[gram:] - total[:-gram]) * down[:len(part) - gram + 1]
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
        last = np.append(first[1:], len(least)) - 1
        at = (least[first] & np.uint64(_PLACE)).astype(np.int64)
        yield keys[at].view(np.int64), at + begin, at - first, last + repeat - at


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    low = 0
    while size - low > 1:
        middle = (low + size) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            size = middle
    return low


def widest(group: list[tuple[int, bytes]], repeat: int) -> list[tuple[int, int]]:
    """Per frame (bytes to the left of its anchor, content): the widest extents to the left and right of the anchor over
    all strings of ``repeat`` bytes or more that another frame of the group shares; (0, 0) if there is none."""
    rights, lefts = [content[left:] for left, content in group], [content[:left][::-1] for left, content in group]
    by_left = sorted(range(len(group)), key=lefts.__getitem__)
    rank = [0] * len(group)
    for place, frame in enumerate(by_left):
        rank[frame] = place
    suffixes = sorted(range(len(group)), key=rights.__getitem__)
    longest_left = max(map(len, lefts))
    extents = [(0, 0)] * len(group)

    def joined(some: list[int], others: list[int], right: int) -> list[int]:
        """Two neighbouring subtrees in the order of their left sides; ``right`` bytes after the anchor are common. Left
        sides that become neighbours are compared: no other pair can reach further to the left."""
        few, many = (some, others) if len(some) < len(others) else (others, some)
        wanted = repeat - right
        for place in few:
            to = bisect_left(many, place)
            for near in many[max(0, to - 1):to + 1]:
                left = common(lefts[by_left[place]], lefts[by_left[near]])
                if left >= wanted:
                    for frame in (by_left[place], by_left[near]):
                        extents[frame] = max(extents[frame][0], left), max(extents[frame][1], right)
            many.insert(to, place)
        return many

    open_intervals: list[tuple[int, list[int]]] = []
    for nth, frame in enumerate(suffixes):
        inside = [rank[frame]]
        following = common(rights[frame], rights[suffixes[nth + 1]]) if nth + 1 < len(suffixes) else -1
        while open_intervals and open_intervals[-1][0] >= following:
            right, before = open_intervals.pop()
            inside = joined(before, inside, right)
        if following + longest_left >= repeat:
            open_intervals.append((following, inside))
        else:
            while open_intervals:
                right, before = open_intervals.pop()
                inside = joined(before, inside, right)
    return extents


def blocks(left: int, content: bytes, key: int, repeat: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """The frame's strings, ``size`` neighbouring starts at a time, counted from the anchor: the block's key (the hash of
    the bytes all its strings share), the hash of the block, and the distances from the anchor to its last and first start."""
    least, most = repeat - (len(content) - left), left
    for number in range(least // size, most // size + 1):
        near, far = max(least, number * size), min(most, (number + 1) * size - 1)
        shared = content[left - number * size:left - (number + 1) * size + 1 + repeat]
        whole = content[left - far:left - near + repeat]
        yield _signed(shared, (key * 1024 + number) % (1 << 64)), _signed(whole, far), near, far


def _signed(value: bytes, seed: int) -> int:
    number = xxhash.xxh64_intdigest(value, seed)
    return number - (1 << 64) if number >> 63 else number


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the spans, the bytes removed and the maximal removed runs."""
    kept, at, removed, runs = [], 0, 0, 0
    reach = -1
    for start, stop in sorted(spans):
        if start > reach:
            kept.append(text[at:start])
            runs += 1
            removed += stop - start
        elif stop > reach:
            removed += stop - reach
        reach = max(reach, stop)
        at = reach
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id (null: -1) and a hash of the text name a document; equal pairs are repeated rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("did"), F.hash(text).alias("tag"), text.alias("text"))


def _packed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The texts compressed, so that a shuffle of them stays below the size of the stored table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            packed = pa.array([squeeze.compress(text) for text in utf8(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), packed], [*columns, "__packed"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, "text").mapInArrow(run, f"{schema}, __packed binary")


def _all_frames(numbered: DataFrame, repeat: int, gram: int) -> DataFrame:
    """did, tag, ``place`` (position, left and right of the anchor in one long), key and ``body`` (hash of the frame)."""
    names = ["did", "tag", "place", "key", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, tag, text in zip(batch.column("did").to_pylist(), batch.column("tag").to_pylist(), utf8(batch.column("text"))):
                for keys, at, left, right in frames(text, repeat, gram):
                    bodies = [xxhash.xxh64_intdigest(text[a - b:a + c], b) for a, b, c in zip(at.tolist(), left.tolist(), right.tolist())]
                    place = (at << 20) | (left << 10) | right
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(at), did, np.int64)), pa.array(np.full(len(at), tag, np.int32)), pa.array(place), pa.array(keys),
                        pa.array(np.array(bodies, np.uint64).view(np.int64))], names)

    return numbered.where(F.octet_length("text") >= repeat).mapInArrow(run, "did bigint, tag int, place bigint, key bigint, body bigint")


def _contents(numbered: DataFrame, classes: DataFrame) -> DataFrame:
    """key, body, m, left and the content of each class's representative."""
    wanted = classes.groupBy("did", "tag").agg(F.collect_list(F.struct("key", "body", "m", "place")).alias("frames"))
    joined = _packed(numbered, ["did", "tag"]).join(wanted, ["did", "tag"]).select("__packed", "frames")
    names, types = ["key", "body", "m", "left", "content"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        rows = []
        for batch in batches:
            for packed, found in zip(batch.column("__packed"), batch.column("frames")):
                text = loosen.decompress(packed.as_py())
                for frame in found.as_py():
                    at, left, right = frame["place"] >> 20, frame["place"] >> 10 & 1023, frame["place"] & 1023
                    rows.append((frame["key"], frame["body"], frame["m"], left, text[at - left:at + right]))
                if len(rows) >= _ROWS:
                    yield _batch(rows, names, types)
                    rows = []
        yield _batch(rows, names, types)

    return joined.mapInArrow(run, "key bigint, body bigint, m bigint, left int, content binary")


def _scanned(contents: DataFrame, repeat: int) -> DataFrame:
    """key, body and the extents ``l``, ``r`` of frames that share a string with another frame of their key."""
    names, types = ["key", "body", "l", "r"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, rows = None, {}, []

        def close() -> None:
            if len(group) > 1:
                for body, (left, right) in zip(group, widest(list(group.values()), repeat)):
                    if right:
                        rows.append((key, body, left, right))

        for batch in batches:
            for now, body, left, content in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "left", "content"))):
                if now != key:
                    close()
                    key, group = now, {}
                group[body] = (left, content)
            if len(rows) >= _ROWS:
                yield _batch(rows, names, types)
                rows = []
        close()
        yield _batch(rows, names, types)

    ordered = contents.select("key", "body", "left", "content").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "key bigint, body bigint, l int, r int")


def _sized(classes: DataFrame) -> DataFrame:
    """``classes`` of keys with more than one frame or copy, with ``m``, the number of different frames of the key."""
    keys = classes.groupBy("key").agg(F.count("*").alias("m"), F.max("copies").alias("most")).where("m > 1 or most").select("key", "m")
    return classes.join(keys, "key")


def _frequent(contents: DataFrame, repeat: int, gram: int) -> DataFrame:
    """As ``_scanned``, for keys with more different frames than a task may hold."""
    size = min(BLOCK, max(1, (repeat - gram) // 4))
    names = ["key", "body", "block", "part", "near", "far"]
    types = [pa.int64()] * 4 + [pa.int32()] * 2

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(key, body, *block) for key, body, left, content in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "left", "content")))
                          for block in blocks(left, content, key, repeat, size)], names, types)

    contents = materialise(contents, "frequent-frames")
    parts = materialise(contents.mapInArrow(cut_up, "key bigint, body bigint, block bigint, part bigint, near int, far int"), "frequent-blocks")
    first = F.min(F.struct("key", "body", "near", "far"))
    kinds = parts.groupBy("block", "part").agg(first.alias("rep"), (F.min(F.struct("key", "body")) != F.max(F.struct("key", "body"))).alias("copies"))
    sized = materialise(_sized(kinds.withColumnRenamed("block", "key")), "frequent-kinds")
    whole = sized.where("copies").select(F.col("key").alias("block"), "part", F.col("rep.far").alias("l"), (F.lit(repeat) - F.col("rep.near")).alias("r"))
    again = sized.where("m > 1").select(F.col("key").alias("block"), "part", "m", "rep.*").join(contents.select("key", "body", "left", "content"), ["key", "body"])
    inner = again.select(F.col("block").alias("key"), F.col("part").alias("body"), "m", F.col("far").alias("left"),
                         F.expr(f"substring(content, left - far + 1, far - near + {repeat})").alias("content"))
    inner = materialise(inner.dropDuplicates(["key", "body"]), "frequent-contents")
    scanned = _scanned(inner.where(F.col("m") <= GROUP), repeat)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body, left, content in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "left", "content"))):
                rows = [(key, body, left - at, _signed(content[at:at + repeat], 0)) for at in range(len(content) - repeat + 1)]
                yield _batch(rows, ["key", "body", "l", "string"], [pa.int64(), pa.int64(), pa.int32(), pa.int64()])

    single = inner.where(F.col("m") > GROUP).mapInArrow(strings, "key bigint, body bigint, l int, string bigint")
    twice = single.groupBy("key", "string").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low <> high").select("key", "string")
    counted = single.join(twice, ["key", "string"]).select("key", "body", "l", (F.lit(repeat) - F.col("l")).alias("r"))
    found = scanned.union(counted).select(F.col("key").alias("block"), F.col("body").alias("part"), "l", "r").union(whole)
    return parts.join(found, ["block", "part"]).select("key", "body", "l", "r")


def _classes(numbered: DataFrame, repeat: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """All frames, and the different ones of keys with more than one frame or copy."""
    members = materialise(_all_frames(numbered, repeat, gram), "frames")
    classes = members.groupBy("key", "body").agg(F.min(F.struct("did", "tag", "place")).alias("rep"), (F.count("*") > 1).alias("copies"))
    return members, materialise(_sized(classes).select("key", "body", "m", "copies", "rep.*"), "frame-classes")


def spans(docs: DataFrame, repeat: int = REPEAT, gram: int = GRAM) -> DataFrame:
    """did, tag and ``spans``: stretches (start, stop) whose every byte lies in a string of ``repeat`` bytes that also
    starts elsewhere, in this document or another. Stretches may overlap."""
    if repeat > 1023 or gram >= repeat:
        raise ValueError("frames hold strings of at most 1023 bytes, longer than their gram")
    return _spans(_numbered(docs), repeat, gram)


def _spans(numbered: DataFrame, repeat: int, gram: int) -> DataFrame:
    members, classes = _classes(numbered, repeat, gram)
    right, left = F.col("place").bitwiseAND(1023).cast("int"), F.shiftright("place", 10).bitwiseAND(1023).cast("int")
    copied = classes.where("copies").select("key", "body", left.alias("l"), right.alias("r"))
    contents = _contents(numbered, classes.where("m > 1"))
    if classes.where(F.col("m") > GROUP).isEmpty():
        found = _scanned(contents, repeat)
    else:
        contents = materialise(contents, "frame-contents")
        found = _scanned(contents.where(F.col("m") <= GROUP), repeat).union(_frequent(contents.where(F.col("m") > GROUP), repeat, gram))
    extents = found.union(copied).groupBy("key", "body").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    extents = materialise(extents, "extents")  # so that both sides are dealt for the join, which may then split a hot frame
    at = F.shiftright("place", 20)
    covered = members.join(extents, ["key", "body"]).select("did", "tag", F.struct((at - F.col("l")).alias("start"), (at + F.col("r")).alias("stop")).alias("span"))
    return covered.groupBy("did", "tag").agg(F.collect_set("span").alias("spans"))


def _steps(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each text in sorted order, and the common prefixes of neighbours in that order."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    rank = np.empty(len(texts), np.int64)
    rank[order] = np.arange(len(texts))
    return rank, np.array([common(texts[a], texts[b]) for a, b in zip(order, order[1:])], np.int64)


def repeats_of(group: list[tuple[int, int, bytes, bool]], repeat: int) -> Iterator[tuple[int, int, int, int]]:
    """The maximal repeats among the frames of a key (body, bytes to the left of the anchor, content, whether it has copies):
    frame, identity of the repeat, its length and the distance from its start to the anchor.

    A string that starts ``s`` bytes before the anchor is shared by the frames that lie in one interval of ``repeat - s`` common
    bytes to the right and in one interval of ``s`` common bytes to the left. From start to start the intervals only change
    where a common prefix ends, so only those starts are looked at; starts with the same frames are one repeat, which ends
    where the bytes on one of its sides differ between its occurrences."""
    left = np.array([g[1] for g in group])
    least = np.array([repeat - len(content) + before for _, before, content, _ in group])
    copies = np.array([g[3] for g in group])
    marks = np.array([xxhash.xxh64_intdigest(body.to_bytes(8, "little", signed=True)) for body, *_ in group], np.uint64)
    right_rank, right_common = _steps([content[before:] for _, before, content, _ in group])
    left_rank, left_common = _steps([content[:before][::-1] for _, before, content, _ in group])
    starts = np.unique(np.concatenate([repeat - 1 - right_common, left_common, left, least - 1]))
    starts = starts[(starts >= least.min()) & (starts <= left.max())][::-1]
    now, since = np.zeros(len(group), np.uint64), np.zeros(len(group), np.int64)

    def ended(which: np.ndarray, at: int) -> Iterator[tuple[int, int, int, int]]:
        for frame in np.flatnonzero(which & (now != 0)).tolist():
            first = int(since[frame])
            yield frame, _signed(int(now[frame]).to_bytes(8, "little"), first), repeat + first - at, first

    for start in starts.tolist():
        apart = [np.concatenate(([0], np.cumsum(shared < wanted)))[rank] for rank, shared, wanted in (
            (right_rank, right_common, repeat - start), (left_rank, left_common, start))]
        holds = np.flatnonzero((left >= start) & (least <= start))
        _, kind, size = np.unique(apart[0][holds] * len(group) + apart[1][holds], return_inverse=True, return_counts=True)
        total = np.zeros(len(size), np.uint64)
        np.add.at(total, kind, marks[holds])
        following = np.zeros(len(group), np.uint64)
        following[holds] = np.where((size[kind] > 1) | copies[holds], total[kind] | np.uint64(1), 0)
        changed = following != now
        yield from ended(changed, start + 1)
        since[changed] = start
        now = following
    yield from ended(now != 0, int(least.min()))


def repeat_groups(docs: DataFrame, repeat: int = REPEAT, gram: int = GRAM) -> DataFrame:
    """The repeats with all their occurrences: group, ``length`` in bytes, did, tag and the ``position`` (byte) of one occurrence.

    A group is a string of ``repeat`` bytes or more that occurs at least twice, as long as it can be with the same occurrences
    around its anchor: one byte more to the left or right, and some occurrence differs, or another anchor's groups begin. Each
    start of a string of ``repeat`` bytes that repeats lies in exactly one group, together with all equal strings.
    Frames of a key with over ``GROUP`` of them are cut into single strings, which are grouped by what shares them and
    joined to runs again."""
    if repeat > 1023 or gram >= repeat:
        raise ValueError("frames hold strings of at most 1023 bytes, longer than their gram")
    numbered = _numbered(docs)
    members, classes = _classes(numbered, repeat, gram)
    right, left = F.col("place").bitwiseAND(1023).cast("int"), F.shiftright("place", 10).bitwiseAND(1023).cast("int")
    names, types = ["key", "body", "group", "length", "start"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    schema = "key bigint, body bigint, `group` bigint, length int, start int"
    alone = classes.where("m = 1 AND copies").select("key", "body", F.xxhash64("key", "body").alias("group"), (left + right).alias("length"), left.alias("start"))
    contents = _contents(numbered, classes.where("m > 1")).join(classes.where("m > 1").select("key", "body", "copies"), ["key", "body"])
    contents = materialise(contents, "group-contents")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, rows = None, [], []

        def close() -> None:
            rows.extend((key, group[frame][0], _signed(name.to_bytes(8, "little", signed=True), key % (1 << 64)), length, start)
                        for frame, name, length, start in (repeats_of(group, repeat) if group else ()))

        for batch in batches:
            for now, *frame in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "left", "content", "copies"))):
                if now != key:
                    close()
                    key, group = now, []
                group.append(tuple(frame))
                if len(rows) >= _ROWS:
                    yield _batch(rows, names, types)
                    rows.clear()
        close()
        yield _batch(rows, names, types)

    few = contents.where(F.col("m") <= GROUP).repartition("key").sortWithinPartitions("key").mapInArrow(scan, schema)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body, left, content, copies in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "left", "content", "copies"))):
                rows = [(key, body, left - at, _signed(content[at:at + repeat], 0), copies) for at in range(len(content) - repeat + 1)]
                yield _batch(rows, ["key", "body", "start", "string", "copies"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()])

    single = contents.where(F.col("m") > GROUP).mapInArrow(strings, "key bigint, body bigint, start int, string bigint, copies boolean")
    shared = single.groupBy("key", "start", "string").agg(F.count("*").alias("n"), F.max("copies").alias("copies"), F.bit_xor(F.xxhash64("body")).alias("name"))
    named = single.drop("copies").join(shared.where("n > 1 OR copies").select("key", "start", "string", "name"), ["key", "start", "string"])
    run = F.col("start") + F.row_number().over(Window.partitionBy("key", "body", "name").orderBy(F.col("start").desc()))
    many = named.withColumn("run", run).groupBy("key", "body", "name", "run").agg(F.max("start").alias("start"), F.count("*").alias("n")).select(
        "key", "body", F.xxhash64("key", "name", "start").alias("group"), (F.col("n") + repeat - 1).cast("int").alias("length"), "start")
    found = materialise(alone.union(few).union(many), "repeat-groups")
    return members.join(found, ["key", "body"]).select("group", "length", "did", "tag", (F.shiftright("place", 20) - F.col("start")).alias("position"))


class _Codes(dict):
    """Codes of words seen before, a bounded number of them."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _CODES:
            self.clear()
        code = self[word] = xxhash.xxh64_digest(word)
        return code


def word_spans(docs: DataFrame, words: int) -> DataFrame:
    """As ``spans``, for passages of ``words`` words or more that also start elsewhere; stretches are counted in bytes of the
    coded text."""
    numbered = _numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in slices(batches):
            coded = pa.array([b"".join(map(codes.__getitem__, _WORD.findall(text))) for text in utf8(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("tag"), coded], ["did", "tag", "text"])

    if words <= WORD_GRAM or words * CODE > 1023:
        raise ValueError("passages are longer than their gram and fit into a frame")
    return _spans(numbered.mapInArrow(run, "did bigint, tag int, text binary"), words * CODE, WORD_GRAM * CODE)


def in_bytes(text: bytes, coded: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of the coded text as stretches of the text: all words that lie whole in them, with what is between."""
    if not coded:
        return []
    places = [match.span() for match in _WORD.finditer(text)]
    return [(places[-(-start // CODE)][0], places[stop // CODE - 1][1]) for start, stop in coded]


def remove_repeats(docs: DataFrame, repeat: int = REPEAT, gram: int = GRAM, as_text: bool = False, words: int | None = None) -> DataFrame:
    """``docs`` without text and with ``cut``, a struct of ``kept`` (the bytes left, or with ``as_text`` the text that they
    are, without characters of which a part was removed), n_bytes, n_removed and n_spans (maximal removed runs);
    a column of docs that has this name is left out. With ``words``, repeated passages of so many words go too."""
    names = [c for c in docs.columns if c not in ("cut", "text")]
    keyed = docs.select(*names, "text").withColumns({
        "__did": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__tag": F.hash(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    found = spans(docs, repeat, gram).select(F.col("did").alias("__did"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans"))
    if words is None:
        found = found.withColumn("__words", F.lit(None).cast("array<struct<start: bigint, stop: bigint>>"))
    else:
        passages = word_spans(docs, words).select(F.col("did").alias("__did"), F.col("tag").alias("__tag"), F.col("spans").alias("__words"))
        found = found.join(passages, ["__did", "__tag"], "full")
    joined = _packed(keyed, [*names, "__did", "__tag"]).join(found, ["__did", "__tag"], "left").select(*names, "__packed", "__spans", "__words")
    kind = pa.struct([("kept", pa.string() if as_text else pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            rows = []
            for packed, *found in zip(*(batch.column(c).to_pylist() for c in ("__packed", "__spans", "__words"))):
                text = loosen.decompress(packed)
                strings, passages = ([(s["start"], s["stop"]) for s in some or []] for some in found)
                kept, removed, runs = cut(text, strings + in_bytes(text, passages))
                rows.append({"kept": kept.decode("utf-8", "ignore") if as_text else kept, "n_bytes": len(text), "n_removed": removed, "n_spans": runs})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, kind)], [*names, "cut"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return joined.mapInArrow(run, f"{schema}, cut struct<kept: {'string' if as_text else 'binary'}, n_bytes: bigint, n_removed: bigint, n_spans: bigint>")
