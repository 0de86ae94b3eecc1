"""Near copies by the Jaccard similarity of their word shingles, for the corpus pipeline.

Two texts are near copies if their sets of five-word shingles have a similarity of at least ``SIMILAR``. At that
similarity 64-bit SimHash fingerprints differ in about ten bits, for which segments would be so short that nearly all
fingerprints meet; so candidates come from MinHash: texts that agree in all ``ROWS`` values of one of ``BANDS`` bands. Of a
pair at the least similarity one in 1,500 shares no band, of more similar pairs fewer.

Equal sets are collapsed first. A band's members are never paired with each other: each is tied to the smallest, and only
the members of a component of such ties are compared, by their whole sets. A component too large for one task is dealt
into pairs of blocks; every block emits a spanning forest of its verified links, and no candidate is dropped.

Defined results: fewer words than a shingle has are one shingle; null, empty and blank texts are copies of each other;
letters are compared without ASCII case, as in ``simhash``.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplattice.llm.common import id_and_text, slices, utf8
from shoplattice.llm.simhash import SEED, components, first_rows
from shoplattice.session import materialise

WORDS = 5
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 24, 6
#: Texts, and their shingles together, of a component that one block holds; a task compares two blocks at once.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
_STEP = 4096
_FACTORS, _TERMS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, 1, BANDS * ROWS), dtype=np.uint64)
_FACTORS |= np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of the different shingles, in order."""
    found = text.lower().split()
    if len(found) <= words:
        grams = {b" ".join(found)} if found else set()
    else:
        grams = set(map(b" ".join, zip(*(found[at:] for at in range(words)))))
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8"))


def bands(hashes: np.ndarray) -> list[int]:
    """Keys of the bands, as signed longs; none of an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), _STEP):
        np.minimum(least, (hashes[at:at + _STEP, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], "<u8").view("<i8").tolist()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, ``fp`` (a hash of the set of shingles), ``mark`` (a hash of the text), ``size`` of the set and ``keys``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(text) for text in utf8(batch.column("text"))]
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(fps), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "fp", "mark", "size", "keys"])

    source = id_and_text(docs).withColumn("mark", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, fp bigint, mark bigint, size bigint, keys array<bigint>")


def forest(fps: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what all pairs of similar sets connect, fewer than there are sets; no set is empty."""
    over, under = SIMILAR
    sizes = np.array([len(s) for s in sets])
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    marked = np.zeros(len(vocabulary), np.uint8)
    rest, links = np.arange(len(sets)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        flat = np.concatenate([parts[n] for n in rest]) if len(rest) else flat[:0]
        while queue and len(rest):
            node = queue.pop()
            marked[parts[node]] = 1
            both = np.add.reduceat(marked[flat], np.cumsum(sizes[rest]) - sizes[rest], dtype=np.int64)
            marked[parts[node]] = 0
            near = under * both >= over * (sizes[rest] + sizes[node] - both)
            if near.any():
                found = rest[near]
                flat, rest = flat[np.repeat(~near, sizes[rest])], rest[~near]
                links += [(fps[node], fps[other]) for other in found]
                queue += found.tolist()
    return links


def candidates(prints: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``node`` and ``root`` of all sets that share a band, or one of ``groups``, with another, over any number of steps."""
    members = prints.groupBy("fp").agg(F.first("keys").alias("keys")).select("fp", F.explode("keys").alias("key"))
    members = materialise(members, "near-bands")
    shared = materialise(members.groupBy("key").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").select("key", "low"), "near-shared")
    ties = members.join(shared, "key").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    if groups is not None:
        ties = ties.union(ties_of_groups(prints, groups))
    found = components(ties.distinct(), "near-ties")
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())  # a root isn't a node of its own


def links(docs: DataFrame, prints: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Verified links (a, b) between sets whose components are those of all similar candidates."""
    named = F.struct(F.coalesce("doc_id", F.lit(-1)).alias("did"), "mark")
    classes = prints.groupBy("fp").agg(F.min(named).alias("rep"), F.first("size").alias("size"))
    tied = classes.join(candidates(prints, groups), F.col("fp") == F.col("node")).select("fp", "size", "root", "rep.did", "rep.mark")
    tied = materialise(tied, "near-tied")
    sums = tied.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    wanted = tied.join(materialise(sums, "near-sums"), "root").select("did", "mark", "fp", "root", "blocks")
    texts = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("did"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = pa.array([shingles(text).tobytes() for text in utf8(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("fp", "root", "blocks")), sets], ["fp", "root", "blocks", "ids"])

    sets = texts.join(wanted, ["did", "mark"]).select("fp", "root", "blocks", "text").mapInArrow(cut_up, "fp bigint, root bigint, blocks int, ids binary")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("mine", mine).select("fp", "root", "ids", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("root", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "fp", "ids")
    names = ["root", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, {}

        def close() -> Iterator[pa.RecordBatch]:
            pairs = forest(list(group), list(group.values())) if len(group) > 1 else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*pairs)], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(n).to_pylist() for n in names))
            for key, fp, ids in zip(keys, batch.column("fp").to_pylist(), batch.column("ids")):
                if key != now:
                    yield from close()
                    now, group = key, {}
                group[fp] = np.frombuffer(ids.as_py(), "<u8")
        yield from close()

    return dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a bigint, b bigint")


def ties_of_groups(prints: DataFrame, groups: DataFrame) -> DataFrame:
    """Ties (a, b) of each set that isn't empty to the smallest of its group; ``groups`` has doc_id, mark and root of the rows."""
    row = [F.coalesce("doc_id", F.lit(-1)).alias("did"), "mark"]
    met = prints.where("size > 0").select(*row, "fp").join(groups.select(*row, "root").distinct(), ["did", "mark"]).select("fp", "root").distinct()
    met = materialise(met, "near-grouped")
    least = met.groupBy("root").agg(F.min("fp").alias("low"))
    return met.join(least, "root").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))


def one_of_each(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with one row left of each component of near copies: that of the smallest doc_id (nulls last, then
    by a hash of the text); of repeated rows one stays. Rows of one of ``groups`` (doc_id, mark, root), such as those of
    ``simhash.groups``, are candidates beside those of the bands."""
    prints = materialise(sketches(docs), "near")
    roots = components(links(docs, prints, groups), "near-links")
    rooted = prints.select("fp").distinct().join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return first_rows(docs, prints, materialise(rooted, "near-roots"))
