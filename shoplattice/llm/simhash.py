"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments. Two fingerprints that differ in at most three bits differ in at most
one bit of one segment. So each segment is indexed under its exact value and under its 32 variants with one bit wiped
out; an equality join on those signatures brings all candidates together and the whole fingerprints are verified.

Equal fingerprints are collapsed first. A signature's members are never paired with each other: they come together in
blocks of bounded size, each block emits a spanning forest of its verified links, and the components are found by
alternating star contractions, all as distributed tables.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows come
back repeated; rows with a null doc_id take part, but a component's id is its smallest doc_id that is not null.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplattice.llm.common import id_and_text, slices, utf8
from shoplattice.session import materialise

SEED = 42
#: Distinct fingerprints of a signature that one task compares at once; larger buckets are dealt into pairs of blocks.
BLOCK = 2048
#: Fingerprints of which a task makes the signatures, 66 each.
SHARE = 4096
_STEP = 1 << 16


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """SimHash of the word shingles, repeats included; fewer words are one shingle, none give zero."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[at:] for at in range(words_per_shingle))))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        ones += np.unpackbits(hashes[at:at + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, ``fp`` (the 64 bits as a signed long) and ``mark`` (a hash of the text) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(text) for text in utf8(batch.column("text"))], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), batch.column("mark")], ["doc_id", "fp", "mark"])

    source = id_and_text(docs).withColumn("mark", F.xxhash64("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp bigint, mark bigint")


def signatures(classes: DataFrame) -> DataFrame:
    """One row per distinct fingerprint and signature: segment, wiped bit (32: none) and the segment's other bits, packed
    into one long without loss, and ``side``, the wiped bit's value (2: none wiped)."""
    segments = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))]
    rows = []
    for number, segment in enumerate(segments):
        for bit in range(33):
            left = segment if bit == 32 else segment.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit)))
            side = F.lit(2) if bit == 32 else F.shiftrightunsigned(segment, bit).bitwiseAND(F.lit(1)).cast("int")
            rows.append(F.struct((left + F.lit((number * 33 + bit) << 32)).alias("signature"), side.alias("side")))
    return classes.select("fp", F.explode(F.array(*rows)).alias("s")).select("fp", "s.signature", "s.side")


def _forest(some: np.ndarray, others: np.ndarray | None, most: int) -> list[tuple[int, int]]:
    """Links that connect what pairs at ``most`` differing bits connect, fewer than there are nodes: pairs among ``some``,
    or with ``others`` pairs of one from each."""
    links, rest = [], [some] if others is None else [some, others]
    across = len(rest) - 1
    while all(map(len, rest)):
        queue, rest[0] = [(rest[0][0], across)], rest[0][1:]  # a node and the side on which its partners are
        while queue:
            node, side = queue.pop()
            near = np.bitwise_count(rest[side] ^ node) <= most
            if near.any():
                found, rest[side] = rest[side][near], rest[side][~near]
                links += [(int(node), int(other)) for other in found]
                queue += [(other, across - side) for other in found]
    return links


def links(classes: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs with ``most`` or fewer differing
    bits; ``most`` may be up to 3, for which two segments are enough.

    Fingerprints with an equal segment meet under its exact value alone; under a wiped bit only those meet that differ in
    that bit, so a dense cluster isn't compared once for each of its common signatures."""
    if not 0 <= most <= 3:
        raise ValueError("two segments with one wiped bit find at most 3 differing bits")
    signed = signatures(classes)
    counts = signed.groupBy("signature").agg(F.count("*").alias("n"), F.min("side").alias("low"), F.max("side").alias("high"))
    shared = counts.where("n > 1 and (low = 2 or low <> high)").select("signature", "n")
    members = signed.hint("merge").join(shared, "signature")  # Spark would size ``signed`` by the fingerprints, a 66th of it, and broadcast it
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = members.select("signature", "side", "fp", blocks.alias("blocks"), mine.alias("mine")).select(
        "signature", "side", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "mine")
    groups = dealt.groupBy("signature", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")).agg(
        F.collect_set(F.when(F.col("side") != 1, F.col("fp"))).alias("some"), F.collect_set(F.when(F.col("side") == 1, F.col("fp"))).alias("others"),
        F.max("side").alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for some, others, side in zip(*(batch.column(c).to_pylist() for c in ("some", "others", "side"))):
                either = np.array(others, "<i8").view("<u8") if side != 2 else None
                found.update(_forest(np.array(some, "<i8").view("<u8"), either, most))
            pairs = np.array(sorted(found), "<u8").reshape(-1, 2).view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return groups.where(F.size("some") + F.size("others") > 1).select("some", "others", "side").mapInArrow(run, "a bigint, b bigint").distinct()


def components(pairs: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node in ``pairs`` (a, b), by alternating large-star and
    small-star steps. Each round is written to the shared folder, so a lost executor costs one round at most."""
    edges = materialise(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), label)
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialise(small.select("e.u", "e.v").where("u > v").distinct(), label)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        state = now


def _tasks(spark: SparkSession, n: int) -> int:
    """Tasks over ``n`` fingerprints: of SHARE each while that is no more than the session's shuffles have, later of up to 256 times as many."""
    return max(1, min(-(-n // SHARE), int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-n // (256 * SHARE)))


def _rooted(docs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Every row's fingerprint; every fingerprint's smallest doc_id and the root of its component."""
    prints = materialise(fingerprints(docs), "simhash")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    spread = classes.select("fp").repartition(_tasks(docs.sparkSession, classes.count()), "fp")  # a small table would be read in two tasks
    roots = components(links(spread, most), "simhash-links")
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return prints, materialise(rooted, "simhash-roots")


def near_duplicates(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links, itself included) of every row."""
    prints, rooted = _rooted(docs, most)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def groups(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, mark (a hash of the text) and root, the component's name, of every row."""
    prints, rooted = _rooted(docs, most)
    return prints.join(rooted, "fp").select("doc_id", "mark", "root")


def one_of_each(docs: DataFrame, most: int = 3) -> DataFrame:
    """The rows of ``docs`` with one row left of each component: that of the smallest doc_id (nulls last, then by a hash of
    the text); of repeated rows one stays."""
    return first_rows(docs, *_rooted(docs, most))


def first_rows(docs: DataFrame, prints: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``one_of_each`` leaves: ``prints`` has doc_id, fp and mark of each row, ``rooted`` fp and root."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("mark").alias("mark")))
    chosen = prints.join(rooted, "fp").groupBy("root").agg(first.alias("first")).select(
        F.col("first.null").alias("__null"), F.coalesce("first.id", F.lit(-1)).alias("__id"), F.col("first.mark").alias("__mark")).distinct()
    keys = ["__null", "__id", "__mark"]
    keyed = docs.withColumns({"__null": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(-1)), "__mark": F.xxhash64(F.col("text").cast("string"))})
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    return keyed.join(chosen, keys).withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
