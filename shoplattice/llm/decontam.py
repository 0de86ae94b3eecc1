"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, probed by every window of the corpus.

Only DataFrame functions. Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. A window travels as
the 64-bit hash of its words, never as text; the set of the grams' hashes is broadcast only if its counted size is within
``BROADCAST_GRAMS``, a larger one is joined by shuffle. Windows whose hash hits are then verified: their words must be the
gram's.

Defined results: null or wordless texts have no windows, no hits and zero words; a benchmark item without words (or with
null text) matches nothing; the windows of an item with a null item_id are hit, but it is counted and named nowhere;
repeated rows each give a row; an empty benchmark leaves every document clean; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplattice.llm.common import ascii_lower, id_and_text
from shoplattice.session import materialise

WINDOW = 10
#: Hashes of 8 bytes: some 40 MB as a hash set at most.
BROADCAST_GRAMS = 2_000_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The same in text that isn't lower-cased yet.
_RAW_GAP, _RAW_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP + "+"), "")


def _grams(words: Column, length: int) -> Column:
    """All runs of ``length`` words, in order."""
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.array_join(F.slice(words, at, length), " "))


def _hashes(words: Column, length: int) -> Column:
    """Place (from 1) and hash of all runs of ``length`` words; no run is built as text."""
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.struct(at.alias("at"), F.lit(length).alias("length"), F.xxhash64(F.slice(words, at, length)).alias("hash")))


def test_grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``gram``, its ``length`` in words, the ``items`` it occurs in and the ``hash`` of its words; an item of fewer words is one gram."""
    words = F.array(_words(F.col("text").cast("string")))
    cut = benchmark.select("item_id", F.inline(F.transform(words, lambda w: F.struct(w.alias("w")))))
    grams = F.when(F.size("w") >= window, _grams(F.col("w"), window)).when(F.size("w") > 0, F.array(F.array_join("w", " ")))
    return cut.select("item_id", F.least(F.size("w"), F.lit(window)).alias("length"), F.explode(grams).alias("gram")).groupBy("gram", "length").agg(
        F.collect_set(F.col("item_id").cast("string")).alias("items")).withColumn("hash", F.xxhash64(F.split("gram", " ")))


def _probed(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """doc_id, mark, n_words, ``copies`` (rows of this id and text) and ``places``: the windows (place, words,
    hash) whose hash is a gram's."""
    sizes = {row["length"]: row["count"] for row in grams.groupBy("length").count().collect()}  # at most ``window`` rows
    keys = grams.select("hash").distinct()
    known = F.broadcast(keys) if sum(sizes.values()) <= BROADCAST_GRAMS else keys

    def windows(words: Column) -> Column:
        runs = [_hashes(words, n) for n in sorted(sizes)] or [F.array().cast("array<struct<at: int, length: int, hash: bigint>>")]
        return F.concat(*runs) if len(runs) > 1 else runs[0]

    row = F.transform(F.array(_words(F.col("text"))), lambda w: F.struct(F.size(w).alias("n_words"), windows(w).alias("windows")))
    cut = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.inline(row))
    rows = cut.select("doc_id", "mark", "n_words", F.posexplode_outer("windows").alias("nth", "w")).select("doc_id", "mark", "n_words", "nth", "w.*")
    hit = rows.join(known.select("hash", F.lit(True).alias("hit")), "hash", "left").where("hit or nth is null or nth = 0")
    place = F.when(F.col("hit"), F.struct("at", "length", "hash"))
    return hit.groupBy("doc_id", "mark").agg(F.max("n_words").alias("n_words"), F.count_if(F.expr("nth is null or nth = 0")).alias("copies"), F.collect_set(place).alias("places"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, ``mark`` (hash of the text), n_words, ``hits`` (positions of the words inside an occurrence, from 1)
    and ``items`` (ids with occurring grams, as sorted strings)."""
    grams = materialise(test_grams(benchmark, window), "test-grams")
    texts = id_and_text(docs)
    probed = materialise(_probed(texts, grams), "probed-windows")
    none = F.array()
    clean = probed.where(F.size("places") == 0).select("doc_id", "mark", "n_words", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id", "mark", "n_words", none.cast("array<int>").alias("hits"), none.cast("array<string>").alias("items"))
    # hits only: their grams, then the words of their texts, which must be the gram's
    places = probed.where(F.size("places") > 0).select("doc_id", "mark", F.explode("places").alias("p")).select("doc_id", "mark", "p.*")
    named = places.join(grams.select("hash", "length", "gram", "items"), ["hash", "length"]).groupBy("doc_id", "mark").agg(
        F.collect_list(F.struct("at", "length", "gram", "items")).alias("found"))
    named = materialise(named, "probed-grams").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "found")
    keyed = texts.withColumn("mark", F.xxhash64("text"))
    held = probed.where(F.size("places") > 0).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "n_words")
    suspect = keyed.join(held, keyed["doc_id"].eqNullSafe(F.col("__id")) & (keyed["mark"] == F.col("__mark"))).drop("__id", "__mark")
    joined = suspect.join(named, suspect["doc_id"].eqNullSafe(F.col("__id")) & (suspect["mark"] == F.col("__mark")), "left")
    checked = F.transform(F.array(_words(F.col("text"))), lambda w: F.filter(
        F.coalesce("found", none.cast("array<struct<at: int, length: int, gram: string, items: array<string>>>")),
        lambda f: F.array_join(F.slice(w, f["at"], f["length"]), " ") == f["gram"]))[0]
    true = joined.select("doc_id", "mark", "n_words", F.explode(F.array(checked)).alias("true"))
    spans = F.transform("true", lambda f: F.sequence(f["at"], f["at"] + f["length"] - 1))
    hits = true.select("doc_id", "mark", "n_words", F.array_distinct(F.flatten(spans)).alias("hits"),
                       F.array_sort(F.array_distinct(F.flatten(F.transform("true", lambda f: f["items"])))).alias("items"))
    return clean.unionByName(hits)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents") -> DataFrame:
    """``docs`` without what occurs in the benchmark: whole documents, or (``spans``) only the words inside an occurrence
    with the gap before each; ``n_chars``, where it is a column, then follows the text. Repeated rows stay repeated."""
    found = scan(docs, benchmark, window).where(F.size("hits") > 0).dropDuplicates(["doc_id", "mark"]).select(
        F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("hits").alias("__hits"))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__mark"))
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    joined = docs.join(found, same, "left")
    pieces = F.regexp_extract_all("text", F.lit(f"({_RAW_GAP}*{_RAW_WORD}+|{_RAW_GAP}+$)"), F.lit(1))
    kept = F.array_join(F.filter(pieces, lambda p, at: ~F.array_contains("__hits", at + 1)), "")
    text = F.when(F.col("__hits").isNull(), F.col("text")).otherwise(kept)
    clean = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("__hits").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return clean.select(*docs.columns)
