"""The corpus operators as registered queries, with SQL where it can say the same."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplattice.llm import (bpe, decontam, hosts, langid, licences, normbuckets, packing, quality, simhash, slicecodes, suffix, superkmers,
                             toxicity)
from shoplattice.session import materialise

Query = Callable[[SparkSession, str], DataFrame]
#: The stated rules for urls.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Order of the chain: whether a text is junk is known before it is judged toxic.
TOXIC_CHAIN = {"junk": "1 - quality", "toxic": "toxic"}
#: Probability from which a document is rejected.
TOXIC_FROM = 0.5
RANKS = "byte_bpe_50k.tiktoken"
#: Words from which a repeated passage is reported, however few bytes it has.
PASSAGE = 51


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.hash(text).alias("mark"))
    cut = suffix.remove_repeats(docs).select("doc_id", "mark", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"))
    passages = materialise(suffix.word_spans(docs, PASSAGE).select("did", "tag", F.lit(True).alias("passage")), "passages")
    both = cut.join(passages, (F.coalesce(F.col("doc_id"), F.lit(-1)) == F.col("did")) & (F.col("mark") == F.col("tag")), "left")
    return both.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("passage", F.lit(False)).alias("has_repeated_passage"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.recognise(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentence_ids"),
                        F.array_join("licences", ",").alias("licences"), F.col("rest").alias("unmatched"))


def op3_host_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(_read(spark, sf_dir, "pages"), URL_RULES)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, _read(spark, sf_dir, "labels"), TOXIC_CHAIN)
    scored = toxicity.score(docs, chain).select("doc_id", *(F.round(f"toxicity.{c}", 6).alias(f"p_{c}") for c in TOXIC_CHAIN))
    return scored.withColumn("rejected", F.col("p_toxic") >= TOXIC_FROM)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.learn(docs.where(F.col("doc_id").isNotNull() & ~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    encoded = bpe.encode(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    end = 1 + max(bpe.lookup(path)[0].values())  # the first two ids after the vocabulary end a document and pad a row
    encoded = bpe.encode(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    rows = packing.pack(packing.ended(encoded, end), pad=end + 1, width=packing.LONG)
    return rows.select(
        "doc_ids", "offsets", "cu_seqlens", F.element_at("cu_seqlens", -1).cast("long").alias("n_tokens"), F.size("doc_ids").cast("long").alias("n_segments"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents")).select("doc_id", *quality.MEASURES, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_later_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = superkmers.remove_later_copies(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "cut.n_words", "cut.n_removed", F.sha2("cut.kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = slicecodes.compress(_read(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(slicecodes.digest(books)).alias("codebooks_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normbuckets.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_repeats": op1_repeats,
    "op2_licences": op2_licences,
    "op3_host_links": op3_host_links,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_language": op6_language,
    "op7_packing": op7_packing,
    "op8_weak_quality": op8_weak_quality,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_later_copies": op11_later_copies,
    "op12_vector_codes": op12_vector_codes,
    "op13_ranked_search": op13_ranked_search,
}

SQL: dict[str, str] = {
    "op2_licences": licences.sql(),
    "op3_host_links": hosts.sql(URL_RULES),
    "op9_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
        grams AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
                  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT n FROM grams),
        windows AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
                    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
        hits AS (SELECT doc_id, i, n, item FROM windows JOIN grams USING (gram, n)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
          sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_later_copies": superkmers.sql(),
    "op12_vector_codes": slicecodes.sql(),
    "op13_ranked_search": normbuckets.sql(),
}
