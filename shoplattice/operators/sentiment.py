"""Review sentiment: weak labels, text model, aspects from clauses, product rollups."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Collection, Iterable, Iterator, Mapping, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from shoplattice.constants import ASPECT_LEXICON, CLAUSE_BREAK, LEXICON_FRAGMENT, NEGATION_TERMS
from shoplattice.functions.grouped import grouped_percentiles, top_k
from shoplattice.functions.scalars import contains_any, ratio, title_label, tokens
from shoplattice.session import materialise

LABELS = ("negative", "neutral", "positive")
TOKEN = re.compile("[a-z0-9]+")
#: Words whose character grams a task remembers, and grams it counts before it sends them.
WORDS_HELD, GRAMS_HELD = 100_000, 400_000


def rating_label(rating: Column | str = "rating") -> Column:
    r = F.col(rating) if isinstance(rating, str) else rating
    return F.when(r >= 4, "positive").when(r == 3, "neutral").otherwise("negative")


def review_text() -> Column:
    return F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("body", F.lit(""))))


def weak_labels(reviews: DataFrame) -> DataFrame:
    return reviews.select("id", "product_id", "rating", review_text().alias("text"), rating_label().alias("label")).where(F.length("text") > 10)


def stratified_split(labelled: DataFrame, test_share: float = 0.25) -> DataFrame:
    """Per-label cut at the percentile of a stable hash: exact shares without ordering a whole label."""
    h = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long")
    hashed = labelled.withColumn("_h", h)
    cut = grouped_percentiles(hashed, ["label"], "_h", {"_cut": 1 - test_share})
    return hashed.join(cut, "label").withColumn("is_test", F.col("_h") > F.col("_cut")).drop("_h", "_cut")


# ---- text model ------------------------------------------------------------
class SublinearTfIdf(Transformer):
    """Counts to (1 + ln tf) * idf with idf = ln((1 + n) / (1 + df)) + 1, each block scaled to length one, side by side."""

    def __init__(self, blocks: Sequence[tuple[str, Sequence[float]]], target: str):
        super().__init__()
        self.names, self.idfs, self.target = [n for n, _ in blocks], [np.asarray(idf) for _, idf in blocks], target

    def _transform(self, dataset: DataFrame) -> DataFrame:
        idfs = self.idfs

        @F.pandas_udf(VectorUDT())  # a sparse vector travels as its parts, a batch of rows at a time
        def weigh(*blocks: pd.DataFrame) -> pd.DataFrame:
            return _weighed([(list(counts["indices"]), list(counts["values"])) for counts in blocks], idfs)

        return dataset.withColumn(self.target, weigh(*self.names))


class TextTfIdf(SublinearTfIdf):
    """The same from ``text`` itself: word 1-2 grams and character 3-5 grams are looked up in their vocabularies, counted and
    weighed in one step."""

    def __init__(self, vocabularies: Sequence[Sequence[str]], idfs: Sequence[Sequence[float]], target: str):
        super().__init__([("word", idfs[0]), ("char", idfs[1])], target)
        self.vocabularies = vocabularies

    def _transform(self, dataset: DataFrame) -> DataFrame:
        (word, char), idfs = ({gram: at for at, gram in enumerate(v)} for v in self.vocabularies), self.idfs
        numbers = CharNumbers(char.get)

        @F.pandas_udf(VectorUDT())
        def weigh(text: pd.Series) -> pd.DataFrame:
            blocks = ([], []), ([], [])
            for words in tokenised(text):
                found = np.array([at for at in map(word.get, word_grams(words)) if at is not None], np.int32)
                for (places, counts), (at, times) in zip(blocks, (np.unique(found, return_counts=True), numbers.counts(Counter(words)))):
                    places.append(at)
                    counts.append(times.astype(np.float64))
            return _weighed(blocks, idfs)

        return dataset.withColumn(self.target, weigh(F.lower("text")))


def _weighed(blocks: Sequence[tuple[list, list]], idfs: Sequence[np.ndarray]) -> pd.DataFrame:
    """The parts of the vectors of a batch from each block's places and counts, row by row."""
    at, indices, values = 0, [], []
    for (places, counts), idf in zip(blocks, idfs):
        sizes = np.array([len(row) for row in places], np.int64)
        flat = np.concatenate([*places, np.zeros(0, np.int32)])
        v = (1 + np.log(np.concatenate([*counts, np.zeros(0)]))) * idf[flat]
        squares = np.bincount(np.repeat(np.arange(len(sizes)), sizes), v * v, len(sizes))
        v /= np.repeat(np.sqrt(squares), sizes)
        cuts = np.cumsum(sizes)[:-1]
        indices.append(np.split(flat + at, cuts))
        values.append(np.split(v, cuts))
        at += len(idf)
    join = lambda parts: [np.concatenate(row) for row in zip(*parts)]
    rows = len(blocks[0][0])
    return pd.DataFrame({"type": np.zeros(rows, np.int8), "size": np.full(rows, at, np.int32), "indices": join(indices), "values": join(values)})


def word_grams(words: list[str]) -> Iterator[str]:
    return chain(words, map(" ".join, zip(words, words[1:])))


def _char_grams(word: str, lo: int = 3, hi: int = 5) -> list[str]:
    """As ``char_wb_ngrams``, of one word."""
    padded = f" {word} "
    return [padded[at:at + n] for n in range(lo, min(hi, len(padded)) + 1) for at in range(len(padded) - n + 1)]


def tokenised(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The words of lowered texts, as ``tokens`` has them with stop words."""
    return (TOKEN.findall(text or "") for text in texts)


class CharNumbers(dict):
    """The numbers of a word's character grams, worked out once for each word; grams without a number have none."""

    def __init__(self, number: Callable[[str], int | None]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= WORDS_HELD:
            self.clear()
        found = [n for n in map(self.number, _char_grams(word)) if n is not None]
        self[word] = np.array(found, np.int32)
        return self[word]

    def counts(self, words: Mapping[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in order, and how often each comes in a text with these words."""
        parts = [self[word] for word in words]
        flat = np.concatenate([*parts, np.zeros(0, np.int32)])
        times = np.repeat(np.fromiter(words.values(), np.int64, len(parts)), [len(p) for p in parts])
        number, back = np.unique(flat, return_inverse=True)
        return number.astype(np.int32), np.bincount(back, times, len(number))


def gram_counts(texts: DataFrame, stop: Collection[str] = ()) -> DataFrame:
    """(kind, gram, tf, df) over all texts: word 1-2 grams, without the words of ``stop``, and character 3-5 grams. A task counts what it meets in
    dictionaries, a word's character grams once for all its places, and sends them when they have grown to GRAMS_HELD."""
    stop = frozenset(stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tf, df, grams, numbers = Counter(), Counter(), {}, None
        totals = np.zeros((2, 0), np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(["word"] * len(tf), pa.string()), pa.array(list(tf), pa.string()),
                                              pa.array(list(tf.values()), pa.int64()), pa.array([df[g] for g in tf], pa.int64())], names)
            n = len(grams)
            yield pa.RecordBatch.from_arrays([pa.array(["char"] * n, pa.string()), pa.array(list(grams), pa.string()), pa.array(totals[0, :n]), pa.array(totals[1, :n])], names)

        names = ["kind", "gram", "tf", "df"]
        for batch in batches:
            for words in tokenised(batch.column("text").to_pylist()):
                if numbers is None:
                    numbers = CharNumbers(lambda gram: grams.setdefault(gram, len(grams)))
                met = list(word_grams([w for w in words if w not in stop]))
                tf.update(met)
                df.update(set(met))
                number, times = numbers.counts(Counter(words))
                if len(grams) > totals.shape[1]:
                    totals = np.pad(totals, ((0, 0), (0, 2 * len(grams) - totals.shape[1])))
                totals[0, number] += times.astype(np.int64)
                totals[1, number] += 1
                if len(tf) + len(grams) > GRAMS_HELD:
                    yield from flush()
                    tf, df, grams, numbers, totals = Counter(), Counter(), {}, None, np.zeros((2, 0), np.int64)
        yield from flush()

    counted = texts.select(F.lower("text").alias("text")).mapInArrow(run, "kind string, gram string, tf long, df long")
    return counted.groupBy("kind", "gram").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def fit_classifier(train: DataFrame, vocab: int = 40000, max_iter: int = 100, c: float = 4.0):
    """Word 1-2 gram and character 3-5 gram sublinear TF-IDF into balanced multinomial logistic regression."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    rows = _spread(train)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n, k = sum(counts.values()), len(counts)
    weight = F.create_map(*[F.lit(x) for label, m in counts.items() for x in (label, n / (k * m))])[F.col("label")]
    indexer = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc", handleInvalid="error").fit(rows.select("label"))
    counted = materialise(gram_counts(rows), "review-grams")
    vocabularies, idfs = [], []
    for name, min_df in (("word", 2), ("char", 3)):
        best = counted.where((F.col("kind") == name) & (F.col("df") >= min_df)).orderBy(F.col("tf").desc(), "gram").limit(vocab).select("gram", "df").toPandas()  # vocab rows
        vocabularies.append(best["gram"].tolist())
        idfs.append(np.log((n + 1) / (best["df"].to_numpy() + 1)) + 1)
    weighed = TextTfIdf(vocabularies, idfs, "features")
    features = weighed.transform(indexer.transform(rows)).withColumn("weight", weight).select("target", "weight", "features")
    lr = LogisticRegression(labelCol="target", featuresCol="features", weightCol="weight", family="multinomial", regParam=1.0 / (c * n),
                            standardization=False, maxIter=max_iter, tol=1e-4).fit(materialise(features, "review-features"))
    return PipelineModel(stages=[indexer, weighed, lr])


def _spread(df: DataFrame) -> DataFrame:
    """Texts over all cores: building n-grams is CPU-bound, and tasks of the advisory size in bytes would be few and long. The
    number is given, so that adaptive execution doesn't merge them."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "id")


def text_features(model, texts: DataFrame) -> DataFrame:
    """Add ``features``, the sparse term weights of the fitted vocabulary, to any frame with ``text``. They are written once."""
    return materialise(model.stages[-2].transform(_spread(texts)), "review-features")


def score_text(model, texts: DataFrame) -> DataFrame:
    """Add ``label`` and ``score`` = P(positive) - P(negative) to any frame with ``text``."""
    from pyspark.ml.functions import vector_to_array
    names = list(model.stages[0].labels)
    scored = model.stages[-1].transform(text_features(model, texts))
    scored = scored.withColumn("_p", vector_to_array("probability"))
    p = lambda name: F.col("_p")[names.index(name)] if name in names else F.lit(0.0)
    labels = F.array(*[F.lit(x) for x in names])
    return scored.select(*texts.columns, F.element_at(labels, (F.col("prediction") + 1).cast("int")).alias("label"),
                         F.round(p("positive") - p("negative"), 5).alias("score"))


# ---- aspects ---------------------------------------------------------------
def clauses(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(text), CLAUSE_BREAK), lambda c: F.trim(c) != "")


def _lexicon_polarity(clause: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    head = lambda ps: [p.lower()[:LEXICON_FRAGMENT] for p in ps]
    return F.when(contains_any(clause, head(positive)), "positive").when(contains_any(clause, head(negative)), "negative")


def clause_table(reviews: DataFrame) -> DataFrame:
    return reviews.select("id", F.posexplode(clauses("text")).alias("pos", "clause"))


def _names_an_aspect(clause: Column) -> Column:
    return clause.rlike("|".join(sorted({re.escape(k) for keywords, _, _ in ASPECT_LEXICON.values() for k in keywords})))


def aspect_mentions(clause_rows: DataFrame, score: str | None = None) -> DataFrame:
    """(id, pos, aspect, polarity, strength) for every clause that mentions an aspect. Clauses without any aspect's keyword
    leave after one pattern match.

    Phrase evidence wins with strength 1; otherwise the clause score (0 without a
    model) is flipped under negation and cut at +-0.10. Lexicon tests are column
    expressions, so a clause is looked at once for all aspects.
    """
    text = F.col("clause")
    s = F.col(score) if score else F.lit(0.0)
    rows = clause_rows.where(_names_an_aspect(text)).withColumn("_e", F.when(contains_any(text, NEGATION_TERMS), -s).otherwise(s))
    found = []
    for aspect, (keywords, positive, negative) in ASPECT_LEXICON.items():
        lexical = _lexicon_polarity(text, positive, negative)
        soft = F.when(F.col("_e") > 0.10, "positive").when(F.col("_e") < -0.10, "negative").otherwise("neutral")
        found.append(F.when(contains_any(text, keywords), F.struct(
            F.lit(aspect).alias("aspect"), F.coalesce(lexical, soft).alias("polarity"),
            F.when(lexical.isNotNull(), 1.0).otherwise(F.abs("_e")).alias("strength"))))
    hits = F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return rows.select("id", "pos", hits.alias("h")).select("id", "pos", "h.*")


def review_aspects(mentions: DataFrame) -> DataFrame:
    """Strongest clause per (review, aspect); the later clause wins ties."""
    return mentions.groupBy("id", "aspect").agg(F.max_by("polarity", F.struct("strength", "pos")).alias("polarity"))


def score_reviews(model, reviews: DataFrame, version: str) -> DataFrame:
    """Label, score, model version and aspect map for reviews (title, body)."""
    texts = reviews.select("id", review_text().alias("text"))
    scored = score_text(model, texts)
    named = clause_table(_spread(texts)).where(_names_an_aspect(F.col("clause")))  # the others' scores would be read by nothing
    by_clause = score_text(model, named.withColumnRenamed("clause", "text")).withColumnRenamed("text", "clause")
    aspects = review_aspects(aspect_mentions(by_clause, "score")).groupBy("id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("aspect", "polarity")))).alias("aspects"))
    return scored.join(aspects, "id", "left").select(
        "id", F.col("label").alias("sentiment_label"), F.col("score").alias("sentiment_score"),
        F.lit(version).alias("sentiment_model_version"), F.coalesce("aspects", F.create_map().cast("map<string,string>")).alias("aspects"))


def aspect_evaluation(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Detection precision, recall, F1 and polarity accuracy of (id, aspect, polarity) sets."""
    p = predicted.select("id", "aspect", F.col("polarity").alias("_p"))
    t = truth.select("id", "aspect", F.col("polarity").alias("_t"))
    both = t.join(p, ["id", "aspect"], "full_outer")
    hit = F.col("_p").isNotNull() & F.col("_t").isNotNull()
    agg = both.agg(F.count_if(hit).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"),
                   F.count_if(hit & (F.col("_p") == F.col("_t"))).alias("same"))
    prec, rec = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    return agg.select(F.round(prec, 5).alias("precision"), F.round(rec, 5).alias("recall"), ratio(2 * prec * rec, prec + rec, 5).alias("f1"),
                      ratio("same", "tp", 5).alias("polarity_accuracy"))


# ---- product rollups -------------------------------------------------------
def product_rollup(reviews: DataFrame) -> DataFrame:
    n = lambda label: F.count_if(F.col("sentiment_label") == label)
    labelled = F.greatest(F.count("sentiment_label"), F.lit(1))
    return reviews.groupBy("product_id").agg(
        F.count("*").alias("review_count"), *[n(x).alias(x) for x in LABELS], *[ratio(n(x), labelled, 4).alias(f"{x}_pct") for x in LABELS],
        F.round(F.coalesce(F.avg("sentiment_score"), F.lit(0.0)), 4).alias("average_score"), F.round(F.avg("rating"), 2).alias("average_rating"))


def aspect_rollup(aspects: DataFrame, reviews: DataFrame) -> DataFrame:
    """Mentions and net sentiment per (product, aspect)."""
    rows = aspects.join(reviews.select("id", "product_id"), "id")
    n = lambda p: F.count_if(F.col("polarity") == p)
    return rows.groupBy("product_id", "aspect").agg(
        F.count("*").alias("mentions"), n("positive").alias("positive"), n("negative").alias("negative"), n("neutral").alias("neutral"),
        F.round((n("positive") - n("negative")) / F.count("*"), 4).alias("sentiment")).withColumn("label", title_label("aspect"))


def praise_and_complaints(rollup: DataFrame, k: int = 5) -> DataFrame:
    praise = top_k(rollup.where("sentiment > 0.2"), ["product_id"], [F.col("mentions").desc(), F.col("aspect")], k).withColumn("kind", F.lit("praise"))
    complaint = top_k(rollup.where("sentiment < -0.1"), ["product_id"], [F.col("sentiment"), F.col("mentions").desc(), F.col("aspect")], k).withColumn("kind", F.lit("complaint"))
    return praise.unionByName(complaint)


def keywords(reviews: DataFrame, k: int = 12, by: str | None = "product_id") -> DataFrame:
    """Document frequency of body tokens: the top k first, then only terms longer than 3."""
    cols = [by] if by else []
    n = reviews.select(*cols, F.explode(F.array_distinct(tokens("body"))).alias("term")).groupBy(*cols, "term").agg(F.count("*").alias("count"))
    order = [F.col("count").desc(), F.col("term")]
    best = top_k(n, cols, order, k) if by else n.orderBy(*order).limit(k)
    return best.where(F.length("term") > 3)


def product_summary(rollup: DataFrame, ranked: DataFrame) -> DataFrame:
    """Summary sentence per product from label shares and the leading praise and complaint."""
    first = lambda kind: F.max(F.when((F.col("kind") == kind) & (F.col("rank") == 1), F.lower("label")))
    lead = ranked.groupBy("product_id").agg(first("praise").alias("praise"), first("complaint").alias("complaint"))
    share = ratio("positive", F.greatest(F.col("positive") + F.col("neutral") + F.col("negative"), F.lit(1)))
    pct = F.concat(F.bround(share * 100, 0).cast("int"), F.lit("%"))
    base = F.when(share >= 0.7, F.concat(F.lit("Reviews are strongly positive ("), pct, F.lit(" favourable)."))).when(
        share >= 0.45, F.concat(F.lit("Reviews are mixed but lean positive ("), pct, F.lit(" favourable)."))).otherwise(
        F.concat(F.lit("Reviews are mostly critical (only "), pct, F.lit(" favourable).")))
    more = F.coalesce(F.concat(F.lit(" Customers consistently praise "), F.col("praise"), F.lit(".")), F.lit(""))
    worse = F.coalesce(F.concat(F.lit(" The most common complaint concerns "), F.col("complaint"), F.lit(".")), F.lit(""))
    return rollup.join(lead, "product_id", "left").select("product_id", "review_count", F.concat(base, more, worse).alias("summary"))
