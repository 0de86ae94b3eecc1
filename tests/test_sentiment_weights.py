"""Sublinear term weights in batches against the formula, row by row."""
import math
import time

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shoplattice.functions.scalars import char_wb_ngrams, tokens, word_ngrams
from shoplattice.operators import sentiment
from shoplattice.operators.sentiment import SublinearTfIdf


def test_weights_match_the_formula(spark):
    rows = [(0, {0: 1.0, 2: 3.0}, {1: 2.0}), (1, {}, {0: 1.0, 1: 5.0}), (2, {}, {}), (3, {1: 4.0}, {})]
    idf = [[1.5, 2.0, 1.1], [1.0, 3.0]]
    df = spark.createDataFrame([(i, Vectors.sparse(3, a), Vectors.sparse(2, b)) for i, a, b in rows], ["id", "a", "b"])
    got = {r.id: r.out for r in SublinearTfIdf([("a", idf[0]), ("b", idf[1])], "out").transform(df).collect()}
    for i, *blocks in rows:
        want = {}
        for at, counts, weights in ((0, blocks[0], idf[0]), (3, blocks[1], idf[1])):
            raw = {k: (1 + math.log(n)) * weights[k] for k, n in counts.items()}
            length = math.sqrt(sum(v * v for v in raw.values())) or 1.0
            want |= {at + k: v / length for k, v in raw.items()}
        assert got[i].size == 5 and list(got[i].indices) == sorted(want)
        assert all(abs(got[i][k] - v) < 1e-12 for k, v in want.items())
    assert SublinearTfIdf([("a", idf[0])], "out").transform(df.limit(0)).count() == 0


def test_texts_are_spread_over_all_cores(spark):
    texts = spark.range(400).select("id", F.concat(F.lit("some words of "), "id").alias("text"))
    assert sentiment._spread(texts).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_ngrams_of_a_long_text(spark):
    """Linear in the words; with the text tokenised anew for every gram this took minutes."""
    text = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("word"), i)), " ").alias("text"))
    began = time.monotonic()
    row = text.select(word_ngrams(tokens("text"), 2).alias("two"), word_ngrams(tokens("text"), 3).alias("three")).first()
    assert time.monotonic() - began < 20
    assert len(row.two) == 19_999 and row.two[0] == "word1 word2" and row.three[-1] == "word19998 word19999 word20000"


TEXTS = ["Good sound, good sound. It's 5x!", "", None, "ab a  ÉÀ Élan vital\n42", "the same the same the same", "x" * 40]


def test_grams_counted_by_word_equal_those_of_the_columns(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(2)
    words = tokens("text", drop_stopwords=False)
    want = {}
    for kind, grams in (("word", F.concat(words, word_ngrams(words, 2))), ("char", char_wb_ngrams(words, 3, 5))):
        for r in df.select("id", F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("tf"), F.count_distinct("id").alias("df")).collect():
            want[kind, r.gram] = (r.tf, r.df)
    for held in (400_000, 20):
        monkeypatch.setattr(sentiment, "GRAMS_HELD", held)
        assert {(r.kind, r.gram): (r.tf, r.df) for r in sentiment.gram_counts(df).collect()} == want


def test_features_equal_those_of_the_vectorizers(spark):
    from pyspark.ml.feature import CountVectorizer
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    words = tokens("text", drop_stopwords=False)
    grams = df.withColumns({"word": F.concat(words, word_ngrams(words, 2)), "char": char_wb_ngrams(words, 3, 5)})
    fitted = [CountVectorizer(inputCol=n, outputCol=f"{n}_tf", vocabSize=30).fit(grams) for n in ("word", "char")]
    weighed = SublinearTfIdf([(f"{v.getInputCol()}_tf", [1 + i / 7 for i in range(len(v.vocabulary))]) for v in fitted], "features")
    counted = fitted[1].transform(fitted[0].transform(grams))
    want = {r.id: r.features for r in weighed.transform(counted).collect()}
    got = {r.id: r.features for r in sentiment.TextTfIdf([v.vocabulary for v in fitted], weighed.idfs, "features").transform(df).collect()}
    assert got == want


def test_only_clauses_that_name_an_aspect_are_scored(spark, monkeypatch):
    scored = []

    def score(model, texts):
        scored.extend(r.text for r in texts.collect() if "pos" in texts.columns)
        return texts.withColumns({"label": F.lit("neutral"), "score": F.lit(0.5)})

    monkeypatch.setattr(sentiment, "score_text", score)
    reviews = spark.createDataFrame([(1, "Fine", "The battery is great. We went home. Nothing else")], "id long, title string, body string")
    row = sentiment.score_reviews(None, reviews, "v").first()
    assert len(scored) == 1 and "battery" in scored[0] and set(row.aspects) == {r.aspect for r in sentiment.aspect_mentions(
        sentiment.clause_table(reviews.select("id", sentiment.review_text().alias("text")))).collect()}
