"""Operators that compare rows with each other or with a reference set, and the pipeline, against plain versions."""
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from shoplattice.llm import bpe, decontam, hosts, nearcopies, queries, simhash, toxicity
from tests.conftest import DATA
from tests.llm import brute
from tests.oracle import connection, rows as cells

SCHEMA = "doc_id bigint, text string, fp string, mark string, root string, items string, toxicity string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "f", "m", "r", "i", "t", len(t or "")) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("block", [2048, 3])
def test_links_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = random.Random(block)
    prints = {0, 1, 7}
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(12):
            other = centre
            for bit in draw.sample(range(64), draw.randint(0, 5)):
                other ^= 1 << bit
            prints.add(other)
            centre = draw.choice([centre, other])
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"))).collect()
    root = {r.node: r.root for r in found}
    want = brute.groups(prints, brute.near)
    for a in range(len(prints)):
        for b in range(a):
            assert (root.get(signed[a], signed[a]) == root.get(signed[b], signed[b])) == (want[a] == want[b])


def test_signatures_are_not_broadcast(spark):
    """66 signatures come of a fingerprint, while Spark sizes them by the fingerprints."""
    few = spark.range(40).select(F.xxhash64("id").alias("fp"))
    assert "BroadcastHashJoin" not in simhash.links(few)._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates(spark):
    long = " ".join(f"w{n % 977}x{n % 13}" for n in range(3000))
    rows = [(4, long), (9, long + " end"), (2, "Alpha beta gamma"), (3, "alpha BETA gamma"), (5, None), (6, ""), (7, " \n\t"), (8, "É alpha"), (8, "É alpha"), (None, "alpha beta gamma"), (11, "b")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = [brute.simhash(t) for _, t in rows]
    assert sorted((str(r.doc_id), r.fp % (1 << 64)) for r in got) == sorted((str(i), p) for (i, _), p in zip(rows, prints))
    roots = brute.groups(prints, brute.near)
    want = {}
    for (i, _), root in zip(rows, roots):
        want.setdefault(root, []).append(i)
    ids = {i: min(x for x in want[root] if x is not None) for (i, _), root in zip(rows, roots)}
    assert all(r.component_id == ids[r.doc_id] for r in got)
    kept = simhash.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(ids.values()))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and simhash.one_of_each(frame(spark, [])).count() == 0
    assert [r.component_id for r in simhash.near_duplicates(frame(spark, [(None, "a"), (None, "a")])).collect()] == [None, None]
    assert simhash.one_of_each(frame(spark, [(None, "a"), (None, "a"), (None, "b c d")])).count() == 2


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_contamination(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_GRAMS", broadcast)
    draw = random.Random(8)
    vocabulary = ["ab", "Cd", "é", "x1", "ÉF", "q"]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(0, 60))) for _ in range(60)]
    items = [(10, texts[0]), (2, "Cd, x1! q"), (3, None), (4, "--"), (2, texts[5] + " tail"), (7, " ".join(texts[9].split()[:14])), (8, "é é é é é é é é é é é")]
    rows = [(n, t) for n, t in enumerate(texts)] + [(100, None), (101, ""), (None, "cd x1 q"), (3, texts[3]), (102, "cd-X1.q cd" * 500)]
    got = decontam.scan(frame(spark, rows), bench(spark, items)).collect()
    want = [(str(i), n, tuple(sorted(at + 1 for at in hit)), tuple(which)) for (i, _), (n, hit, which) in zip(rows, brute.contamination([t for _, t in rows], items))]
    assert sorted((str(r.doc_id), r.n_words, tuple(sorted(r.hits)), tuple(r.items)) for r in got) == sorted(want)
    hit = {i for i, _, positions, _ in want if positions}
    kept = decontam.decontaminate(frame(spark, rows), bench(spark, items))
    assert kept.columns == frame(spark, []).columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if str(i) not in hit)
    spans = decontam.decontaminate(frame(spark, rows), bench(spark, items), remove="spans").collect()
    plain = {(str(i), " ".join(w for at, w in enumerate(brute.words(t)) if at not in hit)) for (i, t), (_, hit, _) in zip(rows, brute.contamination([t for _, t in rows], items))}
    assert len(spans) == len(rows) and {(str(r.doc_id), " ".join(brute.words(r.text))) for r in spans} == plain


def test_contamination_of_nothing(spark):
    assert decontam.scan(frame(spark, []), bench(spark, [(1, "a b")])).count() == 0
    assert [(r.n_words, list(r.hits)) for r in decontam.scan(frame(spark, [(1, "a b")]), bench(spark, [])).collect()] == [(2, [])]


PAGES = [
    (1, "http://Good.org/x?y", '<a href="http://fair.net/a">'), (2, "https://fair.net", "<a HREF='//far.net/b'>"), (3, "http://x.com/de/1#t", None),
    (4, "http://linker.net/de/", '<a href="https://x.com/de/2"><a href="/own"><a href="https://x.com/de/2">'), (5, "http://far.net/", ""), (6, None, '<a href="http://x.com">'), (7, "no scheme", None), (8, "http://", None),
    (None, "http://example.org/es/q", None), (3, "http://x.com/de/1#t", None), (9, "http://a.example.org/en/12", None), (10, "http://org/", None), (11, "http://borg/", None), (12, "http://org", None)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "r", 0) for r in rows], "page_id bigint, url string, html string, host string, rule string, trust bigint")


def test_host_rules_and_spread(spark):
    got = hosts.judge(pages(spark, PAGES), queries.URL_RULES).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(PAGES)
    rule = {i: (by_id[i].rule, by_id[i].verdict) for i in by_id}
    assert rule[1] == ("org/", "allow") and rule[3] == ("com/de/", "block") and rule[None] == ("example.org/es/", "block") and rule[9] == ("example.org/en/1", "block")
    assert rule[10] == ("org/", "allow") and rule[11] == (None, "allow") and rule[12] == (None, "allow")
    assert (by_id[6].host, by_id[6].path, by_id[7].host, by_id[8].host) == ("", "", "", "") and rule[6] == (None, "allow")
    assert (by_id[1].host, by_id[1].path, by_id[2].host, by_id[2].path) == ("good.org", "/x", "fair.net", "")
    assert rule[4] == (None, "block") and by_id[4].distrust > 0  # it links to a blocked host
    assert rule[5] == (None, "allow") and by_id[5].trust > 0  # trust came over two links
    assert hosts.judge(pages(spark, []), queries.URL_RULES).count() == 0


def test_spread_against_plain_rounds(spark):
    draw = random.Random(9)
    names = [f"h{n}" for n in range(12)]
    edges = sorted({(a, b) for a, b in (draw.sample(names, 2) for _ in range(25))})
    seeds = [(n, draw.randint(0, 5), draw.randint(0, 5)) for n in names[:6]]
    got = {r.host: (r.trust, r.distrust) for r in hosts.spread(spark.createDataFrame(edges + edges[:3], "src string, dst string"), spark.createDataFrame(seeds, "host string, allowed bigint, blocked bigint"), 7).collect()}
    for kind in (0, 1):
        total = sum(s[1 + kind] for s in seeds)
        base = {n: 0 for n in {x for e in edges for x in e} | {s[0] for s in seeds}}
        for s in seeds:
            q, rest = divmod(s[1 + kind] * 10 ** 6, total)
            base[s[0]] = q * 10 ** 9 + rest * 10 ** 9 // total
        ways = [e[::-1] if kind else e for e in edges]
        mass = dict(base)
        for _ in range(7):
            got_now = {n: 0 for n in base}
            for n in base:
                out = [b for a, b in ways if a == n]
                for b in out:
                    got_now[b] += mass[n] // len(out)
                if not out:
                    got_now[n] += mass[n]
            mass = {n: (15 * base[n] + 85 * got_now[n]) // 100 for n in base}
        assert {n: v[kind] for n, v in got.items()} == mass


def toxic_rows():
    draw = random.Random(10)
    plain = ["river", "house", "letter", "garden", "winter", "music", "paper", "stone"]
    rows, labels = [], []
    for n in range(300):
        bad = n % 5 == 0
        words = draw.choices(plain, k=30) + (["zorfling" + draw.choice(["", "s", "ed"])] if bad else [])
        draw.shuffle(words)
        rows.append((n, " ".join(words)))
        labels.append((n, None if n % 11 == 0 else 1, int(bad)))
    return rows, labels


def test_toxicity_chain(spark):
    rows, labels = toxic_rows()
    marks = spark.createDataFrame(labels + labels[:2] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    fresh = [(900, "the house was zorflinged in winter"), (901, "the house in winter"), (902, None), (903, ""), (None, "paper"), (900, "the house was zorflinged in winter"), (904, "river stone " * 20000)]
    chain = toxicity.train(frame(spark, rows), marks, queries.TOXIC_CHAIN)
    got = toxicity.score(frame(spark, fresh), chain)
    assert got.columns == [c for c in frame(spark, []).columns if c != "toxicity"] + ["toxicity"]
    found = {r.doc_id: r.toxicity for r in got.collect()}
    assert got.count() == len(fresh) and found[900].toxic > 0.5 and all(found[n].toxic < 0.5 for n in (901, 902, 903, 904, None))
    assert all(v.junk < 1e-6 for v in found.values())  # every labelled row is of quality
    assert len(chain.models[1]) == len(chain.models[0]) + 1  # the later model sees the earlier probability
    again = toxicity.train(frame(spark, rows).repartition(7), marks, queries.TOXIC_CHAIN)
    assert all((a == b).all() for a, b in zip(chain.models, again.models)) and chain.features == again.features
    none = toxicity.train(frame(spark, rows), marks.where("false"), queries.TOXIC_CHAIN)
    assert all(max(r.toxicity) < 1e-6 for r in toxicity.score(frame(spark, fresh), none).collect()) and toxicity.score(frame(spark, []), none).count() == 0
    few = toxicity.training_rows(frame(spark, rows), marks, queries.TOXIC_CHAIN, 50)
    assert few.count() == 50


def test_grams_of_one_fold_are_not_chosen_for_it(spark):
    rows, labels = toxic_rows()
    fold = lambda text: zlib.crc32(text.encode()) % toxicity.FOLDS
    rows = [(n, text.replace("zorfling", "zorfling" if fold(text) == 1 else "quackling") if n % 5 == 0 else text) for n, text in rows]
    marked = [(n, text) for n, text in rows if "zorfling" in text]
    rows = [(n, text) for n, text in rows if "zorfling" not in text or fold(text) == 1]  # what changed its fold is left out
    assert len(marked) > 8
    training = toxicity.training_rows(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), queries.TOXIC_CHAIN)
    assert {r["__fold"] for r in training.where("text LIKE '%zorfling%'").collect()} == {1}
    every, own, chosen = toxicity._chosen(training, list(queries.TOXIC_CHAIN))
    special = {column for gram, column in every.items() if "zorf" in gram}
    assert special and any(column < own for column in special)
    assert not special & chosen[1] and special & chosen[0] and special & chosen[2]


def test_chain_against_plain_rows():
    """Every fold's probabilities come from a model of the other folds' rows and of the columns chosen there."""
    draw = random.Random(4)
    texts = [(sorted(draw.sample(range(8), 3)), [draw.random() for _ in range(toxicity.FORM)], n % toxicity.FOLDS) for n in range(60)]
    truth = np.array([[float(0 in t[0]), float(1 in t[0] or draw.random() < 0.2)] for t in texts])
    truth[7, 0] = np.nan
    features, chosen = {f"g{n}": n for n in range(6)}, [{0, 1, 2}, {0, 1, 6}, {1, 3, 7}]
    chain = toxicity.fit_chain(["a", "b"], features, texts, truth, chosen)

    def linear(some, columns, dense, width):
        pairs = [(row, c) for row, n in enumerate(some) for c in texts[n][0] if c in columns]
        return toxicity.fit_linear(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), width, dense[some], target[some])

    dense = np.array([t[1] for t in texts])
    for at in range(2):
        target, outside = truth[:, at], np.zeros(60)
        assert np.allclose(chain.models[at], linear(list(range(60)), set(range(6)), dense, 6), atol=1e-6)
        for fold in range(toxicity.FOLDS):
            weights = linear([n for n in range(60) if n % toxicity.FOLDS != fold], chosen[fold], dense, 8)
            for n in range(fold, 60, toxicity.FOLDS):
                odds = sum(weights[c] for c in texts[n][0] if c in chosen[fold]) + weights[8:-1] @ dense[n] + weights[-1]
                outside[n] = 1 / (1 + np.exp(-odds))
        dense = np.column_stack([dense, outside])


def test_near_copies_edges(spark):
    text = " ".join(f"w{n}" for n in range(40))
    rows = [(5, text), (5, text), (4, text + " more"), (None, text), (7, None), (8, ""), (None, "alone in here")]
    clash = frame(spark, rows).selectExpr("*", "1 AS size", "2 AS keys", "3 AS ties")
    got = nearcopies.one_of_each(clash)
    assert got.columns == clash.columns and sorted(str(r.doc_id) for r in got.collect()) == ["4", "7", "None"]
    assert nearcopies.one_of_each(clash.where("false")).count() == 0


def test_pipeline_takes_candidates_by_fingerprint(spark, monkeypatch):
    """Without a single MinHash band, near copies are found by their SimHash fingerprints alone."""
    sketches = nearcopies.sketches
    monkeypatch.setattr(nearcopies, "sketches", lambda docs: sketches(docs).withColumn("keys", F.array().cast("array<bigint>")))
    long = " ".join(f"word{n}" for n in range(3000))
    rows = [(1, long), (2, long + " end"), (3, "another text"), (4, None)]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "CAST(length(text) AS bigint) AS n_chars")
    assert (simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(rows[1][1].encode())).bit_count() <= 3
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 3, 4}


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark, []).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_signatures_are_spread(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARE", 2)
    monkeypatch.setattr(simhash, "components", lambda pairs, label: pairs.select("a").withColumnRenamed("a", "node").withColumn("root", F.col("node")).limit(0))
    seen = []
    monkeypatch.setattr(simhash, "links", lambda classes, most: seen.append(classes.rdd.getNumPartitions()) or classes.selectExpr("fp AS a", "fp AS b"))
    simhash.near_duplicates(frame(spark, [(n, f"text number {n} {n * n}") for n in range(40)])).count()
    assert seen[0] > 1 and simhash._tasks(spark, 0) == 1 and simhash._tasks(spark, 512 * 10 ** 6) == 10 ** 6


def test_pipeline_against_plain_stages(spark, tmp_path):
    draw = random.Random(11)
    rows, labels = toxic_rows()
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    long = [" ".join(word() for _ in range(120)) for _ in range(30)]
    passage, item = " ".join(word() for _ in range(90)), " ".join(word() for _ in range(20))
    extra = [(1000 + n, t) for n, t in enumerate(long)] + [(1100, long[0]), (1101, long[1] + " tail"), (1102, f"{long[2]} {passage} {long[3][:300]}"), (1103, f"{long[4]} {passage}"), (1104, f"{long[5][:200]} {item} {long[6][:200]}"), (1105, None), (1106, "")]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows + extra], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    bench(spark, [(1, item)]).write.parquet(f"{folder}/benchmark.parquet")
    state = {i: t for i, t in rows + extra if i % 5 or i >= 1000}
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], folder))
    assert all(f.columns == docs.columns for f in frames[1:-1])
    kept = {r.doc_id: r.text for r in frames[1].collect()}
    assert kept == state
    ids = sorted(state)
    sets = [set(zip(*(w[at:] for at in range(5)))) if len(w) > 5 else {tuple(w)} for i in ids for w in [(state[i] or "").lower().split()]]
    roots = brute.groups(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    state = {ids[n]: state[ids[n]] for n in sorted(set(roots))}
    assert {r.doc_id: r.text for r in frames[2].collect()} == state and 1100 not in state
    texts = [(t or "").encode() for t in state.values()]
    state = {i: brute.cut(t, m)[0].decode() for i, t, m in zip(state, texts, brute.covered(texts, 400))}
    assert {r.doc_id: (r.text, r.n_chars) for r in frames[3].collect()} == {i: (t, len(t)) for i, t in state.items()} and passage not in "".join(state.values())
    state = {i: t for (i, t), (_, hit, _) in zip(state.items(), brute.contamination(state.values(), [(1, item)])) if not hit}
    assert {r.doc_id: r.text for r in frames[4].collect()} == state and 1104 not in state
    encoder = bpe.Encoder(*bpe.lookup(public_tokenizers.path(queries.RANKS)), public_tokenizers.PATTERN)
    got = {r.doc_id: (bytes(r.ids), r.n_tokens, r.text) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i: (encoder.encode(t), len(encoder.encode(t)) // 4, t) for i, t in state.items()}


@pytest.mark.parametrize("block", [512, 3])
def test_near_copies_of_the_pipeline(spark, monkeypatch, block):
    """Copies with changed words, 0.8 alike on five-word shingles but over 3 bits of SimHash apart."""
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    draw = random.Random(17)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    rows = [(900, None), (901, " "), (902, "few words"), (903, "FEW  words"), (904, "few other words")]
    for n in range(12):
        base = [word() for _ in range(200)]
        for copy in range(7):
            changed = list(base)
            for at in draw.sample(range(200), copy * 2):
                changed[at] = word()
            rows.append((n * 10 + copy, " ".join(changed)))
    sets = [set(zip(*(w[at:] for at in range(5)))) if len(w) > 5 else {tuple(w)} for _, t in rows for w in [(t or "").lower().split()]]
    roots = brute.groups(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    want = {rows[n][0] for n in set(roots)}
    assert len(want) < len(set(brute.groups([brute.simhash(t) for _, t in rows], brute.near)))
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want


def test_pipeline_cuts_passages_of_51_words(spark):
    draw = random.Random(23)
    word = lambda size: "".join(draw.choices("abcdefghij", k=size))
    own = [" ".join(word(7) for _ in range(60)) for _ in range(8)]
    short, least, tiny = (" ".join(word(size) for _ in range(n)) for size, n in ((5, 50), (5, 51), (2, 51)))
    assert len(least) < 400
    rows = [(n, f"{own[2 * n]} {passage} {own[2 * n + 1]}") for n, passage in enumerate([short, least, tiny])] + [(3, f"{own[6]}\n{short} {least}  {tiny} é{own[7]}"), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert got == {0: rows[0][1], 1: f"{own[2]}  {own[3]}", 2: f"{own[4]}  {own[5]}", 3: f"{own[6]}\n{short}    é{own[7]}", 4: ""}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = connection(DATA).sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_whole_table_is_returned(spark, name):
    got = entry.queries()[name](spark, DATA)
    documents = spark.read.parquet(f"{DATA}/documents.parquet").count()
    if name == "op7_packing":
        assert got.selectExpr("explode(doc_ids) as d").distinct().count() == documents
    else:
        assert got.count() == documents
