"""Super-k-mers, sliced codebooks and norm buckets against plain versions."""
import hashlib
import math
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from shoplattice.llm import normbuckets, slicecodes, superkmers
from tests.conftest import DATA
from tests.oracle import connection, rows as cells

SCHEMA = "doc_id bigint, text string, cut string, packed string, key string, did string, score string, rank string, number string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *"cpkdsrn") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op11_later_copies", "op12_vector_codes", "op13_ranked_search"])
def test_matches_sql(spark, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = connection(DATA).sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)


def plain_cut(rows, window):
    """Words and kept words of each row; places are (doc_id, start), null ids last."""
    last = (1 << 63) - 1
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, split):
        for at in range(len(w) - window + 1):
            place = (last if i is None else i, at)
            first[tuple(w[at:at + window])] = min(first.get(tuple(w[at:at + window]), place), place)
    for (i, _), w in zip(rows, split):
        gone = set()
        for at in range(len(w) - window + 1):
            if first[tuple(w[at:at + window])] < (last if i is None else i, at):
                gone.update(range(at, at + window))
        yield i, len(w), len(gone), " ".join(x for at, x in enumerate(w) if at not in gone).encode()


@pytest.mark.parametrize("group,slab", [(4096, 1 << 18), (1, 1 << 18), (4096, 7), (3, 64)])
def test_later_copies(spark, monkeypatch, group, slab):
    monkeypatch.setattr(superkmers, "GROUP", group)
    monkeypatch.setattr(superkmers, "_SLAB", slab)
    draw = random.Random(group + slab)
    vocabulary = ["a", "bb", "é", "the", "of", "x y"]
    passage = " ".join(draw.choices(vocabulary, k=30))
    rows = [(draw.randint(-3, 40), " ".join(draw.choices(vocabulary, k=draw.randint(0, 40)) + [passage] * draw.randint(0, 2) + draw.choices(vocabulary, k=draw.randint(0, 25))))
            for _ in range(60)]
    rows += [(5, "the " * 300), (-7, "of\n\tof  of " * 40), (90, None), (91, ""), (92, " \n"), (None, passage + " tail"), (None, passage + " tail"), rows[0], rows[0], (93, passage.replace(" ", "\r\n "))]
    got = superkmers.remove_later_copies(frame(spark, rows), window=20, gram=7).collect()
    assert sorted((str(r.doc_id), r.cut.n_words, r.cut.n_removed, bytes(r.cut.kept)) for r in got) == sorted((str(i), n, gone, kept) for i, n, gone, kept in plain_cut(rows, 20))
    assert any(r.cut.n_removed for r in got)


def test_later_copies_edges(spark):
    found = superkmers.remove_later_copies(frame(spark, []))
    assert found.count() == 0 and set(found.columns) == set(SCHEMA.replace(" string", "").replace(" bigint", "").split(", ")) - {"text"}
    long = " ".join(f"w{n * n % 7919}" for n in range(30000))
    got = {r.doc_id: r.cut.n_removed for r in superkmers.remove_later_copies(frame(spark, [(2, long), (1, long + " end")])).collect()}
    assert got[2] == 30000
    with pytest.raises(ValueError):
        superkmers.remove_later_copies(frame(spark, []), window=40, gram=7)


def test_super_kmers_hold_every_window_once():
    hashes = np.random.default_rng(4).integers(0, 1 << 62, 500, dtype=np.uint64)
    starts = [start for _, first, count in superkmers.super_kmers(hashes) for a, n in zip(first.tolist(), count.tolist()) for start in range(a, a + n)]
    assert starts == list(range(481))


def plain_codes(vectors, parts, entries, rounds):
    parted = [[v[p * len(v) // parts:(p + 1) * len(v) // parts] for p in range(parts)] for v in vectors]
    books = [[list(x[p]) for x in parted[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), number) for number, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in parted:
                groups.setdefault(nearest(p, x[p])[1], []).append(x[p])
            for number, members in groups.items():
                books[p][number] = [sum(column) // len(members) for column in zip(*members)]
    coded = [[nearest(p, x[p]) for p in range(parts)] for x in parted]
    text = ",".join(str(x) for book in books for c in book for x in c)
    return ["".join(f"{number:02x}" for _, number in row) for row in coded], [sum(far for far, _ in row) for row in coded], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("spread,entries", [(1.0, 16), (3000.0, 5), (0.004, 256)])
def test_codes(spark, spread, entries):
    draw = random.Random(entries)
    values = [[draw.gauss(0, spread) for _ in range(8)] for _ in range(90)]
    values += [values[3], values[3], [0.0] * 8]
    rows = [(n, v, n % 3 or None, "c", "v") for n, v in enumerate(values)]
    bad = [(200, None, 1, "c", "v"), (201, [1.0] * 7 + [None], 1, "c", "v"), (202, [float("nan")] * 8, 1, "c", "v"), (203, [1.0] * 12, 1, "c", "v"), (204, [float("inf")] * 8, 1, "c", "v"), (205, [], 1, "c", "v")]
    table = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, label int, code string, v string").repartition(3)
    found, books = slicecodes.compress(table, entries=entries, rounds=3)
    got = {r.vec_id: r for r in found.collect()}
    whole = [[math.floor(1024 * float(np.float32(x))) for x in v] for v in values]
    codes, errors, digest = plain_codes(whole, 4, entries, 3)
    assert sorted(got) == list(range(len(values))) and slicecodes.digest(books) == digest
    assert [got[n].code for n in sorted(got)] == codes and [got[n].error for n in sorted(got)] == errors
    for n, r in got.items():
        assert r.label_error == sum(e for m, e in enumerate(errors) if (m % 3 or None) == (n % 3 or None))
    apart = {r.vec_id: sum((a - b) ** 2 for a, b in zip(r.v, whole[r.vec_id])) for r in slicecodes.decode(found, books).collect()}
    assert apart == {n: r.error for n, r in got.items()}


def test_codes_edges(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert slicecodes.compress(spark.createDataFrame([], schema))[0].count() == 0
    rows = [(None, [1e30, 0.0, 0.0, -1e30], 1), (1, [1.0, 2.0, 3.0, 4.0], 1), (1, [1.0, 2.0, 3.0, 4.0], None)]
    found, books = slicecodes.compress(spark.createDataFrame(rows, schema))
    assert sorted((str(r.vec_id), r.error) for r in found.collect()) == [("1", 0), ("1", 0), ("None", 0)] and books.max() == slicecodes.MOST


def test_masks_against_all_distances():
    draw = np.random.default_rng(2)
    for count, span in ((1, 5), (70, 3), (256, 1000), (200, 1 << 22)):
        book, points = draw.integers(-span, span, (count, 6)), draw.integers(-2 * span, 2 * span, (300, 6))
        points[:20] = book[draw.integers(0, count, 20)]
        far = ((points[:, None] - book[None]) ** 2).sum(2)
        entry_, best = slicecodes.Slices(book).nearest(points)
        assert (entry_ == far.argmin(1)).all() and (best == far.min(1)).all()
        words = slicecodes.Slices(book).within(points, np.full(300, span // 2))
        chosen = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :count]
        assert (chosen == (np.abs(points[:, None] - book[None]) <= span // 2).all(2)).all()


def plain_search(docs, items, top):
    split = {n: (i, [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]) for n, (i, t) in enumerate(docs)}
    held = {n: d for n, d in split.items() if d[1]}
    total = sum(len(w) for _, w in held.values())
    for item, text in items:
        scores = []
        wanted = {w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w}
        for i, w in held.values():
            m = 100 - 90 + (90 * len(w) * len(held)) // total
            score = 0
            for term in wanted & set(w):
                df = sum(term in words for _, words in held.values())
                score += math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df + 1))) * (1_000_000_000 * w.count(term) // (1000 * w.count(term) + 8 * m))
            if score:
                scores.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(scores)[:top], 1):
            yield str(item), rank, str(None if null else i), -score


@pytest.mark.parametrize("bucket,terms,head", [(1024, 200_000, 0.02), (3, 200_000, 0.5), (5, 40, 0.1)])
def test_ranked_search(spark, monkeypatch, bucket, terms, head):
    monkeypatch.setattr(normbuckets, "BUCKET", bucket)
    monkeypatch.setattr(normbuckets, "TERMS", terms)
    monkeypatch.setattr(normbuckets, "HEAD", head)
    draw = random.Random(bucket)
    vocabulary = [f"w{n}" for n in range(40)] + ["É", "日本", "x-y"]
    weights = [1 / (n + 1) for n in range(len(vocabulary))]
    docs = [(n, " ".join(draw.choices(vocabulary, weights, k=draw.randint(0, 80)))) for n in range(120)]
    docs += [(300, None), (301, "-- !"), (None, "w1 W2 É"), (7, docs[7][1]), (8, docs[7][1]), (302, "w39 " * 5000)]
    items = [(1, "w1 w2 w3"), (2, None), (3, "absent"), (4, "W39, w38! é É 日本"), (5, docs[7][1]), (6, " ".join(vocabulary)), (None, "w5"), (9, "..."), (10, "x y")]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = normbuckets.search(frame(spark, docs).repartition(3), asked, top=4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in got.collect()) == sorted(plain_search(docs, items, 4))


def test_ranked_search_edges(spark):
    asked = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert normbuckets.search(frame(spark, []), asked).count() == 0
    assert normbuckets.search(frame(spark, [(1, "a")]), asked.where("false")).count() == 0
    copies = frame(spark, [(n, "a b c") for n in range(500, 0, -1)] + [(n, "c") for n in range(1000, 2000)])
    assert [r.doc_id for r in normbuckets.search(copies, asked).orderBy("rank").collect()] == list(range(1, 11))
    item = spark.createDataFrame([(1, "a"), (1, "a")], "item_id bigint, text string")
    assert normbuckets.search(frame(spark, [(3, "a"), (4, "b")]), item).count() == 2
