"""Operators that cut, encode, pack and judge texts, against plain versions."""
import base64
import random
import re
import struct
from itertools import product

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from shoplattice.llm import bpe, langid, licences, packing, quality, queries, suffix
from tests.conftest import DATA
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, ids string, cut string, kept string, spans string, packed string"


def frame(spark, rows):
    """Rows (doc_id, text) with more columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", None, "y", "z", "p") for i, t in rows], SCHEMA)


ODD = [(1, "a  b\n\n c"), (2, None), (3, ""), (None, "it's 2nd  naïve…\r\n\tyes"), (1, "a  b\n\n c"), (5, "日本 ½ x²\x1c\x85 " * 50), (6, "word " * 4000), (7, "\n"), (8, " lead and trail ")]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_as_the_library(spark, library):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe.decode(bpe.encode(frame(spark, ODD), path, public_tokenizers.PATTERN), path).collect()
    assert len(got) == len(ODD)
    want = sorted((i, struct.pack(f"<{len(n)}I", *n), (t or "").encode()) for i, t in ODD if i is not None for n in [library.encode_ordinary(t or "")])
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got if r.doc_id is not None) == want
    assert bpe.encode(frame(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_random_texts(library):
    encoder = bpe.Encoder(*bpe.lookup(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    draw = random.Random(5)
    letters = list("ab \n\t\ré1²½,.'sS!$中😀́_-") + ["  ", "the ", " ing", "'ll", "\x85", "\xa0", "\x1c"]
    for _ in range(3000):
        text = "".join(draw.choices(letters, k=draw.randint(0, 16)))
        ids = library.encode_ordinary(text)
        assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)


def test_perfect_hash_is_minimal():
    keys = [str(n).encode() for n in range(3000)]
    table = bpe.PerfectHash(keys, list(range(3000)))
    assert table.slots == 3000 and all(table.get(k) == n for n, k in enumerate(keys))
    assert table.get(b"absent") is None and bpe.PerfectHash([], []).get(b"a") is None


@pytest.mark.parametrize("group", [2048, 2])
def test_repeats_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "BLOCK", 4)
    draw = random.Random(group)
    parts = ["".join(draw.choices("abcé", k=draw.randint(4, 40))) for _ in range(12)]
    rows = [(n, "".join(draw.choices(parts, k=draw.randint(1, 6)))) for n in range(60)]
    rows += [(100, None), (101, ""), (102, "aaaaaaaa" * 30), (None, parts[0] * 3), (104, rows[0][1]), (5, rows[5][1]), (105, "z" * 19)]
    texts = [(t or "").encode() for _, t in rows]
    got = suffix.remove_repeats(frame(spark, rows), 20, 6).select("doc_id", "cut.*", "ids").collect()
    want = []
    for (i, _), text, mark in zip(rows, texts, brute.covered(texts, 20)):
        kept, removed, runs = brute.cut(text, mark)
        want.append((str(i), kept, len(text), removed, runs, "x"))
    assert sorted((str(r.doc_id), bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans, r.ids) for r in got) == sorted(want)


def test_repeats_of_nothing(spark):
    assert suffix.remove_repeats(frame(spark, []), 20, 6).count() == 0
    assert suffix.remove_repeats(frame(spark, [(1, "short")]), 20, 6).first().cut.n_removed == 0


@pytest.mark.parametrize("group", [2048, 2])
def test_repeat_groups_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    size, gram = 20, 6
    draw = random.Random(3 + group)
    parts = ["".join(draw.choices("abcé", k=draw.randint(4, 40))) for _ in range(10)]
    rows = [(n, "".join(draw.choices(parts, k=draw.randint(1, 6)))) for n in range(40)]
    rows += [(100, None), (101, ""), (102, "aaaaaaaa" * 10), (None, parts[0] * 3), (104, rows[0][1]), (105, "z" * 19)]
    texts = {-1 if i is None else i: (t or "").encode() for i, t in rows}
    equal = {}
    for i, text in texts.items():
        for at in range(len(text) - size + 1):
            equal.setdefault(text[at:at + size], set()).add((i, at))
    members = {}
    for r in suffix.repeat_groups(frame(spark, rows), size, gram).collect():
        members.setdefault((r.group, r.length), []).append((r.did, r.position))
    placed = {}
    for name, found in members.items():
        length = name[1]
        assert len(found) == len(set(found)) > 1 and length >= size
        assert len({texts[i][at:at + length] for i, at in found}) == 1
        for offset in range(length - size + 1):
            together = {(i, at + offset) for i, at in found}
            for start in together:
                assert placed.setdefault(start, (name, together)) == (name, together)  # in one group only
    assert placed.keys() == {start for some in equal.values() if len(some) > 1 for start in some}
    for some in equal.values():
        assert len(some) == 1 or all(placed[start][1] == some for start in some)  # with all equal strings
    anchors = {}
    for i, text in texts.items():
        for nth, (_, at, left, right) in enumerate(suffix.frames(text, size, gram)):
            for a, b, c in zip(at.tolist(), left.tolist(), right.tolist()):
                anchors.update({(i, start): (nth, a) for start in range(a - b, a + c - size + 1)})
    for (i, at), (name, together) in placed.items():  # no longer than that with the same occurrences around the anchor
        if anchors.get((i, at)) == anchors.get((i, at + 1)) and (i, at + 1) in placed and placed[(i, at + 1)][0] != name:
            assert {(j, other + 1) for j, other in together} != placed[(i, at + 1)][1]


def test_repeat_groups_of_repeated_rows(spark):
    text = "one two three four five six"
    got = suffix.repeat_groups(frame(spark, [(1, text), (1, text), (2, "x" + text)]), 20, 6).collect()
    longest = [(r.did, r.position) for r in got if r.length == max(g.length for g in got)]
    assert sorted(longest).count((1, longest[0][1] if longest[0][0] == 1 else min(p for d, p in longest if d == 1))) == 2
    assert {r.did for r in got} == {1, 2}
    assert suffix.repeat_groups(frame(spark, []), 20, 6).count() == 0


def test_repeats_as_text_drop_cut_characters(spark):
    shared = "0123456789" * 3
    got = suffix.remove_repeats(frame(spark, [(1, "aé" + shared), (2, "bê" + shared)]), 31, 6, as_text=True).collect()
    assert sorted(r.cut.kept for r in got) == ["aé" + shared, "bê" + shared]
    got = suffix.remove_repeats(frame(spark, [(1, "x" + shared + "é"), (2, "y" + shared + "ê")]), 31, 6, as_text=True).collect()
    assert sorted(r.cut.kept for r in got) == ["x", "y"]


def test_long_text_in_slabs(monkeypatch):
    monkeypatch.setattr(suffix, "_SLAB", 64)
    draw = random.Random(1)
    text = bytes(draw.choices(b"ab", k=500))
    starts = []
    for keys, at, left, right in suffix.frames(text, 20, 6):
        for a, b, c in zip(at.tolist(), left.tolist(), right.tolist()):
            starts += range(a - b, a + c - 20 + 1)
    assert starts == list(range(481))


def test_licences(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, "
           "including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject "
           "to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in\nall copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
           "EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.")
    rows = [(1, mit), (2, None), (3, ""), (4, "no end\nReleased under the MIT License.\nThen\nLicensed under CC BY-NC 4.0."), (5, "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n"),
            (6, "a licence of nobody"), (None, "Mit license.\nmit license."), (6, "a licence of nobody")]
    got = {(r.doc_id, tuple(r.licences), tuple(r.sentences), r.rest) for r in licences.recognise(frame(spark, rows)).collect()}
    assert (1, ("MIT",), ("mit-grant", "mit-notice", "mit-as-is"), "") in got
    assert (4, ("MIT", "CC-BY-NC-4.0"), ("mit-released", "cc-by-nc"), "") in got
    assert (5, ("Apache-2.0",), ("apache-2-the", "apache-comply"), "") in got
    assert {(2, (), (), ""), (3, (), (), ""), (6, (), (), "")} <= got and (None, ("MIT",), ("mit-short", "mit-short"), "<mit-short>") not in got
    assert licences.recognise(frame(spark, rows)).count() == len(rows) and licences.recognise(frame(spark, [])).count() == 0


LICENSED = {
    "MIT License\n\nCopyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, "
    "including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following "
    "conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, "
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.\n": ("MIT",),
    "# Copyright (C) 2019 A. Person. All rights reserved.\n#\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:\n#\n# 1. Redistributions of source code "
    "must retain the above copyright notice, this\n#    list of conditions and the following disclaimer.\n# 2. Redistributions in binary form must reproduce the above copyright notice,\n#    this list of conditions and the following disclaimer in the "
    "documentation\n#    and/or other materials provided with the distribution.\n": ("BSD-2-Clause",),
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\n"
    "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.\n": ("GPL-3.0-or-later",),
    "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */": ("MPL-2.0",),
    "// SPDX-License-Identifier: Apache-2.0\n#include <x>": ("Apache-2.0",),
    "code\n/* SPDX-License-Identifier: GPL-2.0-or-later */\nmore": ("GPL-2.0-or-later",),
    "Some text.\nLicensed under the MIT License (see LICENSE).\n": ("MIT",),
    "This project is licensed under the ISC License, see the LICENSE file for details.": ("ISC",),
    "One line\nAll rights reserved.\nend": ("Proprietary",),
    "Copyright 2021 Some Firm, all rights reserved": ("Proprietary",),
    "(c) 2021 Some Firm": (),
    "You were granted permission to read the report of 2021": (),
}


def test_licences_of_real_texts(spark):
    rows = list(enumerate(LICENSED)) + [(99, "word " * 200_000 + "\nMIT License.\n" + "tail " * 200_000)]
    clash = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS sentences", "2 AS licences", "3 AS rest", "4 AS cut")
    got = {r.doc_id: tuple(r.licences) for r in licences.recognise(clash).collect()}
    assert got == {n: want for n, want in enumerate(LICENSED.values())} | {99: ("MIT",)}


@pytest.mark.parametrize("name", ["op2_licences"])
def test_licences_match_sql_on_real_texts(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(LICENSED)) + [(50, None), (51, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns and sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


def test_licence_lines_of_the_documents_are_found(spark):
    """Of the lines of documents that speak of a licence, the share in documents with a licence found."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    spoken = docs.where("text RLIKE '(?i)licensed under|released under the|rights reserved|spdx-license'").select("doc_id").distinct()
    found = licences.recognise(docs).where("size(licences) > 0").select("doc_id").distinct()
    assert spoken.count() > 0 and spoken.join(found, "doc_id", "left_anti").count() <= 0.05 * spoken.count()


def test_licence_tables():
    assert all(re.search(licences.CUE, text) for text in licences.SENTENCES.values())
    assert all(re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", text) for text in licences.SENTENCES.values())
    assert len(set(licences.SENTENCES.values())) == len(licences.SENTENCES)
    assert all(re.search(licences.CUE, text.replace("spdx license identifier ", "spdx-license-identifier-")) for text in licences.TABLE)
    assert {i for _, run in licences.RULES for i in run} <= set(licences.TABLE.values())
    assert set(licences.TABLE.values()) - {i for _, run in licences.RULES for i in run} <= {"apache-comply", "apache-obtain", "apache-as-is", "apache-see", "gpl-warranty", "mit-notice", "mit-as-is"}
    for nth, (_, run) in enumerate(licences.RULES):  # a rule inside another has to come after it
        joined = "".join(f"<{i}>" for i in run)
        assert not any(joined in "".join(f"<{i}>" for i in later) and later != run for _, later in licences.RULES[nth + 1:])


def test_packing_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 500)
    draw = random.Random(2)
    rows = [(n, "".join(draw.choices("aé", k=draw.choice([0, 1, 5, 63, 64, 65, 200])))) for n in range(80)] + [(200, None), (None, "abc"), (3, "again"), (201, "q" * 1000)]
    packed = packing.pack(packing.byte_ids(frame(spark, rows)), 64)
    got: dict = {}
    for r in sorted(packing.unpack(packed).collect(), key=lambda r: r.offset):
        got.setdefault(r.doc_id, []).append((r.offset, bytes(r.ids)))
    text = {i: b"".join(part for _, part in parts) for i, parts in got.items() if i != 3}
    for i, t in rows:
        if i != 3:
            assert text[i] == np.array([*(t or "").encode(), packing.END], "<u2").tobytes()
    for r in packed.collect():
        ids, positions, ends = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2"), r.cu_seqlens
        assert len(ids) == len(positions) == 64 and ends[0] == 0 and ends == sorted(ends) and (ids[ends[-1]:] == packing.PAD).all()
        assert all((positions[a:b] == np.arange(b - a)).all() and b > a for a, b in zip(ends, ends[1:])) and len(ends) == len(r.doc_ids) + 1
    assert packing.pack(packing.byte_ids(frame(spark, []))).count() == 0


def test_packed_rows_hold_token_ids(spark, library, monkeypatch, tmp_path):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 9000)
    rows = [(n, t) for n, (_, t) in enumerate(ODD)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    pack = packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **b: seen.append(pack(*a, **b)) or seen[-1])
    got = queries.op7_packing(spark, str(tmp_path)).collect()
    end = 1 + max(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")).values())
    want = {i: [*library.encode_ordinary(t or ""), end] for i, t in rows}
    assert sum(r.n_tokens for r in got) == sum(map(len, want.values()))
    parts: dict = {}
    for r in sorted(packing.unpack(seen[0], packing.LONG).collect(), key=lambda r: r.offset):
        parts.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert parts == want
    with pytest.raises(ValueError):
        pack(seen[0], pad=1 << 16)
    wide = spark.createDataFrame([(1, bytearray(np.array([70000, 1], "<u4").tobytes()))], "doc_id bigint, ids binary")
    row = pack(wide, 4, 99999, packing.LONG).first()
    assert np.frombuffer(row.ids, "<u4").tolist() == [70000, 1, 99999, 99999] and row.cu_seqlens == [0, 2]


def test_best_fit_takes_the_tightest_row():
    draw = random.Random(3)
    for _ in range(200):
        sizes = [draw.randint(1, 20) for _ in range(draw.randint(0, 40))]
        rooms, plain = [], []
        for at in sorted(range(len(sizes)), key=lambda at: (-sizes[at], at)):
            fitting = [r for r in range(len(rooms)) if rooms[r] >= sizes[at]]
            if fitting:
                least = min(rooms[r] for r in fitting)
                rooms[next(r for r in fitting if rooms[r] == least)] -= sizes[at]
            else:
                rooms.append(20 - sizes[at])
        packed = packing.best_fit_decreasing(sizes, 20)
        plain = sorted(20 - room for room in rooms)
        assert sorted(sum(sizes[p] for p in row) for row in packed) == plain
        assert sorted(p for row in packed for p in row) == list(range(len(sizes)))


def plain_measures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [line for line in text.split("\n") if re.sub(r"[\x20\x09-\x0D]", "", line)]
    seen, twice = set(), 0
    for line in lines:
        twice += line in seen
        seen.add(line)
    windows = [tuple(words[at:at + 5]) for at in range(len(words) - 4)]
    hit = {at + k for at, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(hit)


def test_quality_measures_and_posterior(spark):
    draw = random.Random(4)
    rows = [(n, " ".join(draw.choices(["a", "é", "bb\n", "c#", "\t", "d|<"], k=draw.randint(0, 40)))) for n in range(80)]
    good = ["The quick brown fox number %d jumps over some lazy dogs near our river bank today while others read old books about ships and stars in quiet rooms filled with warm light, "
            "and nobody minds the rain that falls on roofs or the wind that moves every leaf of all those trees outside." % n for n in range(40)]
    rows += [(200 + n, t) for n, t in enumerate(good)] + [(300, None), (301, ""), (302, " \n"), (None, "x y"), (1, rows[1][1]), (303, "lorem ipsum dolor sit amet " * 3000)]
    got = quality.score(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), *(r[m] for m in quality.MEASURES)) for r in got) == sorted((str(i), *plain_measures(t or "")) if i != 303 else ("303", 15000, 66000, 0, 0, 15000) for i, t in rows)
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(200, 240)) <= kept and not kept & {300, 301, 302, 303, None}
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert quality.score(frame(spark, [])).count() == 0


def test_em_finds_the_accurate_rules():
    draw = random.Random(6)
    counts: dict = {}
    for _ in range(4000):
        good = draw.random() < 0.7
        votes = "".join("0" if draw.random() < 0.2 else "+" if (draw.random() < accuracy) == good else "-" for accuracy in (0.9, 0.8, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    share, accuracy, posterior = quality.estimate(sorted(counts.items()))
    assert abs(share - 0.7) < 0.1 and accuracy[0] > accuracy[2] and abs(accuracy[1] - 0.8) < 0.1
    assert posterior["+++"] > 0.9 > 0.5 > posterior["---"] and quality.estimate([])[2] == {}


def test_language_spans(spark):
    english, german, russian = "the house and the river with other things over there", "der hund und die katze sind nicht über schön grün", "это просто русский текст про дом и реку"
    labelled = spark.createDataFrame([(1, english * 3, "en"), (2, german, "de"), (3, russian, "ru"), (4, None, "en"), (5, "x", None)], "doc_id bigint, text string, lang string")
    model = langid.learn(labelled)
    assert model.languages == ["de", "en", "ru"]
    rows = [(1, english), (2, f"{english} {english} {russian}"), (3, None), (4, ""), (5, "12 ½ -- _"), (None, german), (1, english), (7, "the " * 20000)]
    got = langid.predict(frame(spark, rows), model).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by_id[1].lang_pred == "en" and by_id[None].lang_pred == "de" and by_id[7].lang_pred == "en"
    assert [s.lang for s in by_id[2].spans] == ["en", "ru"] and by_id[2].spans[1].first_word == 20 and 0.5 < by_id[2].score < 1
    assert all((by_id[n].lang_pred, by_id[n].score, by_id[n].spans) == ("und", 0.0, []) for n in (3, 4, 5))
    nothing = langid.learn(labelled.where("false"))
    assert {r.lang_pred for r in langid.predict(frame(spark, rows), nothing).collect()} == {"und"}


def test_paths_against_all_paths():
    draw = np.random.default_rng(7)
    for _ in range(60):
        scores = draw.normal(size=(5, 3))
        block = np.zeros((2, 7, 3))
        block[0, :5] = scores
        path = langid.best_paths(block, np.array([5, 0]), 0.7)[0, :5]
        value = lambda p: sum(scores[at, s] for at, s in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        assert abs(value(path) - max(map(value, product(range(3), repeat=5)))) < 1e-9


