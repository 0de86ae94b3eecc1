"""Licence recognition by sentence rules.

A text is cut into sentences, each sentence is normalised (A-Z lower-cased, every run of other characters than letters
and digits one space) and looked up among known licence sentences. The identifiers found, in order, are matched against
the licence rules, first rule first; a rule takes its run of identifiers out, so a longer rule shadows what it contains.

Only DataFrame functions, row by row: nothing is shuffled, so no key can be hot. Sentences are cut twice, once with line
ends as boundaries and once with the lines of a paragraph joined; the cut that finds more known sentences counts, the first
on a tie. Copyright lines are known by their form and belong to no rule; an SPDX tag is a sentence with its value.
Texts without any cue word, which every known sentence holds, are not cut at all.

Defined results: null and empty texts have no licence; repeated rows come back repeated; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplattice.llm.common import ascii_lower, id_and_text

CUE = "licen[sc]e|copyright|permission|redistribut|warrant|public domain|copying|rights reserved|distributed under|liable"
#: What may follow a notice in brackets or after a comma.
POINTER = " see (the )?licen[sc]e( file)?( for (details|more information))?$"
#: Sentences known by their form.
RIGHTS, COPYRIGHT = "^(copyright|c) .*all rights reserved$", "^(copyright|c)( c)? (19|20)[0-9][0-9]( |$)"
SPDX_TAG = "spdx-license-identifier:[ \t]*"

# Normalised sentences of public licence texts and notices.
SENTENCES: dict[str, str] = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-short": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-2": "licensed under the apache license version 2 0",
    "apache-2-the": "licensed under the apache license version 2 0 the license",
    "apache-2-title": "apache license version 2 0",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-3": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-2": "licensed under the gnu general public license version 2",
    "lgpl-3": "licensed under the gnu lesser general public license version 3",
    "agpl-3": "licensed under the gnu affero general public license version 3",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "reserved": "copyright all rights reserved",
    "rights": "all rights reserved",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "gpl-3-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl-3-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-2-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl-3-later": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl-2-form": "this source code form is subject to the terms of the mozilla public license v",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
}

# Licences that short notices name, and SPDX identifiers.
NAMES: dict[str, str] = {
    "MIT": "mit license", "Apache-2.0": "apache license version 2 0", "GPL-2.0": "gnu general public license version 2", "GPL-3.0": "gnu general public license version 3",
    "LGPL-3.0": "gnu lesser general public license version 3", "AGPL-3.0": "gnu affero general public license version 3", "BSD-2-Clause": "bsd 2 clause license",
    "BSD-3-Clause": "bsd 3 clause license", "ISC": "isc license", "MPL-2.0": "mozilla public license version 2 0", "Zlib": "zlib license",
    "BSL-1.0": "boost software license version 1 0", "EPL-2.0": "eclipse public license version 2 0", "Unlicense": "unlicense",
}
SPDX = ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
        "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Zlib", "BSL-1.0", "EPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")


def _table() -> dict[str, str]:
    """Normalised sentence to identifier: the sentences as they stand, then the forms of notices and tags."""
    table = {text: name for name, text in SENTENCES.items()}
    for licence, words in NAMES.items():
        for form in ("", "the ", "licensed under the ", "released under the ", "distributed under the ", "this project is licensed under the ", "available under the "):
            table.setdefault(form + words, f"notice-{licence.lower()}")
    for licence in SPDX:
        table[f"spdx license identifier {licence.lower().replace('-', ' ').replace('.', ' ')}"] = f"spdx-{licence.lower()}"
    return table


TABLE = _table()

_MIT, _BSD = ("mit-grant", "mit-notice", "mit-as-is"), ("bsd-redistribute", "bsd-source", "bsd-binary")
#: (licence, identifiers in a row), in the order in which they are tried: whole texts before their headings and short notices.
_ORDERED: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", (*_BSD, "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", (*_BSD, "bsd-endorse")),
    ("BSD-2-Clause", (*_BSD, "bsd-as-is")),
    ("BSD-2-Clause", _BSD),
    *(("MIT", (*head, *_MIT, *tail)) for tail in (("mit-liability",), ()) for head in (("mit-title",), ("mit-short",), ())),
    ("Apache-2.0", ("apache-2-the", "apache-comply", "apache-obtain", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-2-the", "apache-comply")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-short",)),
    ("Apache-2.0", ("apache-2",)),
    ("Apache-2.0", ("apache-2-the",)),
    ("Apache-2.0", ("apache-2-title",)),
    ("GPL-3.0", ("gpl-3-work",)),
    ("GPL-3.0", ("gpl-3",)),
    ("GPL-2.0", ("gpl-2",)),
    ("LGPL-3.0", ("lgpl-3",)),
    ("AGPL-3.0", ("agpl-3",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("MPL-2.0", ("mpl-2",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("public-domain",)),
    *((f"{kind}-or-later", (f"{kind.split('.')[0].lower()}-later", "gpl-warranty")) for kind in ("GPL-3.0", "GPL-2.0", "AGPL-3.0")),
    ("GPL-3.0-or-later", ("gpl-3-later",)),
    ("GPL-2.0-or-later", ("gpl-2-later",)),
    ("LGPL-3.0-or-later", ("lgpl-3-later",)),
    ("LGPL-2.1-or-later", ("lgpl-2-later",)),
    ("AGPL-3.0-or-later", ("agpl-3-later",)),
    ("MPL-2.0", ("mpl-2-form",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    *((licence, (f"notice-{licence.lower()}",)) for licence in NAMES),
    *((licence, (f"spdx-{licence.lower()}",)) for licence in SPDX),
    ("Proprietary", ("reserved",)),
    ("Proprietary", ("rights",)),
)
#: Rights that are reserved right before an open licence's text belong to its copyright line.
RULES = tuple(rule for name, run in _ORDERED for rule in (
    ((name, ("rights", *run)), (name, run)) if run[0] in ("bsd-redistribute", "mit-grant", "apache-2-the", "apache-2") else ((name, run),)))


def _known(sentences: Column) -> Column:
    """Identifiers of the known sentences, in order."""
    table = F.create_map(*(F.lit(x) for pair in TABLE.items() for x in pair))

    def name(sentence: Column) -> Column:
        plain = F.regexp_replace(F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " ")), POINTER, "")
        return F.coalesce(F.try_element_at(table, plain), F.when(plain.rlike(RIGHTS), "rights").when(plain.rlike(COPYRIGHT), "copyright-line"))

    return F.filter(F.transform(sentences, name), lambda found: found.isNotNull())


def recognise(docs: DataFrame) -> DataFrame:
    """doc_id, ``sentences`` (identifiers in order), ``licences`` (by the order of the rules, each once) and ``rest``
    (identifiers that no rule took, each in angle brackets) of every text."""
    lower = ascii_lower(F.coalesce("text", F.lit("")))
    source = id_and_text(docs).select("doc_id", F.regexp_replace(lower, SPDX_TAG, "\nspdx-license-identifier-").alias("text"))
    by_line, wrapped = _known(F.split("text", r"\n|[.;:!?]\s+")), _known(F.split("text", r"\n[ \t]*\n|[.;:!?]\s+"))
    both = F.struct(by_line.alias("by_line"), wrapped.alias("wrapped"))
    cut = source.select("doc_id", F.explode(F.array(F.when(F.col("text").rlike(CUE), both))).alias("cut"))
    longer = F.when(F.size("cut.wrapped") > F.size("cut.by_line"), F.col("cut.wrapped")).otherwise(F.col("cut.by_line"))
    ids = cut.select("doc_id", F.coalesce(longer, F.array().cast("array<string>")).alias("sentences"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in run)).alias("run")) for name, run in RULES))
    start = F.struct(F.array_join(F.transform(F.array_remove("sentences", "copyright-line"), lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("rest"), F.array().cast("array<string>").alias("licences"))

    def tried(state: Column, rule: Column) -> Column:
        fits = state["rest"].contains(rule["run"])
        return F.when(fits, F.struct(F.replace(state["rest"], rule["run"], F.lit("")).alias("rest"), F.array_append(state["licences"], rule["name"]).alias("licences"))).otherwise(state)

    matched = ids.select("doc_id", "sentences", F.explode(F.array(F.aggregate(rules, start, tried))).alias("state"))
    return matched.select("doc_id", "sentences", F.array_distinct("state.licences").alias("licences"), F.col("state.rest").alias("rest"))


def sql() -> str:
    """The same in DuckDB, as the columns of the registered query."""
    pairs = ", ".join(f"'{text}': '{name}'" for text, name in TABLE.items())

    def known(pieces: str) -> str:
        plain = f"list_transform({pieces}, lambda s: regexp_replace(trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), '{POINTER}', ''))"
        form = f"CASE WHEN regexp_matches(p, '{RIGHTS}') THEN 'rights' WHEN regexp_matches(p, '{COPYRIGHT}') THEN 'copyright-line' END"
        return f"list_filter(list_transform({plain}, lambda p: coalesce((MAP {{{pairs}}})[p], {form})), lambda i: i IS NOT NULL)"

    lines, joined = r"regexp_split_to_array(t, '\n|[.;:!?]\s+')", r"regexp_split_to_array(t, '\n[ \t]*\n|[.;:!?]\s+')"
    steps = [f"""s0 AS (SELECT doc_id, ids, array_to_string(list_transform(list_filter(ids, lambda i: i <> 'copyright-line'), lambda i: '<' || i || '>'), '') AS rest, CAST([] AS VARCHAR[]) AS found FROM
        (SELECT doc_id, CASE WHEN NOT cue THEN CAST([] AS VARCHAR[]) WHEN len(b) > len(a) THEN b ELSE a END AS ids FROM
        (SELECT doc_id, cue, {known(lines)} AS a, {known(joined)} AS b FROM d)))"""]
    for at, (name, run) in enumerate(RULES):
        text = "".join(f"<{i}>" for i in run)
        steps.append(f"""s{at + 1} AS (SELECT doc_id, ids, replace(rest, '{text}', '') AS rest,
            CASE WHEN contains(rest, '{text}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM s{at})""")
    return f"""WITH d AS (SELECT doc_id, t, regexp_matches(t, '{CUE}') AS cue FROM
        (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '{SPDX_TAG}', chr(10) || 'spdx-license-identifier-', 'g') AS t FROM documents)),
        {", ".join(steps)}
        SELECT doc_id, len(ids) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(found, ',') AS licences, rest AS unmatched FROM s{len(RULES)}"""
