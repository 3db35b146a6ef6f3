"""Licence scans with a positional rare-token index, in DataFrame operations only.

Templates are word sequences: short notices, and the grants and headers of common licences in full. One pass over the
corpus finds the places of each file's licence words and counts in how many files each of them stands; the KEYS rarest
words of a template index it. The index is a small table of postings (word, template, place in the template): a file's
licence words join it, and each hit votes for start = position - place. Grouped by file, template and start, the votes are
the intersection of the postings by relative position: a base phrase stands where all its words vote for one start; a
template adds its label where LEAST_SHARE of its keys and every word of its mandatory phrases vote for one start.

Words are runs of 0-9, a-z and non-ASCII characters after A-Z is lower-cased; a text is scanned whole. Files without the
rarest mandatory word of any template are done; only starts of the others are shuffled, counted before, and the counts of
the licence words.

Defined results: null counts as empty; a file without a base phrase has n_base 0, null first_word and last_word, and
an empty base_labels; templates found add labels; score is the best share of a template's keys in place, MENTION where
a base phrase stands without a better template, else 0; an empty table gives no rows; other columns are kept, those
named as the outputs are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import join_small, written

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
KEYS, LEAST_SHARE, MENTION = 8, 0.7, 0.5
#: Label, text and mandatory phrases of each template, as the licences have them.
TEMPLATES = [
    ("gpl-3.0", "This work is licensed under the GNU General Public License version 3", ["GNU General Public License version 3"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License version 2", ["GNU General Public License version 2"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["Apache License, Version 2.0"]),
    ("mit", "Released under the MIT License", ["under the MIT License"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["CC BY-NC 4.0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["CC BY-SA 4.0"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["CC BY 4.0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["Creative Commons Attribution 4.0"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["Creative Commons Attribution-ShareAlike 4.0"]),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software.""", ["Permission is hereby granted, free of charge", "without restriction"]),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""", ["with or without fee is hereby granted"]),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met""", ["Redistribution and use in source and binary forms"]),
    ("bsd-3-clause", """may be used to endorse or promote products derived from this software without specific prior written
permission""", ["endorse or promote products derived from this software"]),
    ("apache-2.0", """you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License.""", ["except in compliance with the License", "www.apache.org/licenses/LICENSE-2.0"]),
    ("gpl-3.0", """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version""", ["GNU General Public License as published by", "version 3 of the License"]),
    ("gpl-2.0", """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation; either version 2 of the License, or (at your option) any later version""", ["GNU General Public License as published by", "version 2 of the License"]),
    ("lgpl", """under the terms of the GNU Lesser General Public License as published by the Free Software Foundation""", ["GNU Lesser General Public License"]),
    ("agpl", """under the terms of the GNU Affero General Public License as published by the Free Software Foundation""", ["GNU Affero General Public License"]),
    ("lgpl", "licensed under the GNU Lesser General Public License", ["GNU Lesser General Public License"]),
    ("agpl", "licensed under the GNU Affero General Public License", ["GNU Affero General Public License"]),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at""", ["Mozilla Public License, v. 2.0"]),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""", ["free and unencumbered software released into the public domain"]),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely""", ["alter it and redistribute it freely"]),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license""", ["any person or organization obtaining a copy of the software"]),
]
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_of(phrase: str) -> list[str]:
    return re.findall("[0-9a-z]+", phrase.lower())


def _find(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def _postings() -> list[tuple[int, int, str, bool]]:
    """(template, place, word, must) of every word that may be a key (six letters or more) or must stand. The base phrases
    come first, as templates whose every word must stand."""
    out = [(t, i, w, True) for t, p in enumerate(BASE) for i, w in enumerate(_words_of(p))]
    for t, (_, text, mandatory) in enumerate(TEMPLATES, len(BASE)):
        words = _words_of(text)
        must = {_find(words, m) + i for m in map(_words_of, mandatory) for i in range(len(m))}
        out += [(t, i, w, i in must) for i, w in enumerate(words) if i in must or len(w) >= 6]
    return out


POSTINGS = _postings()
LABELS = [*BASE.values(), *(label for label, _, _ in TEMPLATES)]
VOCABULARY = sorted({w for _, _, w, _ in POSTINGS})


def scan_words(text: Column) -> Column:
    """All words of a text in order."""
    text = F.coalesce(text, F.lit(""))
    # lower() differs from A-Z alone only where it makes a Latin letter: of the Kelvin sign, and of a dotted I, whose dot stays a mark of its own
    low = F.when(text.contains("\u212a"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def _with_hits(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with n_words and __hits: licence words with their places."""
    names = [c for c in docs.columns if c.lower() not in ("n_words", "__hits", "__row")]
    known = F.array(*map(F.lit, VOCABULARY))
    words = docs.select(*names, scan_words(F.col(text_col)).alias("__w"))
    places = F.filter(F.transform("__w", lambda w, i: F.when(w.isin(VOCABULARY), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    hits = F.when(F.arrays_overlap("__w", known), places)
    return words.select(*names, F.size("__w").cast("long").alias("n_words"), hits.alias("__hits"), F.monotonically_increasing_id().alias("__row"))


def document_frequencies(hits: DataFrame) -> dict[str, int]:
    """In how many files each licence word stands, over all files; at most one number for each word of the vocabulary."""
    rows = hits.select(F.explode(F.array_distinct(F.transform("__hits", lambda h: h["w"]))).alias("w")).groupBy("w").count().collect()
    return dict.fromkeys(VOCABULARY, 0) | {r.w: r["count"] for r in rows}


def keyed_postings(frequency: dict[str, int]) -> list[tuple[int, int, str, bool, bool]]:
    """POSTINGS with whether a place is one of its template's KEYS rarest; places that are neither key nor must are left out."""
    keys = set()
    for t in range(len(LABELS)):
        mine = sorted((frequency[w], i) for k, i, w, _ in POSTINGS if k == t)
        keys |= {(t, i) for _, i in mine[:KEYS]}
    return [(t, i, w, (t, i) in keys, must) for t, i, w, must in POSTINGS if must or (t, i) in keys]


def rare_words(frequency: dict[str, int]) -> list[str]:
    """Of each template the rarest word that must stand: a file without one of these has no licence."""
    return sorted({min((frequency[w], w) for k, _, w, must in POSTINGS if k == t and must)[1] for t in range(len(LABELS))})


def scan_licenses(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score. The text is kept or left out."""
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    names = [c for c in docs.columns if c.lower() not in made and (keep_text or c != text_col)]
    rows = written(_with_hits(docs, text_col).select(*names, "n_words", "__hits", "__row"), "hits")
    frequency = document_frequencies(rows)
    table, rare = keyed_postings(frequency), rare_words(frequency)
    spark, base = docs.sparkSession, len(BASE)
    postings = spark.createDataFrame(table, "t int, place int, w string, key boolean, must boolean")
    needs = [(t, LABELS[t], t < base, sum(k for x, _, _, k, _ in table if x == t), sum(m for x, _, _, _, m in table if x == t)) for t in range(len(LABELS))]
    needs = spark.createDataFrame(needs, "t int, label string, is_base boolean, keys int, musts int")
    hits = rows.where(F.exists("__hits", lambda h: h["w"].isin(rare))).select("__row", F.explode("__hits").alias("h")).select("__row", "h.w", "h.i")
    votes = hits.join(F.broadcast(postings), "w")  # a fixed table of some hundred rows
    starts = votes.groupBy("__row", "t", (F.col("i") - F.col("place")).alias("start")).agg(F.count_if("key").alias("k"), F.count_if("must").alias("m"))
    share = F.col("k") / F.col("keys")
    found = starts.join(F.broadcast(needs), "t").where((F.col("m") == F.col("musts")) & (share >= LEAST_SHARE))
    place = F.when(F.col("is_base"), F.col("start")).cast("long")
    names_of = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_row = found.groupBy(F.col("__row").alias("__r")).agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"), names_of(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"), names_of("label").alias("labels"),
        F.max(F.when(F.col("is_base"), F.lit(MENTION)).otherwise(share)).alias("score"),
    )
    out = join_small(rows.drop("__hits"), written(by_row, "licences"), F.col("__row") == F.col("__r"), "left")
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select(*names, "n_words", *(F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in made[1:]))


#: The same votes as joins over all words.
ORACLE = f"""
WITH postings(t, place, word, must) AS (VALUES {", ".join(f"({t}, {i}, '{w}', {str(m).lower()})" for t, i, w, m in POSTINGS)}),
named(t, label, is_base) AS (VALUES {", ".join(f"({t}, '{label}', {str(t < len(BASE)).lower()})" for t, label in enumerate(LABELS))}),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
h AS MATERIALIZED (SELECT * FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d) WHERE word IN (SELECT word FROM postings)),
df AS (SELECT word, count(DISTINCT doc_id) AS files FROM h GROUP BY word),
p AS (SELECT postings.*, row_number() OVER (PARTITION BY t ORDER BY coalesce(files, 0), place) <= {KEYS} AS key FROM postings LEFT JOIN df USING (word)),
n AS (SELECT t, count(*) FILTER (key) AS keys, count(*) FILTER (must) AS musts FROM p GROUP BY t),
v AS (SELECT doc_id, t, pos - place AS s, count(*) FILTER (key) AS k, count(*) FILTER (must) AS m FROM h JOIN p USING (word) GROUP BY ALL),
f AS (SELECT doc_id, label, is_base, s, CASE WHEN is_base THEN {MENTION}e0 ELSE k / keys::DOUBLE END AS share FROM v JOIN n USING (t) JOIN named USING (t) WHERE m = musts AND k / keys::DOUBLE >= {LEAST_SHARE}e0),
r AS (SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(s) FILTER (is_base) AS first_word, max(s) FILTER (is_base) AS last_word, max(share) AS score,
string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score FROM d LEFT JOIN r USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs, keep_text=False)
