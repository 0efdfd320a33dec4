"""Licence scans by a positional rare-token index, with DataFrame operations only.

The templates below are short notices and whole licence texts. Their words other than STOP and short
words are the index's tokens; a posting is (token, template, position). All licence words of a file
are looked up. Each hit votes for the offset at which the template would start. Votes meet in windows
of offsets, 2 SLACK wide and overlapping by half, so that words left out or put in between, up to SLACK of
them, don't part them. In a window each posting counts once, weighted by IDF (from the number of
documents that have the word, over all documents). A template is found where a window gets MIN_SCORE of
the weight of all its postings, and has all its mandatory key phrases, word by word, at offsets of the same window.

The templates bound the postings, the IDF table and the key phrases, so these are broadcast. Texts
are read once: what stays of a document is the positions of the licence words in it. Key phrases are
only looked for in documents that have a window with enough votes.

Defined results: a null or empty text has no words, labels or places; repeated rows are scanned one
by one (rows are told apart by a number given at the checkpoint); an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import checkpointed, table

#: A word of a lower-cased text, and of one that isn't: runs of letters, digits and anything not ASCII.
#: Written by what they have: Java matches the complements of these classes twenty times slower.
WORDS = "[0-9a-z\u0080-\U0010ffff]+"
WORDS_ANY_CASE = "[0-9A-Za-z\u0080-\U0010ffff]+"

#: The share of a template's weight that finds it, and how many words may be put in or left out.
MIN_SCORE, SLACK = 0.6, 8

#: Phrases whose places are counted, by label.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

# The words of public licences.

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form
must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""

GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version {} of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""

UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
software."""

#: (label, template, its mandatory key phrases)
TEMPLATES = [
    *[(label, phrase, (phrase,)) for label, phrase in BASE.items()],
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", MIT.partition(", including")[0], ("permission is hereby granted", "without restriction")),
    ("mit", MIT, ("permission is hereby granted", "substantial portions of the software")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", APACHE, ("apache license version 2 0", "required by applicable law")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", GPL.format(3), ("gnu general public license", "either version 3")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2.0", GPL.format(2), ("gnu general public license", "either version 2")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("bsd", BSD.partition(": 1.")[0], ("redistribution and use", "are permitted provided that")),
    ("bsd", BSD, ("redistribution and use", "redistributions in binary form must reproduce")),
    ("isc", ISC.partition(", provided")[0], ("permission to use copy modify", "fee is hereby granted")),
    ("isc", ISC, ("permission to use copy modify", "appear in all copies")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", UNLICENSE.partition(".")[0], ("unencumbered software", "public domain")),
    ("unlicense", UNLICENSE, ("unencumbered software", "public domain")),
    ("zlib", ZLIB, ("alter it and redistribute it freely", "must not be misrepresented")),
]

#: Words that are no tokens; short ones aren't either, but for those of SHORT.
STOP = set("above agreed anyone appear arising author authors charge claim code copies copy deal even event except fitness following form forms free freely from hands hope including into kind later list means must obtain option origin other otherwise person persons portions program provided purpose regard required restriction rights source subject terms that this under useful using whether will with without writing wrote your".split())
SHORT = set("affero agpl bsd by cc gnu gpl isc mit nc nd sa".split()) - {"by"}
TOKEN_LETTERS = 5


def template_words(text: str) -> list[str]:
    return re.findall(WORDS, text.lower())


class Index:
    """Postings, key phrases and the tokens of a list of templates."""

    def __init__(self, templates=TEMPLATES) -> None:
        self.labels = [label for label, _, _ in templates]
        #: (token, template, position); (phrase, template, position of its start, phrases of the template).
        self.postings: list[tuple[str, int, int]] = []
        self.keys: list[tuple[str, int, int, int]] = []
        for n, (_, text, phrases) in enumerate(templates):
            words = template_words(text)
            self.postings += [(w, n, at) for at, w in enumerate(words) if w in SHORT or (len(w) >= TOKEN_LETTERS and w not in STOP)]
            for phrase in phrases:
                part = phrase.split()
                start = next(k for k in range(len(words)) if words[k : k + len(part)] == part)
                self.keys.append((phrase, n, start, len(phrases)))
        self.phrases = sorted({phrase for phrase, _, _, _ in self.keys})
        self.tokens = sorted({w for w, _, _ in self.postings})
        # All words that are kept of a document: the index's and those of key phrases.
        self.words = sorted(set(self.tokens).union(*[p.split() for p in self.phrases]))


def _trie_pattern(words: list[str]) -> str:
    """A regular expression for any of the words at a word's start, its branches sharing prefixes."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def write(node: dict) -> str:
        if "" in node:  # a shorter word ends here: what follows doesn't matter to a filter
            return ""
        parts = [c + write(below) for c, below in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return f"(?i)(?<![A-Za-z0-9]){write(tree)}"


def _places(phrase: str) -> Column:
    """The starts of the phrase in `hits`, where all its words are kept and so stand side by side."""
    words = phrase.split()

    def starts(hit: Column, i: Column) -> Column:
        test = hit["w"] == words[0]
        for k, word in enumerate(words[1:], 1):
            other = F.get(F.col("hits"), i + k)
            test = test & (other["w"] == word) & (other["pos"] == hit["pos"] + k)
        return F.coalesce(test, F.lit(False))

    return F.transform(F.filter("hits", starts), lambda hit: hit["pos"])


def licence_words(docs: DataFrame, index: Index) -> DataFrame:
    """row (a number), doc_id, n_words and hits: the positions of the index's words, in order. Checkpointed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(WORDS), F.lit(0))
    numbered = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("w")))
    hits = F.when(text.rlike(_trie_pattern(index.tokens)), F.filter(numbered, lambda hit: hit["w"].isin(index.words))).otherwise(F.array().cast("array<struct<pos:int,w:string>>"))
    return checkpointed(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.regexp_count(text, F.lit(WORDS_ANY_CASE)).cast("long").alias("n_words"), hits.alias("hits")))


def _windows(offset: Column) -> Column:
    """The two windows of an offset, as numbers."""
    width = 2 * SLACK
    return F.array(2 * F.floor(offset / width), 2 * F.floor((offset + SLACK) / width) + 1)


def found_templates(rows: DataFrame, index: Index) -> DataFrame:
    """(row, template, score) of the verified templates, the best window of each."""
    spark = rows.sparkSession
    some = rows.where(F.size("hits") > 0)
    known = F.col("w").isin(index.tokens)
    present = some.select(F.explode(F.array_distinct(F.transform("hits", lambda hit: hit["w"]))).alias("w")).where(known).groupBy("w").agg(F.count("*").alias("df"))
    n = rows.count()
    # As many rows as the templates have different words.
    idf = {r["w"]: r["idf"] for r in present.select("w", F.log((F.lit(n) + 1.0) / (F.col("df") + 0.5)).alias("idf")).collect()}
    weight = {w: max(idf.get(w, 0.0), 1e-3) for w in index.tokens}
    total: dict[int, float] = {}
    for w, t, _ in index.postings:
        total[t] = total.get(t, 0.0) + weight[w]
    postings = spark.createDataFrame([(w, t, at, weight[w] / total[t]) for w, t, at in index.postings], "w string, template int, at int, share double")
    keys = spark.createDataFrame([(p, t, at, size) for p, t, at, size in index.keys], "phrase string, template int, at int, n_keys int")

    looked_up = some.select("row", F.explode(F.filter("hits", lambda hit: hit["w"].isin(index.tokens))).alias("hit"))
    votes = looked_up.select("row", "hit.pos", "hit.w").join(F.broadcast(postings), "w").select("row", "template", F.explode(_windows(F.col("pos") - F.col("at"))).alias("window"), F.struct("at", "share").alias("posting"))
    # A set is bounded by the template's postings.
    share = F.aggregate(F.collect_set("posting"), F.lit(0.0), lambda sum_, posting: sum_ + posting["share"])
    aligned = checkpointed(votes.groupBy("row", "template", "window").agg(F.least(share, F.lit(1.0)).alias("score")).where(F.col("score") >= MIN_SCORE))

    def placed(phrase: str) -> Column:
        return F.transform(_places(phrase), lambda pos: F.struct(F.lit(phrase).alias("phrase"), pos.alias("pos")))

    places = F.flatten(F.array(*map(placed, index.phrases)))
    there = some.join(aligned.select("row").distinct(), "row", "left_semi").select("row", F.explode(places).alias("place")).select("row", "place.*")
    stand = there.join(F.broadcast(keys), "phrase").select("row", "template", "n_keys", "phrase", F.explode(_windows(F.col("pos") - F.col("at"))).alias("window"))
    whole = stand.groupBy("row", "template", "window", "n_keys").agg(F.size(F.collect_set("phrase")).alias("n")).where("n = n_keys")
    return aligned.join(whole, ["row", "template", "window"]).groupBy("row", "template").agg(F.max("score").alias("score"))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row."""
    index = Index(templates)
    rows = licence_words(docs, index)
    names = F.array(*map(F.lit, index.labels))
    found = found_templates(rows, index).groupBy("row").agg(F.collect_set(F.element_at(names, F.col("template") + 1)).alias("found"), F.max("score").alias("score"))
    places = [(label, _places(phrase)) for label, phrase in BASE.items()]
    base = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for label, p in places]))
    placed = rows.select("row", "doc_id", "n_words", F.flatten(F.array(*[p for _, p in places])).alias("at"), base.alias("base"))
    none = F.array().cast("array<string>")
    return placed.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"),
    )


def op3_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(repr(x) for x in row)})" for row in rows)


def _scan_sql(templates=TEMPLATES) -> str:
    """The scan in DuckDB SQL; tables that the templates give are written out."""
    index = Index(templates)

    def places(phrase: str) -> str:
        words = phrase.split()
        joins = "".join(f" JOIN hits h{k} ON h{k}.rid = h0.rid AND h{k}.pos = h0.pos + {k} AND h{k}.w = '{w}'" for k, w in enumerate(words) if k)
        return f"SELECT '{phrase}' AS phrase, h0.rid, h0.pos FROM hits h0{joins} WHERE h0.w = '{words[0]}'"

    def windows(offset: str) -> str:
        return f"unnest([2 * floor(({offset}) / {2 * SLACK}.0)::BIGINT, 2 * floor(({offset} + {SLACK}) / {2 * SLACK}.0)::BIGINT + 1])"

    all_places = " UNION ALL ".join(map(places, index.phrases))
    return rf"""
WITH labels_of(template, label) AS (VALUES {_values(list(enumerate(index.labels)))}),
postings(w, template, place) AS (VALUES {_values(index.postings)}),
keys(phrase, template, place, n_keys) AS (VALUES {_values(index.keys)}),
base_of(label, phrase) AS (VALUES {_values(list(BASE.items()))}),
texts AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
hits AS MATERIALIZED (
  SELECT * FROM (SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS pos FROM texts)
  WHERE w IN ({', '.join(repr(w) for w in index.words)})),
weights AS (
  SELECT w, greatest(coalesce(ln(((SELECT count(*) FROM texts) + 1.0::DOUBLE) / (any_value(df) + 0.5::DOUBLE)), 0.0::DOUBLE), 0.001::DOUBLE) AS weight
  FROM (SELECT DISTINCT w FROM postings) LEFT JOIN (SELECT w, count(DISTINCT rid) AS df FROM hits GROUP BY w) USING (w) GROUP BY w),
totals AS (SELECT template, sum(weight) AS total FROM postings JOIN weights USING (w) GROUP BY template),
votes AS (SELECT DISTINCT rid, template, place, w, {windows("pos - place")} AS win FROM hits JOIN postings USING (w)),
aligned AS (
  SELECT rid, template, win, least(sum(weight / total), 1.0::DOUBLE) AS score
  FROM votes JOIN weights USING (w) JOIN totals USING (template)
  GROUP BY ALL HAVING least(sum(weight / total), 1.0::DOUBLE) >= {MIN_SCORE}::DOUBLE),
places AS MATERIALIZED ({all_places}),
stand AS (SELECT DISTINCT rid, template, phrase, n_keys, {windows("pos - place")} AS win FROM places JOIN keys USING (phrase)),
verified AS (SELECT rid, template, win FROM stand GROUP BY rid, template, win, n_keys HAVING count(*) = n_keys),
found AS (SELECT rid, label, max(score) AS score FROM aligned JOIN verified USING (rid, template, win) JOIN labels_of USING (template) GROUP BY rid, label),
base AS (
  SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places JOIN base_of USING (phrase) GROUP BY rid),
all_labels AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT rid, label FROM places JOIN base_of USING (phrase) UNION SELECT rid, label FROM found) GROUP BY rid),
best AS (SELECT rid, max(score) AS score FROM found GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0::DOUBLE), 9) AS score
FROM texts LEFT JOIN base USING (rid) LEFT JOIN all_labels USING (rid) LEFT JOIN best USING (rid)
"""


OP3_SQL = _scan_sql()
