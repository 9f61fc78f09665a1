"""License scan by a positional rare-token index.

Words are the lower-cased (A-Z) runs of letters, digits and non-ASCII characters. One pass over the texts counts
words and notes which words of the templates a file has; files that have all words of a mandatory phrase also keep
the places of these words. Document frequencies are counted over all files. Of each template the ``RARE`` words of
highest IDF are indexed with their positions. Every indexed word of such a file is looked up (the index is of fixed
size) and postings are intersected by relative position: (word's place in the file) - (its place in the template)
agrees for all words of one occurrence. A template counts if the indexed words found at one offset hold ``COVER`` of
its weight and its mandatory phrase is in the file. After the first pass all work is inside a row, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.exprs import ascii_lower
from quillon.store import Stages

#: Runs of the characters outside [\x00-\x2F\x3A-\x60\x7B-\x7F], of a text without A-Z.
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
RARE = 6
COVER = 0.7

# fixed values: phrases and labels of the base
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# fixed values: label, opening words, mandatory phrase
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license", "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published", "lesser general public license"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "without warranty of any kind express or implied"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "distributed on an as is basis"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "endorse or promote products"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "retain the above copyright notice"),
    ("agpl", "under the terms of the gnu affero general public license as published", "affero general public license"),
    ("epl", "made available under the terms of the eclipse public license v 2 0", "eclipse public license"),
    ("bsl", "distributed under the boost software license version 1 0", "boost software license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "without any express or implied warranty"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0 universal"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one", "copy of the mpl"),
]


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def document_frequencies(files: DataFrame) -> tuple[int, dict[str, int]]:
    """How many files there are, and how many have each word of the templates (a bounded list)."""
    rows = files.select(F.explode(F.concat(F.array(F.lit("")), "present")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    counts = {r["w"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def rare_index(n: int, counts: dict[str, int], templates=TEMPLATES) -> list[tuple[int, str, int, float]]:
    """Postings (template, word, place, weight in the template)."""
    idf = lambda w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1
    postings = []
    for i, (_, opening, _) in enumerate(templates):
        words = opening.split()
        rare = sorted(set(words), key=lambda w: (-idf(w), w))[:RARE]
        total = sum(idf(w) for w in words if w in rare)
        postings += [(i, w, place, idf(w) / total) for place, w in enumerate(words) if w in rare]
    return postings


def words_of(docs: DataFrame, vocabulary: list[str], phrases: list[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words, the words of ``vocabulary`` present, and their places (null if no phrase has all its words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # lower() agrees with A-Z lower-casing in the places of words; only the Kelvin sign becomes an ASCII letter
    t = F.when(F.contains(text, F.lit("\u212a")), ascii_lower(text)).otherwise(F.lower(text))
    first = docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"))
    second = first.select("doc_id", "words", F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary))).alias("present"))
    likely = F.lit(False)
    for phrase in phrases:
        all_words = F.lit(True)
        for w in sorted(set(phrase.split()), key=lambda w: (-len(w), w)):
            all_words = all_words & F.array_contains("present", w)
        likely = likely | all_words
    placed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(vocabulary))
    return second.select("doc_id", F.size("words").cast("long").alias("n_words"), "present", F.when(likely, placed).alias("hits"))


def _starts(phrase: list[str]) -> Column:
    """Places where the phrase stands."""

    def here(x, k):
        ok = x["w"] == phrase[0]
        for j in range(1, len(phrase)):
            following = F.get("hits", k + j)
            ok = ok & (following["w"] == phrase[j]) & (following["i"] == x["i"] + j)
        return ok

    return F.transform(F.filter("hits", here), lambda x: x["i"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: words, base places and labels, and the method's labels.

    A null or empty text has no words, no labels and score 0; a very long one is scanned whole.
    Repeated rows and null ids are scanned row by row; of equal covers the score takes either.
    Other columns are not read, so their names may clash with ours. An empty table gives no
    rows. The index is made from the templates, so it does not grow with the documents.
    """
    phrases = sorted({p for _, _, p in templates} | {p for p, _ in BASE})
    vocabulary = sorted({w for _, opening, _ in templates for w in opening.split()} | {w for p in phrases for w in p.split()})
    stages = Stages(docs.sparkSession, "licenses")
    files = stages.keep(words_of(docs, vocabulary, phrases, id_col, text_col), "files")
    postings = rare_index(*document_frequencies(files), templates)

    by_word: dict[str, list[Column]] = {}
    for t, w, q, x in postings:
        by_word.setdefault(w, []).append(F.struct(F.lit(t).alias("t"), F.lit(q).alias("q"), F.lit(x).alias("x")))
    index = F.create_map(*[y for w, found in by_word.items() for y in (F.lit(w), F.array(*found))])
    known = F.filter("hits", lambda h: h["w"].isin(list(by_word)))
    votes = F.flatten(F.transform(known, lambda h: F.transform(F.element_at(index, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["q"]).alias("o"), p["x"].alias("x")))))
    joined = F.transform("hits", lambda h, k: F.concat(F.when(h["i"] == F.get("hits", k - 1)["i"] + 1, "").otherwise("| "), h["w"]))
    first = files.select(
        "doc_id", "n_words", "hits", *[_starts(p.split()).alias(f"at{i}") for i, (p, _) in enumerate(BASE)],
        F.sort_array(votes).alias("votes"), F.concat(F.lit(" "), F.array_join(joined, " "), F.lit(" ")).alias("spaced"),
    )
    # votes are in order of template and offset: one pass closes a sum where either changes
    kind = "struct<t:int,o:int,sum:double,done:array<struct<t:int,cover:double>>>"
    closed = lambda a: F.when(a["sum"] >= COVER - 1e-9, F.array_append(a["done"], F.struct(a["t"].alias("t"), a["sum"].alias("cover")))).otherwise(a["done"])
    add = lambda a, v: F.when(
        (a["t"] == v["t"]) & (a["o"] == v["o"]), F.struct(a["t"].alias("t"), a["o"].alias("o"), (a["sum"] + v["x"]).alias("sum"), a["done"].alias("done"))
    ).otherwise(F.struct(v["t"].alias("t"), v["o"].alias("o"), v["x"].alias("sum"), closed(a).alias("done"))).cast(kind)
    start = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("o"), F.lit(0.0).alias("sum"), F.array().cast("array<struct<t:int,cover:double>>").alias("done")).cast(kind)
    needs = _strings([p for _, _, p in templates])
    labels = _strings([label for label, _, _ in templates])
    every = F.concat(*[F.col(f"at{i}") for i in range(len(BASE))])
    base = F.array_compact(F.array(*[F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    second = first.select(
        "doc_id", "n_words", F.coalesce(every, F.array().cast("array<int>")).alias("at"), F.array_sort(F.array_distinct(base)).alias("base"),
        F.coalesce(
            F.filter(F.aggregate("votes", start, add, closed), lambda x: F.contains(F.col("spaced"), F.concat(F.lit(" "), F.get(needs, x["t"]), F.lit(" ")))),
            F.array().cast("array<struct<t:int,cover:double>>"),
        ).alias("found"),
    )
    n_base = F.size("at").cast("long")
    score = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda x: x["cover"])), F.lit(0.0)), F.when(n_base > 0, 0.5).otherwise(0.0))
    return second.select(
        "doc_id", "n_words", n_base.alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("found", lambda x: F.get(labels, x["t"])))), ",").alias("labels"),
        F.least(F.round(score, 6), F.lit(1.0)).alias("score"),
    )


def _oracle() -> str:
    quote = lambda s: "'" + s + "'"
    words = ", ".join(f"({i}, {quote(w)}, {q})" for i, (_, o, _) in enumerate(TEMPLATES) for q, w in enumerate(o.split()))
    heads = ", ".join(f"({i}, {quote(label)}, {quote(p)})" for i, (label, _, p) in enumerate(TEMPLATES))
    base = ", ".join(f"({quote(p)}, {quote(label)}, {len(p.split())})" for p, label in BASE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
e AS MATERIALIZED (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS p FROM w),
tw(t, w, q) AS (VALUES {words}),
th(t, label, phrase) AS (VALUES {heads}),
bp(phrase, label, size) AS (VALUES {base}),
v AS (SELECT DISTINCT w FROM tw),
idf AS (SELECT v.w, ln(((SELECT count(*) FROM d) + 1.0::DOUBLE) / (count(DISTINCT e.r) + 1.0::DOUBLE)) + 1 AS idf FROM v LEFT JOIN e USING (w) GROUP BY v.w),
rare AS (SELECT t, w, idf FROM (SELECT DISTINCT t, w FROM tw) JOIN idf USING (w) QUALIFY row_number() OVER (PARTITION BY t ORDER BY idf DESC, w) <= {RARE}),
post AS (SELECT tw.t, tw.w, q, idf / sum(idf) OVER (PARTITION BY tw.t) AS weight FROM tw JOIN rare USING (t, w)),
al AS (SELECT e.r, post.t, e.p - post.q AS o, sum(weight) AS cover FROM e JOIN post ON post.w = e.w GROUP BY ALL HAVING cover >= {COVER} - 1e-9),
sp AS (SELECT r, ' ' || array_to_string(words, ' ') || ' ' AS s FROM w),
ok AS (SELECT r, label, cover FROM al JOIN th ON th.t = al.t JOIN sp USING (r) WHERE cover >= {COVER} - 1e-9 AND contains(s, ' ' || phrase || ' ')),
hit AS (SELECT e.r, e.p, bp.label FROM e JOIN w USING (r) JOIN bp ON e.w = string_split(bp.phrase, ' ')[1]
  WHERE array_to_string(words[e.p + 1 : e.p + size], ' ') = bp.phrase),
b AS (SELECT r, count(*) AS n, min(p) AS lo, max(p) AS hi FROM hit GROUP BY r),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT DISTINCT r, label FROM hit) GROUP BY r),
al2 AS (SELECT r, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT r, label FROM hit UNION SELECT r, label FROM ok) GROUP BY r),
mx AS (SELECT r, max(cover) AS c FROM ok GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(bl.l, '') AS base_labels, coalesce(al2.l, '') AS labels,
  least(round(greatest(coalesce(c, 0.0::DOUBLE), CASE WHEN b.n > 0 THEN 0.5 ELSE 0 END), 6), 1.0)::DOUBLE AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN bl USING (r) LEFT JOIN al2 USING (r) LEFT JOIN mx USING (r)
"""


ORACLE_SQL = _oracle()
