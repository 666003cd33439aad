"""Licence scans by a positional rare-token index; only DataFrame functions.

Templates are short licence notices; each has a mandatory key phrase inside it. Over all documents the licence words are
counted by document, which gives each an IDF (a table of at most as many rows as the templates have words). A template is
posted under the POSTED highest-IDF words of its key phrase, with the places they have there. For each text, the places of
licence words come first; each posted word's places propose starts of the template by relative position, and the
proposals of its words are intersected; a start counts if the key phrase stands there word by word and the words around it
that agree hold COVER of the template's IDF.

As the posted words lie in the mandatory phrase, what is found doesn't depend on which are posted, only how fast.
Base phrases (labels cc-by, gpl, reserved) are counted at every place where their words stand consecutively.

`score` is the largest IDF share that a label of the text has: 1 for a base phrase, else its template's cover, else 0.
Everything happens in the row: nothing is shuffled but the word counts. Null and empty texts have no words, no labels and
score 0. Null and repeated doc_ids are scanned row by row; labels of one text are sorted, so that ties don't matter; other
columns are ignored. Without documents there are no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.common import read

#: Share of a template's IDF that has to agree; words of its key phrase under which it is posted.
COVER, POSTED = 0.6, 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHERS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: Phrases of the base and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label: words of the notice, mandatory phrase in it.
TEMPLATES = {
    "agpl-3.0": ("this program is licensed under the gnu affero general public license version 3", "affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "cc by sa"),
    "cc0": ("released under the creative commons zero license cc0 1 0", "cc0 1"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "general public license version 3"),
    "lgpl": ("licensed under the gnu lesser general public license version", "lesser general public license"),
    "mit": ("released under the mit license", "the mit license"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "proprietary": ("all rights reserved no part of this work may be reproduced", "no part of this work may be reproduced"),
}
VOCABULARY = sorted({w for t, _ in TEMPLATES.values() for w in t.split()} | {w for p in BASE for w in p.split()})


def split_words(text: str = "text") -> Column:
    """WORDs of a text, A-Z lowered: every ASCII character outside them becomes a blank, and blanks separate."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER + OTHERS, LOWER + " " * len(OTHERS)), " ", -1), "")


def idf(docs: DataFrame) -> dict[str, float]:
    """ln((documents + 1) / (documents with the word + 1)) + 1 of every licence word."""
    own = docs.select(F.array_intersect(split_words(), F.lit(VOCABULARY)).alias("w"))
    counts = {r.w: r.n for r in own.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = docs.count()
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1 for w in VOCABULARY}


def offset(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def _covers(label: str, weights: dict[str, float]) -> Column:
    """Covers of all starts of a template whose key phrase stands in `words`; `seen`: places of licence words."""
    words, phrase = (x.split() for x in TEMPLATES[label])
    first = offset(words, phrase)
    rare = sorted(range(first, first + len(phrase)), key=lambda k: (-weights[words[k]], k))[:POSTED]
    total = sum(weights[w] for w in words)

    def cover(start: Column) -> Column:
        shares = [F.when(F.get("words", start + k) == w, weights[w] / total).otherwise(0.0) for k, w in enumerate(words)]
        return sum(shares[1:], shares[0])


    def proposed(k: int) -> Column:
        return F.transform(F.filter("seen", lambda i: F.get("words", i) == words[k]), lambda i: i - k)

    starts = reduce(F.array_intersect, map(proposed, rare))
    valid = F.filter(starts, lambda s: (s + first >= 0) & (F.slice("words", F.greatest(s + first, F.lit(0)) + 1, len(phrase)) == F.array(*map(F.lit, phrase))))
    return F.filter(F.transform(valid, lambda s: F.round(cover(s), 9)), lambda c: c >= COVER)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    weights = idf(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), split_words().alias("words"))
    rows = rows.withColumn("seen", F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(VOCABULARY), i))))

    def base_places(phrase: list[str]) -> Column:
        return F.filter("seen", lambda i: F.slice("words", i + 1, len(phrase)) == F.array(*map(F.lit, phrase)))

    places = {label: base_places(phrase.split()) for phrase, label in BASE.items()}
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.size("seen") > 0, F.struct(*(p.alias(f"b{k}") for k, p in enumerate(places.values())), *(_covers(t, weights).alias(f"t{k}") for k, t in enumerate(TEMPLATES)))).alias("f"),
    )
    empty = F.array().cast("array<int>")
    base = [F.coalesce(F.col(f"f.b{k}"), empty) for k in range(len(BASE))]
    found = [F.coalesce(F.col(f"f.t{k}"), F.array().cast("array<double>")) for k in range(len(TEMPLATES))]
    named = lambda labels, own: [F.when(F.size(x) > 0, F.lit(label)) for label, x in zip(labels, own, strict=True)]
    joined = lambda names: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))), ",")
    all_base = F.flatten(F.array(*base))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(all_base).cast("long").alias("n_base"),
        F.array_min(all_base).cast("long").alias("first_word"),
        F.array_max(all_base).cast("long").alias("last_word"),
        joined(named(BASE.values(), base)).alias("base_labels"),
        joined(named(BASE.values(), base) + named(TEMPLATES, found)).alias("labels"),
        F.when(F.size(all_base) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.flatten(F.array(*found))), F.lit(0.0))).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


#: All places of all texts against all templates, without an index.
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
v AS (SELECT unnest({VOCABULARY!r}) AS word),
idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT doc_id) + 1)) + 1 AS x FROM v LEFT JOIN p USING (word) GROUP BY word),
t AS (SELECT label, string_split(t, ' ') AS t, string_split(m, ' ') AS m FROM (VALUES {", ".join(f"('{k}', '{t}', '{m}')" for k, (t, m) in TEMPLATES.items())}) x(label, t, m)),
b AS (SELECT label, string_split(m, ' ') AS m FROM (VALUES {", ".join(f"('{label}', '{m}')" for m, label in BASE.items())}) x(label, m)),
tm AS (SELECT label, t, m, list_position(list_transform(range(1, len(t) - len(m) + 2), lambda k: list_slice(t, k, k + len(m) - 1) = m), true) - 1 AS o FROM t),
tp AS (SELECT label, unnest(t) AS word, unnest(range(len(t))) AS k FROM t),
tot AS (SELECT label, sum(x) AS x FROM tp JOIN idf USING (word) GROUP BY label),
bh AS (SELECT doc_id, i, label FROM p JOIN b ON p.word = m[1] JOIN d USING (doc_id) WHERE list_slice(w, i + 1, i + len(m)) = m),
th AS (SELECT doc_id, i - o AS s, label FROM p JOIN tm ON p.word = m[1] JOIN d USING (doc_id) WHERE list_slice(w, i + 1, i + len(m)) = m),
tc AS (SELECT doc_id, s, label, round(sum(idf.x / tot.x), 9) AS c FROM th JOIN tp USING (label) JOIN p USING (doc_id, word) JOIN idf USING (word) JOIN tot USING (label) WHERE i = s + k GROUP BY doc_id, s, label),
tl AS (SELECT doc_id, label, c FROM tc WHERE c >= {COVER}),
bs AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM bh GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM bh UNION ALL SELECT doc_id, label FROM tl) GROUP BY doc_id),
mx AS (SELECT doc_id, max(c) AS c FROM tl GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(bs.labels, '') AS base_labels, coalesce(al.labels, '') AS labels, CAST(CASE WHEN n > 0 THEN 1 ELSE coalesce(c, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN mx USING (doc_id)
"""
