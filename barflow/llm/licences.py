"""Licence texts in documents: MinHash bands over text windows find candidates, exact shingle containment confirms them.

Words are runs of letters and digits, lower-cased. A document's shingles of three words are cut into overlapping windows
(8 words, every 4), and each window is described by the smallest value of its shingles under `BANDS` permutations. Every
permutation is a band of one row, so a window and a template window of similarity s meet in some band with probability
1 - (1 - s)^BANDS: for the shortest template, 5 words that some window always holds whole, s is 1/2 and that is 0.999.
Bands that equal one of the templates' retrieve it; a candidate is confirmed if the whole document holds at least
`CONTAINED` of the template's shingles.

Everything is DataFrame and SQL functions, in one pass over the documents: no document is shuffled, and each is described
by itself, so no source or group of copies can overload a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 3
WINDOW = 8
STRIDE = 4
BANDS = 10
CONTAINED = 0.75
#: band values of all templates together
MOST = 200_000

#: fixed values: short licence notices
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often and wherever the body mentions it."""
    return F.transform(F.array(value), body)[0]


def _shingles(text: Column) -> Column:
    """Hashes of all runs of three words; of the whole sequence where there are fewer; none without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def runs(h: Column) -> Column:
        # three aligned copies of the word hashes, zipped: one hash for every start
        parts = [F.slice(h, k + 1, F.greatest(F.size(h) - SHINGLE + 1, F.lit(0))).alias(f"w{k}") for k in range(SHINGLE)]
        return F.transform(F.arrays_zip(*parts), lambda z: F.xxhash64(*[z[f"w{k}"] for k in range(SHINGLE)]))

    def of(h: Column) -> Column:
        return F.when(F.size(h) >= SHINGLE, runs(h)).when(F.size(h) > 0, F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _bands(shingles: Column, starts: Column) -> Column:
    """Band values of every window: the smallest shingle under each permutation. The band's number is part of the hash."""

    def band(b: int) -> Column:
        return _let(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(b))), lambda p: F.transform(starts, lambda i: F.array_min(F.slice(p, i, WINDOW - SHINGLE + 1))))

    return F.concat(*[band(b) for b in range(BANDS)])


def template_table(templates: DataFrame) -> DataFrame:
    """(licence, shingles, value) of templates (licence, text), from windows at every word."""
    t = templates.filter("licence is not null and text is not null").select("licence", _shingles(F.col("text")).alias("shingles")).filter(F.size("shingles") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("shingles") - (WINDOW - SHINGLE), F.lit(1)))
    return t.select("licence", "shingles", F.explode(F.array_distinct(_bands(F.col("shingles"), starts))).alias("value")).withColumn("shingles", F.array_distinct("shingles"))


def scan(docs: DataFrame, templates: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """doc_id, licence, found and of (shingles of the template that the document holds, and all), one row per match and row
    of `docs`.

    Null, empty and wordless texts match nothing; repeated rows match each for itself; an empty table gives an empty result
    and other columns are left out. Of two templates with one name the shingles are united. The template table is gathered
    into one row beside every document; more than `MOST` band values in it raise an error.
    """
    table = template_table(templates)
    names = table.groupBy("value").agg(F.collect_set("licence").alias("licences"))
    contents = table.groupBy("licence").agg(F.array_distinct(F.flatten(F.collect_set("shingles"))).alias("shingles"))
    one = names.agg(F.collect_list("value").alias("values"), F.map_from_entries(F.collect_list(F.struct("value", "licences"))).alias("named"))
    one = one.crossJoin(contents.agg(F.map_from_entries(F.collect_list(F.struct("licence", "shingles"))).alias("contents")))
    one = one.withColumn("values", F.when(F.size("values") <= MOST, F.col("values")).otherwise(F.raise_error(F.lit("too many templates for one row"))))

    def starts(x: Column) -> Column:
        last = F.greatest(F.size(x) - (WINDOW - SHINGLE) + STRIDE - 1, F.lit(1))
        return F.when(F.size(x) > 0, F.sequence(F.lit(1), last, F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))

    # a generator keeps what it makes from being computed again further up
    described = _let(_shingles(F.col("text")), lambda x: F.struct(x.alias("shingles"), _bands(x, starts(x)).alias("bands")))
    rows = docs.select("doc_id", F.inline(F.array(described))).crossJoin(F.broadcast(one))  # one row
    retrieved = _let(F.array_intersect("bands", "values"), lambda met: F.array_distinct(F.flatten(F.transform(met, lambda v: F.element_at("named", v)))))
    pairs = rows.select("doc_id", "shingles", "contents", F.explode(retrieved).alias("licence"))
    whole = F.element_at("contents", F.col("licence"))
    counted = pairs.select("doc_id", "licence", F.size(F.array_intersect(whole, F.col("shingles"))).cast("long").alias("found"), F.size(whole).cast("long").alias("of"))
    return counted.filter(F.col("found") >= F.lit(contained) * F.col("of"))
