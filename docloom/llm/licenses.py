"""License scans: MinHash bands over overlapping text windows find templates, exact shingle containment verifies them.

DataFrame functions only. A band is the smallest hash of a window's shingles under one of BANDS orders. A window and a template
meet in a band if these are equal, so a window can meet a template only if it holds one of the shingles that are smallest in the
template. Positions of these few shingles are found first, and only windows over them are hashed; no meeting is lost by that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, and the share of a template's shingles that a window must hold.
SHINGLE, LEAST = 5, 0.8
#: Bands of one row. Where a template lies in a window of its class, their Jaccard likeness is 0.27 or more even if a fifth of
#: its shingles are changed; then they meet in at least one of 24 bands with probability 1 - 0.73**24 > 0.9994.
BANDS = 24
#: Tables of so many templates at most are broadcast.
BROADCAST_TEMPLATES = 5_000

#: Public license notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-file", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-program", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit-permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def _fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once for each row: the optimizer doesn't put a generator's output in the place of its uses."""
    return df.withColumn(name, F.explode(F.array(value)))


def hop(size: int) -> int:
    return max(1, size // 4)


def holds(size: int) -> int:
    """The longest run of shingles that one of the windows of a size always holds whole."""
    return size - hop(size) + 1


def classes_for(n: int) -> list[int]:
    """Sizes of windows, in shingles, for templates of up to n: powers of two, as many as it takes. Neighbours begin a quarter of
    the size apart."""
    found = [1]
    while holds(found[-1]) < n:
        found.append(2 * found[-1])
    return found


def class_of(n: int) -> int:
    """The smallest window of which one always holds a run of n shingles whole."""
    return classes_for(n)[-1]


def _words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    n = F.size(words) - (SHINGLE - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, SHINGLE)))).otherwise(F.array().cast("array<string>"))


def _hash(shingle: Column) -> Column:
    return F.xxhash64(*[F.xxhash64(F.get(F.split(shingle, " "), F.lit(k))) for k in range(SHINGLE)])


def _bands(hashes: Column) -> Column:
    """For each band the smallest of the hashes in its order, with the hash that has it."""
    one = lambda k: F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, F.lit(k)).alias("low"), h.alias("h"))))
    return F.array(*[F.struct(F.lit(k).alias("band"), one(k)["low"].alias("low"), one(k)["h"].alias("h")) for k in range(BANDS)])


def _lows(bands: Column) -> Column:
    return F.transform(bands, lambda b: b["low"])


def templates_table(spark: SparkSession, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(template, shingles, n, size, bands): templates of at least SHINGLE words, with their window class."""
    rows = F.array(*[F.struct(F.lit(a).alias("template"), F.lit(b).alias("body")) for a, b in templates])
    t = _fixed(spark.range(1).select(F.explode(rows).alias("t")).select("t.*"), "words", _words(F.col("body")))
    t = _fixed(t, "shingles", F.array_distinct(_shingles(F.col("words")))).select("template", "shingles")
    t = t.withColumn("n", F.size("shingles")).where("n > 0")
    known = classes_for(max((len(body) for _, body in templates), default=1))  # a text has fewer words than characters
    size = F.lit(known[-1])
    for c in reversed(known[:-1]):
        size = F.when(F.col("n") <= holds(c), F.lit(c)).otherwise(size)
    t = _fixed(t.withColumn("size", size), "hashes", F.transform("shingles", _hash))
    return _fixed(t, "bands", _bands(F.col("hashes"))).drop("hashes")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, text: str = "text") -> DataFrame:
    """(doc_id, template, containment, first_word, n_windows): the templates of which a window of the document holds LEAST of the
    shingles or more; the highest share, where the first such window begins, and how many there are.

    Null and short texts hold nothing. Rows of equal doc_id, null too, are reported as one document. Templates of fewer than
    SHINGLE words are left out; others may be of any length, as windows grow with them. The driver sees BANDS hashes for each
    template. A window is verified once for a template, at the first band in which they meet. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    table = templates_table(spark, templates)
    known = table.select("template", "size", _lows(F.col("bands")).alias("theirs"), F.explode("bands").alias("b")).select("template", "size", "theirs", "b.band", "b.low", "b.h")
    small = F.broadcast if len(templates) <= BROADCAST_TEMPLATES else (lambda df: df)
    seeds = [r["h"] for r in known.select("h").distinct().collect()]  # BANDS for each template at most
    sizes = [r["size"] for r in table.select("size").distinct().orderBy("size").collect()]

    rows = _fixed(docs.select("doc_id", F.col(text).alias("_text")), "words", _words(F.col("_text"))).drop("_text")
    rows = _fixed(rows, "wh", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("wh") - (SHINGLE - 1)
    at = lambda i: F.xxhash64(*[F.get(F.col("wh"), i + k) for k in range(SHINGLE)])
    places = F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: at(i).isin(seeds))).otherwise(F.array().cast("array<int>"))
    rows = _fixed(rows, "places", places).where(F.size("places") > 0).select("doc_id", "words", "places")

    def starts(size: int) -> Column:
        """Windows of this class that hold a place: multiples of the hop."""
        h = hop(size)
        over = F.transform("places", lambda p: F.sequence(F.greatest(F.ceil((p - (size - 1)) / h), F.lit(0)).cast("int"), F.floor(p / h).cast("int")))
        return F.transform(F.array_distinct(F.flatten(over)), lambda s: F.struct(F.lit(size).alias("size"), (s * h).alias("start"), F.slice("words", s * h + 1, size + SHINGLE - 1).alias("words")))

    windows = rows.select("doc_id", F.explode(F.flatten(F.array(*[starts(s) for s in sizes]))).alias("w")).select("doc_id", "w.*")
    windows = _fixed(_fixed(windows, "held", _shingles(F.col("words"))), "hashes", F.transform("held", _hash))
    met = _fixed(windows, "bands", _bands(F.col("hashes"))).withColumn("lows", _lows(F.col("bands"))).drop("hashes")
    met = met.select("doc_id", "size", "start", "held", "lows", F.explode("bands").alias("b")).select("doc_id", "size", "start", "held", "lows", "b.band", "b.low")
    met = met.join(small(known.drop("h")), ["size", "band", "low"])  # BANDS rows for each template
    met = met.where(F.array_position(F.zip_with("lows", "theirs", lambda a, b: a == b), True) == F.col("band") + 1).select("doc_id", "size", "start", "held", "template")
    met = met.join(small(table.select("template", "shingles", "n")), "template")
    share = F.size(F.array_intersect("held", "shingles")) / F.col("n")
    held = met.withColumn("containment", share).where(F.col("containment") >= LEAST)
    return held.groupBy("doc_id", "template").agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"), F.count_distinct("start").alias("n_windows"))


def op8_licenses(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan(docs)


def _oracle() -> str:
    """Every window of every document against every template, without hashes."""
    quoted = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)
    known = classes_for(max(len(body) for _, body in TEMPLATES))
    size = "CASE " + " ".join(f"WHEN n <= {holds(c)} THEN {c}" for c in known) + " END"
    words = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    shingles = "list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))"
    return f"""
WITH t0 AS (SELECT template, {words.format("body")} AS words FROM (VALUES {quoted}) v(template, body)),
t1 AS (SELECT template, list_distinct({shingles}) AS shingles FROM t0 WHERE len(words) >= 5),
t AS (SELECT template, shingles, len(shingles) AS n, unnest(shingles) AS shingle FROM t1),
ts AS (SELECT template, n, shingle, {size} AS size, greatest(1, {size} // 4) AS hop FROM t),
d0 AS (SELECT doc_id, {words.format("text")} AS words FROM documents),
d1 AS (SELECT doc_id, {shingles} AS held FROM d0 WHERE len(words) >= 5),
d AS (SELECT doc_id, unnest(held) AS shingle, unnest(range(0, len(held))) AS pos FROM d1),
hits AS (
  SELECT d.doc_id, ts.template, ts.n, ts.shingle, ts.hop * unnest(range(CAST(greatest(ceil((pos - (size - 1)) / hop), 0) AS BIGINT), pos // hop + 1)) AS start
  FROM d JOIN ts USING (shingle)),
w AS (SELECT doc_id, template, start, count(DISTINCT shingle) / any_value(n) AS containment FROM hits GROUP BY doc_id, template, start)
SELECT doc_id, template, max(containment) AS containment, CAST(min(start) AS BIGINT) AS first_word, count(*) AS n_windows
FROM w WHERE containment >= 0.8 GROUP BY doc_id, template
"""


ORACLE = _oracle()
