"""License scans by diagonal voting, in DataFrame operations only.

Templates (license notices, excerpts of license texts, and the base phrases) and documents are cut into words; every rolling word bigram
of a text is hashed and joined with the bigrams of the templates. A hit at text position p and template position t votes
for the diagonal p - t: a template that stands in the text whole puts all its votes on one diagonal. Votes are counted
by diagonal; neighbouring diagonals, which words put in or left out lead to, are merged into one span. A span is then
verified: bigrams are compared as text after the join by hash, and of the diagonals after a span's first only those
votes count that lie further on in the text and in the template than all before them, so what is covered is covered in
the template's order. A span counts if that is enough of the template.

A bitmap of the template hashes (a literal of fixed size) lets the array of a text's bigrams drop those that cannot
join, before rows are made of them; it never drops one that does.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import ascii_lower, prepare

#: Phrases whose places are counted, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Usual names and wordings of licenses, and the labels that the method adds for them.
NOTICES = {
    "mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under the mozilla public license version 2 0": "mpl-2",
    "all rights reserved no part of this publication may be reproduced": "proprietary",
}
#: Excerpts of license texts by label, without title and copyright lines; some leave the disclaimer out.
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.""",
}
#: Most bigrams of a template, whose positions are the bits of a long; longer texts are cut into sections.
LONGEST = 60
#: What lies between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Longwords of the bitmap, 64 bits each.
BITMAP = 256
#: Diagonals apart, and words apart, that are still one span; and the share of a notice that a span must cover.
DRIFT, REACH, COVER = 3, 8, 0.82


@cache
def templates() -> tuple[tuple[int, str, str, bool], ...]:
    """(number, words, label, base). The sections of a long text are as even as can be and share their border words."""
    found = [*((w, v, True) for w, v in BASE.items()), *((w, v, False) for w, v in NOTICES.items())]
    for label, text in TEXTS.items():
        w = re.findall("[a-z0-9]+", text.lower())
        parts = -(-(len(w) - 1) // LONGEST)
        edges = [(len(w) - 1) * k // parts for k in range(parts + 1)]
        found += [(" ".join(w[s : e + 1]), label, False) for s, e in zip(edges, edges[1:], strict=False)]
    return tuple((i, *x) for i, x in enumerate(found))


def words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def positions(spark: SparkSession) -> DataFrame:
    """(template, at, gram, h, size): the bigrams of the templates; a table of fixed size."""
    rows = []
    for i, text, _, _ in templates():
        w = text.split(" ")
        if not 2 <= len(w) <= LONGEST + 1:
            raise ValueError(f"a template needs 2 to {LONGEST + 1} words: {text!r}")
        rows += [(i, k, f"{w[k]} {w[k + 1]}", w[k], w[k + 1], len(w) - 1) for k in range(len(w) - 1)]
    table = spark.createDataFrame(rows, "template int, at int, gram string, a string, b string, size int")
    return table.select("template", "at", "gram", F.xxhash64("a", "b").alias("h"), "size")


@cache
def _bitmap_of(hashes: tuple[int, ...]) -> tuple[int, ...]:
    bits = [0] * BITMAP
    for h in hashes:
        bits[(h >> 6) & (BITMAP - 1)] |= 1 << (h & 63)
    return tuple(b - (1 << 64) if b >> 63 else b for b in bits)


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row with what its whole text holds.

    ``n_words``; ``n_base``, ``first_word``, ``last_word``: places where a base phrase's words stand consecutively, and
    the smallest and largest of their starts (words count from 0); ``base_labels``; ``labels``, with those that the
    method adds; ``score``: the largest share of a template that one span covers (0 to 1); ``spans``: array of (label,
    first word, last word, covered share) of the notices found.

    Null and empty texts, and texts of one word, hold nothing. A text of any length is one row's array of words; only
    its hits become rows. Repeated rows each come back; of equal places none is preferred, all are counted; an empty
    table gives no rows. Extra columns play no part, whatever their names.
    """
    spark = prepare(docs.sparkSession)
    table = positions(spark)
    hashes = tuple(sorted(r["h"] for r in table.select("h").distinct().collect()))
    bitmap = F.array(*map(F.lit, _bitmap_of(hashes)))
    pair = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1))
    # Rows are told apart by a number made in the scan, so repeated or null ids do no harm.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own"), words(F.col(f"`{text_col}`")).alias("w"))
    at = F.when(F.size("w") > 1, F.sequence(F.lit(0), F.size("w") - 2)).otherwise(F.array().cast("array<int>"))
    may = F.filter(at, lambda i: F.getbit(F.get(bitmap, (F.shiftright(pair(i), 6).bitwiseAND(F.lit(BITMAP - 1))).cast("int")), pair(i).bitwiseAND(F.lit(63)).cast("int")) == 1)
    grams = F.transform(may, lambda i: F.struct(i.alias("p"), pair(i).alias("h"), F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)).alias("gram")))
    # The first element stands for the row itself, so that rows without a hit stay.
    self_ = F.array(F.struct(F.lit(-1).alias("p"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("string").alias("gram")))
    each = rows.select("row", "own", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(self_, grams)).alias("g"))
    each = each.select("row", F.when(F.col("g.p") < 0, F.col("own")).alias("own"), F.when(F.col("g.p") < 0, F.col("n_words")).alias("n_words"), F.col("g.p").alias("p"), F.col("g.h").alias("h"), F.col("g.gram").alias("gram"))
    hit = each.join(F.broadcast(table), ["h", "gram"], "left").filter("template IS NOT NULL OR p < 0")
    votes = hit.groupBy("row", "template", (F.col("p") - F.col("at")).alias("diagonal")).agg(
        F.first("own", ignorenulls=True).alias("own"), F.max("n_words").alias("n_words"), F.max("size").alias("size"),
        F.min("p").alias("low"), F.max("p").alias("high"), F.max("at").alias("top"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce("at", F.lit(0)))).alias("covered"),
    )
    # Neighbouring diagonals are a band; in order of their place in the text, a span goes on while the next is near.
    lead = W.Window.partitionBy("row", "template")
    votes = votes.withColumn("far", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(lead.orderBy("diagonal")) > DRIFT).cast("int"), F.lit(0)))
    votes = votes.withColumn("band", F.sum("far").over(lead.orderBy("diagonal")))
    order = W.Window.partitionBy("row", "template", "band").orderBy("low", "diagonal")
    gap = F.col("low") - F.max("high").over(order.rowsBetween(W.Window.unboundedPreceding, -1)) > REACH
    votes = votes.withColumn("new", F.coalesce(gap.cast("int"), F.lit(0)))
    votes = votes.withColumn("span", F.struct("band", F.sum("new").over(order).alias("part")))
    # Verified in order: past the largest template position before, and past the place of the largest text position.
    before = W.Window.partitionBy("row", "template", "span").orderBy("low", "diagonal").rowsBetween(W.Window.unboundedPreceding, -1)
    past = F.greatest(F.max("top").over(before), F.max("high").over(before) - F.col("diagonal"))
    ahead = F.call_function("shiftleft", F.lit(-1).cast("long"), F.least(F.greatest(past + 1, F.lit(0)), F.lit(62)).cast("int"))
    votes = votes.withColumn("in_order", F.when(past.isNull(), F.col("covered")).otherwise(F.col("covered").bitwiseAND(ahead)))
    spans = votes.groupBy("row", "template", "span").agg(
        F.first("own", ignorenulls=True).alias("own"), F.max("n_words").alias("n_words"), F.max("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("in_order").alias("covered"),
        # A base phrase stands where a single diagonal has all of its bigrams.
        F.count(F.when(F.bit_count("covered") == F.col("size"), 1)).alias("whole"),
        F.min(F.when(F.bit_count("covered") == F.col("size"), F.col("diagonal"))).alias("first"), F.max(F.when(F.bit_count("covered") == F.col("size"), F.col("diagonal"))).alias("last"),
    )
    share = F.when(F.col("template").isNotNull(), F.bit_count("covered") / F.col("size"))
    is_base = F.col("template").isin([i for i, _, _, base in templates() if base])
    label = F.get(F.array(*[F.lit(v) for _, _, v, _ in templates()]), F.col("template"))
    notice = ~is_base & (share >= COVER)
    base = is_base & (F.col("whole") > 0)
    join = lambda when: F.concat_ws(",", F.array_sort(F.collect_set(F.when(when, label))))
    done = spans.groupBy("row").agg(
        F.first("own", ignorenulls=True).alias("own"), F.max("n_words").alias("n_words"),
        F.coalesce(F.sum(F.when(base, F.col("whole"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        join(base).alias("base_labels"), join(base | notice).alias("labels"), F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(notice, F.struct(label.alias("label"), F.col("low").cast("long").alias("first_word"), (F.col("high") + 1).cast("long").alias("last_word"), share.alias("covered"))))).alias("spans"),
    )
    return done.select(*[F.col("own").getField(c).alias(c) for c in keep], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
