"""Licences named or quoted in texts, by diagonal voting.

The rolling word grams of every text, hashed, are joined to the places that they have in templates. A gram at word p of a
text that stands at word t of a template votes for the diagonal p - t: votes of a passage that quotes the template lie on
one diagonal, or, where words were put in or left out, on neighbouring ones. Diagonals that lie near each other are merged
to a span, and a span counts if its votes hold enough of the template's words close enough together. Votes are checked by
the words themselves, so a span rests on words and not on hashes.

The base phrases are templates as well: a phrase stands wherever a diagonal has all of its votes.

Only built-in functions are used. A text is read once; what leaves that pass is a row a text and a row a vote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import settle

#: What stands between words, where A-Z are not lower-cased yet; cutting at it takes a quarter of the time of finding words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a gram: of templates with fewer than ``SHORT`` words, and of others.
FEW, MANY, SHORT = 2, 4, 6
#: Of a template with ``SHORT`` words or more: the part of its words that a span must hold, and that its own words must be of the template's.
HELD, DENSE = 0.6, 0.6
#: Diagonals merge if no further apart than this part of the template's words, and never beyond ``DRIFT``.
APART, DRIFT = 8, 12
#: Words of all templates up to which their table, at most 100 bytes a word, is broadcast.
BROADCAST_WORDS = 100_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False


# The base phrases and their labels.
BASE = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]
# Short forms of further licences, and passages of published licence notices.
OWN = [
    Template("agpl", "gnu affero general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("apache-2", "apache license version 2 0"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by", "creative commons attribution"),
    Template("cc0", "cc0 1 0 universal"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
    Template("mpl", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
]


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(template, label, base, size, k, t, gram, hash) of every gram of every template; template is its number, t the gram's place."""
    rows = [F.struct(F.lit(n).alias("template"), F.lit(x.label).alias("label"), F.lit(x.base).alias("base"), F.split(F.lit(x.text), " ").alias("w")) for n, x in enumerate(templates)]
    size = F.size("w")
    k = F.when(size < SHORT, FEW).otherwise(MANY)
    told = spark.range(1).select(F.inline(F.array(*rows))).withColumns({"size": size, "k": k})
    told = told.select("template", "label", "base", "size", "k", "w", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))).alias("t"))
    gram = F.array_join(F.slice("w", F.col("t") + 1, F.col("k")), " ")
    return told.select("template", "label", "base", "size", "k", "t", gram.alias("gram"), F.xxhash64("k", gram).alias("hash"))


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def find_votes(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, doc_id, n_words, p, template, label, base, size, k, t), written once: for each row of docs one with p = -1 and the rest null, and one for each vote, p its word."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), BETWEEN), "").alias("w"))
    # The gram at each word, of fewer words at the end; the shorter gram is its beginning. In front stands the text itself, as a gram
    # without words, which meets a template of its own: so all rows come out of one inner join.
    long = F.transform("w", lambda x, i: F.concat_ws(" ", x, *(F.get("w", i + j) for j in range(1, MANY))))
    cut = words.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.concat(F.array(F.lit("")), long).alias("g"))
    each = cut.select("row", "doc_id", "n_words", F.posexplode("g").alias("p", "long"))
    each = each.select("row", "doc_id", "n_words", (F.col("p") - 1).alias("p"), F.inline(F.array(F.struct(F.lit(MANY).alias("of"), F.col("long").alias("g")), F.struct(F.lit(FEW).alias("of"), F.substring_index("long", " ", FEW).alias("g")))))
    grams = template_grams(docs.sparkSession, templates)
    none = grams.sparkSession.range(1).select(*(F.lit(None).cast(grams.schema[c].dataType).alias(c) for c in grams.columns[:-2]), F.lit("").alias("gram"), F.xxhash64(F.lit(MANY), F.lit("")).alias("hash"))
    grams = grams.unionByName(none)
    if sum(len(x.text.split(" ")) for x in templates) <= BROADCAST_WORDS:
        grams = F.broadcast(grams)
    # Hashed as lower-cased by Unicode, which is quick and at most joins more; the words decide, by A-Z alone.
    met = each.join(grams, (F.xxhash64("of", F.lower("g")) == F.col("hash")) & (_lower(F.col("g")) == F.col("gram")))
    return settle(met.select("row", "doc_id", "n_words", "p", "template", "label", "base", "size", "k", "t"), "votes")


def diagonals(votes: DataFrame) -> DataFrame:
    """(row, template, label, base, size, k, diagonal, places): the template's words where grams of the diagonal begin, at most its length."""
    told = votes.where("p >= 0").withColumn("diagonal", F.col("p") - F.col("t"))
    return told.groupBy("row", "template", "label", "base", "size", "k", "diagonal").agg(F.array_sort(F.collect_set("t")).alias("places"))


def _covered(places: Column, k: Column) -> Column:
    """Words under grams of k words at sorted distinct places."""
    step = F.transform(places, lambda t, i: F.when(i == 0, k).otherwise(F.least(k, t - F.get(places, i - 1))))
    return F.aggregate(step, F.lit(0), lambda a, b: a + b)


def spans(found: DataFrame) -> DataFrame:
    """(row, template, label, base, size, start, end, share, holds): neighbouring diagonals merged, share of the template's words that they hold, and whether the span counts.

    Every word of a short template must be there, in a row. Of a longer one, ``HELD`` of its words must be, and ``DENSE`` of
    the words of the span must be the template's.
    """
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    near = F.least(F.floor(F.col("size") / APART), F.lit(DRIFT))
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > near).cast("int"), F.lit(1))
    cut = found.withColumn("new", new).withColumn("span", F.sum("new").over(by)).withColumn("words", _covered(F.col("places"), F.col("k")))
    start, end = F.col("diagonal") + F.element_at("places", 1), F.col("diagonal") + F.element_at("places", -1) + F.col("k")
    g = cut.groupBy("row", "template", "label", "base", "size", "k", "span").agg(
        F.min(start).alias("start"), F.max(end).alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("all"), F.sum("words").alias("words")
    )
    covered = _covered(F.col("all"), F.col("k"))
    share = covered / F.col("size")
    dense = F.least(F.col("words") / (F.col("end") - F.col("start")), F.lit(1.0))
    holds = F.when(F.col("size") < SHORT, covered == F.col("size")).otherwise((share >= HELD) & (dense >= DENSE))
    return g.select("row", "template", "label", "base", "size", "start", "end", share.alias("share"), holds.alias("holds"))


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs(doc_id, text, ...)``.

    n_base: places of base phrases, first_word and last_word their smallest and largest start, null without any. Labels are
    distinct, sorted and joined by commas; labels has the base ones too. score: the largest share of a template's words that
    one span holds, 1 for a whole phrase, 0 without a vote. ``templates`` are the base phrases and others of two words or more.

    A null text is empty. Repeated rows, equal texts and null doc_ids give a row each; other columns are left out. An empty table
    gives no rows.
    """
    templates = BASE + OWN if templates is None else templates
    if any(len(x.text.split(" ")) < FEW for x in templates):
        raise ValueError(f"templates need {FEW} words at least")
    votes = find_votes(docs, templates)
    found = diagonals(votes)
    whole = found.where(F.col("base") & (F.size("places") == F.col("size") - F.col("k") + 1))
    base = whole.groupBy("row").agg(F.count(F.lit(1)).alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("b"))
    own = spans(found).groupBy("row").agg(F.max("share").alias("score"), F.collect_set(F.when(F.col("holds"), F.col("label"))).alias("o"))
    told = votes.where("p < 0").select("row", "doc_id", "n_words").join(base, "row", "left").join(own, "row", "left")
    none = F.array().cast("array<string>")
    b, o = F.coalesce("b", none), F.coalesce("o", none)
    labels = lambda x: F.array_join(F.array_sort(x), ",")
    return told.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", labels(b).alias("base_labels"), labels(F.array_union(b, o)).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
