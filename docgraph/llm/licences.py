"""License scans with a positional index of the templates' words, with DataFrame functions only."""

import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docgraph.plans.durable import cut

# Phrases that name a licence, and the label of each.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Words that are too common to index.
COMMON = ("a", "all", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "with", "you", "your")
# Notices by which files declare a licence: label, text, and the phrases that must be there.
TEMPLATES = (
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("hereby granted", "associated documentation files", "without restriction")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3.", ("gnu lesser general public license version 3",)),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3.", ("gnu affero general public license version 3",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2 0",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("binary forms", "without modification", "following conditions")),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", ("distribute", "without fee", "hereby granted")),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "nc 4 0")),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc", "sa 4 0")),
    ("cc-by-4.0", "Licensed under CC BY 4.0.", ("cc", "4 0")),
    ("cc0-1.0", "Licensed under CC0 1.0 Universal.", ("cc0 1 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered software released", "public domain")),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", ("unauthorized copying", "strictly prohibited")),
)
#: Indexed words of a template that must stand at their relative places: this many, or all that it has.
AGREE = 2

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def _postings(templates: tuple) -> tuple[list[tuple], list[str]]:
    """(number, label, word, place, must) of each indexed word of each template; the vocabulary.

    must: the word belongs to a mandatory phrase.
    """
    rows = []
    for number, (label, text, phrases) in enumerate(templates):
        words, must = words_of(text), set()
        for phrase in phrases:
            part = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
            must |= set(range(at, at + len(part)))
        rows += [(number, label, w, place, place in must) for place, w in enumerate(words) if w not in COMMON or place in must]
    return rows, sorted({r[2] for r in rows} | {w for p in PHRASES for w in p.split()})


def _lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def _array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``.

    Words are runs of digits, letters a-z (A-Z in lower case) and characters outside ASCII. Base labels come from
    every place where a phrase of ``PHRASES`` stands; ``first_word`` and ``last_word`` are the least and greatest
    start. A template is found where indexed words of it, two or more, stand at their
    relative places and each mandatory phrase stands at its own; all of a file's licence words are looked up. score: the greatest share of a found
    template's indexed words, at least 0.5 with a base label, else 0. Null and empty texts have no words and no label;
    repeated rows stay repeated; an empty table gives no rows.
    """
    rows, vocabulary = _postings(templates)
    split = docs.select(F.col(id_col).alias("id"), F.split(F.coalesce(F.col(text_col), F.lit("")), _GAP).alias("words"))
    lead = (F.element_at("words", 1) == "").cast("int")
    tail = ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    spots = F.filter(F.transform("words", lambda w, i: F.struct(F.lower(w).alias("w"), i.alias("p"))), lambda x: x["w"].isin(vocabulary))
    found = split.select("id", (F.size("words") - lead - tail).cast("long").alias("n_words"), lead.alias("lead"), spots.alias("spots"), "words")
    # Unicode lower case may turn a character outside ASCII into a letter: such words do not count.
    true = F.filter("spots", lambda x: _lower(F.get("words", x["p"])) == x["w"])
    slim = found.select("id", "n_words", "lead", F.when(F.size("spots") > 0, true).otherwise(F.col("spots")).alias("spots"))
    slim = slim.select("id", "n_words", F.transform("spots", lambda x: F.struct(x["w"].alias("w"), (x["p"] - F.col("lead")).cast("long").alias("p"))).alias("spots"))
    slim = cut(slim.withColumn("row", F.monotonically_increasing_id()))

    spark = docs.sparkSession
    postings = spark.createDataFrame([(n, label, w, place, must) for n, label, w, place, must in rows], "number int, label string, w string, place long, must boolean")
    placed = slim.filter(F.size("spots") > 1).select("row", F.explode("spots").alias("spot")).select("row", "spot.w", "spot.p")
    per_template = postings.groupBy("number").agg(F.count("*").alias("words"), F.sum(F.col("must").cast("int")).alias("musts"))
    small = F.broadcast(postings.join(per_template, "number"))
    # Each of a file's spots meets the few postings of its word: intersect by where the template would begin.
    meets = placed.join(small, "w")
    begun = meets.groupBy("row", "number", "label", "words", "musts", (F.col("p") - F.col("place")).alias("begin")).agg(
        F.count("*").alias("agree"), F.sum(F.col("must").cast("int")).alias("there")
    )
    whole = begun.filter((F.col("agree") >= F.least(F.lit(AGREE), F.col("words"))) & (F.col("there") == F.col("musts")))
    best = whole.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("agree") / F.col("words")).alias("share"))

    places = {phrase: _places(phrase.split()) for phrase in PHRASES}
    scanned = slim.select("id", "row", "n_words", *[p.alias(f"in_{PHRASES[phrase]}") for phrase, p in places.items()])
    every = F.concat(*[F.col(f"in_{label}") for label in PHRASES.values()])
    base = F.array_compact(F.array(*[F.when(F.size(f"in_{label}") > 0, F.lit(label)) for label in PHRASES.values()]))
    out = scanned.select("id", "row", "n_words", every.alias("every"), base.alias("base")).join(best, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return out.select(
        F.col("id").alias(id_col), "n_words", F.size("every").cast("long").alias("n_base"), F.array_min("every").alias("first_word"), F.array_max("every").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def _starts(word: str, place: int) -> Column:
    """Where a phrase would start if ``word`` is its word number ``place``."""
    return F.transform(F.filter("spots", lambda x: x["w"] == word), lambda x: x["p"] - F.lit(place).cast("long"))


def _places(words: list[str]) -> Column:
    """Starts of a phrase: where the starts by each of its words agree."""
    return reduce(F.array_intersect, [_starts(w, k) for k, w in enumerate(words)])
