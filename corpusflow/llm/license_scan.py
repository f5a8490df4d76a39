"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a line, or as many consecutive words as a template has that cross a line end, so that
statements which wrap are found. It meets a template if it has at least `threshold` of the template's
distinct words, and all those that tell its license from others. Of a line of more than ROOM times a
template's words, each run of that many is a block: words scattered over a long line aren't a statement.
The words of all templates are put into one global order, rarest in the corpus
first. A block that meets a template T must have one of T's first |T| - need + 1 words (prefix
filter), at least need words of the templates' vocabulary (length filter), and enough words of
either side from the first common one on (positional filter); what is left is verified by
intersection. No pair is lost. All of it is DataFrame functions.

Known phrases are found as well: places where their words stand consecutively.

Defined results: null and empty texts have no words and no labels; a document without places
has null first_word and last_word; rows that repeat get equal rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.decontamination import LOWER, SEPARATOR, UPPER, words

#: Phrases and their labels, as the contract gives them.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Words of a line, as a multiple of a template's, among which the template's may stand.
ROOM = 2


@dataclass(frozen=True)
class Template:
    """A statement of a license. must: words without which a block is another license's, however
    many of the others it has; short statements differ in nothing else."""

    label: str
    text: str
    must: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return sorted(set(self.text.split()))

    @property
    def length(self) -> int:
        return len(self.text.split())


#: Usual statements of public licenses and sentences of their notices as published, in
#: lower-case words.
TEMPLATES = (
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu", "general", "public")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache",)),
    Template("mit", "released under the mit license", ("mit",)),
    Template("bsd", "released under the bsd license", ("bsd",)),
    Template("gpl", "released under the gpl license", ("gpl",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc", "by")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc", "by", "nc")),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc", "by", "nd")),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc", "by", "sa")),
    Template("cc-by-nc-nd", "licensed under cc by nc nd 4 0", ("cc", "by", "nc", "nd")),
    Template("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ("cc", "by", "nc", "sa")),
    Template("cc-by", "licensed under the creative commons attribution license", ("creative", "commons", "attribution")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("lgpl", "this library is free software under the gnu lesser general public license", ("lesser",)),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", ("mozilla",)),
    Template("all-rights-reserved", "all rights reserved no part may be reproduced", ("rights", "reserved")),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ),
    Template(
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ),
    Template(
        "mit",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
    ),
    Template(
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    ),
    Template(
        "bsd",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"
    ),
    Template(
        "epl",
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        ("eclipse",)
    ),
    Template(
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def need(size: int, threshold: float) -> int:
    """Words that a block must share with a template of that many words."""
    return ceil(round(size * threshold, 9))


def _literal(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def frequencies(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """Number of documents with each word of the vocabulary, over all of docs."""
    met = docs.select(F.explode(F.array_intersect(words(F.col("text")), _literal(vocabulary))).alias("word"))
    found = {r.word: r["count"] for r in met.groupBy("word").count().collect()}  # one row a vocabulary word
    return {w: found.get(w, 0) for w in vocabulary}


def _prefixes(docs: DataFrame, templates: Sequence[Template], threshold: float) -> tuple[list[str], list[tuple]]:
    """The global order of words, and a row for each word of the templates' prefixes."""
    count = frequencies(docs, sorted({w for t in templates for w in t.words}))
    order = sorted(count, key=lambda w: (count[w], w))
    rows = []
    for number, t in enumerate(templates):
        own = sorted(t.words, key=order.index)
        least = need(len(own), threshold)
        head = own[: len(own) - least + 1]
        rows += [(number, t.label, own, least, list(t.must), t.length, i, w) for i, w in enumerate(head)]
    return order, rows


PREFIX = "template int, label string, own array<string>, need int, must array<string>, length int, i int, word string"


def match_windows(
    docs: DataFrame, keys: list[str], templates: Sequence[Template], rows: list[tuple], threshold: float
) -> DataFrame:
    """keys, label and containment of templates met by words that cross a line end: by a window
    as long as the template, around one of its prefix words. A template isn't met if a nearer one
    in the words around has all words that it shares."""
    length = [t.length for t in templates]
    prefixes = docs.sparkSession.createDataFrame(rows, PREFIX)
    lines = F.transform(F.split("text", "\n"), words)
    spoken = docs.where(
        F.arrays_overlap(words(F.col("text")), _literal(sorted({r[-1] for r in rows})))
    ).where(F.col("text").contains("\n"))
    spoken = spoken.select(
        *keys, F.flatten(lines).alias("w"),
        F.flatten(F.transform(lines, lambda x, i: F.transform(x, lambda _: i))).alias("line")
    )
    # Only the words around a prefix word go on, so that a row's size doesn't grow with its document.
    most, rare = max(length), _literal(sorted({r[-1] for r in rows}))
    low, high = lambda j: F.greatest(j - most + 1, F.lit(0)), lambda j: F.least(j + most, F.size("w"))
    at = F.filter(
        F.sequence(F.lit(0), F.size("w") - 1),
        lambda j: F.array_contains(rare, F.get("w", j)) & (F.get("line", low(j)) < F.get("line", high(j) - 1))
    )
    around = lambda c, j: F.slice(c, low(j) + 1, high(j) - low(j))
    places = F.transform(
        at,
        lambda j: F.struct(
            F.get("w", j).alias("word"), (j - low(j)).alias("j"), around("w", j).alias("w"),
            around("line", j).alias("line")
        )
    )
    seen = spoken.select(*keys, F.explode(places).alias("place")).select(*keys, "place.*")
    # The prefixes are a parameter of the scan, a few rows a template.
    seen = seen.join(F.broadcast(prefixes), "word")
    begin = F.greatest(F.col("j") - F.col("length") + 1, F.lit(0))
    near = lambda c: F.slice(c, begin + 1, F.col("j") + F.col("length") - begin)
    seen = seen.select(
        *keys, "template", "label", "own", "need", "must", "length", near("w").alias("w"), near("line").alias("line")
    )
    seen = seen.where(
        (F.element_at("line", 1) < F.element_at("line", -1)) & (F.size(F.array_intersect("own", "w")) >= F.col("need"))
    )

    def window(s):
        met = F.array_intersect("own", F.slice("w", s + 1, F.col("length")))
        crosses = F.get("line", s) < F.get("line", F.least(s + F.col("length"), F.size("line")) - 1)
        told = crosses & (F.size(F.array_except("must", met)) == 0)
        return F.struct(F.when(told, F.size(met)).otherwise(0).alias("n"), met.alias("met"))

    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - F.col("length"), F.lit(0)))
    best = seen.withColumn("best", F.array_max(F.transform(starts, window))).where("best.n >= need")
    share = F.col("best.n") / F.size("own")
    def nearer(t):
        own, must = _literal(t.words), _literal(t.must).cast("array<string>")
        n = F.size(F.array_intersect(own, "w"))
        more = (n / len(t.words) > share) | ((n / len(t.words) == share) & (n > F.col("best.n")))
        told = (n >= need(len(t.words), threshold)) & (F.size(F.array_except(must, "w")) == 0)
        return told & more & (F.size(F.array_except("best.met", own)) == 0)

    return best.where(~reduce(or_, map(nearer, templates))).select(*keys, "label", share.alias("containment"))


def _parts(b: str, room: int) -> Column:
    """A line's words in parts of bounded size, so that each run of `room` words is inside one of them."""
    step = 3 * room
    last = F.greatest(F.ceil((F.size(b) - step - room) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(b, c * step + 1, step + room))


def match_blocks(
    docs: DataFrame, keys: list[str], templates: Sequence[Template], order: list[str], rows: list[tuple]
) -> DataFrame:
    """keys, label and containment of every line and template that meet in a block, but for templates whose
    words in the line's best block are all words of a nearer one, met to a larger share or, of equal shares,
    with more words: statements that differ in a word meet each other's templates."""
    prefixes = docs.sparkSession.createDataFrame(rows, PREFIX)
    rare = _literal(sorted({r[-1] for r in rows}))
    lines = docs.withColumn("__lower", F.translate("text", UPPER, LOWER)).where(
        F.arrays_overlap(F.split("__lower", SEPARATOR), rare)
    )
    blocks = lines.select(*keys, F.posexplode(F.split("__lower", "\n")).alias("block", "line"))
    blocks = blocks.select(*keys, "block", F.array_remove(F.split("line", SEPARATOR), "").alias("b"))
    known, least = _literal(order), min(r[3] for r in rows)
    # Few lines have enough words of the vocabulary; only these are cut into parts.
    blocks = blocks.where(F.size(F.array_intersect(known, "b")) >= least)
    blocks = blocks.select(*keys, "block", F.explode(_parts("b", ROOM * max(t.length for t in templates))).alias("b"))
    blocks = blocks.withColumn("has", F.array_intersect(known, "b")).where(F.size("has") >= least)
    seen = blocks.select(*keys, "block", "b", "has", F.posexplode("has").alias("j", "word"))
    bound = 1 + F.least(F.size("own") - F.col("i") - 1, F.size("has") - F.col("j") - 1)
    # The prefixes are a parameter of the scan, a few rows a template.
    pairs = seen.join(F.broadcast(prefixes), "word").where((F.size("has") >= F.col("need")) & (bound >= F.col("need")))
    # Own words are in the global order, as those of a line are: a pair is verified at its first common one.
    shared = F.array_intersect("own", "has")
    pairs = pairs.where((F.get(shared, F.lit(0)) == F.col("word")) & (F.size(shared) >= F.col("need")))
    pairs = pairs.where(F.size(F.array_except("must", "has")) == 0)

    def run(s):
        met = F.array_intersect("own", F.slice("b", s + 1, ROOM * F.col("length")))
        told = F.size(F.array_except("must", met)) == 0
        return F.struct(F.when(told, F.size(met)).otherwise(0).alias("n"), F.array_sort(met).alias("met"))

    # Of all runs, those that start with a word of the template have the most of them.
    starts = F.filter(F.sequence(F.lit(0), F.size("b") - 1), lambda s: F.array_contains("own", F.get("b", s)))
    met = pairs.withColumn("best", F.array_max(F.transform(starts, run))).where("best.n >= need")
    one = F.struct((F.col("best.n") / F.size("own")).alias("containment"), "label", F.col("best.met").alias("met"))
    met = met.groupBy(*keys, "block", "template").agg(F.max(one).alias("m"))
    # A row a template at most.
    met = met.groupBy(*keys, "block").agg(F.collect_set("m").alias("all"))
    more = lambda o, m: (o["containment"] > m["containment"]) | (
        (o["containment"] == m["containment"]) & (F.size(o["met"]) > F.size(m["met"]))
    )
    nearer = lambda m: F.exists("all", lambda o: more(o, m) & (F.size(F.array_except(m["met"], o["met"])) == 0))
    met = met.select(*keys, F.explode(F.filter("all", lambda m: ~nearer(m))).alias("m"))
    return met.select(*keys, "m.label", "m.containment")


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (of phrases and of
    each template that a block meets) and score (the largest containment of any block in a
    template it meets, else 0) of every document."""
    mark = F.xxhash64("doc_id", "text")
    marked = docs.select("doc_id", "text", mark.alias("__mark"))
    order, rows = _prefixes(marked, templates, threshold)
    met = match_blocks(marked, ["doc_id", "__mark"], templates, order, rows)
    met = met.unionByName(match_windows(marked, ["doc_id", "__mark"], templates, rows, threshold))
    by_doc = met.groupBy(F.col("doc_id").alias("__id"), F.col("__mark").alias("__key")).agg(
        F.collect_set("label").alias("own_labels"), F.max("containment").alias("best")
    )

    phrase = "(?<= )(" + "|".join(PHRASES) + ")(?= )"
    spoken = marked.select(
        "doc_id", "__mark", words(F.col("text")).alias("w")
    ).withColumn("n_words", F.size("w").cast("long"))
    firsts = _literal(sorted({p.split()[0] for p in PHRASES}))
    joined = F.when(
        F.arrays_overlap("w", firsts), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    ).otherwise(F.lit(""))
    counted = lambda c: F.regexp_count(c, F.lit("[^ ]+"))
    places = (
        spoken.select("doc_id", "__mark", "n_words", joined.alias("s"))
        .select(
            "doc_id", "__mark", "n_words", F.regexp_extract_all("s", F.lit(phrase), 1).alias("found"),
            F.split("s", phrase).alias("pieces")
        )
        .withColumn("n_base", F.size("found").cast("long"))
        .withColumn("last_piece", F.get("pieces", F.size("pieces") - 1))
        .withColumn("last_found", F.get("found", F.size("found") - 1))
        .select(
            "doc_id", "__mark", "n_words", "n_base",
            F.when(F.col("n_base") > 0, counted(F.get("pieces", F.lit(0)))).cast("long").alias("first_word"),
            F.when(
                F.col("n_base") > 0, F.col("n_words") - counted("last_piece") - counted("last_found")
            ).cast("long").alias("last_word"),
            F.array_compact(
                F.array(*(F.when(F.array_contains("found", p), label) for p, label in PHRASES.items()))
            ).alias("base"),
        )
    )
    out = places.join(
        by_doc.hint("merge"), F.col("__mark").eqNullSafe(F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")),
        "left"
    )
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    every = F.concat("base", F.coalesce("own_labels", F.array().cast("array<string>")))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", named(F.col("base")).alias("base_labels"),
        named(every).alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score")
    )
