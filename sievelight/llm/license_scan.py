"""Licence texts and notices, found through an index of the places of rare words in templates. DataFrame functions only."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import bounded, let, materialize

#: A word: letters and digits of any script, ASCII's lower-cased; and what stands between words.
WORD, BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The letters outside ASCII that lower-case to ASCII ones (Kelvin sign, I with a dot), and others in their place.
ODD = {"\u212a": "\u0138", "\u0130": "\u0131"}
#: Words of a template that are looked up, by how rare they are, at most and as a share of its words; least share of their weight
#: that must line up; and words by which what lines up may be out of place, for names and dates put in between.
RARE, RARE_SHARE, LEAST_SHARE, SLACK = 8, 3, 0.5, 16


@dataclass(frozen=True)
class Template:
    """A licence text or notice, the phrases of it that must stand, and what it shows. Base ones are the contract's phrases."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False


#: The four base phrases of the contract, then notices and opening words of public licences with the phrases that tell them.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("apache-2.0", "Apache License, Version 2.0"),
    Template("gpl-2.0", "GNU General Public License, version 2"),
    Template("gpl-3.0", "GNU General Public License, version 3"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("agpl", "GNU Affero General Public License"),
    Template("cc-by-nc", "CC BY-NC"),
    Template("cc-by-nd", "CC BY-ND"),
    Template("cc-by-sa", "CC BY-SA"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software", "released into the public domain")),
    Template("cc0", "has waived all copyright and related or neighboring rights to the work to the extent possible under law", ("all copyright and related or neighboring rights",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction", "modify merge publish distribute sublicense"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
        ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer.",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"),
    ),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ("you may not use this file except in compliance with the license", "www apache org licenses license 2 0"),
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        ("redistribute it and or modify it under the terms of the gnu", "published by the free software foundation"),
    ),
    Template(
        "zlib",
        "In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely",
        ("in no event will the authors be held liable", "to alter it and redistribute it freely"),
    ),
)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def _words(text: Column, ascii_only: bool) -> Column:
    """Words of a text. Where they are only compared with ASCII words, lower() does for translate(), which takes longer."""
    text = F.coalesce(text, F.lit(""))
    if ascii_only:
        for letter, other in ODD.items():
            text = F.replace(text, F.lit(letter), F.lit(other))
        low = F.lower(text)
    else:
        low = F.translate(text, UPPER, LOWER)
    # Only the first and the last piece can be empty.
    parts = F.split(low, BETWEEN, -1)
    return let(parts, lambda p: F.slice(p, F.when(p[0] == "", 2).otherwise(1), F.size(p) - (p[0] == "").cast("int") - ((F.size(p) > 1) & (F.get(p, F.size(p) - 1) == "")).cast("int")))


def _literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def rarity(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each word of the templates over all documents; as many numbers as the templates have words."""
    words = _words(F.col("text"), all(map(str.isascii, vocabulary)))
    counted = docs.select(F.explode(F.array_append(F.array_intersect(words, _literals(vocabulary)), F.lit(""))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counted.collect()}
    n = found.get("", 0)  # the empty word stands in every document once
    return {w: 1 + math.log((n + 1) / (found.get(w, 0) + 1)) for w in vocabulary}


@dataclass(frozen=True)
class Index:
    """Rows of the index: rare words with their templates and places, and phrases under their rarest word."""

    postings: list[tuple]  # word, template, at, weight
    phrases: list[tuple]  # word, template, phrase, at, offset, words
    needed: list[tuple]  # template, label, base, weight, phrases
    reach: int


def build_index(templates: tuple[Template, ...], weights: dict[str, float]) -> Index:
    postings, phrases, needed, reach = [], [], [], 0
    for no, t in enumerate(templates):
        words = words_of(t.text)
        places = sorted(range(len(words)), key=lambda i: (-weights[words[i]], i))[: min(RARE, max(1, len(words) // RARE_SHARE))]
        postings += [(words[i], no, i, weights[words[i]]) for i in places]
        required = [words_of(p) for p in t.phrases] or [words]
        for k, p in enumerate(required):
            at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
            offset = max(range(len(p)), key=lambda i: weights[p[i]])
            phrases.append((p[offset], no, k, at, offset, p))
            reach = max(reach, len(p))
        needed.append((no, t.label, t.base, sum(weights[words[i]] for i in places), len(required)))
    return Index(postings, phrases, needed, reach)


def read_hits(docs: DataFrame, index: Index) -> DataFrame:
    """One pass over the texts: doc_id, key, n_words, hits: words of the index with their place and the words around those that phrases are under."""
    looked_up = sorted({r[0] for r in index.postings} | {r[0] for r in index.phrases})
    anchors, reach = sorted({r[0] for r in index.phrases}), index.reach - 1
    plain = all(w.isascii() for r in index.phrases for w in r[5]) and all(map(str.isascii, looked_up))

    def hits(words: Column) -> Column:
        placed = F.transform(words, lambda w, i: F.when(w.isin(looked_up), i))
        found = F.filter(placed, lambda i: i.isNotNull())
        around = lambda i: F.slice(words, F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.transform(found, lambda i: F.struct(i.alias("pos"), F.get(words, i).alias("word"), F.least(i, F.lit(reach)).alias("lead"), F.when(F.get(words, i).isin(anchors), around(i)).alias("window"))).alias("hits"),
        )

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), let(_words(F.col("text"), plain), hits).alias("r"))
    return rows.select("doc_id", "key", "r.n_words", "r.hits")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each document.

    A first pass counts in how many documents each word of the templates stands. The index holds, of each template, the
    places of its highest-IDF words, and each phrase that must stand under its own rarest word. A second pass looks up the
    words of each file that are in the index: what meets a phrase's words, one after the other, is a place of the
    phrase, and what meets rare words votes for the template and the relative position. Votes are intersected by position,
    give or take SLACK words. A template is found where LEAST_SHARE of the weight lines up and all its phrases stand in line too.
    Base phrases count wherever they stand. score is the largest share lined up, 1 for a base phrase, 0 without any.

    Texts are never shuffled; what is, are words of the index with their places. A document's sets are bounded by the
    templates. The index is broadcast only if its counted rows are small. Null text is empty; repeated ids and rows get a row
    each; very long texts are read whole; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    index = build_index(templates, rarity(docs, sorted({w for t in templates for w in words_of(t.text)})))
    read = materialize(read_hits(docs, index), "license-hits")
    table = lambda rows, schema, size: bounded(spark.createDataFrame(rows, schema), len(rows), size)
    postings = table(index.postings, "word string, template int, at int, weight double", 64)
    phrases = table(index.phrases, "word string, template int, phrase int, at int, offset int, words array<string>", 64 + 32 * index.reach)
    needed = table(index.needed, "template int, label string, base boolean, whole double, phrases int", 96)

    hits = read.select("doc_id", "key", F.explode("hits").alias("h")).select("doc_id", "key", "h.*")
    fits = (F.col("lead") >= F.col("offset")) & (F.slice("window", F.col("lead") - F.col("offset") + 1, F.size("words")) == F.col("words"))
    stands = hits.join(phrases, "word").filter(fits).select("doc_id", "key", "template", "phrase", (F.col("pos") - F.col("offset")).alias("start"), "at")
    votes = hits.join(postings, "word").select("doc_id", "key", "template", (F.col("pos") - F.col("at")).alias("shift"), F.struct("at", "weight").alias("vote"))
    lined = votes.withColumn("phrase", F.lit(None).cast("int")).unionByName(stands.select("doc_id", "key", "template", (F.col("start") - F.col("at")).alias("shift"), F.lit(None).cast("struct<at:int,weight:double>").alias("vote"), "phrase"))
    # Each shift is in two windows of twice the slack, so shifts that are no further apart share one.
    bucket = F.floor(F.col("shift") / SLACK)
    lined = lined.withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
    sets = lined.groupBy("doc_id", "key", "template", "bucket").agg(F.collect_set("vote").alias("votes"), F.collect_set("phrase").alias("met"))
    share = F.aggregate(F.array_sort("votes"), F.lit(0.0), lambda a, v: a + v["weight"]) / F.col("whole")
    verified = sets.join(needed, "template").filter(F.size("met") == F.col("phrases")).withColumn("score", F.least(share, F.lit(1.0))).filter(F.col("score") >= LEAST_SHARE)
    verified = verified.select("doc_id", "key", "label", "score", F.lit(None).cast("int").alias("start"))
    based = stands.join(needed.filter("base"), "template").select("doc_id", "key", "label", F.lit(1.0).alias("score"), "start").distinct()  # equal rows give their places once
    found = verified.unionByName(based).groupBy("doc_id", "key").agg(
        F.count("start").alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.col("label"))).alias("base"), F.collect_set("label").alias("labels"), F.max("score").alias("score"),
    )
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key"))
    text = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    return read.select("doc_id", "key", "n_words").alias("a").join(found.alias("b"), same, "left").select(
        "a.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", text(F.col("base")).alias("base_labels"), text(F.col("labels")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
