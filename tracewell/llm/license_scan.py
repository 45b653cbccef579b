"""License scans with a positional rare-token index, in DataFrame functions alone.

The index holds postings: for each word of a licence template its template and place.  A
file looks up each template's highest-IDF words, as many as a place with enough agreement
cannot do without; each posting that it meets names the place where the template would have
to begin.  The template's mandatory key phrases are looked for at their own places from
there, and where they are, all of its words are: postings are intersected by relative
position.  Only where enough of the template's weight agrees is its label given, whatever
else the file holds.
Base phrases are always found, wherever their words stand consecutively.

Texts are read once.  Only words of the index are kept, and only of files that hold all words
of some phrase, without which there is no label; document frequencies are counted over all files.  Nothing that is
shuffled is as large as a text, and groups are single places in single texts.

Null and empty texts have no words, no labels and score 0.  Equal texts get equal results,
as do repeated rows; copies of a text are looked up once.  Ties in IDF are broken by the word
and place.  The result has one row for each row of the input; an empty table gives an empty
one, and other columns of the input are not looked at, whatever their names.
A text of any length is one row, whose words one task holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import store

#: Phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, words of a public licence notice, and phrases that must be there.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    ("apache", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ("gnu general public license", "free software foundation"),
    ),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
)

@dataclass(frozen=True)
class Scan:
    agree: float = 0.7  # share of a template's weight that must agree on one place


def words(text: str) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def postings() -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(phrase, word, offset, length), (template, word, offset), (template, phrase, offset)."""
    phrases = list(dict.fromkeys([p for p, _ in BASE] + [p for _, _, own in TEMPLATES for p in own]))
    by_phrase = [(p, w, k, len(p.split())) for p in phrases for k, w in enumerate(p.split())]
    by_template, needs = [], []
    for t, (_, passage, own) in enumerate(TEMPLATES):
        tokens = passage.split()
        by_template += [(t, w, k) for k, w in enumerate(tokens)]
        for p in own:
            n = len(p.split())
            needs.append((t, p, next(k for k in range(len(tokens)) if tokens[k : k + n] == p.split())))
    return by_phrase, by_template, needs


def rarest(own: list[tuple[float, str, int]], agree: float) -> list[tuple[str, int]]:
    """The words (IDF, word, place) of a template by IDF, until those left over could not agree enough alone."""
    left, out = sum(x for x, _, _ in own), []
    least = agree * left * (1 - 1e-9)
    for x, w, k in sorted(own, key=lambda o: (-o[0], *o[1:])):
        if left < least:
            break
        out.append((w, k))
        left -= x
    return out


def scan(docs: DataFrame, how: Scan = Scan(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """n_words, base places, labels and score of every row."""
    spark = docs.sparkSession
    by_phrase, by_template, needs = postings()
    vocabulary = sorted({w for _, w, *_ in by_phrase} | {w for _, w, _ in by_template})
    known = F.array(*map(F.lit, vocabulary))

    one = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"), words("text").alias("words"))
    one = one.withColumn("present", F.array_intersect("words", known))
    placed = F.transform("words", lambda w, i: F.named_struct(F.lit("at"), i.cast("bigint"), F.lit("word"), w))
    some = reduce(or_, (reduce(and_, (F.array_contains("present", w) for w in sorted(set(p.split())))) for p in dict.fromkeys(p for p, *_ in by_phrase)))
    hits = F.when(some, F.filter(placed, lambda x: x["word"].isin(vocabulary)))
    files = store(one.select("doc_id", "key", F.size("words").cast("bigint").alias("n_words"), "present", hits.alias("hits")), "licence-words")

    # at most as many rows as the index has words
    held = files.select(F.explode("present").alias("word")).groupBy("word").count().collect()
    total, df = files.count(), {r["word"]: r["count"] for r in held}
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1e-3 for w in vocabulary}
    texts = store(files.where("hits is not null").groupBy("key").agg(F.first("hits").alias("hits")), "licence-hits")  # copies of a text once
    found = texts.select("key", F.explode("hits").alias("hit")).select("key", "hit.at", "hit.word")

    phrase_index = F.broadcast(spark.createDataFrame(by_phrase, "phrase string, word string, off bigint, length bigint"))
    places = (
        found.join(phrase_index, "word")
        .groupBy("key", "phrase", "length", (F.col("at") - F.col("off")).alias("start"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(off as int)))").alias("bits"))
        .where("bit_count(bits) = length")
        .select("key", "phrase", "start")
    )
    places = store(places, "licence-places")

    own = [[(idf[w], w, k) for u, w, k in by_template if u == t] for t in range(len(TEMPLATES))]
    rare_index = F.broadcast(spark.createDataFrame([(t, w, k) for t, x in enumerate(own) for w, k in rarest(x, how.agree)], "template int, word string, off bigint"))
    begun = found.join(rare_index, "word").select("key", "template", (F.col("at") - F.col("off")).alias("start")).distinct()
    need = F.broadcast(spark.createDataFrame([(t, p, k, sum(u == t for u, _, _ in needs)) for t, p, k in needs], "template int, phrase string, off bigint, needed int"))
    name = F.create_map(*chain.from_iterable((F.lit(t), F.lit(x[0])) for t, x in enumerate(TEMPLATES)))
    phrased = (
        begun.join(need, "template")
        .withColumn("at", F.col("start") + F.col("off"))
        .join(places.withColumnRenamed("start", "at"), ["key", "phrase", "at"])
        .groupBy("key", "template", "start", "needed")
        .agg(F.count("*").alias("there"))
        .where("there = needed")
        .select("key", "template", "start")
    )
    template_index = F.broadcast(spark.createDataFrame([(t, w, k, idf[w]) for t, w, k in by_template], "template int, word string, off bigint, idf double"))
    share = F.create_map(*chain.from_iterable((F.lit(t), F.lit(sum(x for x, _, _ in o))) for t, o in enumerate(own)))
    verified = (
        phrased.join(template_index, "template")
        .withColumn("at", F.col("start") + F.col("off"))
        .join(found, ["key", "at", "word"])
        .groupBy("key", "template", "start")
        .agg(F.collect_set(F.struct("off", "idf")).alias("votes"))  # a template's words at most
        .withColumn("agreed", F.aggregate(F.array_sort("votes"), F.lit(0.0), lambda a, x: a + x["idf"]) / share[F.col("template")])
        .where(F.col("agreed") >= how.agree)
        .select("key", name[F.col("template")].alias("label"), F.least("agreed", F.lit(1.0)).alias("score"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("length"))
    )
    base = F.create_map(*chain.from_iterable((F.lit(p), F.lit(label)) for p, label in BASE))
    based = places.where(F.col("phrase").isin([p for p, _ in BASE])).select("key", base[F.col("phrase")].alias("label"), F.lit(1.0).alias("score"), "start", F.size(F.split("phrase", " ")).cast("bigint").alias("length"))
    results = (
        based.unionByName(verified)
        .groupBy("key")
        .agg(
            F.count("start").alias("n_base"),
            F.min("start").alias("first_word"),
            F.max("start").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("score").alias("score"),
        )
    )
    return files.select("doc_id", "key", "n_words").join(results, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
