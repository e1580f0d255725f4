"""Operator 13: license scans by an exact set-similarity join, in DataFrame operations only.

A template is a passage of m words. Texts are cut into blocks of 2 m words at every m-th word, so that any m
words in a row lie in a block, and a block meets a template when it contains enough of its distinct words.
Tokens are ordered by how many pieces of the corpus have them, rarest first. A block with `need` of a
template's n tokens has one of the first n - need + 1, its prefix; these alone are looked up (an inverted index
of the templates, joined by token). Of the blocks around such a token, those with fewer than `need` different
tokens are dropped (length), then those where the places of the token in both orders leave too few tokens after
and before it (position); the rest is counted in full. Phrases ask for all their words, and in the blocks that
have them the places where these stand in a row are listed.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, save
from .pieces import PIECE, pieces

#: What a word is made of and what parts words (fixed values).
WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The one character outside ASCII whose lower case is an ASCII letter.
KELVIN = "K"


@dataclass(frozen=True)
class Template:
    """label: what it tells; words: its words in order, lower case; least: the part of its distinct words that a
    block must contain; phrase: the words must stand in a row, and each place counts."""

    label: str
    words: tuple[str, ...]
    least: float = 0.8
    phrase: bool = False


def template(label: str, text: str, least: float = 0.8, phrase: bool = False) -> Template:
    return Template(label, tuple(text.split()), least, phrase)


#: The phrases of the contract.
PHRASES = (
    template("cc-by", "cc by", 1, True),
    template("gpl", "general public license", 1, True),
    template("reserved", "all rights reserved", 1, True),
)
#: Notices of a line, whose words stand in a row as well, and passages of public licenses.
NOTICES = (
    template("mit", "released under the mit license", 1, True),
    template("mit", "licensed under the mit license", 1, True),
    template("apache-2.0", "licensed under the apache license version 2 0", 1, True),
    template("bsd", "licensed under the bsd license", 1, True),
    template("bsd", "released under the bsd license", 1, True),
    template("gpl-2", "licensed under the gnu general public license version 2", 1, True),
    template("gpl-3", "licensed under the gnu general public license version 3", 1, True),
    template("lgpl", "licensed under the gnu lesser general public license", 1, True),
    template("agpl", "licensed under the gnu affero general public license", 1, True),
    template("mpl-2.0", "licensed under the mozilla public license version 2 0", 1, True),
    template("cc-by-nc", "licensed under cc by nc", 1, True),
    template("cc-by-sa", "licensed under cc by sa", 1, True),
    template("cc-by-nd", "licensed under cc by nd", 1, True),
    template("cc-by", "licensed under a creative commons attribution license", 1, True),
    template("cc0", "creative commons zero public domain dedication", 1, True),
)
PASSAGES = (
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at your option any later version"),
    template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    template("warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
)
TEMPLATES = PHRASES + NOTICES + PASSAGES


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{GAP}+"), "")


def _lowered(text: Column) -> Column:
    """A-Z lower-cased. lower() folds other letters too, which no template has, but is many times faster."""
    return F.when(F.contains(text, F.lit(KELVIN)), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def token_counts(docs: DataFrame, tokens: list[str], size: int = PIECE) -> dict[str, int]:
    """In how many pieces of all texts each of these tokens occurs; only so many numbers reach the driver."""
    rows = docs.select(F.explode(pieces(_lowered(F.col("text")), WORD, size=size)).alias("p")).select(F.explode(F.array_intersect(_words(F.col("p.piece")), _array(tokens))).alias("token"))
    return {r.token: r["count"] for r in rows.groupBy("token").count().collect()}


def _index(spark: SparkSession, templates: tuple[Template, ...], order: dict[str, int]) -> DataFrame:
    """Prefix tokens of the templates: (token, i, t, label, phrase, words, m, tokens, need). One row a prefix token,
    so its size is that of the templates, which the caller holds in memory."""
    rows = []
    for t, x in enumerate(templates):
        tokens = sorted(set(x.words), key=order.__getitem__)
        need = ceil(len(tokens) * x.least - 1e-9)
        for i, token in enumerate(tokens[: len(tokens) - need + 1]):
            values = {"token": F.lit(token), "i": F.lit(i), "t": F.lit(t), "label": F.lit(x.label), "phrase": F.lit(x.phrase), "m": F.lit(len(x.words)), "need": F.lit(need), "words": _array(list(x.words)), "tokens": _array(tokens)}
            rows.append(F.struct(*[v.alias(k) for k, v in values.items()]))
    return spark.range(1).select(F.inline(F.array(*rows)))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, size: int = PIECE) -> DataFrame:
    """(doc_id, n_words long, found) for each row of docs, whose columns doc_id and text alone are read.

    found: array<struct<start long, template int, label string, phrase boolean, containment double>> in order of
    start: of a phrase each place, of another template each block that meets it. start counts words from 0. In a
    text of more than `size` characters blocks are counted from the start of each piece; every m words in
    a row are in a block there too. A null, empty or blank text has no words and nothing is found. Repeated rows
    and doc_ids are each scanned and returned for themselves, null doc_ids too. An empty table gives an empty
    result. Without templates nothing is found.
    """
    spark, longest = docs.sparkSession, max((len(x.words) for x in templates), default=0)
    vocabulary = sorted({w for x in templates for w in x.words})
    counts = token_counts(docs, vocabulary, size) if vocabulary else {}
    ranked = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", pieces(_lowered(F.col("text")), WORD, GAP, 2 * longest, size).alias("p"))
    own = own.select("row", "doc_id", F.posexplode_outer("p").alias("part", "p"))
    own = own.select("row", "doc_id", F.coalesce("part", F.lit(0)).alias("part"), _words(F.coalesce("p.piece", F.lit(""))).alias("here"), _words(F.coalesce("p.next", F.lit(""))).alias("there"))
    own = own.select("row", "doc_id", "part", F.size("here").alias("n"), F.concat("here", "there").alias("all"))
    none = "array<struct<start:int,template:int,label:string,phrase:boolean,containment:double>>"
    if not templates:
        met = own.select("row", "doc_id", "part", "n", F.lit(None).cast(none).alias("met"))
    else:
        order = {w: i for i, w in enumerate(ranked)}
        index = _index(spark, templates, order)
        prefix = sorted({w for x in templates for w in sorted(set(x.words), key=order.__getitem__)[: len(set(x.words)) - ceil(len(set(x.words)) * x.least - 1e-9) + 1]}, key=order.__getitem__)
        hits = own.withColumn("token", F.explode_outer(F.array_intersect("all", _array(prefix))))
        hits = hits.withColumn("all", F.when(F.col("token").isNotNull(), F.col("all")))
        hits = hits.withColumn("at", F.filter(F.transform("all", lambda w, i: F.when(w == F.col("token"), i)), lambda i: i.isNotNull()))
        # the index has one row a prefix token of the templates
        hits = hits.join(F.broadcast(index), "token", "left")
        m = F.col("m")
        ks = F.array_distinct(F.flatten(F.transform("at", lambda p: F.array((p / m).cast("int"), (p / m).cast("int") - 1))))
        ks = F.filter(ks, lambda k: (k >= 0) & (k * m < F.col("n")))
        blocks = F.transform(ks, lambda k: F.struct((k * m).alias("first"), F.slice("all", k * m + 1, 2 * m).alias("block")))
        rows = hits.withColumn("b", F.explode_outer(blocks)).drop("all", "at")
        rows = rows.withColumn("has", F.array_intersect(_array(ranked), "b.block"))
        i, j, n = F.col("i"), F.array_position("has", F.col("token")) - 1, F.size("tokens")
        length = F.size(F.array_distinct("b.block")) >= F.col("need")
        position = F.least(i, j) + 1 + F.least(n - i - 1, F.size("has") - j - 1) >= F.col("need")
        rows = rows.withColumn("both", F.when(length & position, F.array_intersect("tokens", "has")))
        # a block is counted once, at the first token that both have
        ok = (F.size("both") >= F.col("need")) & (F.element_at("both", 1) == F.col("token"))
        one = lambda start, part: F.struct(start.alias("start"), F.col("t").alias("template"), "label", "phrase", part.alias("containment"))
        places = F.filter(F.sequence(F.lit(0), m - 1), lambda s: (F.slice("b.block", s + 1, m) == F.col("words")) & (F.col("b.first") + s < F.col("n")))
        phrase = F.transform(places, lambda s: one(F.col("b.first") + s, F.lit(1.0)))
        met = rows.select("row", "doc_id", "part", "n", F.when(ok & F.col("phrase"), phrase).when(ok, F.array(one(F.col("b.first"), F.size("both") / n))).alias("met"))
    # rows are named once and for all by what is written
    met = save(met)
    parts = met.groupBy("row", "doc_id", "part").agg(F.max("n").cast("long").alias("n"), F.flatten(F.collect_list("met")).alias("met"))
    whole = parts.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "met"))).alias("parts"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast(none.replace("start:int", "start:bigint")).alias("found"))

    def add(acc: Column, p: Column) -> Column:
        moved = F.transform(p["met"], lambda x: F.struct((x["start"] + acc["n"]).alias("start"), x["template"].alias("template"), x["label"].alias("label"), x["phrase"].alias("phrase"), x["containment"].alias("containment")))
        return F.struct((acc["n"] + p["n"]).alias("n"), F.concat(acc["found"], moved).alias("found"))

    out = whole.select("doc_id", F.aggregate("parts", zero, add).alias("x"))
    return out.select("doc_id", F.col("x.n").alias("n_words"), F.array_sort("x.found").alias("found"))


def _labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of all documents."""
    out = scan(load(spark, sf_dir, "documents")).withColumn("base", F.filter("found", lambda x: x["template"] < len(PHRASES)))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.element_at(F.transform("base", lambda x: x["start"]), F.when(F.size("base") > 0, 1)).alias("first_word"), F.element_at(F.transform("base", lambda x: x["start"]), F.when(F.size("base") > 0, -1)).alias("last_word"),
        _labels(F.col("base")).alias("base_labels"), _labels(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["containment"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    rows = ", ".join(f"({t}, '{x.label}', {str(x.phrase).lower()}, {[*x.words]}, {sorted(set(x.words))}, {ceil(len(set(x.words)) * x.least - 1e-9)})" for t, x in enumerate(TEMPLATES))
    return f"""
with templates(t, label, phrase, words, tokens, need) as (values {rows}),
  texts as (select row_number() over () r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}+'), lambda w: w <> '') w from documents),
  maybe as (select r, w, t, label, phrase, words, tokens, need, len(words) m from texts, templates where len(list_intersect(w, tokens)) >= need),
  blocks as (select *, unnest(range(0, len(w), m)) spot from maybe),
  met as (select *, len(list_intersect(w[spot + 1 : spot + 2 * m], tokens)) overlap from blocks where len(list_intersect(w[spot + 1 : spot + 2 * m], tokens)) >= need),
  found as (select r, label, false base, spot as start, overlap / len(tokens) part from met where not phrase union all
    select r, label, t < {len(PHRASES)}, start, 1.0 from (select *, unnest(range(spot, spot + m)) start from met where phrase) where w[start + 1 : start + m] = words),
  each as (select r, count(*) filter (base) n_base, min(start) filter (base) first_word, max(start) filter (base) last_word,
    coalesce(string_agg(distinct label, ',' order by label) filter (base), '') base_labels, string_agg(distinct label, ',' order by label) labels, max(part) score from found group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0)::double score
from texts left join each using (r)"""


SQL = _sql()
