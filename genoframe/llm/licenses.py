"""Licence scan: a positional index of rare template words, intersected by relative position and verified.

DataFrame expressions only; each document is scanned inside its own row, so nothing is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import alnum_words

#: Label and template (alphanumeric words of public licence notices); words in brackets are mandatory key phrases.
BASE = (
    ("mit", "[mit license]"),
    ("apache", "[apache license]"),
    ("gpl", "[general public license]"),
)
TEMPLATES = (
    ("0bsd", "[permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted]"),
    ("agpl", "[gnu affero general public license]"),
    ("apache", "[licensed under the apache license] version"),
    ("apache", "[unless required by applicable law or agreed to in writing] software distributed under [the license is distributed on an]"),
    ("bsd", "[redistribution and use in source and binary forms] with or without [modification are permitted]"),
    ("artistic", "[artistic license]"),
    ("bsd", "[neither the name of]"),
    ("bsd", "[this software is provided by the copyright holders and contributors as is]"),
    ("bsd", "[bsd 3 clause]"),
    ("bsd", "[bsd 2 clause]"),
    ("bsl", "[boost software license]"),
    ("cc0", "[creative commons zero]"),
    ("cc0", "[cc0 1 0 universal]"),
    ("cc-by", "[creative commons attribution]"),
    ("cc-by", "[licensed under cc by]"),
    ("epl", "[eclipse public license]"),
    ("gpl", "this program is [free software you can redistribute it] and or [modify it under the terms of the gnu general public license]"),
    ("gpl", "this program is distributed in the hope that it will be useful but [without any warranty without even the implied warranty of merchantability]"),
    ("isc", "[isc license]"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose"),
    ("lgpl", "[gnu lesser general public license]"),
    ("mit", "[permission is hereby granted free of charge] to any person [obtaining a copy of this software]"),
    ("mit", "[the software is provided as is without warranty of any kind express or implied]"),
    ("mit", "[the above copyright notice and this permission notice shall be included in all copies or substantial portions]"),
    ("mpl", "[mozilla public license]"),
    ("mpl", "[this source code form is subject to the terms of the mozilla public license]"),
    ("python", "[python software foundation license]"),
    ("unlicense", "this is [free and unencumbered software released into the public domain]"),
    ("wtfpl", "[do what the fuck you want to public license]"),
    ("zlib", "this software is provided as is [without any express or implied warranty in no event will the authors be held liable]"),
    ("zlib", "[zlib license]"),
)


@dataclass(frozen=True)
class Template:
    """A template: its length in words, mandatory phrases by word offset, and rare words by word offset."""

    label: str
    base: bool
    length: int
    phrases: tuple[tuple[int, tuple[str, ...]], ...]
    anchors: tuple[tuple[str, int], ...]


def _parse(text: str) -> tuple[list[str], list[tuple[int, tuple[str, ...]]]]:
    words, phrases, start = [], [], None
    for token in text.split():
        if token.startswith("["):
            start = len(words)
        words.append(token.strip("[]"))
        if token.endswith("]"):
            phrases.append((start, tuple(words[start:])))
    return words, phrases


def index(base=BASE, more=TEMPLATES, rare: int = 2) -> list[Template]:
    """Builds the index: each template keeps its ``rare`` words of highest IDF among all templates, with their offsets.

    Only words of mandatory phrases are eligible, so a verified occurrence always has all of them.
    """
    parsed = [(label, is_base, *_parse(text)) for group, is_base in ((base, True), (more, False)) for label, text in group]
    in_templates: dict[str, int] = {}
    for _, _, words, _ in parsed:
        for w in set(words):
            in_templates[w] = in_templates.get(w, 0) + 1
    idf = {w: math.log(len(parsed) / n) for w, n in in_templates.items()}
    out = []
    for label, is_base, words, phrases in parsed:
        eligible = {w: at + k for at, phrase in reversed(phrases) for k, w in reversed(list(enumerate(phrase)))}
        anchors = sorted(eligible.items(), key=lambda x: (-idf[x[0]], x[1]))[:rare]
        out.append(Template(label, is_base, len(words), tuple(phrases), tuple(anchors)))
    return out


def _literal(value) -> Column:
    """A literal of nested tuples (arrays) and dictionaries (structs)."""
    if isinstance(value, tuple):
        return F.array(*map(_literal, value))
    if isinstance(value, dict):
        return F.struct(*[_literal(v).alias(k) for k, v in value.items()])
    return F.lit(value)


def postings(templates: list[Template]) -> dict[str, tuple[dict, ...]]:
    """The positional index: for each rare word the templates (t) that have it, the offset (o) there, and how many rare words the template has (n)."""
    out: dict[str, list[dict]] = {}
    for t, template in enumerate(templates):
        for word, offset in template.anchors:
            out.setdefault(word, []).append({"t": t, "o": offset, "n": len(template.anchors)})
    return {w: tuple(p) for w, p in sorted(out.items())}


def _candidates(rare: Column, index: dict[str, tuple[dict, ...]]) -> Column:
    """(t, s, n) for each occurrence of a rare word and each of its postings: where template t would start; sorted."""
    by_word = F.create_map(*[x for w, p in index.items() for x in (F.lit(w), _literal(p))])
    of = lambda h: F.transform(by_word[h["w"]], lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["o"]).alias("s"), p["n"].alias("n")))
    return F.array_sort(F.flatten(F.transform(rare, of)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """One row per document: id, n_words, starts (template and start of each occurrence), n_base, first_word, last_word, base_labels, labels, score.

    A document's words that are in the index are looked up there; the starts that all rare words
    of a template agree on are the candidates, and there the template's mandatory phrases are
    verified.  ``score`` is 1 for a verified licence body or notice, 0.8 where only a licence's
    name (a base phrase) stands, else 0.  Null and empty texts have no words, no labels (empty
    strings) and score 0; repeated rows get a row each.
    """
    templates = templates or index()
    by_word = postings(templates)
    words = docs.select(F.col(id_col), alnum_words(F.col(text_col)).alias("_words"))
    rare = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(list(by_word)), F.struct(i.alias("i"), w.alias("w")))), lambda h: h.isNotNull())
    found = words.select(id_col, "_words", rare.alias("_rare")).select(id_col, "_words", F.when(F.size("_rare") > 0, _candidates(F.col("_rare"), by_word)).alias("_at"))
    # Equal entries stand together: the n-th of a template with n rare words says that all agree.
    agreed = F.filter(F.transform("_at", lambda x, i: F.when((i + 1 >= x["n"]) & (F.get("_at", i + 1 - x["n"]) == x), x)), lambda x: x.isNotNull())
    phrases = _literal(tuple(tuple({"o": o, "w": tuple(p)} for o, p in t.phrases) for t in templates))
    there = lambda x: F.forall(phrases[x["t"]], lambda p: F.slice(F.col("_words"), F.greatest(x["s"], F.lit(0)) + p["o"] + 1, F.size(p["w"])) == p["w"])
    starts = F.transform(F.filter(agreed, lambda x: (x["s"] >= 0) & there(x)), lambda x: F.struct(x["t"].alias("template"), x["s"].alias("start")))
    table = _literal(tuple({"label": t.label, "base": t.base} for t in templates))
    known = found.select(id_col, F.size("_words").cast("long").alias("n_words"), F.coalesce(starts, F.array().cast("array<struct<template:int,start:int>>")).alias("starts"))
    places = F.transform(F.filter("starts", lambda x: table[x["template"]]["base"]), lambda x: x["start"])
    labels = lambda which: F.array_join(F.array_sort(F.array_distinct(F.transform(which, lambda x: table[x["template"]]["label"]))), ",")
    body = F.exists("starts", lambda x: ~table[x["template"]]["base"])
    return known.select(
        id_col, "n_words", "starts", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        labels(F.filter("starts", lambda x: table[x["template"]]["base"])).alias("base_labels"), labels(F.col("starts")).alias("labels"),
        F.when(body, 1.0).when(F.size(places) > 0, 0.8).otherwise(0.0).alias("score"),
    )
