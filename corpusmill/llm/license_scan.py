"""Operator 6, licence scans: a trained paragraph classifier, applied with native expressions.

Model.  Multinomial logistic regression over sparse word n-grams (one to three words)
tells licence families from an unknown class.  It is trained here, on the driver, from
the notices in TEMPLATES and SPDX, and for the unknown class from sentences in
BACKGROUND and every other licence of OTHERS, with words dropped, repeated and mixed in
at random; its size is that of these texts, whatever the data.  A feature holds at least
one anchor, a word that notices use and the background does not, so a paragraph without
an anchor has no feature and is unknown.  The softmax temperature and the unknown class's
threshold are calibrated on held-out samples, in which the unknown class is background
and those of OTHERS that training has not seen: FALSE_ALARMS of them may pass.

Scan.  Paragraphs are runs of lines between blank ones.  Each of its lines is judged, and
the paragraph as a whole if it has several.  Those without an anchor are passed over; the
others' n-grams are joined to the broadcast table of weights, summed, and turned into
probabilities.  A template of the predicted family must then confirm: the share of its
n-grams that the text holds has to reach CONFIRM, and all its keys (KEYS: the words that
tell it from its relatives, such as a name with its version) have to be there.  Nothing is
confirmed in a line or paragraph that says "not released under" or the like, and reserved rights are only where the
sentence ends with the word: "All rights reserved for the house" is none.
Further families of a paragraph are found by the templates alone, in windows of words.

The main path runs no Python: only the small tables come from the driver.

Defined results.  Null and empty texts have no paragraphs.  Texts of any length are
scanned whole.  Rows that repeat a document are scanned one by one, and a null id is
carried along.  Ties between families go to the first name.  A family that is confirmed in
a paragraph has no unconfirmed rows there.  An empty table gives no rows.  Extra columns
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common as C

#: Short notices by which works name their licence, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "BSD": ("Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "proprietary": ("Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced or distributed without prior written permission of the publisher."),
}
#: The SPDX identifiers of the families.
SPDX: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache-2.0",),
    "BSD": ("BSD-2-Clause", "BSD-3-Clause"),
    "CC-BY": ("CC-BY-4.0",),
    "CC-BY-NC": ("CC-BY-NC-4.0",),
    "CC-BY-SA": ("CC-BY-SA-4.0",),
    "CC0": ("CC0-1.0",),
    "GPL": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
    "LGPL": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "MIT": ("MIT",),
    "MPL-2.0": ("MPL-2.0",),
}
#: The words of a notice that tell its family from its relatives; a template's keys are all those it holds.
KEYS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("apache license", "2.0"),
    "BSD": ("bsd license", "source and binary"),
    "CC-BY": ("cc by 4.0", "commons attribution 4.0"),
    "CC-BY-NC": ("cc by-nc 4.0", "attribution-noncommercial 4.0"),
    "CC-BY-SA": ("cc by-sa 4.0", "attribution-sharealike 4.0"),
    "CC0": ("cc0 1.0",),
    "GPL": ("gnu general public",),
    "LGPL": ("gnu lesser general",),
    "MIT": ("mit license", "hereby granted free"),
    "MPL-2.0": ("mozilla public license", "2.0"),
    "proprietary": ("rights reserved",),
}
#: Notices of licences outside the families.
OTHERS = (
    "Licensed under the Eclipse Public License, Version 2.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "This software is released under the ISC License.",
    "This program is licensed under the GNU Affero General Public License, version 3.",
    "Licensed under the Common Development and Distribution License, Version 1.0.",
    "Licensed under CC BY-SA 3.0.",
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "Licensed under the Apache License, Version 1.1.",
    "Released under the zlib License.",
    "This work is licensed under CC BY-NC-SA 4.0.",
    "Licensed under the SIL Open Font License, Version 1.1.",
    "Released under the Boost Software License, Version 1.0.",
    "This work is licensed under the Artistic License, version 2.0.",
    "Licensed under the Academic Free License, version 3.0.",
    "This is free and unencumbered software released into the public domain.",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: AGPL-3.0-only",
    "Licensed under CC BY 3.0.",
    "Licensed under CC BY-ND 4.0.",
    "Released under the PostgreSQL License.",
    "Released under the Microsoft Public License.",
)
#: Sentences that are no licence notice, with some of the same words.
BACKGROUND = (
    "The work was done in the house and the people of the town came to see it.",
    "She got her driving license last year and a fishing license this spring.",
    "The office will give you a license if you pay the fee in person.",
    "He studied at MIT and wrote about free trade and public law.",
    "Apache is the name of a people in the south of the country.",
    "A new version of the story was published under her name.",
    "They were licensed to sell food in the market and at the station.",
    "The general public is free to use the park under the terms of the city.",
    "It may be that the first edition was released without a foreword.",
    "The conditions at the source of the river are met by few visitors.",
    "Der Text wurde in der Zeit von einem Autor und nicht von der Stadt geschrieben.",
    "Le texte est dans la ville et pour les gens de la maison.",
    "El texto es para la gente que vive en la ciudad y no en el campo.",
    "In no event shall the meeting be held before noon, the chairman said.",
    "As with all the others, any of them can take part or not, except the one that has no form.",
    "The author may do a deal with the reader, and the following copy is written prior to it.",
    "A library has files, a file has code, and a program is a form of related writing, as far as possible.",
    "Part of the foundation was provided by the publisher, free of charge, subject to documentation.",
    "The international form of the following subjects is universal, and the publication has its extent.",
)
UNKNOWN = "unknown"
GRAMS = (1, 2, 3)
#: Least share of a template's n-grams that confirms a prediction.
CONFIRM = 0.6
SAMPLES, ROUNDS, PENALTY = 100, 400, 3e-4
#: Highest share of held-out unknown samples, half of them licences never seen, that may pass the threshold.
FALSE_ALARMS = 0.05
_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def tokens_of(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def _grams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in GRAMS for i in range(len(tokens) - n + 1)}


@dataclass(frozen=True)
class Model:
    anchors: tuple[str, ...]
    families: tuple[str, ...]  # the unknown class comes last
    weights: dict[str, list[float]]  # n-gram: a weight for each family
    bias: list[float]
    threshold: float
    templates: tuple[tuple[str, str, tuple[str, ...], tuple[str, ...]], ...]  # family, template name, its n-grams, its keys


def _noisy(rng: np.random.Generator, tokens: list[str], other: list[str]) -> list[str]:
    out = [t for t in tokens if rng.random() > 0.08]
    for _ in range(int(rng.integers(0, 4))):
        out.insert(int(rng.integers(0, len(out) + 1)), other[int(rng.integers(len(other)))])
    if rng.random() < 0.3:
        lead = [other[int(i)] for i in rng.integers(0, len(other), int(rng.integers(1, 12)))]
        out = lead + out if rng.random() < 0.5 else out + lead
    return out


def notices() -> list[tuple[str, str, list[str]]]:
    """Family, name and words of every template."""
    plain = [(f, f"{f} {k + 1}", tokens_of(t)) for f, ts in TEMPLATES.items() for k, t in enumerate(ts)]
    return plain + [(f, i, tokens_of(f"SPDX-License-Identifier: {i}")) for f, ids in SPDX.items() for i in ids]


def keys_of(family: str, name: str, tokens: list[str]) -> tuple[str, ...]:
    """The n-grams that a text must hold to confirm a template; an identifier is its own key."""
    if name in SPDX.get(family, ()):
        return (" ".join(tokens),)
    return tuple(k for k in KEYS[family] if k in _grams(tokens))


@lru_cache(maxsize=1)
def train(seed: int = 3) -> Model:
    """The classifier; the same on every call."""
    rng = np.random.default_rng(seed)
    plain = [tokens_of(s) for s in BACKGROUND]
    common = sorted({t for s in plain for t in s})
    known, others = notices(), [tokens_of(t) for t in OTHERS]
    # anchors: words of short notices' kind that ordinary sentences lack, and the words that name a licence at all
    anchors = {t for _, _, ts in known for t in ts if t not in common and not t.isdigit() and len(t) > 1} | {"license", "licensed", "apache"}
    families = (*TEMPLATES, UNKNOWN)

    def features(tokens: list[str]) -> set[str]:
        return {g for g in _grams(tokens) if anchors & set(g.split())}

    def draw(n: int, unseen: bool) -> tuple[list[set[str]], np.ndarray]:
        rows, labels = [], []
        for label, family in enumerate(TEMPLATES):
            own = [t for f, _, t in known if f == family]
            for i in range(n):
                rows.append(features(_noisy(rng, own[i % len(own)], common)))
                labels.append(label)
        words, other = sorted(anchors), others[1::2] if unseen else others[::2]
        for i in range(4 * n):  # ordinary sentences, some with a stray anchor or two, and other licences
            tokens = list(plain[i % len(plain)])
            for _ in range(int(rng.integers(0, 3))):
                tokens.insert(int(rng.integers(0, len(tokens) + 1)), words[int(rng.integers(len(words)))])
            rows.append(features(_noisy(rng, tokens, common)))
            rows.append(features(_noisy(rng, other[i % len(other)], common)))
            labels += [len(families) - 1] * 2
        return rows, np.array(labels)

    vocabulary = sorted({g for ts in (*(t for _, _, t in known), *plain, *others[::2]) for g in features(ts)})
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(vocabulary) + 1))
        x[:, -1] = 1
        for i, row in enumerate(rows):
            x[i, [at[g] for g in row if g in at]] = 1
        return x

    rows, labels = draw(SAMPLES, False)
    x, y = matrix(rows), np.eye(len(families))[labels]
    w, step = np.zeros((x.shape[1], len(families))), 0.5
    for _ in range(ROUNDS):  # full-batch gradient descent on the convex loss
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= step * (x.T @ (p - y) / len(x) + PENALTY * w)
    rows, labels = draw(SAMPLES // 2, True)  # held out: temperature, then threshold
    z = matrix(rows) @ w

    def soft(t: float) -> np.ndarray:
        e = np.exp(z / t - (z / t).max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    heat = min(np.arange(0.2, 2.05, 0.05), key=lambda t: -np.log(soft(t)[np.arange(len(labels)), labels] + 1e-12).mean())
    passed = 1 - soft(heat)[labels == len(families) - 1][:, -1]
    threshold = float(np.quantile(passed, 1 - FALSE_ALARMS))
    w = w / heat
    weights = {g: w[i].round(9).tolist() for g, i in at.items()}
    templates = tuple((f, name, tuple(sorted(_grams(ts))), keys_of(f, name, ts)) for f, name, ts in known)
    return Model(tuple(sorted(anchors)), families, weights, w[-1].round(9).tolist(), threshold, templates)


def _anchored(col: Column, anchors: tuple[str, ...]) -> Column:
    """Does the text hold an anchor?  Alternatives are grouped by first letter, so most words fail at once."""
    by_letter: dict[str, list[str]] = {}
    for a in sorted(anchors, key=lambda a: (-len(a), a)):
        by_letter.setdefault(a[0], []).append(re.escape(a[1:]))
    words = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_letter.items()))
    return col.rlike(rf"(?i)(?<![a-z0-9])(?:{words})(?![a-z0-9])")


def _all_words(text: Column) -> Column:
    """A paragraph's pairs and triples of words, across lines: gram, word number, first and last line."""
    words = lambda line, i: F.transform(F.regexp_extract_all(F.lower(line), F.lit(f"({_TOKEN})"), F.lit(1)), lambda w: F.struct(w.alias("w"), i.alias("line")))

    def grams(t: Column, n: int) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        at = lambda i, k: F.element_at(t, i + k)
        return F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[at(i, k)["w"] for k in range(n)]).alias("gram"), i.alias("pos"), at(i, 0)["line"].alias("line"), at(i, n - 1)["line"].alias("till")))

    # bound as a lambda's variable, so that the words are cut once
    return F.transform(F.array(F.flatten(F.transform(F.split(text, "\n"), words))), lambda t: F.concat(grams(t, 2), grams(t, 3)))[0]


#: A sentence that says that something is not under a licence, and "rights reserved" where its sentence ends there.
_DENIED = r"(?i)\b(?:not|never|no\s+longer)\s+(?:\w+\s+){0,2}(?:licen[sc]ed|released|distributed|available|published)\s+(?:\w+\s+){0,3}under\b"
_CLOSED = r"(?i)\brights\s+reserved\s*(?:[^\s\w]|$)"


def _plausible(family: Column, text: Column) -> Column:
    """May a notice in ``text`` be confirmed?  Not where the licence is denied, nor rights that are reserved for something."""
    return ~text.rlike(_DENIED) & ((family != "proprietary") | text.rlike(_CLOSED))


def _in_windows(paragraphs: DataFrame, model: Model) -> DataFrame:
    """Templates confirmed by words in windows over whole paragraphs, whatever their lines: doc_id, text_hash, paragraph, line, family, template, overlap, notice.

    A window spans twice a template's length or more, and begins at every multiple of half of that.  A word counts where it
    stands in a pair that the template holds too.  Of templates that meet at one place the one with the largest overlap
    stays, and another family's if also CONFIRM of the n-grams that are its own are there.
    """
    spark = paragraphs.sparkSession
    kinds = spark.createDataFrame([(i, f, t, max(4, len(g) // 2), list(g), list(k)) for i, (f, t, g, k) in enumerate(model.templates)], "t int, family string, template string, span int, all array<string>, keys array<string>")
    shingles = kinds.select("t", "span", F.explode("all").alias("gram")).filter(F.contains("gram", F.lit(" ")))
    rows = paragraphs.filter(~F.col("text").rlike(_DENIED)).withColumn("row", F.monotonically_increasing_id()).withColumn("closed", F.col("text").rlike(_CLOSED))
    of = ("row", "doc_id", "text_hash", "paragraph", "closed")
    met = rows.select(*of, F.explode(_all_words(F.col("text"))).alias("g")).select(*of, "g.*").join(F.broadcast(shingles), "gram")
    at = lambda shift: F.floor((F.col("pos") + shift * F.col("span")) / (2 * F.col("span"))) * 2 + shift
    found = met.withColumn("window", F.explode(F.array(at(0), at(1)))).groupBy(*of, "t", "window")
    found = found.agg(F.collect_set(F.struct("pos", "gram")).alias("at"), F.min("line").alias("line"))
    found = found.withColumn("held", F.array_distinct(F.flatten(F.transform("at", lambda x: F.concat(F.array(x["gram"]), F.split(x["gram"], " "))))))
    found = found.join(F.broadcast(kinds), "t").withColumn("overlap", F.size("held") / F.size("all")).filter((F.col("overlap") >= CONFIRM) & (F.size(F.array_except("keys", "held")) == 0) & ((F.col("family") != "proprietary") | F.col("closed")))
    said = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda x: F.transform(F.split(x["gram"], " "), lambda w, i: F.struct((x["pos"] + i).alias("pos"), w.alias("w")))))))
    found = found.withColumn("said", said).withColumn("from", F.col("said")[0]["pos"]).withColumn("to", F.element_at("said", -1)["pos"])
    found = found.withColumn("notice", F.array_join(F.transform("said", lambda x: x["w"]), " "))
    fields = ("family", "template", "overlap", "held", "all", "from", "to", "line", "notice", "t", "window")
    # a notice spans fewer than `wide` words, so those that it meets begin in its own cell or beside it; a cell holds a bounded number
    wide = 2 * max(max(4, len(g) // 2) for _, _, g, _ in model.templates) + 3
    found = found.withColumn("cell", F.floor(F.col("from") / wide)).withColumn("near", F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])))
    found = found.groupBy(*of, "near").agg(F.collect_list(F.struct(*fields, (F.col("near") == F.col("cell")).alias("home"))).alias("c"))
    rank = lambda x: F.struct(x["overlap"], F.size(x["all"]), -x["from"], -x["t"], -x["window"])
    own = lambda a, b: F.size(F.array_except(a["held"], b["all"])) >= CONFIRM * F.greatest(F.lit(1), F.size(F.array_except(a["all"], b["all"])))
    beats = lambda b, a: (rank(b) > rank(a)) & (b["from"] <= a["to"]) & (a["from"] <= b["to"]) & ((a["family"] == b["family"]) | ~own(a, b))
    best = F.filter("c", lambda a: a["home"] & ~F.exists("c", lambda b: beats(b, a)))
    return found.select("doc_id", "text_hash", "paragraph", F.explode(best).alias("x")).select("doc_id", "text_hash", "paragraph", "x.line", "x.family", "x.template", "x.overlap", "x.notice")


def _judged(units: DataFrame, model: Model) -> DataFrame:
    """Units (doc_id, text_hash, paragraph, line, notice) that the classifier takes for a notice, with family, probability, template, overlap, confirmed."""
    spark = units.sparkSession
    names = [f"w{i}" for i in range(len(model.families))]
    weights = spark.createDataFrame([(g, *w) for g, w in model.weights.items()], "gram string, " + ", ".join(f"{n} double" for n in names))
    shingles = spark.createDataFrame([(f, t, g, float(len(grams)), g in keys, len(keys)) for f, t, grams, keys in model.templates for g in grams], "t_family string, template string, gram string, t_size double, is_key boolean, n_keys int")
    units = units.withColumn("row", F.monotonically_increasing_id())
    words = units.withColumn("t", F.regexp_extract_all(F.lower("notice"), F.lit(f"({_TOKEN})"), F.lit(1)))

    def grams(n: int) -> Column:
        starts = F.when(F.size("t") >= n, F.sequence(F.lit(1), F.size("t") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("t", i, n), " "))

    of = ("doc_id", "text_hash", "paragraph", "line", "notice")
    every = words.select("row", *of, F.explode(F.array_distinct(F.concat(*[grams(n) for n in GRAMS]))).alias("gram"))
    # one pass sums the class weights and counts what each template shares with the unit
    by_gram = shingles.groupBy("gram").agg(F.collect_list(F.struct("t_family", "template", "t_size", "is_key", "n_keys")).alias("in_templates"))
    table = weights.join(by_gram, "gram", "full_outer")
    met = every.join(F.broadcast(table), "gram")
    sums = met.groupBy("row").agg(*[F.first(c).alias(c) for c in of], *[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names], F.flatten(F.collect_list("in_templates")).alias("shared"))
    logits = F.array(*[F.col(n) + F.lit(b) for n, b in zip(names, model.bias)])
    told = sums.withColumn("z", logits).withColumn("top", F.array_max("z"))
    told = told.withColumn("e", F.transform("z", lambda v: F.exp(v - F.col("top"))))
    told = told.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    k = len(model.families) - 1
    told = told.withColumn("known", 1 - F.col("e")[k] / F.col("total"))
    first = F.array_position(F.slice("z", 1, k), F.array_max(F.slice("z", 1, k))).cast("int")
    told = told.withColumn("family", F.element_at(F.array(*[F.lit(f) for f in model.families]), first)).filter(F.col("known") >= model.threshold)
    own = F.filter("shared", lambda s: s["t_family"] == F.col("family"))
    kinds = F.array_distinct(F.transform(own, lambda s: F.struct(s["template"].alias("template"), s["t_size"].alias("t_size"), s["n_keys"].alias("n_keys"))))
    held = lambda s: F.filter(own, lambda o: o["template"] == s["template"])

    def share(s: Column) -> Column:
        overlap, keys = F.size(held(s)) / s["t_size"], F.size(F.filter(held(s), lambda o: o["is_key"])) == s["n_keys"]
        return F.struct((keys & (overlap >= CONFIRM)).alias("confirmed"), overlap.alias("overlap"), s["template"].alias("template"))

    told = told.withColumn("best", F.array_max(F.transform(kinds, share)))
    overlap, sure = F.coalesce(F.col("best.overlap"), F.lit(0.0)), F.coalesce(F.col("best.confirmed"), F.lit(False)) & _plausible(F.col("family"), F.col("notice"))
    return told.select("doc_id", "text_hash", "paragraph", "line", "family", F.round("known", 6).alias("probability"), F.col("best.template").alias("template"), F.round(overlap, 6).alias("overlap"), sure.alias("confirmed"), "notice")


#: One blank line or more, between paragraphs.
_BLANK = r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"


def _units(text: Column) -> Column:
    """The lines of a paragraph, numbered from 0, and the paragraph itself without a number if it has several."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.cast("long").alias("line"), x.alias("notice")))
    whole = F.array(F.struct(F.lit(None).cast("long").alias("line"), F.translate(text, "\n", " ").alias("notice")))
    return F.when(F.contains(text, F.lit("\n")), F.concat(lines, whole)).otherwise(lines)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per notice: doc_id, paragraph, line (both from 0), family, probability, template, overlap, confirmed, notice.

    ``line`` is null where the paragraph as a whole is meant.  A family that the classifier does not name, because the
    paragraph holds another one too, has no probability, the first line of its words, and these words as its notice.
    """
    model = model or train()
    hit = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(_anchored(F.col("text"), model.anchors))
    parts = hit.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", _BLANK)).alias("paragraph", "text")).filter(_anchored(F.col("text"), model.anchors))
    parts = parts.withColumn("paragraph", F.col("paragraph").cast("long"))
    units = parts.select("doc_id", "text_hash", "paragraph", F.explode(_units(F.col("text"))).alias("u")).select("doc_id", "text_hash", "paragraph", "u.*").filter(_anchored(F.col("notice"), model.anchors))
    told = C.materialize(_judged(units, model), "licences-told")
    also = C.materialize(_in_windows(parts, model), "licences-in-windows")
    key = ("doc_id", "text_hash", "paragraph", "family")

    def less(rows: DataFrame, others: DataFrame) -> DataFrame:
        """``rows`` without those whose family ``others`` has in the same paragraph."""
        gone = others.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
        same = rows["doc_id"].eqNullSafe(gone["_doc_id"])
        for c in key[1:]:
            same = same & (rows[c] == gone[f"_{c}"])
        return rows.join(gone, same, "left_anti")

    sure = told.filter("confirmed")
    by_line = sure.filter("line IS NOT NULL")
    whole = less(sure.filter("line IS NULL"), by_line)
    windows = less(also, sure).withColumn("line", F.col("line").cast("long")).withColumn("probability", F.lit(None).cast("double")).withColumn("confirmed", F.lit(True))
    open_ = less(less(told.filter("NOT confirmed"), sure), also)
    columns = ("doc_id", "paragraph", "line", "family", "probability", "template", "overlap", "confirmed", "notice")
    out = [x.select(*columns) for x in (by_line, whole, windows.withColumn("overlap", F.round("overlap", 6)), open_)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
