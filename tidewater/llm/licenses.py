"""License scans: a trained paragraph classifier with template confirmation.

A paragraph is a line with a word. Its features are the word 1- to 3-grams that
hold an anchor (a word typical of licence notices); their weights come from a
multinomial logistic regression, trained in numpy on the notices below, on
variations of them and on everyday sentences that use the same words. One class
is "unknown"; a temperature fitted on variations kept out of training
calibrates all probabilities. A paragraph counts when a licence family has the
highest probability and at least ``LEAST``, and the prediction is confirmed
when enough of a template of that family stands in the paragraph.

Scoring is one native projection. Texts without any anchor are settled by
substring tests: without an anchor no feature can be present.

Defined cases: null or blank text has no paragraphs; a paragraph without
features is unknown; repeated rows give repeated rows; an empty table gives an
empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.base import SPACE_CHARS, let, read

# Notices of common licence families.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "This software is distributed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "proprietary": [
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced or distributed without the prior written permission of the publisher.",
    ],
}
EVERYDAY = (
    "She got her driving license last week and drove to the coast.",
    "The restaurant is licensed to sell beer and wine until midnight.",
    "Public transport is free of charge for any person over sixty.",
    "The general met the public in the square and gave permission to leave.",
    "Please read the conditions before you use the software at home.",
    "We released the birds and the work went on under the sun.",
    "The apache helicopter flew over a common field, version two of the plan.",
    "All the rights and duties of a citizen are reserved for later chapters.",
    "He studied at MIT and then moved to the bay area.",
    "The copyright debate in parliament took three days.",
    "Creative people have ideas in common with their neighbours.",
    "Redistribution of income was a topic of the conference.",
    "A copy of the file is attached; you may use it as you like.",
    "The foundation of the house is free of water and is permitted to dry.",
)
#: Every feature holds a word that contains one of these.
ANCHORS = (
    "licen", "copyright", "gpl", "mit", "apache", "bsd", "creative", "commons", "cc", "mozilla", "mpl",
    "redistribut", "permission", "permitted", "rights", "public", "domain", "spdx", "reproduced", "waived", "gnu",
)
UNKNOWN = "unknown"
TOKEN = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
LEAST = 0.6
CONFIRM = 0.6


def words_of(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def features(words: list[str]) -> list[str]:
    """Distinct 1- to 3-grams, in order."""
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return list(dict.fromkeys(grams))


def _anchored(gram: str) -> bool:
    return any(a in w for w in gram.split() for a in ANCHORS)


def _varied(rng: np.random.Generator, text: str, fillers: list[str]) -> list[str]:
    """Words of a notice with a few dropped, changed or surrounded by others."""
    words = words_of(text)
    kept = [w for w in words if len(words) < 6 or rng.random() > 0.08]
    if rng.random() < 0.3:
        kept = [str(rng.choice(fillers)) for _ in range(rng.integers(1, 9))] + kept
    if rng.random() < 0.3:
        kept += [str(rng.choice(fillers)) for _ in range(rng.integers(1, 9))]
    return kept


@functools.cache
def trained(seed: int = 5) -> tuple[list[str], dict[str, list[float]], list[float]]:
    """Families, weights per feature and biases, already divided by the temperature."""
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN]
    fillers = sorted({w for t in EVERYDAY for w in words_of(t)})
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in features(words_of(t)) if _anchored(g)})
    place = {g: i for i, g in enumerate(vocabulary)}

    def sample(n: int) -> tuple[np.ndarray, np.ndarray]:
        x, y = [], []
        for k, f in enumerate(families):
            texts = TEMPLATES.get(f, EVERYDAY)
            for i in range(n * (4 if f == UNKNOWN else 1)):
                row = np.zeros(len(vocabulary))
                row[[place[g] for g in features(_varied(rng, texts[i % len(texts)], fillers)) if g in place]] = 1
                x.append(row)
                y.append(k)
            for t in texts:  # and each single anchored word alone is no notice
                for w in {w for w in words_of(t) if w in place and f != UNKNOWN}:
                    row = np.zeros(len(vocabulary))
                    row[place[w]] = 1
                    x.append(row)
                    y.append(len(families) - 1)
        return np.array(x), np.array(y)

    x, y = sample(60)
    target = np.eye(len(families))[y]
    weights, bias = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    bias[-1] = 2.0
    for _ in range(400):
        z = x @ weights + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weights -= 1.5 * (x.T @ (p - target) / len(y) + 1e-4 * weights)
        bias -= 1.5 * (p - target).mean(0)
    x, y = sample(20)
    z = x @ weights + bias

    def loss(t: float) -> float:
        s = z / t
        s -= s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    heat = min(np.geomspace(0.2, 5, 60).tolist(), key=loss)
    rounded = np.round(weights / heat, 6)
    return families, {g: rounded[i].tolist() for g, i in place.items()}, np.round(bias / heat, 6).tolist()


def _score(words: Column) -> Column:
    """(family, confidence) of a paragraph's words."""
    families, weights, bias = trained()
    table = F.from_json(F.lit(json.dumps(weights)), "map<string,array<double>>")
    names = F.array(*[F.lit(f) for f in families])
    start = F.array(*[F.lit(float(b)) for b in bias])
    n = F.size(words)

    def grams_of(k: int) -> Column:
        places = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat_ws(" ", F.slice(words, i, k)))

    grams = F.array_distinct(F.concat(grams_of(1), grams_of(2), grams_of(3)))
    hits = F.array_sort(F.array_intersect(grams, F.map_keys(table)))
    logits = F.aggregate(hits, start, lambda a, g: F.zip_with(a, F.element_at(table, g), lambda x, y: x + y))

    def pick(z: Column) -> Column:
        top = F.array_max(z)
        total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        at = F.array_position(z, top)
        return F.struct(F.element_at(names, at.cast("int")).alias("family"), (F.lit(1.0) / total).alias("confidence"))

    none = F.struct(F.lit(UNKNOWN).alias("family"), F.lit(1.0).alias("confidence"))
    return F.when(F.size(hits) == 0, none).otherwise(let(logits, pick))


def _overlap(words: Column, family: Column) -> Column:
    """The largest share of a template of the family (or of the paragraph, if that is shorter) that both have."""
    templates = F.from_json(
        F.lit(json.dumps({f: [sorted(set(words_of(t))) for t in ts] for f, ts in TEMPLATES.items()})), "map<string,array<array<string>>>"
    )
    own = F.array_distinct(words)
    shares = F.transform(
        F.coalesce(F.element_at(templates, family), F.array().cast("array<array<string>>")),
        lambda t: F.size(F.array_intersect(t, own)) / F.least(F.size(t), F.greatest(F.size(own), F.lit(3))).cast("double"),
    )
    return F.coalesce(F.array_max(shares), F.lit(0.0))


FOUND = "array<struct<paragraph:int,family:string,confidence:double,overlap:double,confirmed:boolean>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_paragraphs, notices``: the licence paragraphs of each document, in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    lowered = F.lower(text)
    anchored = functools.reduce(lambda a, b: a | b, [lowered.contains(a) for a in ANCHORS if len(a) > 3])
    anchored = anchored | lowered.rlike(r"\b\w*(?:" + "|".join(a for a in ANCHORS if len(a) <= 3) + ")")
    base = docs.select("doc_id", lines.alias("paragraphs"), anchored.alias("anchored"))

    def judged(p: Column, i: Column) -> Column:
        def with_words(w: Column) -> Column:
            return let(
                _score(w),
                lambda s: let(
                    _overlap(w, s["family"]),
                    lambda o: F.struct(
                        (i + 1).alias("paragraph"),
                        s["family"].alias("family"),
                        F.round(s["confidence"], 9).alias("confidence"),
                        o.alias("overlap"),
                        (o >= CONFIRM).alias("confirmed"),
                    ),
                ),
            )

        return let(F.regexp_extract_all(F.lower(p), F.lit(TOKEN), F.lit(0)), with_words)

    every = F.transform("paragraphs", judged)
    notices = F.filter(every, lambda x: (x["family"] != UNKNOWN) & (x["confidence"] >= LEAST))
    return base.select(
        "doc_id",
        F.size("paragraphs").cast("bigint").alias("n_paragraphs"),
        F.when(F.col("anchored"), notices).otherwise(F.array().cast(FOUND)).cast(FOUND).alias("notices"),
    )


def scan_text(text: str | None) -> list[tuple[int, str, float, float, bool]]:
    """The same scan in plain Python: the tests' yardstick."""
    families, weights, bias = trained()
    found = []
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE_CHARS)]
    for i, line in enumerate(lines):
        words = words_of(line)
        hits = sorted(g for g in features(words) if g in weights)
        if not hits:
            continue
        z = list(bias)
        for g in hits:
            z = [a + b for a, b in zip(z, weights[g], strict=True)]
        top = max(z)
        family, sure = families[z.index(top)], 1 / sum(np.exp(x - top) for x in z)
        if family != UNKNOWN and sure >= LEAST:
            own = set(words)
            overlap = max(len(own & (t := set(words_of(x)))) / min(len(t), max(len(own), 3)) for x in TEMPLATES[family])
            found.append((i + 1, family, round(float(sure), 9), overlap, overlap >= CONFIRM))
    return found


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(read(spark, sf_dir, "documents"))
    sure = F.filter("notices", lambda x: x["confirmed"])
    return scanned.select(
        "doc_id",
        "n_paragraphs",
        F.size("notices").cast("bigint").alias("n_notices"),
        F.size(sure).cast("bigint").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform("notices", lambda x: x["paragraph"].cast("string")), ",").alias("paragraphs"),
        F.coalesce(F.array_max(F.transform("notices", lambda x: F.round(x["confidence"], 6))), F.lit(0.0)).alias("confidence"),
    )
