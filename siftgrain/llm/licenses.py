"""Operator 5: a trained paragraph classifier for licence families, with DataFrame functions only.

A paragraph is a line. Its features are the n-grams of up to three words that
hold a key word of the templates; a line with less than two of these words is
no licence, whatever else it says. A licence that is wrapped over several lines,
or stands beside another one, is found as a passage: a run of words, over lines
with words in them, that holds a template in large part and little else; it is
classified as a paragraph is. A multinomial logistic regression over the
licence families and `unknown` gives each family's probability; a temperature,
fitted on paragraphs kept from training, calibrates it. A predicted family counts
as confirmed when one of the family's templates is in the paragraph in large
part.

Training uses the fixed paragraphs below and changed copies of them, a bounded
set on the driver. On the corpus everything is an expression or a join with
the weights, whose size is that of the templates.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.llm.store import write_table

UNKNOWN = "unknown"

# Phrases by which public licences are known, by family.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license version 3", "gnu affero general public license as published by the free software foundation", "spdx license identifier agpl 3.0 or later"],
    "apache": [
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "see the license for the specific language governing permissions and limitations under the license",
        "spdx license identifier apache 2.0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "licensed under the bsd 3 clause license",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "spdx license identifier bsd 3 clause",
    ],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related rights to this work", "released under cc0 1.0 universal public domain dedication", "spdx license identifier cc0 1.0"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
        "spdx license identifier gpl 3.0 or later",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "lgpl": ["licensed under the gnu lesser general public license version 3", "gnu lesser general public license as published by the free software foundation", "spdx license identifier lgpl 3.0 or later"],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "spdx license identifier mit",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license version 2.0", "licensed under the mozilla public license version 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"],
    "proprietary": ["all rights reserved", "copyright all rights reserved", "no part of this publication may be reproduced without the prior written permission of the publisher"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"],
}
# Sentences with such words that are no licence.
OTHERS = [
    "the officer asked for his driving license and the papers of the car",
    "she has the right to work here and the permission of her mother",
    "all the seats were reserved for the guests of the public hearing",
    "the first version of the software was released in the spring",
    "a copy of the book is in the general library under the stairs",
    "the foundation gave free books to every person in the village",
    "the apache people lived in the south and the gnu is an animal of the plains",
    "he studied at mit and published a work on the terms of trade",
    "the rights of the workers were the source of the dispute",
    "the file was distributed to the members with a notice of the meeting",
    "no license is required for this purpose and no fee",
    "the law was written without the public and without the commons",
    "the permission to build was granted by the town free of charge",
    "the author of the source was any person who had a copy of the notice",
    "the warranty of the car is void without a copy of the documents",
    "all conditions of the contract must be met and all fees paid in form of cash",
]
# Paragraphs kept from training, on which the model is calibrated and measured.
HELD_OUT = [
    ("apache", "Licensed to the foundation under one or more contributor agreements; this file is licensed to you under the Apache License, Version 2.0 (the License)"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License in the project's root"),
    ("bsd", "Use of this source code is governed by a BSD-style license: redistribution and use in source and binary forms, with or without modification, are permitted provided that these conditions are met"),
    ("bsd", "Neither the name of Example Corp. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by", "Text and pictures on this page: this work is licensed under a Creative Commons Attribution 4.0 International License, unless said otherwise"),
    ("cc-by-sa", "The articles of this site are licensed under CC BY-SA 4.0 by their authors"),
    ("cc-by-nc", "Slides of the course, licensed under CC BY-NC 4.0, for teaching"),
    ("cc0", "The data set is released under CC0 1.0 Universal (Public Domain Dedication) by the library"),
    ("gpl", "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 or later"),
    ("gpl", "You should have received a copy of the GNU General Public License along with Foo. If not, see the web page of the project"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3, or any later version"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later one"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "This plugin was released under the MIT License by its author in 2019"),
    ("mit", "// SPDX-License-Identifier: MIT"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0, version 2.0 of which is enclosed"),
    ("proprietary", "Copyright 2021 Example Corp. All rights reserved."),
    ("unlicense", "This is free and unencumbered software released into the public domain by its writer"),
    ("unknown", "She had a license to drive, and a copy of it in her bag with the other papers"),
    ("unknown", "The general public was not permitted to use the source of the river"),
    ("unknown", "He is a professor at MIT and has the copyright of two books on free trade"),
    ("unknown", "The foundation released a version of its terms for any person who asked"),
    ("unknown", "The apache helicopter was subject to a notice of the authorities"),
    ("unknown", "Use the form above to apply for the permission of the owner, without fee"),
    ("unknown", "The rights of the author were reserved by the court until all copies came back"),
    ("unknown", "The software was provided by the school, and the files were distributed in binary form"),
    ("unknown", "A public domain is a set of values; the work on it is a purpose of this paper"),
    ("unknown", "The following conditions were met on the coast: rain, wind and ice"),
    ("unknown", "No warranty was given with the car and the seller disclaims it in the contract"),
]
#: Different key words that a licence paragraph has, at least.
LEAST_KEYS = 2
# Words too common to mark a licence.
COMMON = frozenset("a an and any are as at be by for from has he her here his in is it its may nor not of on or that the their this to was were will with you your all no she one up out if so do".split())

_SPLIT = r"[^a-z0-9.]+|\.(?![0-9])"
#: As _SPLIT, with line ends as words.
_TOKENS = r"[^a-z0-9.\n]+|\.(?![0-9])|(?<=\n)|(?=\n)"


def tokens(text: str) -> list[str]:
    """Words of a paragraph: lower-cased runs of a-z, digits and points before digits. `words` is the same as an expression."""
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def key_words() -> list[str]:
    return sorted({w for own in TEMPLATES.values() for t in own for w in tokens(t)} - COMMON)


def n_grams(w: list[str], keys: frozenset[str]) -> set[str]:
    """Distinct n-grams of 1 to 3 words with a key word."""
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1) if not keys.isdisjoint(w[i : i + n])}


@dataclass
class LicenseModel:
    families: list[str]  #: the last is unknown
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float

    def probabilities(self, text: str) -> list[float]:
        """As the expressions give them, for one paragraph."""
        keys = frozenset(key_words())
        own = n_grams(tokens(text), keys)
        scale = 1 / math.sqrt(max(1, len(own)))
        z = [b + scale * sum(self.weights[g][k] for g in sorted(own) if g in self.weights) for k, b in enumerate(self.bias)]
        z = [x / self.temperature for x in z]
        top = max(z)
        e = [math.exp(x - top) for x in z]
        return [x / sum(e) for x in e]


def _paragraphs(seed: int, copies: int) -> list[tuple[str, int]]:
    """Templates, changed copies of them, and other paragraphs, with the class of each."""
    rng = random.Random(seed)
    families = [*sorted(TEMPLATES), UNKNOWN]
    filler = sorted({w for t in OTHERS for w in tokens(t)} | COMMON)
    keys = key_words()
    out = []
    for k, family in enumerate(families[:-1]):
        for t in TEMPLATES[family]:
            out.append((t, k))
            for _ in range(copies):
                w = [x for x in tokens(t) if rng.random() > 0.12] or tokens(t)
                w = [rng.choice(filler) for _ in range(rng.randint(0, 6))] + w + [rng.choice(filler) for _ in range(rng.randint(0, 10))]
                out.append((" ".join(w), k))
    for t in OTHERS:
        for _ in range(2 * copies):
            w = tokens(t)
            rng.shuffle(w)
            out.append((" ".join(w[: rng.randint(1, len(w))]), len(families) - 1))
        out.append((t, len(families) - 1))
    for _ in range(30 * copies):  # key words out of their order, one by one
        w = rng.sample(filler, rng.randint(0, 8)) + rng.sample(keys, rng.randint(1, 3))
        rng.shuffle(w)
        out.append((" ".join(w), len(families) - 1))
    out += [(" ".join(rng.sample(filler, 6)), len(families) - 1) for _ in range(4 * copies)]
    return out


def train(copies: int = 8, rounds: int = 300) -> LicenseModel:
    """Fit on the fixed paragraphs (on the driver; their number doesn't depend on the data). The temperature is the one that HELD_OUT is likeliest at."""
    families, keys = [*sorted(TEMPLATES), UNKNOWN], frozenset(key_words())
    rows, kept = _paragraphs(3, copies), [(t, families.index(f)) for f, t in HELD_OUT]
    names = sorted({g for t, _ in rows for g in n_grams(tokens(t), keys)} & {g for own in TEMPLATES.values() for t in own for g in n_grams(tokens(t), keys)})
    place = {g: i for i, g in enumerate(names)}

    def matrix(own: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(own), len(names) + 1))
        for i, (t, _) in enumerate(own):
            grams = n_grams(tokens(t), keys)
            for g in grams:
                if g in place:
                    x[i, place[g]] = 1 / math.sqrt(len(grams))
        x[:, -1] = 1
        return x, np.eye(len(families))[[k for _, k in own]]

    x, y = matrix(rows)
    w, step = np.zeros((x.shape[1], len(families))), np.zeros((x.shape[1], len(families)))
    for _ in range(rounds):  # gradient descent with momentum on the logistic loss
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        step = 0.9 * step - 1.0 * (x.T @ (p - y) / len(x) * 4 + 2e-5 * w)
        w = w + step
    xv, yv = matrix(kept)
    yv = yv + (1 / len(families) - yv) / (len(kept) + 2)  # not certain of the labels, else rows that are all right would make it certain of all

    def loss(t: float) -> float:
        z = xv @ w / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - (z * yv).sum(1)).mean())

    temperature = min((0.05 * 1.15**k for k in range(40)), key=loss)
    return LicenseModel(families, {g: [round(float(v), 6) for v in w[i]] for g, i in place.items()}, [round(float(v), 6) for v in w[-1]], temperature)


def _values(spark: SparkSession, rows: list[str], columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({columns})")


def scan_paragraphs(df: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text", confirm: float = 0.75) -> DataFrame:
    """(key, paragraph, text, family, probability, similarity, confirmed) of every paragraph with LEAST_KEYS key words.

    key is struct<id, digest> of the row; rows of equal id and text are one. The
    paragraph is its place among the row's lines, from 0. similarity is the
    largest share of a template of the family whose distinct words are in the
    paragraph. confirmed: the family isn't unknown and the similarity is `confirm` or more.
    """
    spark = df.sparkSession
    keys = key_words()
    lines = df.filter(F.col(text_col).isNotNull()).select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest")).alias("key"), F.posexplode(F.split(text_col, "\n")).alias("paragraph", "line"))
    w = F.split(F.lower("line"), _SPLIT)
    likely = F.size(F.array_intersect(w, F.array(*map(F.lit, keys)))) >= LEAST_KEYS
    own = lines.filter(likely).distinct().withColumn("w", words(F.col("line")))
    return _classified(own, model, keys, confirm)


def _classified(own: DataFrame, model: LicenseModel, keys: list[str], confirm: float) -> DataFrame:
    """family, probability, similarity and confirmed of each row of own (key, paragraph, line, w and perhaps others); line is renamed text."""
    spark, by = own.sparkSession, [c for c in own.columns if c not in ("line", "w")]
    at_key = F.filter(F.transform("w", lambda x, i: F.when(x.isin(keys), i + 1)), lambda i: i.isNotNull())
    own = own.withColumn("at", at_key)
    held = [c for c in own.columns if c != "at"]

    def gram(at: Column, ahead: int, n: int) -> Column:
        """The n words from `ahead` words ahead of a key word; null where there are not so many."""
        begin = at - ahead
        return F.when((begin >= 1) & (begin + n - 1 <= F.size("w")), F.array_join(F.slice("w", F.greatest(begin, F.lit(1)), n), " "))

    around = F.transform("at", lambda i: F.array(*[gram(i, ahead, n) for n in (1, 2, 3) for ahead in range(n)]))
    own = own.select(*held, F.array_distinct(F.array_compact(F.flatten(around))).alias("grams"))
    own, _ = write_table(own, "licence-lines")  # few lines are left; both sides of the join below read them
    f = len(model.families)
    weights = _values(spark, [f"('{g}', array({', '.join(f'{v}D' for v in v_)}))" for g, v_ in sorted(model.weights.items())], "gram, weight")
    features = own.select(*by, F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram")
    sums = features.groupBy(*by).agg(*[F.sum(F.col("weight")[k]).alias(f"z{k}") for k in range(f)])
    scored = own.join(sums, by, "left")
    scale = F.sqrt(F.size("grams").cast("double"))
    z = F.array(*[(F.lit(b) + F.coalesce(F.col(f"z{k}"), F.lit(0.0)) / scale) / model.temperature for k, b in enumerate(model.bias)])
    scored = scored.withColumn("z", z).withColumn("top", F.array_max("z"))
    e = F.aggregate(F.transform("z", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda s, x: s + x)
    best = F.array_position("z", F.col("top")).cast("int")
    scored = scored.select(*held, F.element_at(F.array(*map(F.lit, model.families)), best).alias("family"), (1 / e).alias("probability"))
    rows = [f"('{k}', array({', '.join(repr(w) for w in sorted(set(tokens(t))))}))" for k, own_ in sorted(TEMPLATES.items()) for t in own_]
    templates = _values(spark, rows, "family, template").groupBy("family").agg(F.collect_list("template").alias("templates"))
    met = scored.join(F.broadcast(templates), "family", "left")
    share = F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("w"))) / F.size(t))
    similarity = F.coalesce(F.array_max(share), F.lit(0.0))
    return met.select(*[F.col(c).alias("text") if c == "line" else c for c in held if c != "w"], "family", "probability", similarity.alias("similarity"), ((F.col("family") != UNKNOWN) & (similarity >= confirm)).alias("confirmed"))


def _without_overlaps(spans: Column) -> Column:
    """Of an array of structs with place, begin and end, best first, those that no better one of the same place overlaps."""

    def free(held: Column, x: Column) -> Column:
        return F.when(F.exists(held, lambda y: (y["place"] == x["place"]) & (y["begin"] <= x["end"]) & (x["begin"] <= y["end"])), held).otherwise(F.concat(held, F.array(x)))

    return F.aggregate(spans, F.filter(spans, lambda x: F.lit(False)), free)


def scan_passages(df: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text", confirm: float = 0.75) -> DataFrame:
    """(key, paragraph, last, place, begin, end, text, family, probability, similarity) of the passages that a template confirms.

    paragraph and last are the places of the lines where the passage begins and
    ends; place, begin and end its place among the words. A passage has at most
    1 / confirm times a template's words, and no line without words in it.
    """
    keys = key_words()
    longest = math.ceil(max(len(tokens(t)) for own in TEMPLATES.values() for t in own) / confirm)
    rows = [F.struct(F.array(*map(F.lit, sorted(set(tokens(t))))).alias("d"), F.lit(math.ceil(len(tokens(t)) / confirm)).alias("most")) for _, own_ in sorted(TEMPLATES.items()) for t in own_]
    templates, known = F.array(*rows), sorted({w for own_ in TEMPLATES.values() for t in own_ for w in tokens(t)})

    def held(t: Column, w: Column) -> Column:
        return F.size(F.array_intersect(t["d"], w)) >= confirm * F.size(t["d"])

    # few documents have the words of a template at all; an array of one binds them, so that the text is split once
    some = F.array(F.array_intersect(F.split(F.lower(text_col), _SPLIT), F.array(*map(F.lit, known))))
    likely = F.exists(some, lambda w: (F.size(F.array_intersect(w, F.array(*map(F.lit, keys)))) >= LEAST_KEYS) & F.exists(templates, lambda t: held(t, w)))
    own = df.filter(F.col(text_col).isNotNull() & likely).select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest")).alias("key"), F.filter(F.split(F.lower(text_col), _TOKENS), lambda x: x != "").alias("t"))
    own = own.withColumn("at", F.filter(F.transform("t", lambda x, i: F.when(x.isin(keys), i + 1)), lambda i: i.isNotNull()))
    own, _ = write_table(own, "licence-documents")  # else the filters below would split the texts again, for each element
    # regions of words around key words; between two regions lie more words than a passage has
    far = 4 * longest  # t has line ends as well

    def ends(step: int) -> Column:
        beside = F.transform("at", lambda i, k: F.when(F.abs(F.coalesce(F.try_element_at("at", F.when(k + step >= 0, k + 1 + step)), F.lit(-far)) - i) >= far, i))
        return F.filter(beside, lambda i: i.isNotNull())

    own = own.filter(F.size("at") >= LEAST_KEYS).select("key", "t", F.arrays_zip(ends(-1).alias("a"), ends(1).alias("b")).alias("regions"))
    begin = lambda r: F.greatest(r["a"] - far // 2 + 1, F.lit(1))
    regions = F.transform("regions", lambda r: F.struct(begin(r).alias("place"), F.slice("t", begin(r), r["b"] + far // 2 - begin(r)).alias("t")))
    likely = F.filter(regions, lambda r: F.size(F.array_distinct(F.filter(r["t"], lambda x: x.isin(keys)))) >= LEAST_KEYS)
    lines_before = F.transform("regions", lambda r: F.struct(r["place"], r["t"], F.size(F.filter(F.slice("t", 1, r["place"] - 1), lambda x: x == "\n")).alias("before")))
    own = own.select("key", "t", likely.alias("regions")).filter(F.size("regions") > 0).select("key", F.explode(lines_before).alias("r")).select("key", "r.*").distinct()
    # words with their lines; a line without words stands as one empty word
    parts = F.split(F.array_join("t", " "), "\n")
    of_line = F.transform(parts, lambda x, k: F.transform(F.coalesce(F.nullif(F.filter(F.split(x, " "), lambda w: w != ""), F.array().cast("array<string>")), F.array(F.lit(""))), lambda w: F.struct(w.alias("w"), (k + F.col("before")).alias("line"))))
    own = own.select("key", "place", F.flatten(of_line).alias("x")).select("key", "place", F.col("x.w").alias("words"), F.col("x.line").alias("lines"))
    own, _ = write_table(own, "licence-regions")
    met = F.filter(templates, lambda t: held(t, F.col("words")))
    own = own.select("key", "place", "words", "lines", F.explode(met).alias("template")).select("key", "place", "words", "lines", "template.*")
    begins = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("d", w), i + 1)), lambda i: i.isNotNull())
    own = own.withColumn("runs", F.transform(begins, lambda i: F.struct(i.alias("begin"), F.element_at(F.split(F.array_join(F.slice("words", i, F.col("most")), " "), "  | $"), 1).alias("run"))))
    own = own.withColumn("runs", F.transform("runs", lambda r: F.struct(r["begin"], F.split(r["run"], " ").alias("run"))))
    own = own.withColumn("runs", F.transform("runs", lambda r: F.struct(r["begin"], F.transform(F.array_intersect("d", r["run"]), lambda w: F.array_position(r["run"], w)).alias("found"))))
    spans = F.transform(F.filter("runs", lambda r: F.size(r["found"]) >= confirm * F.size("d")), lambda r: F.struct((-F.size(r["found"])).alias("order"), F.array_max(r["found"]).alias("n"), r["begin"].alias("begin"), (r["begin"] + F.array_max(r["found"]) - 1).alias("end"), F.col("place").alias("place")))
    own = own.withColumn("s", F.array_sort(spans)).withColumn("s", F.explode(_without_overlaps(F.col("s"))))
    w = F.slice("words", F.col("s.begin"), F.col("s.n").cast("int"))
    own = own.select("key", F.element_at("lines", F.col("s.begin").cast("int")).alias("paragraph"), F.element_at("lines", F.col("s.end").cast("int")).alias("last"), "place", "s.begin", "s.end", F.array_join(w, " ").alias("line"), w.alias("w"))
    return _classified(own.distinct(), model, keys, confirm).filter("confirmed").drop("confirmed")


def scan(df: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of df: id, n_paragraphs, licences array<struct<paragraph, family, probability, similarity>> (confirmed ones, in order), families array<string>, n_doubtful.

    Passages are licences of the line that they begin in, unless a line that they
    touch is one of the same family, or a passage that holds more of its template
    overlaps them. n_doubtful counts paragraphs that were given a family that no
    template confirmed, neither in them nor in a passage that touches them. A null text has no paragraphs, an empty one has one. Rows with a
    null id, and repeated rows, are rows of their own; other columns are not
    looked at; an empty table gives an empty result.
    """
    found = scan_paragraphs(df, model, id_col, text_col).filter(F.col("family") != UNKNOWN)
    part = F.struct("paragraph", "family", "probability", "similarity")
    found = found.groupBy("key").agg(F.collect_list(F.when(F.col("confirmed"), part)).alias("whole"), F.collect_list(F.when(~F.col("confirmed"), F.col("paragraph"))).alias("doubtful"))
    best = F.struct((-F.col("similarity")).alias("s"), (-F.col("probability")).alias("p"), "place", "begin", "end", "last", part.alias("part"))
    passages = scan_passages(df, model, id_col, text_col).groupBy("key").agg(F.sort_array(F.collect_list(best)).alias("passages"))
    passages = passages.withColumn("passages", _without_overlaps(F.col("passages")))
    held = found.join(passages, "key", "full").withColumns({"whole": F.coalesce("whole", F.transform(F.filter("passages", lambda x: F.lit(False)), lambda x: x["part"])), "doubtful": F.coalesce("doubtful", F.array().cast("array<int>"))})

    def within(x: Column, line: Column) -> Column:
        return (x["part"]["paragraph"] <= line) & (line <= x["last"])

    added = F.filter("passages", lambda x: ~F.exists("whole", lambda y: (y["family"] == x["part"]["family"]) & within(x, y["paragraph"])))
    licences = F.sort_array(F.concat("whole", F.coalesce(F.transform(added, lambda x: x["part"]), F.filter("whole", lambda x: F.lit(False)))))
    doubtful = F.filter("doubtful", lambda line: ~F.coalesce(F.exists("passages", lambda x: within(x, line)), F.lit(False)))
    held = held.select(F.col("key.id").alias("held_id"), F.col("key.digest").alias("held_digest"), licences.alias("licences"), F.coalesce(F.size(doubtful), F.lit(0)).cast("long").alias("n_doubtful"))
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).alias("n"), F.col(text_col).isNull().alias("none"))
    out = rows.join(held, F.col("id").eqNullSafe(F.col("held_id")) & (F.col("digest") == F.col("held_digest")), "left")
    empty = F.filter(F.array(F.struct(F.lit(0).alias("paragraph"), F.lit("").alias("family"), F.lit(0.0).alias("probability"), F.lit(0.0).alias("similarity"))), lambda x: F.lit(False))
    licences = F.coalesce("licences", empty)
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("none"), 0).otherwise(F.col("n")).cast("long").alias("n_paragraphs"),
        licences.alias("licences"),
        F.sort_array(F.array_distinct(F.transform(licences, lambda x: x["family"]))).alias("families"),
        F.coalesce("n_doubtful", F.lit(0).cast("long")).alias("n_doubtful"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: licence families of all documents."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), train())
    best = F.coalesce(F.array_max(F.transform("licences", lambda x: x["probability"])), F.lit(0.0))
    return out.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), F.array_join("families", ",").alias("families"), F.round(best, 6).alias("probability"), "n_doubtful")
