import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftgrain.llm import katz, language_id, licenses, quality
from tests.llm.helpers import DATA, awkward, docs, empty, prose, thue_morse


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w] + ["</s>"]


class Brute:
    """Katz by definition, over lists of tokens."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [None, *(collections.Counter() for _ in range(order))]
        for own in texts:
            w = ["<b>"] * (order - 1) + own
            for i in range(order - 1, len(w)):
                for k in range(1, order + 1):
                    self.counts[k][tuple(w[i - k + 1 : i + 1])] += 1
        self.d = [None, *(katz.discounts([sum(v == r for v in c.values()) for r in range(1, 7)]) for c in self.counts[1:])]
        self.n, self.types = sum(self.counts[1].values()), len(self.counts[1])
        self.left = sum((1 - self.d[1][c]) * c for c in self.counts[1].values() if c <= 5) / self.n
        self.after = [None, *(collections.defaultdict(dict) for _ in range(order))]
        for k in range(2, order + 1):
            for g, c in self.counts[k].items():
                self.after[k][g[:-1]][g[-1]] = c

    def kept(self, k, c):
        return 1.0 if c > 5 else self.d[k][c]

    def p(self, k, h, w):
        if k == 1:
            c = self.counts[1].get((w,), 0)
            return self.kept(1, c) * c / self.n if c else self.left
        words = self.after[k].get(h)
        if not words:
            return self.p(k - 1, h[1:], w)
        total = sum(words.values()) + all(c > 5 for c in words.values())
        if w in words:
            return self.kept(k, words[w]) * words[w] / total
        left = 1 - sum(self.kept(k, c) * c for c in words.values()) / total
        return left / (1 - sum(self.p(k - 1, h[1:], x) for x in words)) * self.p(k - 1, h[1:], w)

    def score(self, own):
        w = ["<b>"] * (self.order - 1) + own
        return sum(math.log10(self.p(self.order, tuple(w[i - self.order + 1 : i]), w[i])) for i in range(self.order - 1, len(w)))


@pytest.mark.parametrize(("order", "hot"), [(2, 1 << 20), (3, 5)])
def test_katz_is_brute_force(spark, order, hot):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()][:60]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", ~katz.held_out("doc_id")).repartition(4)
    got = {r.doc_id: r for r in katz.katz_scores(df, "train", order=order, hot_count=hot).collect()}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    b = Brute([tokens(t) for i, t in rows if i in train], order)
    for i, t in rows:
        own = tokens(t)
        counts = [b.counts[1].get((w,), 0) for w in own]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(c > 0 for c in counts), b.n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c + 1) / (b.n + b.types + 1)) for c in counts))
        assert got[i].score == pytest.approx(b.score(own), rel=1e-9)


def test_katz_tells_long_words_apart(spark):
    a, b = thue_morse(1024)
    df = spark.createDataFrame([(1, a, True), (2, b, False), (3, f"{a} {b}", False)], "doc_id long, text string, train boolean")
    assert {r.doc_id: r.n_known for r in katz.katz_scores(df, "train").collect()} == {1: 2, 2: 1, 3: 2}


def test_katz_splits_contexts_at_default_settings(spark):
    # more occurrences of one context than HOT_COUNT, in a text of several units' size
    n = katz.HOT_COUNT + 1000
    text = "a " * (n // 2) + "b " + "a " * (n - n // 2) + "c"
    df = spark.createDataFrame([(1, text, True), (2, "a c", False), (3, "a z b", False)], "doc_id long, text string, train boolean")
    got = {r.doc_id: r.score for r in katz.katz_scores(df, "train", order=2).collect()}
    b = Brute([tokens(text)], 2)
    assert got[2] == pytest.approx(b.score(tokens("a c")), rel=1e-9) and got[3] == pytest.approx(b.score(tokens("a z b")), rel=1e-9)


def test_katz_query_is_of_order_3(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    b = Brute([tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], 3)
    got = {r.doc_id: r.score for r in katz.query(spark, DATA).collect()}
    short = sorted(rows, key=lambda r: len(r[1] or ""))[:40]
    assert all(got[i] == pytest.approx(b.score(tokens(t)), rel=1e-9) for i, t in short)


def test_katz_distributions_sum_to_one():
    texts = [tokens(t) for t in ("a b a b a c", "a b c d e a b", "f a b a b a b a b a b a b", "c c c c c c c c")]
    b = Brute(texts, 3)
    words = [g[0] for g in b.counts[1]]
    for k in (1, 2, 3):
        for h in [(), ("a",), ("zz",), ("a", "b"), ("b", "a"), ("zz", "a"), ("<b>", "<b>"), ("c", "c")]:
            h = (("q",) * k + h)[-(k - 1) :] if k > 1 else ()
            assert sum(b.p(k, h, w) for w in [*words, "<unseen>"]) == pytest.approx(1)


def test_katz_of_awkward_documents(spark):
    df = docs(spark).withColumn("train", F.col("doc_id") % 2 == 1)
    rows = katz.katz_scores(df, "train").collect()
    assert len(rows) == len(awkward()) and all(np.isfinite(r.score) and r.score <= 0 for r in rows)
    got = {r.doc_id: r for r in rows}
    assert got[4].n_tokens == 1 and got[5].score == got[6].score == got[4].score
    assert katz.katz_scores(df.filter("false"), "train").count() == 0
    nothing = katz.katz_scores(docs(spark).withColumn("train", F.lit(False)), "train").collect()
    assert all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in nothing)


def test_language_of_held_out_documents(spark):
    sf = DATA.replace("0.001", "0.01")
    got = language_id.query(spark, sf)
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(lang, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_kernel_is_the_blended_spectrum():
    def grams(t):
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if " " not in t[i : i + n]}

    texts = ["der hund und die katze", "the dog and the cat", "le chien et le chat", "xyz"]
    model = language_id.fit(texts[:3], ["de", "en", "fr"])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    x = language_id.presences(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), 3)
    want = [[len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b))) for b in texts[:3]] for a in texts]
    got = x[:, model.columns].astype(float) @ model.landmarks / np.sqrt(x.sum(1))[:, None]
    assert np.allclose(got, want, atol=0.02)


def test_language_of_awkward_documents(spark):
    model = language_id.fit_presences(*language_id.sample(docs(spark), "doc_id", "text", "lang"))
    rows = language_id.predict(docs(spark), model).collect()
    got = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == len(awkward()) and got[4] == got[5] == got[6] == got[14] == "und" and got[9] in {"en", "de", "fr"}
    assert language_id.predict(empty(spark), model).count() == 0
    none = language_id.fit([], [])
    assert {r.lang_pred for r in language_id.predict(docs(spark), none).collect()} == {"und"}
    x, labels = language_id.sample(empty(spark), "doc_id", "text", "lang")
    assert x.shape == (0, language_id.SPACE) and labels == []


def test_languages_are_scored_as_kernel_ridge_regression_does(spark):
    """Scores by the definition: the kernel of all pairs, the Nyström map of the landmarks, and the normal equations."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text and r.lang][:80]

    def grams(t):
        own = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode()
        own = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in own)
        return {own[i : i + n] for n in (1, 2, 3) for i in range(len(own) - n + 1) if b" " not in own[i : i + n]}

    fit_on, others = rows[:50], rows[50:]
    model = language_id.fit([t for _, t, _ in fit_on], [lang for *_, lang in fit_on], landmarks=16)
    names = sorted({lang for *_, lang in fit_on})
    marks = sorted(i for name in names for i in [k for k, r in enumerate(fit_on) if r[2] == name][: 16 // len(names)])
    sets = [grams(t) for _, t, _ in rows]
    kernel = np.array([[len(a & sets[m]) / math.sqrt(max(1, len(a)) * max(1, len(sets[m]))) for m in marks] for a in sets])
    value, vector = np.linalg.eigh(kernel[marks])
    x = kernel @ (vector / np.sqrt(value))
    y = np.where(np.array([lang for *_, lang in fit_on])[:, None] == np.array(names), 1.0, -1.0)
    a, b = x[:50] - x[:50].mean(0), y - y.mean(0)
    w = np.linalg.solve(a.T @ a + 1e-3 * 50 * np.eye(len(marks)), a.T @ b)
    z = 4.0 * ((x[50:] - x[:50].mean(0)) @ w + y.mean(0))
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame([(i, t) for i, t, _ in others], "doc_id long, text string"), model).collect()}
    for (i, _, _), own in zip(others, p, strict=True):
        # n-grams share places of the hashed space now and then
        assert got[i].score == pytest.approx(own.max(), abs=0.05) and (got[i].lang_pred == names[own.argmax()] or np.sort(own)[-1] - np.sort(own)[-2] < 0.05)


def test_rows_for_fitting_are_even_and_bounded(spark):
    rows = [(i, f"text number {i}", "de" if i % 10 == 0 else "en") for i in range(900)] + [(5, "text number 5", "en")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    x, labels = language_id.sample(df, "doc_id", "text", "lang", rows=120)
    assert labels.count("de") == labels.count("en") == 60 and len(x) == 120
    assert (x == language_id.sample(df.repartition(3), "doc_id", "text", "lang", rows=120)[0]).all()


def test_quality_features_and_scores_by_definition(spark):
    def features(text):
        raw = (text or "").encode()
        n = max(1, len(raw))
        share = lambda f: sum(f(b) for b in raw) / n
        marks = set(b'!#$%&*+/<=>@[]^_`{|}~"\\')
        out = [share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122), share(lambda b: 48 <= b <= 57), share(lambda b: b in b".?"), share(lambda b: b in b",;:"), share(lambda b: b in marks), share(lambda b: b >= 0xC3), share(lambda b: b == 10)]
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
        lower = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
        lines = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in raw.split(b"\n") if x]
        if not words:
            return [*out, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1]
        m, counts, pairs = len(words), collections.Counter(lower), set(zip(lower, lower[1:]))
        shouted = lambda w: not any(97 <= b <= 122 for b in w) and sum(65 <= b <= 90 for b in w) > 1
        out += [sum(any(b in marks for b in w) for w in words) / m, sum(map(shouted, words)) / m, math.log(1 + m), min(40, sum(map(len, words)) / m)]
        out += [len(counts) / m**0.9, len(pairs) / (m - 1) if m > 1 else 1, max(counts.values()) / m, sum(a == b for a, b in zip(lower, lower[1:])) / (m - 1) if m > 1 else 0]
        return [*out, len(set(lines)) / max(1, len(lines)), 0]

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    x = np.array([features(t) for _, t in rows])
    label = (x[:, 6] + x[:, 13] > np.median(x[:, 6] + x[:, 13])).astype(int)
    model = quality.fit(x, label, 0.4)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.rate(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for (i, _), own in zip(rows, x, strict=True):
        strength = sum(min(6, max(-6, (v - m) / s)) * w for v, m, s, w in zip(own, model.mean, model.scale, model.weights, strict=True))
        score = 1 / (1 + math.exp(-(strength - model.threshold)) * 0.7 / 0.3)
        assert got[i][0] == pytest.approx(score, rel=1e-6) and got[i][1] == int(score >= 0.3), i


def test_pairwise_weights_are_the_optimum():
    r = np.random.default_rng(2)
    label = (r.random(300) > 0.5).astype(int)
    x = r.standard_normal((300, len(quality.FEATURES))) + 0.7 * label[:, None]
    model = quality.fit(x, label, 0.5, pairs=4000)
    z = np.clip((x - x.mean(0)) / x.std(0), -6, 6)
    rng = np.random.default_rng(11)
    d = z[rng.choice(np.flatnonzero(label == 1), 4000)] - z[rng.choice(np.flatnonzero(label == 0), 4000)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 0.5e-3 * w @ w
    best = loss(model.weights)
    for k in range(len(model.weights)):
        step = np.eye(len(model.weights))[k] * 1e-3
        assert loss(model.weights + step) >= best - 1e-12 and loss(model.weights - step) >= best - 1e-12


def test_quality_is_learned_from_all_rows_and_pairs(spark):
    r = random.Random(3)
    rows = [(i, prose(r.randint(3, 12), i) + (" !!" * r.randint(0, 2) if i % 9 else " A" * r.randint(0, 3)), int(i % 9 > 0)) for i in range(5400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    model = quality.learn(df, df.select("doc_id", "quality"))
    raw = [t.encode() for _, t, _ in rows]
    x = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
    label = np.array([q for *_, q in rows])
    assert model.mean == pytest.approx(x.mean(0), rel=1e-9, abs=1e-12) and model.scale == pytest.approx(np.maximum(1e-9, x.std(0)), rel=1e-6)
    # the gradient over all pairs, one by one, is zero
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    s = z @ model.weights
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    lost = 1 / (1 + np.exp(s[good][:, None] - s[bad]))
    gradient = (lost.sum(0) @ z[bad] - lost.sum(1) @ z[good]) / lost.size + 1e-3 * model.weights
    assert np.abs(model.weights).max() > 0.1 and np.abs(gradient).max() < 1e-8
    assert np.sum(s < model.threshold) <= len(bad) <= np.sum(s <= model.threshold + 1e-3)
    assert quality.fit(x, label, len(bad) / len(rows)).weights == pytest.approx(model.weights, abs=1e-6)


def test_quality_of_held_out_documents(spark):
    sf = DATA.replace("0.001", "0.1")
    got = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.97
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None]) > 0.99 and all(0 <= r.score <= 1 for r in got)


def test_threshold_is_a_quantile():
    r = np.random.default_rng(0)
    label = (r.random(2000) > 0.3).astype(int)
    x = r.standard_normal((2000, len(quality.FEATURES))) + label[:, None]
    model = quality.fit(x, label, 0.3)
    assert np.mean(model.strengths(x) < model.threshold) == pytest.approx(0.3, abs=0.02)
    assert ((model.scores(x) >= quality.CUT) == (model.strengths(x) >= model.threshold)).all()


def test_quality_of_awkward_documents(spark):
    labels = spark.createDataFrame([(1, 1), (13, 1), (12, 0), (None, 0), (14, None), (5, 0)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    model = quality.learn(docs(spark), labels)
    rows = quality.rate(docs(spark), model).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows) and got[4].score == got[5].score
    assert quality.rate(empty(spark), model).count() == 0
    assert quality.rate(docs(spark), quality.learn(docs(spark), labels.filter("false"))).count() == len(rows)


TEXT = "Some prose here.\nReleased under the MIT License.\nAll rights reserved.\nthe license plate was lost on the way"


@pytest.fixture(scope="module")
def model():
    return licenses.train()


def test_licence_templates_and_others(model):
    for family, own in licenses.TEMPLATES.items():
        for t in own:
            p = model.probabilities(t)
            assert model.families[int(np.argmax(p))] == family, t
    wrong = sum(model.families[int(np.argmax(model.probabilities(t)))] != licenses.UNKNOWN for t in licenses.OTHERS)
    assert wrong == 0
    assert model.families[int(np.argmax(model.probabilities("nothing of the kind")))] == licenses.UNKNOWN


def test_licences_as_the_model_says(spark, model):
    df = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    rows = licenses.scan_paragraphs(df, model).collect()
    assert rows
    for r in rows:
        p = model.probabilities(r.text)
        assert r.family == model.families[int(np.argmax(p))] and r.probability == pytest.approx(max(p))


def test_licences_of_awkward_documents(spark, model):
    df = docs(spark, [*awkward(), (20, TEXT, "en"), (20, TEXT, "en"), (21, TEXT + "\n" + TEXT, None), (None, TEXT, None)])
    rows = licenses.scan(df, model).collect()
    assert len(rows) == len(awkward()) + 4
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [x.family for x in got[20].licences] == ["mit", "proprietary"] and got[20].n_paragraphs == 4 and len(got[21].licences) == 4
    assert got[4].n_paragraphs == 0 and got[5].n_paragraphs == 1 and got[9].licences == []
    assert licenses.scan(empty(spark), model).count() == 0
    plan = licenses.scan(df, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction.",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met: no others",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\r\npurpose with or without fee is hereby granted, provided that the above\r\ncopyright notice appears.",
}
BOTH = "Released under the MIT License, and some parts are licensed under the Apache License, Version 2.0."


def test_licences_over_lines_and_beside_each_other(spark, model):
    from textwrap import fill

    rows = [(k, text, "en") for k, text in enumerate(WRAPPED.values())]
    rows += [(10 + k, "words of a story\n" * 300 + "\n" + fill(text, 20) + "\n\nthe end", "en") for k, text in enumerate(WRAPPED.values())]
    rows += [(20, BOTH, "en"), (21, fill(BOTH, 30), "en"), (22, WRAPPED["mit"] + "\n\n" + WRAPPED["bsd"], "en"), (23, WRAPPED["mit"].replace("\n", "\n\n"), "en"), (None, WRAPPED["isc"], "en")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows), model).collect()}
    for k, family in enumerate(WRAPPED):
        assert got[k].families == [family] and len(got[k].licences) == 1 and got[k].licences[0].paragraph == 0, family
        assert got[10 + k].families == [family] and got[10 + k].licences[0].paragraph == 301 and got[10 + k].n_doubtful == 0
    assert got[20].families == got[21].families == ["apache", "mit"]
    assert [x.family for x in got[22].licences] == ["mit", "bsd"] and got[23].families == [] and got[None].families == ["isc"]


def test_each_template_is_found_however_it_is_wrapped(spark, model):
    from textwrap import fill

    every = [(family, t) for family, own in sorted(licenses.TEMPLATES.items()) for t in own]
    rows = [(100 * width + k, fill(t, width, break_long_words=False), "en") for width in (1, 20, 72) for k, (_, t) in enumerate(every)]
    for r in licenses.scan(docs(spark, rows), model).collect():
        assert r.families == [every[r.doc_id % 100][0]], (r, every[r.doc_id % 100])


def test_paragraphs_kept_from_training(spark, model):
    rows = [(k, t, "en") for k, (_, t) in enumerate(licenses.HELD_OUT)]
    got = {r.doc_id: r.families for r in licenses.scan(docs(spark, rows), model).collect()}
    assert got == {k: [f] if f != licenses.UNKNOWN else [] for k, (f, _) in enumerate(licenses.HELD_OUT)}
    assert 0.5 < model.temperature < 3


# Notices as they stand at the head of files, and the whole text of two short licences.
HEADERS = {
    "apache": """/*
 * Copyright 2020 The Example Authors
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */""",
    "gpl": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# You should have received a copy of the GNU General Public License
# along with this program.""",
    "mpl": """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at a web page.""",
    "mit": """Copyright (c) 2018 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "bsd": """Copyright (c) 2015, Example
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.""",
}


def test_whole_notices_name_their_family_alone(spark, model):
    rows = [(k, text, "en") for k, text in enumerate(HEADERS.values())] + [(10 + k, prose(200, k).replace(" ", "\n") + "\n\n" + text + "\n\n" + prose(50, -k), "en") for k, text in enumerate(HEADERS.values())]
    got = {r.doc_id: r.families for r in licenses.scan(docs(spark, rows), model).collect()}
    for k, family in enumerate(HEADERS):
        assert got[k] == got[10 + k] == [family], (family, got[k], got[10 + k])
