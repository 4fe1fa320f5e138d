"""License scans: a trained paragraph classifier, with template comparison.

Paragraphs (lines) are described by their distinct words and word pairs.  A multinomial logistic regression with an L1
penalty, fitted with Spark's own ML library, keeps a few hundred of these n-grams; the classes are licence families and
"none".  It learns from the notices in TEMPLATES, with words left out and running text around them, and from at most about
NEGATIVES paragraphs of the corpus (picked by hash; those that resemble a notice are left out) and NEAR_MISSES.
Half of each serves calibration: the threshold is the probability that 99.5 % of the other half's negatives stay below (at
least 0.5); a paragraph whose best family reaches less is "unknown" if "none" is not the most likely class either way.
A prediction is confirmed if the paragraph holds at least CONFIRM of the word pairs of one of the family's notices.
Notices that run over line breaks (hard-wrapped text) are judged likewise in windows of words, see wrapped().

Scoring is one pass without a shuffle, built-in functions only.  The weights follow from the templates and the bounded
sample, so their size is bounded.  The weights give a set of words without
which no paragraph can be anything but "none"; paragraphs and documents without these words are settled by substring tests.

Defined cases: null and empty texts have no paragraphs.  Repeated rows each give a row.  Upper and lower case, punctuation
and white space do not count.  An empty table gives an empty result.
"""

import json
import math
import random

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices of public licences, by family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GPL version 3 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "public-domain": [
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": ["All rights reserved.", "Copyright (c) the authors. All rights reserved."],
}
#: Sentences with the words of notices that grant nothing.
NEAR_MISSES = [
    "He lost his driving license and had to walk home.",
    "The license plate of the car was dirty.",
    "All seats are reserved for members of the public.",
    "The general was licensed to sell the work of the public school.",
    "Version 3 of the report was released under pressure.",
    "They reserved all the rooms; the rights of the guests came first.",
    "The software was released in May and the source of the river was found.",
    "A copy of the letter was given to the person free of charge.",
    "The terms were created in common by the two companies.",
    "The apache helicopter flew over the domain of the king.",
    "Students of the institute read the version of the text.",
    "The permission slip must be signed by the parents.",
]
NEGATIVES, VARIANTS, CONFIRM = 3000, 24, 0.6
NONE, UNKNOWN = "none", "unknown"


def tokens(low: Column) -> Column:
    """The words of a text in lower case."""
    return F.regexp_extract_all(low, F.lit("[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def words(text: Column) -> Column:
    return tokens(F.lower(text))


def pairs(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def grams(text: Column) -> Column:
    """Distinct words and word pairs."""
    return grams_of(words(text))


def grams_of(w: Column) -> Column:
    return F.element_at(F.transform(F.array(w), lambda w: F.array_distinct(F.concat(w, pairs(w)))), 1)  # w is evaluated once


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "[\r\n]+"), lambda p: F.length(F.trim(p)) > 0)


def literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver's values."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def template_pairs(spark: SparkSession) -> dict[str, list[list[str]]]:
    """The distinct word pairs of every notice, cut as the corpus is."""
    rows = literal(spark, [{"f": f, "t": t} for f, ts in TEMPLATES.items() for t in ts], "f:string,t:string")
    out: dict[str, list[list[str]]] = {f: [] for f in TEMPLATES}
    for f, p in rows.select("f", F.array_distinct(pairs(words(F.col("t"))))).collect():  # one row per notice
        out[f].append(sorted(p))
    return out


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def covers(gram: Column, notices: Column) -> Column:
    return F.exists(notices, lambda t: F.size(F.array_intersect(t, gram)) >= F.size(t) * CONFIRM)


def may_wrap(rows: DataFrame, model: "Model", judged: Column) -> DataFrame:
    """rows(text, in lower case) with may: a cheap test that every text passes in which wrapped() finds a family.

    A notice is confirmed by CONFIRM of its word pairs, so one at least of any larger part of the rest must be there.
    """
    plain = lambda p: " " + "".join(c if c.isalnum() else " " for c in p) + " "
    rows = rows.withColumn("flat", F.concat(F.lit(" "), F.regexp_replace("text", "[^a-z0-9]+", " "), F.lit(" ")))
    usual = lambda p: (-len(p), p)
    tests = []
    for family, ts in model.notices.items():
        some = sorted({p for t in ts for p in sorted(t, key=usual)[: len(t) - math.ceil(len(t) * CONFIRM) + 1]})
        tests.append(~F.array_contains(judged, F.lit(family)) & _any([F.contains("flat", F.lit(plain(p))) for p in some]))
    return rows.withColumn("may", _any(tests)).drop("flat")


def wrapped(low: Column, model: "Model", judged: Column) -> Column:
    """Families, besides those judged, of notices that run over line breaks; the text is in lower case.

    A window starts at a word pair of the notice and has as many words as the notice, or as many as a notice may be spread
    over; it counts if it is confirmed as a paragraph is, and no single line in it holds enough of the notice.
    """
    one = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  # value is evaluated once
    every = strings(sorted({p for ts in model.notices.values() for t in ts for p in t}))
    kinds = F.array(*(F.struct(F.lit(i + 1).alias("k"), F.lit(c).alias("family"), strings(t).alias("t")) for i, c in enumerate(model.classes) for t in model.notices.get(c, [])))
    enough = lambda x, t: F.size(F.array_intersect(t, x)) >= F.size(t) * CONFIRM

    def inside(ws: Column) -> Column:  # ws: (line, word)
        n = F.greatest(F.size(ws) - 1, F.lit(0))
        ps = F.zip_with(F.slice(ws, F.lit(1), n), F.slice(ws, F.lit(2), n), lambda a, b: F.struct(F.concat(a["w"], F.lit(" "), b["w"]).alias("p"), a["l"].alias("a"), b["l"].alias("b")))
        return one(ps, lambda ps: one(F.array_intersect(F.transform(ps, lambda x: x["p"]), every), lambda seen: F.flatten(F.transform(
            F.filter(kinds, lambda c: enough(seen, c["t"]) & ~F.array_contains(judged, c["family"])), lambda c: starts(ws, ps, c)))))

    def starts(ws: Column, ps: Column, c: Column) -> Column:
        at = F.filter(F.transform(ps, lambda x, i: F.when(F.array_contains(c["t"], x["p"]), i + 1)), lambda i: i.isNotNull())
        sizes = F.array(F.size(c["t"]), F.ceil(F.size(c["t"]) / CONFIRM).cast("int"))
        found = lambda i, n: one(F.slice(ps, i, n), lambda q: F.when(across(q, c), sure(F.transform(F.slice(ws, i, n + 1), lambda x: x["w"]), c)))
        return F.transform(F.filter(F.flatten(F.transform(at, lambda i: F.transform(sizes, lambda n: F.coalesce(found(i, n), F.lit(False))))), lambda x: x), lambda x: c["family"])

    def across(q: Column, c: Column) -> Column:
        line = lambda l: F.transform(F.filter(q, lambda x: (x["a"] == l) & (x["b"] == l)), lambda x: x["p"])  # noqa: E731, E741
        return enough(F.transform(q, lambda x: x["p"]), c["t"]) & ~F.exists(F.array_distinct(F.transform(q, lambda x: x["a"])), lambda l: enough(line(l), c["t"]))  # noqa: E741

    def sure(w: Column, c: Column) -> Column:
        return one(model.scored(F.array_distinct(F.concat(w, pairs(w)))), lambda s: (s["k"] == c["k"]) & (s["p"] >= model.threshold))

    lines = F.flatten(F.transform(paragraphs(low), lambda p, i: F.transform(tokens(p), lambda w: F.struct(i.alias("l"), w.alias("w")))))
    return F.array_distinct(one(lines, inside))


class Model:
    """Weights of the n-grams that count, one number per class; the threshold for families."""

    def __init__(self, classes, intercepts, weights, threshold, notices, usual):
        self.classes, self.intercepts, self.weights, self.threshold, self.notices = classes, intercepts, weights, threshold, notices
        self.usual = usual  # word -> how often it stands in running text; only speed depends on it

    def anchors(self) -> list[str]:
        """Words one of which stands in every paragraph that can be given a family.

        N-grams are set aside, those of usual words first, as long as all of them together could not lift any family
        above "none"; of each n-gram that is left, the rarest word is an anchor.
        """
        none = self.classes.index(NONE)
        rank = lambda w: (self.usual.get(w, 0), -len(w), w)
        rarest = lambda g: min(g.split(" "), key=rank)
        room = [self.intercepts[none] - b for b in self.intercepts]
        found = set()
        for g, w in sorted(self.weights.items(), key=lambda x: (rank(rarest(x[0])), x[0]), reverse=True):
            gain = [max(0.0, x - w[none]) for x in w]
            if all(r > x for c, (r, x) in enumerate(zip(room, gain, strict=True)) if c != none):
                room = [r - x for r, x in zip(room, gain, strict=True)]
            else:
                found.add(rarest(g))
        return sorted(a for a in found if not any(b != a and b in a for b in found))

    def scored(self, gram: Column) -> Column:
        """struct<p, k>: probability and number of the most likely class."""
        table = F.create_map(*(x for g, w in self.weights.items() for x in (F.lit(g), F.array(*map(F.lit, w)))))
        known = F.array_intersect(gram, strings(sorted(self.weights)))
        sums = F.aggregate(known, F.array(*map(F.lit, self.intercepts)), lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b))
        top = F.transform(F.array(sums), lambda s: F.struct(F.array_max(s).alias("m"), s.alias("s")))
        return F.element_at(F.transform(top, lambda x: F.struct((1 / F.aggregate(x["s"], F.lit(0.0), lambda t, v: t + F.exp(v - x["m"]))).alias("p"), F.array_position(x["s"], x["m"]).alias("k"))), 1)


def train(docs: DataFrame, negatives: int = NEGATIVES) -> Model:
    """docs(text): a bounded sample of its paragraphs serves as running text."""
    spark = docs.sparkSession
    notices = template_pairs(spark)
    every = [t for ts in notices.values() for t in ts]
    total = docs.where("text is not null").count()
    share = min(1 << 20, -(-((negatives // 4) << 20) // max(total, 1)))
    some = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share)).select(F.explode(paragraphs(F.col("text").cast("string"))).alias("t"))
    count = some.count()
    own = some.where(F.pmod(F.xxhash64("t", F.lit(1)), F.lit(1 << 20)) < min(1 << 20, -(-(negatives << 20) // max(count, 1))))
    own = own.where(~covers(grams(F.col("t")), F.array(*map(strings, every)))).select(F.lit(NONE).alias("f"), F.substring("t", 1, 2000).alias("t"))
    rng, rows = random.Random(7), []
    around = "of the in and to work time people with on day other is was la de le und der die les el que".split()
    for f, ts in [*TEMPLATES.items(), (NONE, NEAR_MISSES)]:
        for t in ts:
            for v in range(VARIANTS):
                w = t.split()
                if v >= 4 and len(w) > 4:  # the first variants keep every word
                    w = [x for x in w if rng.random() > 0.1] or w
                left, right = ([rng.choice(around) for _ in range(rng.randrange(0, 12))] if v else [] for _ in range(2))
                rows.append({"f": f, "t": " ".join([*left, *w, *right])})
    data = literal(spark, rows, "f:string,t:string").unionByName(own).select("f", grams(F.col("t")).alias("grams"), (F.pmod(F.xxhash64("t", F.lit(2)), F.lit(2)) == 0).alias("fit"))
    data = data.repartition(1).persist()  # a few thousand rows
    try:
        cv = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=20_000, minDF=2).fit(data.where("fit"))
        classes = [*TEMPLATES, NONE]
        label = F.array_position(strings(classes), F.col("f")).cast("double") - 1
        fit = cv.transform(data.where("fit")).select(label.alias("label"), "features")
        lr = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=1.0, maxIter=60, standardization=False).fit(fit)
        m, b = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
        k = m.shape[0]  # classes after the last label seen do not occur
        weights = {g: [round(float(m[c, i]), 6) if c < k else 0.0 for c in range(len(classes))] for i, g in enumerate(cv.vocabulary) if abs(m[:, i]).max() > 1e-4}
        usual = data.where(F.col("f") == NONE).select(F.explode("grams").alias("g")).where(F.col("g").isin(sorted({w for g in weights for w in g.split(" ")}))).groupBy("g").count()
        usual = dict(usual.collect())  # words of the model only
        model = Model(classes, [float(x) for x in b] + [-99.0] * (len(classes) - k), weights, 0.5, notices, usual)
        s = data.where("not fit and f = 'none'").select(model.scored(F.col("grams")).alias("s")).where(F.col("s.k") != classes.index(NONE) + 1)
        held = data.where("not fit and f = 'none'").count()
        wrong = [r[0] for r in s.select("s.p").sort(F.desc("p")).take(held // 200 + 1)] if held else []
        model.threshold = max(0.5, wrong[held // 200]) if len(wrong) > held // 200 else 0.5
    finally:
        data.unpersist()
    return model


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, found: array of (paragraph, family, probability, confirmed) for each row of docs, joined: families
    of notices that run over line breaks and are confirmed on no line."""
    anchors = model.anchors()
    near = lambda text: F.lit(False) if not anchors else _any([F.contains(text, F.lit(a)) for a in anchors])
    none = model.classes.index(NONE) + 1
    rows = docs.select("doc_id", F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))  # once for all that follows
    out = rows.select("doc_id", "text", paragraphs(F.col("text")).alias("ps"), near(F.col("text")).alias("near"))
    out = out.select("doc_id", F.when(F.col("near"), F.col("text")).otherwise(F.lit("")).alias("text"), F.size("ps").cast("bigint").alias("n_paragraphs"), F.when(F.col("near"), F.col("ps")).otherwise(F.array().cast("array<string>")).alias("ps"))
    out = out.withColumn("ps", F.filter(F.transform("ps", lambda p, i: F.struct((i + 1).alias("i"), p.alias("p"))), lambda x: near(x["p"])))
    out = out.withColumn("ps", F.transform("ps", lambda x: F.struct(x["i"].alias("i"), grams_of(tokens(x["p"])).alias("g"))))
    out = out.withColumn("ps", F.filter(F.transform("ps", lambda x: F.struct(x["i"].alias("i"), x["g"].alias("g"), model.scored(x["g"]).alias("s"))), lambda x: x["s"]["k"] != none))
    names, notices = strings(model.classes), F.array(*(F.array(*map(strings, model.notices.get(c, []))) if model.notices.get(c) else F.array().cast("array<array<string>>") for c in model.classes))
    sure = lambda x: x["s"]["p"] >= model.threshold
    found = F.transform("ps", lambda x: F.struct(
        x["i"].cast("int").alias("paragraph"),
        F.when(sure(x), F.element_at(names, x["s"]["k"].cast("int"))).otherwise(F.lit(UNKNOWN)).alias("family"),
        x["s"]["p"].alias("probability"),
        (sure(x) & covers(x["g"], F.element_at(notices, x["s"]["k"].cast("int")))).alias("confirmed"),
    ))
    out = out.select("doc_id", "n_paragraphs", "text", found.alias("found"))
    out = out.withColumn("judged", F.transform(F.filter("found", lambda x: x["confirmed"]), lambda x: x["family"]))
    out = may_wrap(out, model, F.col("judged"))
    return out.select("doc_id", "n_paragraphs", "found", F.when(F.col("may"), wrapped(F.col("text"), model, F.col("judged"))).otherwise(F.array().cast("array<string>")).alias("joined"))


def _any(tests: list[Column]) -> Column:
    while len(tests) > 1:  # a flat tree
        tests = [a | b for a, b in zip(tests[::2], tests[1::2], strict=False)] + (tests[-1:] if len(tests) % 2 else [])
    return tests[0]


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_found, licences (confirmed families, sorted, comma-joined), n_unknown, best (probability)."""
    found = scan(docs, train(docs))
    confirmed = F.filter("found", lambda x: x["confirmed"])
    return found.select(
        "doc_id", "n_paragraphs", F.size("found").cast("bigint").alias("n_found"),
        F.array_join(F.sort_array(F.array_union(F.transform(confirmed, lambda x: x["family"]), "joined")), ",").alias("licences"),
        (F.size("found") - F.size(confirmed)).cast("bigint").alias("n_unknown"),
        F.round(F.array_max(F.transform("found", lambda x: x["probability"])), 6).alias("best"),
    )
