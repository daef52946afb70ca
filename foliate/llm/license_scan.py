"""Licence scan by a trained paragraph classifier (native: DataFrame functions and Spark's own learner).

A paragraph is a line. A multinomial logistic regression on hashed word n-grams (n from 1 to 3) of the fixed texts,
sparse by its elastic net, tells licence families from an unknown class. It is fitted on licence
templates, on shortened variants of them and on a bounded sample of other paragraphs, those with the words of licences
among them; a logistic curve on templates and paragraphs kept whole from a first fit calibrates how far the best family leads the
unknown class. A prediction counts if the calibrated probability reaches ``CALIBRATED`` and a template of that family confirms
it: 5-word shingles of the shorter of both are in the longer one to ``SIMILAR`` or more.

A confirmed paragraph shares a shingle with a telling word: ``gate_words`` makes these from the templates, and each template
has shingles with them. So paragraphs without any telling word could not be confirmed and don't reach the classifier.
Texts are never shuffled; only the other paragraphs are exploded.

Defined results: null and empty texts hold no licence; repeated rows and ties give the same result
each; families come in alphabetical order; a null id is passed on; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from math import exp
from operator import and_, or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import as_text, durable, table

# Well-known notices and sentences of public licences, by family.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "This project is licensed under the Apache License 2.0.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0": ("To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide.", "Released into the public domain under CC0 1.0 Universal."),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Licensed under the GNU GPL version 2 or later.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
}
#: Stems of the licence vocabulary; the gate lets these through as well, and they come first where it is made.
VOCABULARY = ("licens", "licenc", "redistribut", "permission", "copyright", "warrant", "public domain", "cc0", "rights reserved")
#: Sentences with that vocabulary that grant nothing: they teach the unknown class.
OTHERS = (
    "He lost his driving license after the accident.", "A fishing license costs ten dollars a year.", "The license plate was found near the river.", "Permission to enter the hall was refused.",
    "With the permission of the editor we print the letter.", "The television comes with a two year warranty.", "A search warrant was issued by the judge.", "The dispute was about copyright in old songs.",
    "Copyright law differs from country to country.", "The bar lost its liquor license in the spring.", "She asked for permission to leave early.", "All rights and the copyright stay with the publisher.",
    "Software license fees rose again this year.", "The redistribution of land was slow.", "The doctor renewed her medical license.", "A license to print money, said the minister.", "The old songs are in the public domain now.", "All rights reserved.",
)
#: Letters of a telling word of a template.
RARE = 8
UNKNOWN = "unknown"
N_GRAMS = 3
FEATURES = 1 << 14
#: Bound of the other paragraphs that the fit takes from the corpus.
SAMPLE = 400
ITERATIONS = 30
CALIBRATED = 0.5
SHINGLE, SIMILAR = 5, 0.8


def words(text: Column) -> Column:
    """Lower-cased words of letters and digits, parted by other characters; "licence" is spelt "license"."""
    return F.filter(F.split(F.replace(F.lower(text), F.lit("licenc"), F.lit("licens")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(w: Column, n: int) -> Column:
    """Runs of n words joined by spaces, in order; each takes its words by position, so long texts cost no more a word."""
    last = F.size(w) - F.lit(n)
    run = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))
    return F.when(last >= 0, run).otherwise(F.array().cast("array<string>"))


def _features(w: Column) -> Column:
    return F.concat(*[grams(w, n) for n in range(1, N_GRAMS + 1)])


def gate_words(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> tuple[str, ...]:
    """The vocabulary, and the words of ``RARE`` letters or more of templates' shingles without it: those that hit most shingles before others, until no shingle with such a word is left."""
    low = lambda t: re.sub(r"[\W_]+", " ", t.lower().replace("licenc", "licens")).split()
    left = {tuple(w[i : i + SHINGLE]) for texts in templates.values() for w in map(low, texts) for i in range(max(1, len(w) - SHINGLE + 1))}
    left = {s for s in left if not any(v in " ".join(s) for v in VOCABULARY)}
    telling = list(VOCABULARY)
    while counts := Counter(w for s in left for w in set(s) if len(w) >= RARE):
        telling.append(max(counts, key=lambda w: (counts[w], len(w), w)))
        left = {s for s in left if telling[-1] not in s}
    return tuple(telling)


def _gate(text: Column) -> Column:
    words_ = gate_words()
    return F.exists(F.array(F.lower(text)), lambda low: reduce(or_, (low.contains(w) for w in words_)))


def _gated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, all: the lines that the gate lets through with their numbers, of every row. Texts are looked at once."""
    text = as_text(F.col(text_col))
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    passing = F.filter(numbered, lambda p: _gate(p["text"]))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.when(_gate(text), passing).otherwise(F.filter(numbered, lambda p: F.lit(False))).alias("all"))


class LicenceModel:
    """The fitted learner, its calibration curve, the families, and what makes its features."""

    def __init__(self, learner, curve, families: list[str], hashing: HashingTF, slicer: VectorSlicer) -> None:
        self.learner, self.curve, self.families, self.hashing, self.slicer = learner, curve, families, hashing, slicer

    def predict(self, paragraphs: DataFrame) -> DataFrame:
        """``paragraphs`` (with ``_words``) and family, calibrated."""
        scored = self.learner.transform(self.slicer.transform(self.hashing.transform(paragraphs.withColumn("_grams", _features(F.col("_words"))))))
        logits = vector_to_array("_logits")
        best = F.array_max(F.transform(F.slice(logits, 2, len(self.families) - 1), lambda x, i: F.struct(x.alias("logit"), (-i).alias("i"))))
        out = scored.withColumn("_lead", best["logit"] - logits[0]).withColumn("family", F.element_at(F.array(*map(F.lit, self.families[1:])), (1 - best["i"]).cast("int")))
        a, b = self.curve
        return out.withColumn("calibrated", 1 / (1 + F.exp(-(F.lit(a) * F.col("_lead") + F.lit(b))))).drop("_grams", "_hashed", "_known", "_logits", "_lead", "_p", "_guess")


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, id_col: str = "doc_id", gated: DataFrame | None = None) -> LicenceModel:
    """Fit on templates, their variants and a bounded sample of the corpus's other paragraphs."""
    spark = docs.sparkSession
    gated = durable(_gated(docs, id_col, text_col)) if gated is None else gated
    families = [UNKNOWN, *sorted(TEMPLATES)]
    rows = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            w, own = text.split(), text
            made = [text] + [" ".join(w[i : i + max(5, 3 * len(w) // 4)]) for i in range(0, max(1, len(w) // 4 + 1), 2)]
            made += ["Copyright (c) 2020 the authors. " + text, text + " See the file for details.", "This file: " + text.lower()]
            rows += [(family, x, own) for x in made]
    rows += [(UNKNOWN, t, t) for t in OTHERS for _ in range(3)]
    known = spark.createDataFrame([(families.index(f), t, own) for f, t, own in rows], "label int, text string, own string").withColumn("_fixed", F.lit(True)).coalesce(1)
    hashing = HashingTF(inputCol="_grams", outputCol="_hashed", numFeatures=FEATURES, binary=True)
    other = _others(docs, gated, text_col, sample).select(F.lit(0).alias("label"), "text", F.col("text").alias("own"), F.lit(False).alias("_fixed"))
    # What is held out is held with all its variants: whole templates and whole paragraphs.
    data = durable(known.unionByName(other).coalesce(2).withColumn("_held", F.pmod(F.xxhash64("own"), F.lit(4)) == 0).withColumn("_words", words(F.col("text"))))
    hashed = hashing.transform(data.withColumn("_grams", _features(F.col("_words"))))
    # The learner makes dozens of arrays of all coefficients an iteration in the driver, so it gets the features of the fixed texts alone (a tenth, whatever the corpus holds).
    known_features = sorted({int(i) for r in hashed.where("_fixed").select("_hashed").collect() for i in r["_hashed"].indices})
    slicer = VectorSlicer(inputCol="_hashed", outputCol="_known", indices=known_features)
    ready = slicer.transform(hashed).cache()
    learner = LogisticRegression(featuresCol="_known", labelCol="label", rawPredictionCol="_logits", probabilityCol="_p", predictionCol="_guess", family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=ITERATIONS)
    first = learner.fit(ready.where(~F.col("_held")))
    logits = vector_to_array("_logits")
    held = first.transform(ready.where("_held")).select((F.col("label") > 0).cast("int").alias("y"), (F.array_max(F.slice(logits, 2, len(families) - 1)) - logits[0]).alias("x"))
    pairs = [(r["x"], r["y"]) for r in held.collect()]
    model = learner.fit(ready)
    ready.unpersist()
    return LicenceModel(model, calibrate(pairs), families, hashing, slicer)


def _others(docs: DataFrame, gated: DataFrame, text_col: str, sample: int) -> DataFrame:
    """text: ``sample`` paragraphs without the gate's words, and as many with them that no template is like, at most.

    One paragraph of a document each; a hash of the paragraph below a threshold from the number of rows leaves about twice the
    sample, copies fold into one before anything moves, and only these are sorted.
    """

    def drawn(lines: DataFrame, n: int) -> DataFrame:
        picked = lines.where(F.size("all") > 0).select(F.element_at("all", (F.pmod(F.xxhash64("all"), F.size("all")) + 1).cast("int")).alias("text"))
        return picked.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(2 * sample / max(n, 1) * (1 << 40))).distinct()

    some = lambda lines: lines.orderBy(F.xxhash64("text"), "text").limit(sample)
    lines = docs.select(F.filter(F.split(as_text(F.col(text_col)), "\n"), lambda x: F.trim(x) != "").alias("all"))
    telling = gated.where(F.size("all") > 0).select(F.col("all.text").alias("all"))
    # Shingles are made once a distinct paragraph and written down: else the filter goes below the folding of copies, and makes them anew for every template and copy, its words for every shingle.
    near = durable(drawn(telling, telling.count()).coalesce(1).withColumn("_w", words(F.col("text"))).select("text", _shingles(F.col("_w")).alias("_s")))
    templates = F.flatten(F.map_values(_template_shingles(docs.sparkSession)))
    like = F.array_max(F.transform(templates, lambda t: F.size(F.array_intersect("_s", t)) / F.least(F.size("_s"), F.size(t))))
    return some(drawn(lines, docs.count()).where(~_gate(F.col("text")))).unionByName(some(near.where(like < SIMILAR / 2).select("text")))


def calibrate(pairs: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (lead, is a licence), by Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        g0, g1, h00, h01, h11 = 0.01 * (1.0 - a), -0.01 * b, 0.01, 0.0, 0.01
        for x, y in pairs:
            p = 1 / (1 + exp(-max(-30.0, min(30.0, a * x + b))))
            w = p * (1 - p)
            g0, g1 = g0 + (y - p) * x, g1 + (y - p)
            h00, h01, h11 = h00 + w * x * x, h01 + w * x, h11 + w
        det = h00 * h11 - h01 * h01
        a = max(0.05, a + max(-1.0, min(1.0, (g0 * h11 - g1 * h01) / det)))
        b += max(-5.0, min(5.0, (g1 * h00 - g0 * h01) / det))
    return a, b


def _template_shingles(spark: SparkSession) -> Column:
    """family -> the shingle lists of its templates, as a literal: the templates are fixed."""
    rows = [(f, t) for f, texts in sorted(TEMPLATES.items()) for t in texts]
    frame = spark.createDataFrame(rows, "family string, text string").coalesce(1).withColumn("w", words(F.col("text"))).select("family", _shingles(F.col("w")).alias("s"))
    grouped: dict[str, list[list[str]]] = {}
    for r in frame.collect():
        grouped.setdefault(r["family"], []).append(r["s"])
    return F.create_map(*[x for f, lists in sorted(grouped.items()) for x in (F.lit(f), F.array(*[F.array(*map(F.lit, s)) for s in sorted(lists)]))])


def _shingles(w: Column) -> Column:
    """Distinct 5-word shingles; of fewer words, the whole sequence."""
    return F.array_distinct(F.when(F.size(w) < SHINGLE, F.array(F.array_join(w, " "))).otherwise(grams(w, SHINGLE)))


def classify(gated: DataFrame, model: LicenceModel) -> DataFrame:
    """``gated`` (one paragraph a row, in column ``text``) with family, calibrated, similarity and confirmed."""
    found = model.predict(gated.withColumn("_words", words(F.col("text")))).withColumn("_s", _shingles(F.col("_words")))
    shared = lambda t: F.size(F.array_intersect("_s", t)) / F.least(F.size("_s"), F.size(t))
    own = F.element_at(_template_shingles(gated.sparkSession), F.col("family"))
    similar = F.array_max(F.transform(own, shared))
    # A telling word must be in what is shared: runs of plain words alone confirm nothing.
    telling = F.exists(F.array_intersect("_s", F.flatten(own)), _gate)
    found = found.withColumn("similarity", similar).withColumn("confirmed", (F.col("calibrated") >= CALIBRATED) & (F.col("similarity") >= SIMILAR) & telling)
    return found.drop("_words", "_s")


def scan(docs: DataFrame, model: LicenceModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, families, n_gated, n_confirmed, spans of every row.

    families are the confirmed ones, in alphabetical order; spans tells (line number, family,
    calibrated, similarity, confirmed) of every paragraph that the gate lets through, in order.
    """
    # Row numbers are given once and written down with the gated paragraphs.
    gated = durable(_gated(docs, id_col, text_col))
    model = fit(docs, text_col, gated=gated) if model is None else model
    each = classify(gated.select("row", "doc_id", F.explode("all").alias("p")).select("row", "doc_id", "p.line", "p.text"), model)
    span = F.struct("line", "family", "calibrated", "similarity", "confirmed")
    out = each.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
        F.count(F.lit(1)).alias("n_gated"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    ).drop("row")
    kind = dict(out.dtypes)
    rest = gated.where(F.size("all") == 0).select("doc_id", F.array().cast(kind["families"]).alias("families"), F.lit(0).cast("long").alias("n_gated"), F.lit(0).cast("long").alias("n_confirmed"), F.array().cast(kind["spans"]).alias("spans"))
    return out.unionByName(rest)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, families (comma-joined), n_gated, n_confirmed of every document."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.array_join("families", ",").alias("families"), "n_gated", "n_confirmed")
