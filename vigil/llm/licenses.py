"""Licence notices in documents, by a paragraph classifier: sparse logistic regression on word n-grams.

Every paragraph (line) of every document is classified: its words and word pairs are hashed to a sparse vector, and a
multinomial logistic regression fitted with an L1 share gives a probability to each licence family and to a class of
paragraphs that are none. A second regression on paragraphs held back calibrates how far the best family leads, and
paragraphs below ``LEAST`` are unknown. So that notices wrapped over several lines are seen whole, the text around every
line break is classified too, in documents with a word of ``HINTS``, without which no template can be confirmed. A
paragraph counts once a template of its family confirms it: enough of the
template's word triples must stand in it. All steps, fitting included, are DataFrame operations inside the JVM.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.session import smallest

UNKNOWN = "unknown"
#: Public notices of licence families, as projects put them in their files.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is distributed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License v3.0.",
        "This library is distributed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under the Creative Commons Attribution-ShareAlike 3.0 License; CC BY-SA 3.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Shared under CC BY-NC-SA 4.0 for non-commercial use only.",
    ],
    "public-domain": [
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2024 Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced, distributed or transmitted without prior written permission of the publisher.",
    ],
}
#: Paragraphs about licences that are none, so that single words don't decide.
NOT_NOTICES = [
    "You need a driving license to rent a car in most countries.",
    "The committee discussed whether to grant the license to the new station.",
    "Copyright law has changed several times since the version of 1976.",
    "The general public was free to use the library without restriction.",
    "All students have the right to be heard, and all seats were reserved.",
    "He released the new version of the software under a different name.",
    "The apache tribe lived in the southwest under their own law.",
    "She studied at MIT and later worked on source code for the foundation.",
    "Under the terms of the contract the work was done in four weeks.",
    "The author has dedicated this work to the memory of a friend.",
    "Permission to enter the building is granted by the office.",
    "Conditions are met when both forms are signed and sent to the publisher.",
]
FEATURES = 1 << 14
NEGATIVES = 4_000
LEAST = 0.5
CONFIRMED = 0.6
#: Parts of words one of which stands in any ``CONFIRMED`` share of a template's triples.
HINTS = "licens|spdx|compliance|apache|redistribut|software|obtaining|granted|associated|restriction|reproduced|transmitted|permission|reserved|copyright|waived|extent|governed|creative|modification|permitted|binary|dedicated|domain|universal|released|public|distributed|gpl|mozilla|subject|rights|bsd|attribution|available|(?<![a-z0-9])cc(?![a-z0-9])|commercial"
#: Characters taken on each side of a line break, more than any template has, and lines looked at behind it.
AROUND, FOLLOWING = 300, 12


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def hinted(text: Column) -> Column:
    """Whether ``HINTS`` matches the text in lower case. Its plain words are searched for one by one, far cheaper than alternatives at every place."""
    plain = [h for h in HINTS.split("|") if h.isalpha()]
    rest = [h for h in HINTS.split("|") if not h.isalpha()]

    def found(low: Column) -> Column:
        out = F.lit(False)
        for h in plain:
            out = out | F.contains(low, F.lit(h))
        for h in rest:
            out = out | low.rlike(h)
        return out

    # the lower-case text is bound once
    return F.exists(F.array(F.lower(text)), found)


def pairs(w: Column) -> Column:
    return F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def triples(w: Column) -> Column:
    """All runs of three words; a shorter paragraph is one run. The words are bound once, not split anew for each run."""
    return F.transform(F.array(w), _triples)[0]


def _triples(w: Column) -> Column:
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " "))
    return F.when(n > 3, many).otherwise(F.array(F.array_join(w, " ")))


def _examples(spark: SparkSession) -> DataFrame:
    """Templates as they stand, and cut or mixed with other words: (text, family, part)."""
    rows = []
    for family, texts in TEMPLATES.items():
        for i, t in enumerate(texts):
            w = t.split()
            kinds = [t, t.upper(), t.lower(), t.rstrip("."), f"Copyright (c) 2021 The authors. {t}", f"{t} See the file for details.", f"# {t}", f"/* {t} */", f"Note: {t}", f"<p>{t}</p>"]
            if len(w) > 8:
                kinds += [" ".join(w[: len(w) * 3 // 4]), " ".join(w[len(w) // 5 :]), " ".join(x for j, x in enumerate(w) if j % 7 != 3)]
            rows += [(k, family, (i + j) % 4) for j, k in enumerate(kinds)]
    rows += [(k, UNKNOWN, j % 4) for j, t in enumerate(NOT_NOTICES) for k in (t, t.lower(), f"{t} And so on.")]
    return spark.createDataFrame(rows, "text string, family string, part int")


def _grams(df: DataFrame) -> DataFrame:
    df = df.withColumn("w", words(F.col("text")))
    return df.withColumn("grams", F.concat("w", pairs(F.col("w")))).drop("w")


class Classifier:
    """The fitted regressions; ``families`` in the order of the probabilities."""

    def __init__(self, model: PipelineModel, families: list[str], line: tuple[float, float]):
        self.model, self.families, self.line = model, families, line

    def __call__(self, paragraphs: DataFrame) -> DataFrame:
        """Adds family (or unknown) and confidence to rows with a column text."""
        rows = _lead(self.model.transform(_grams(paragraphs)), self.families)
        p = 1 / (1 + F.exp(-(F.lit(self.line[0]) * F.col("lead") + F.lit(self.line[1]))))
        known = p >= LEAST
        return rows.withColumn("confidence", p).withColumn("family", F.when(known, F.col("best")).otherwise(F.lit(UNKNOWN))).drop("grams", "vector", "raw", "lead", "best", "r")


def _lead(df: DataFrame, families: list[str]) -> DataFrame:
    """The best known family and the logit by which it leads the class of all else."""
    df = df.withColumn("r", vector_to_array("raw"))
    u = families.index(UNKNOWN)
    known = [(F.col("r")[i], f) for i, f in enumerate(families) if i != u]
    top = F.greatest(*[k for k, _ in known])
    best = F.coalesce(*[F.when(k == top, F.lit(f)) for k, f in known])
    return df.withColumn("best", best).withColumn("lead", top - F.col("r")[u])


def train(paragraphs: DataFrame) -> Classifier:
    """Fits on the templates and at most ``NEGATIVES`` of the paragraphs given (of the smallest hashes) that share no word triple with any template."""
    spark = paragraphs.sparkSession
    known = _examples(spark)
    families = [*sorted(TEMPLATES), UNKNOWN]
    # a template's triples: some hundreds, fixed here
    taken = sorted({t for r in known.where(F.col("family") != UNKNOWN).select(F.explode(triples(words(F.col("text")))).alias("t")).distinct().collect() for t in [r["t"]]})
    others = paragraphs.select("text").orderBy(F.xxhash64("text"), "text").limit(NEGATIVES)
    others = others.where(~F.arrays_overlap(triples(words(F.col("text"))), F.lit(taken))).select("text", F.lit(UNKNOWN).alias("family"), F.pmod(F.xxhash64("text"), F.lit(4)).cast("int").alias("part"))
    number = F.coalesce(*[F.when(F.col("family") == f, F.lit(float(i))) for i, f in enumerate(families)])
    rows = _grams(known.unionByName(others)).withColumn("label", number).withColumn("weight", F.when(F.col("family") == UNKNOWN, 1.0).otherwise(4.0)).repartition(2, "text").cache()
    fit = LogisticRegression(featuresCol="vector", rawPredictionCol="raw", probabilityCol="p", weightCol="weight", family="multinomial", regParam=2e-4, elasticNetParam=0.3, maxIter=30, standardization=False)
    counted = HashingTF(inputCol="grams", outputCol="vector", numFeatures=FEATURES, binary=True)
    model = Pipeline(stages=[counted, fit]).fit(rows.where("part > 0"))
    held = _lead(model.transform(rows.where("part = 0")), families).withColumn("y", (F.col("family") != UNKNOWN).cast("double"))
    held = VectorAssembler(inputCols=["lead"], outputCol="one").transform(held.select("lead", "y"))
    line = LogisticRegression(featuresCol="one", labelCol="y", regParam=0.01, maxIter=20).fit(held)
    rows.unpersist()
    steps = PipelineModel(stages=[model.stages[0], model.stages[1].setPredictionCol("").setProbabilityCol("")])
    return Classifier(steps, families, (float(line.coefficients[0]), float(line.intercept)))


def around_breaks(lines: Column) -> Column:
    """For every line but the last its end joined with the beginning of the lines after it."""
    heads = F.transform(lines, lambda x: F.substring(x, 1, AROUND))
    one = lambda x, i: F.concat_ws(" ", F.right(x, F.lit(AROUND)), F.substring(F.array_join(F.slice(heads, i + 2, FOLLOWING), " "), 1, AROUND))
    return F.slice(F.transform(lines, one), F.lit(1), F.size(lines) - 1)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text; more columns are ignored): doc_id, n_paragraphs, families, n_notices, confidence.

    ``families`` lists the licence families of confirmed notices in order of name, ``n_notices`` counts the notices (those
    of one family wrapped around neighbouring line breaks as one), ``confidence`` is the highest one (null without notices). Null and empty texts have no paragraphs and no notices.
    Rows that agree in doc_id and text have the same result each; a null doc_id stays null. No rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    rows = rows.withColumn("lines", lines)
    paragraphs = rows.select("doc_id", "mark", F.posexplode("lines").alias("line", "text"))
    some = smallest(rows.select("doc_id", "mark", "lines"), F.xxhash64("doc_id", "mark"), NEGATIVES, docs.count(), "lines").select(F.explode("lines").alias("text"))
    classify = train(some)
    breaks = rows.where(hinted(F.col("text")) & (F.size("lines") > 1)).select("doc_id", "mark", F.posexplode(around_breaks(F.col("lines"))).alias("line", "text")).where(hinted(F.col("text")))
    templates = docs.sparkSession.createDataFrame([(f, t) for f, texts in TEMPLATES.items() for t in texts], "family string, template string")
    templates = templates.select("family", triples(words(F.col("template"))).alias("t")).groupBy("family").agg(F.collect_list("t").alias("templates"))

    def confirmed(paragraphs: DataFrame, wrapped: bool) -> DataFrame:
        found = classify(paragraphs).where(F.col("family") != UNKNOWN)
        found = found.withColumn("own", F.array_distinct(triples(words(F.col("text"))))).join(F.broadcast(templates), "family")
        share = F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("own"))) / F.size(F.array_distinct(t)))
        return found.where(F.array_max(share) >= CONFIRMED).select("doc_id", "mark", "line", "family", "confidence", F.lit(wrapped).alias("wrapped"))

    found = confirmed(paragraphs, False).unionByName(confirmed(breaks, True)).groupBy("doc_id", "mark", "family")
    inside = F.col("wrapped")
    found = found.agg(F.collect_set(F.when(~inside, F.col("line"))).alias("own"), F.collect_set(F.when(inside, F.col("line"))).alias("broken"), F.coalesce(F.max(F.when(~inside, F.col("confidence"))), F.max("confidence")).alias("confidence"))
    # a line break around which a line alone is a notice adds none, and neighbouring breaks show the same one
    found = found.withColumn("broken", F.array_sort(F.filter("broken", lambda x: ~F.exists("own", lambda y: (y >= x) & (y <= x + FOLLOWING)))))
    number = F.size("own") + F.size(F.filter("broken", lambda x: ~F.array_contains(F.col("broken"), x - 1)))
    found = found.withColumn("n", number).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("family")).alias("families"), F.sum("n").alias("n_notices"), F.max("confidence").alias("confidence"))
    out = rows.select("doc_id", "mark", F.size("lines").cast("long").alias("n_paragraphs")).alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.mark <=> f.mark"), "left")
    return out.select("d.doc_id", "n_paragraphs", F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), "confidence")
