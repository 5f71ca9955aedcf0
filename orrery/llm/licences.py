"""Licence scans: a trained passage classifier whose predictions templates confirm.

DataFrame and SQL operations only. Passages are the sentences of lines and, as notices
are often hard-wrapped, the sentences of paragraphs (lines up to a blank one) that go
over more than one line. A multinomial logistic regression with elastic-net penalty over hashed
word n-grams (one to three words) gives each passage a licence family or the class
``unknown``. It is trained on the families' templates under random cuts and swaps,
against sentences that speak of licences without granting a known one, and bounded
samples of corpus passages: ``NEGATIVES`` of any, ``HARD_NEGATIVES`` with an anchor
word, drawn by hash from all parts of all texts, if less than half of
``LEAST_CONTAINED`` of any template is in them. A temperature, fitted on
held-out variants, calibrates the probabilities. A prediction counts if its
probability reaches ``LEAST_PROBABILITY`` and, of all templates, the one most
contained in the passage (by shingles of three words, at least ``LEAST_CONTAINED``)
is of the predicted family, and no other family's template is contained as much: part of
a notice that several families share names none.

A passage without any of ``ANCHORS`` and ``HINTS`` can't hold ``LEAST_CONTAINED`` of a
template: fewer of its shingles are free of these words (tested). So only passages
with one are classified: nothing that the classifier and a template could confirm is
left out.

A sentence over several lines counts once a family, and not if a line in it is
confirmed for that family by itself. Unknown are sentences of a line that have one of
``ANCHORS`` or enough of a template and aren't confirmed, unless they lie within a
sentence that is confirmed only as a whole.

Defined results: one row a document; a null or empty text has no licence; null ids
stay null; repeated rows give repeated results; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import staged

#: Hashed features; variants of a template.
FEATURES, VARIANTS = 1 << 14, 24
#: Passages of the corpus in the training set, and such with an anchor word, at most.
NEGATIVES, HARD_NEGATIVES = 600, 400
LEAST_PROBABILITY, LEAST_CONTAINED = 0.5, 0.6
#: Sentences longer than this many words are cut into windows of it, overlapping by half.
WINDOW = 60

# Short notices by which public licences are granted.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the terms of the GNU General Public License version 2",
        "SPDX-License-Identifier: GPL-2.0-only",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the terms of the GNU General Public License version 3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "EPL-2.0": [
        "This program is made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense license.",
    ],
    "CC0-1.0": [
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
}
# One of these is in every template (lower case).
ANCHORS = ["licen", "permission", "redistribution", "public domain", "copyright"]
# With the anchors of one word, these leave less than LEAST_CONTAINED of any template.
HINTS = [
    "released", "granted", "obtaining", "documentation", "binary", "modification", "permitted", "gnu", "published", "mozilla", "subject",
    "eclipse", "available", "distribute", "modify", "unencumbered", "cc0", "waived", "rights", "4.0", "creative",
    "software", "conditions", "disclaimer", "compliance", "warrant", "endorse", "obtain", "source", "compile", "copies", "except", "contributors", "prior",
]
UNKNOWN = "unknown"
# Sentences about licences that grant none of the above.
OTHER = [
    "All rights reserved.", "Copyright by the authors, all rights reserved.", "The driver lost his license after the trial.",
    "A fishing licence is required in this region.", "Licensed under the terms of the customer agreement.",
    "This software is licensed under a proprietary license and may not be copied.", "Use is subject to license terms.",
    "You need permission from the owner to enter the building.", "The redistribution of income was the aim of the reform.",
    "His songs have passed into the public domain.", "Licensed under the Foo Software License, version 1.",
    "Released under the license of the publisher.", "The license fee is due every year.", "See the LICENSE file for details.",
    "This work is licensed under a custom license.", "Permission was denied by the council.",
    "Copyright law protects authors.", "SPDX-License-Identifier: LicenseRef-Custom", "The state issued a new license plate.",
    "Licensed under the Example Public License, version 9.",
]


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits, dots, plus and hyphens, without dots or hyphens at the ends."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:[.+-]+[\p{L}\p{N}]+)*)"), F.lit(1))
    return F.filter(found, lambda w: w != "")


def grams(tokens: Column, n: int) -> Column:
    """Runs of n words; none if there are fewer."""
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def featured(df: DataFrame) -> DataFrame:
    """Adds ``words`` and the hashed counts of one to three words of ``passage``."""
    if "words" not in df.columns:
        df = once(df, "words", words(F.col("passage")))
    df = df.withColumn("grams", F.concat(*[grams(F.col("words"), n) for n in (1, 2, 3)]))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(df)


def sentences(paragraph: Column) -> Column:
    """A paragraph's sentences; what ends in a full stop before a space, in order."""
    return F.filter(F.split(paragraph, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def has_anchor(text: Column, anchors: list[str] = ANCHORS) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(a)) for a in anchors])


def may_match(text: Column) -> Column:
    """Whether a text can hold enough of a template, or speaks of licences."""
    return has_anchor(text, [*ANCHORS, *HINTS])


def passages(block: Column) -> Column:
    """A paragraph's passages (``line``, ``passage``, ``joined``): sentences of its lines, and those over several lines.

    The latter, in one line, have their number from -1 down for a line.
    """
    def found(sentence: Column, line: Column, joined: bool) -> Column:
        return F.struct(line.cast("int").alias("line"), sentence.alias("passage"), F.lit(joined).alias("joined"))

    lines = F.transform(F.split(block, "\n"), lambda x, i: F.transform(F.filter(sentences(x), may_match), lambda s: found(s, i, False)))
    across = F.transform(sentences(block), lambda s, i: found(F.trim(F.regexp_replace(s, r"\s*\n\s*", "\n")), -1 - i, True))
    across = F.filter(across, lambda x: F.contains(F.trim(x["passage"], F.lit(" \n")), F.lit("\n")) & may_match(x["passage"]))
    across = F.transform(across, lambda x: found(F.translate(x["passage"], "\n", " "), x["line"], True))
    return F.concat(F.flatten(lines), across)


def _rows(spark: SparkSession) -> DataFrame:
    """The templates and the other sentences: (``family``, ``passage``)."""
    pairs = [(f, t) for f, own in TEMPLATES.items() for t in own] + [(UNKNOWN, t) for t in OTHER]
    values = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("passage")) for f, t in pairs])
    return spark.range(1).select(F.inline(values))


def training_set(spark: SparkSession, docs: DataFrame, text_col: str) -> DataFrame:
    """(``label``, ``passage``, ``held``): variants of the templates, and sentences of neither."""
    fixed = _rows(spark)
    variant = fixed.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    w = F.split("passage", " ")
    chance = lambda x, salt: F.pmod(F.xxhash64(x, "i", F.lit(salt)), F.lit(100))
    # The first variant is the template; the others lose words at the ends or within, and gain some around.
    thinned = F.filter(w, lambda x: (F.col("i") == 0) | (F.pmod(F.xxhash64(x, "i"), F.lit(100)) >= F.pmod(F.col("i"), F.lit(4)) * 4))
    around = F.array(*[F.lit(x) for x in ("this", "file", "text", "and", "data", "is", "see", "here")])
    lead = F.when(chance("passage", 1) < 40, F.slice(around, F.lit(1) + F.pmod(F.col("i"), F.lit(4)), 3)).otherwise(F.array().cast("array<string>"))
    variant = variant.select("family", F.array_join(F.when(F.col("i") == 0, w).otherwise(F.concat(lead, thinned)), " ").alias("passage"), (F.pmod(F.col("i"), F.lit(4)) == 3).alias("held"))
    corpus = sampled(docs, text_col, NEGATIVES, F.lit(True)).union(sampled(docs, text_col, HARD_NEGATIVES, has_anchor(F.col("text")), lambda x: has_anchor(x)))
    corpus = once(once(corpus, "words", words(F.col("passage"))), "shingles", shingles(F.col("words")))
    corpus = contained(corpus).filter(F.col("near.share") < LEAST_CONTAINED / 2)
    corpus = corpus.select(F.lit(UNKNOWN).alias("family"), "passage", (F.pmod(F.xxhash64("passage"), F.lit(4)) == 3).alias("held"))
    label = F.array_position(F.array(*[F.lit(x) for x in classes()]), F.col("family")) - 1
    return variant.union(corpus).select(label.cast("double").alias("label"), "passage", "held")


def sampled(docs: DataFrame, text_col: str, n: int, wanted: Column, passage_wanted=lambda x: F.lit(True)) -> DataFrame:
    """(``passage``): one passage of each of at most ``n`` different texts (condition ``wanted`` on ``text``), drawn by hash from all texts and all their parts."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull() & wanted).withColumn("mark", F.xxhash64("text"))
    # Only hashes are sorted; then the few texts are fetched by the greatest of theirs, copies once.
    last = texts.select("mark").distinct().orderBy("mark").limit(n).agg(F.max("mark")).first()[0]
    few = texts.filter(F.col("mark") <= (last if last is not None else 0)).groupBy("mark").agg(F.min("text").alias("text"))
    found = F.filter(sentences(F.col("text")), passage_wanted)
    drawn = F.array_min(F.transform(found, lambda x: F.struct(F.xxhash64(x).alias("hash"), x.alias("passage"))))["passage"]
    # Of a long sentence, a window drawn likewise.
    pieces = F.split("passage", r"\s+")
    start = F.lit(1) + F.pmod(F.xxhash64("passage"), F.greatest(F.size(pieces) - WINDOW + 1, F.lit(1))).cast("int")
    return few.select(drawn.alias("passage")).filter("passage is not null").select(F.array_join(F.slice(pieces, start, WINDOW), " ").alias("passage"))


def classes() -> list[str]:
    return [*TEMPLATES, UNKNOWN]


def train(docs: DataFrame, text_col: str = "text") -> tuple[LogisticRegressionModel, float]:
    """The classifier and its temperature."""
    rows = staged(training_set(docs.sparkSession, docs, text_col), "licence-training")
    rows = featured(rows.coalesce(1)).select("label", "features", "held").cache()
    model = LogisticRegression(maxIter=60, regParam=2e-4, elasticNetParam=0.3, family="multinomial", aggregationDepth=2).fit(rows.filter(~F.col("held")))
    raw = model.transform(rows.filter("held")).select(vector_to_array("rawPrediction").alias("raw"), F.col("label").cast("int").alias("y"))
    grid = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
    loss = [F.avg(-F.ln(F.get(softmax(F.col("raw"), t), F.col("y")))).alias(str(i)) for i, t in enumerate(grid)]
    values = raw.agg(*loss).first()
    rows.unpersist()
    return model, grid[min(range(len(grid)), key=lambda i: values[i])]


def softmax(raw: Column, temperature: float) -> Column:
    shifted = F.transform(raw, lambda x: F.exp((x - F.array_max(raw)) / temperature))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b)
    return F.transform(shifted, lambda x: x / total)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: neither filters nor lambdas behind it take its place."""
    return df.withColumn(name, F.explode(F.array(value)))


def shingles(tokens: Column) -> Column:
    """The runs of two and three words."""
    return F.array_distinct(F.concat(grams(tokens, 2), grams(tokens, 3)))


def contained(df: DataFrame) -> DataFrame:
    """Adds ``near`` to passages with ``shingles``: the template most contained, its ``share`` and ``family``, and of all other families the greatest share (``rival``)."""
    found = []
    for family, texts in TEMPLATES.items():
        own = []
        for text in texts:
            theirs = sorted(template_shingles(text))
            own.append(F.size(F.array_intersect("shingles", F.array(*[F.lit(x) for x in theirs]))) / float(len(theirs)))
        found.append(F.struct((F.greatest(*own) if len(own) > 1 else own[0]).alias("share"), F.lit(family).alias("family")))
    df = once(df, "all_near", F.array(*found))
    best = F.array_max("all_near")
    others = F.transform(F.filter("all_near", lambda x: x["family"] != best["family"]), lambda x: x["share"])
    return df.withColumn("near", F.struct(best["share"].alias("share"), best["family"].alias("family"), F.array_max(others).alias("rival"))).drop("all_near")


def template_shingles(text: str) -> set[str]:
    """The same words as the columns', and runs of three, of a template (of two, if it has no more words)."""
    import regex

    found = regex.findall(r"[\p{L}\p{N}]+(?:[.+-]+[\p{L}\p{N}]+)*", text.lower())
    size = min(3, len(found))
    return {" ".join(found[i : i + size]) for i in range(len(found) - size + 1)} if size > 1 else set()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The classified passages: ``id``, ``mark``, ``paragraph``, ``line``, ``joined``, ``passage``, ``words``, ``family``, ``probability``, ``contained``, ``confirmed``."""
    model, temperature = train(docs, text_col)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(may_match(F.col("text")))
    source = source.select("id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", r"\n(?:[^\S\n]*\n)+")).alias("paragraph", "block"))
    source = source.filter(may_match(F.col("block"))).select("id", "mark", "paragraph", F.inline(passages(F.col("block"))))
    # A sentence of any length, in windows that overlap by half: none of it is left out.
    halves = F.regexp_extract_all("passage", F.lit(rf"((?:\S+\s*){{1,{WINDOW // 2}}})"), F.lit(1))
    windows = F.zip_with(halves, F.slice(halves, F.lit(2), F.greatest(F.size(halves) - 1, F.lit(1))), lambda x, y: F.concat(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))))
    source = source.withColumn("passage", F.explode(windows)).filter(may_match(F.col("passage")))
    source = once(once(source, "words", words(F.col("passage"))), "shingles", shingles(F.col("words")))
    # What neither speaks of licences on a line nor holds enough of a template counts for nothing.
    source = contained(source)
    source = source.filter((~F.col("joined") & has_anchor(F.col("passage"))) | (F.col("near.share") >= LEAST_CONTAINED))
    raw = model.transform(featured(source.drop("shingles"))).withColumn("p", softmax(vector_to_array("rawPrediction"), temperature))
    best = F.array_max(F.transform("p", lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    raw = raw.withColumn("best", best)
    family = F.get(F.array(*[F.lit(x) for x in classes()]), -F.col("best.i"))
    confirmed = (family != UNKNOWN) & (F.col("best.p") >= LEAST_PROBABILITY) & (F.col("near.share") >= LEAST_CONTAINED) & (F.col("near.family") == family) & (F.col("near.share") > F.col("near.rival"))
    return raw.select("id", "mark", "paragraph", "line", "joined", "passage", "words", family.alias("family"), F.col("best.p").alias("probability"), F.col("near.share").alias("contained"), confirmed.alias("confirmed"))


def per_paragraph(found: DataFrame) -> DataFrame:
    """(``id``, ``mark``, ``paragraph``, ``families``, ``n_confirmed``, ``n_unknown``, ``probability``) of classified passages."""
    yes, joined = F.col("confirmed"), F.col("joined")
    found = found.withColumn("key", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    sets = found.groupBy("id", "mark", "paragraph").agg(
        F.collect_set(F.when(yes & ~joined, F.struct("line", "passage", "family", "key"))).alias("own"),
        F.collect_set(F.when(yes & joined, F.struct("line", "family", "key"))).alias("across"),
        F.collect_set(F.when(~yes & ~joined, F.struct("line", "passage", "key"))).alias("other"),
        F.collect_set(F.when(yes, F.col("family"))).alias("families"),
        F.max(F.when(yes, F.col("probability"))).alias("probability"),
    )
    name = lambda x: F.struct(x["line"].alias("line"), x["family"].alias("family"))
    in_line = F.filter("across", lambda b: F.exists("own", lambda a: (a["family"] == b["family"]) & F.contains(b["key"], a["key"])))
    sets = sets.withColumn("whole", F.array_except(F.transform("across", name), F.transform(in_line, name)))
    sets = sets.withColumn("across", F.filter("across", lambda b: F.array_contains("whole", name(b))))
    unknown = F.filter("other", lambda u: ~F.exists("across", lambda b: F.contains(b["key"], u["key"])))
    return sets.select("id", "mark", "paragraph", "families", (F.size("own") + F.size("whole")).alias("n_confirmed"), F.size(unknown).alias("n_unknown"), "probability")


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id_col``, ``families`` (sorted, by commas), ``n_confirmed``, ``n_unknown``, ``probability`` (the highest confirmed)."""
    per_doc = per_paragraph(scan(docs, id_col, text_col)).groupBy("id", "mark").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))), ",").alias("families"),
        F.sum("n_confirmed").alias("n_confirmed"),
        F.sum("n_unknown").alias("n_unknown"),
        F.max("probability").alias("probability"),
    )
    # Only ids and marks of the documents are dealt to meet the few found.
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"))
    same = rows["id"].eqNullSafe(per_doc["id"]) & (rows["mark"] == per_doc["mark"])
    out = rows.join(per_doc, same, "left")
    return out.select(
        rows["id"].alias(id_col),
        F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"),
        F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"),
        "probability",
    )
