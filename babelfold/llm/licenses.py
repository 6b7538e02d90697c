"""Licence scans: a trained paragraph classifier, in native Spark functions.

Paragraphs are the runs of non-blank lines of a text, joined; one of more than
WIDTH words is classified in windows of WIDTH words that overlap all but STEP
of them, so a notice may be wrapped or stand anywhere.  Their features are the
words and bigrams of the templates; a multinomial logistic regression with an L1
penalty separates the licence families from ordinary text.  It is trained on
variants of the template notices, which Spark derives by leaving words out and
shortening either end, by themselves and with lines of the corpus around, against
the corpus's own lines.  Every distinct line of all texts is learnt from or
calibrated on, long ones in pieces of WIDTH words; lines with the same features
are one weighted row, and the fixed weight of ordinary text makes the model
independent of the table's size.

Each family is judged by itself, by its odds against ordinary text, so that a
paragraph can hold several notices.  The unknown class is calibrated: a family
must reach the odds that all but ``1 - PURITY`` of held-out ordinary lines (half of
all) stay under.  A family over the bound is confirmed by comparison with its templates:
the share of a template's bigrams that the window holds.  A family whose matching
bigrams all belong to the better match of another one (an attribution licence
inside a share-alike one) is that other one.

No window without a long word of some template can hold that share of a
template's bigrams, so only the others are classified; this changes no result.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import cut

# fixed values: what licence notices say, by family
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0",
                   "you may not use this file except in compliance with the Apache License",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
                   "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the Software without restriction",
            "SPDX-License-Identifier: MIT"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            "Released under the ISC License", "SPDX-License-Identifier: ISC"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3",
                "you can redistribute it and or modify it under the terms of the GNU General Public License",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
                "SPDX-License-Identifier: GPL-3.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted",
            "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License",
              "Licensed under CC BY 4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
                 "Licensed under CC BY-SA 4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
                 "Licensed under CC BY-NC 4.0"],
    "reserved": ["No part of this work may be reproduced without permission, all rights reserved"],
}
NONE = "none"
VARIANTS, ORDINARY = 24, 4.0  # variants of a template; weight of all ordinary lines in training, those of all notices being 1
PURITY, CONFIRM, LONG, ORDINARY_SHARE = 0.9995, 0.7, 5, 0.3
WIDTH, STEP = 64, 16
WORD = r"[a-z0-9]+(?:[.][0-9]+)*"
BLANK_LINES = r"\n(?:[\x20\x09\x0B-\x0D]*+\n)++"


def words(text: Column) -> Column:
    """Lower-cased words and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def bigrams(w: Column) -> Column:
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))),
                      lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.coalesce(F.get(w, i), F.lit(""))))
    return F.when(F.size(w) > 1, two).otherwise(F.slice(w, 1, 0))


def _template_bigrams() -> list[tuple[str, list[str]]]:
    out = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            w = re.findall(WORD, t.lower())
            two = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
            # the words that candidates are looked up by must reach every confirmed paragraph
            assert sum(not any(len(x) >= LONG for x in p.split()) for p in two) < CONFIRM * len(two), t
            out.append((family, two))
    return out


def _long_words() -> str:
    found = sorted({w for ts in TEMPLATES.values() for t in ts for w in re.findall(WORD, t.lower()) if len(w) >= LONG})
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(found) + r")(?![a-z0-9])"


def _share(two: Column) -> Column:
    """The largest share of a template's bigrams among the bigrams ``two``."""
    table = F.array(*[F.array(*map(F.lit, b)) for _, b in _template_bigrams()])
    return F.coalesce(F.array_max(F.transform(table, lambda b: F.size(F.array_intersect(two, b)) / F.size(b))), F.lit(0.0))


def _confirmed(two: Column, odds: Column, families: list[str], bound: float) -> Column:
    """Array of (family, probability, share) of the families over the bound whose
    template share is high enough and that are not part of a better match."""
    number = {f: i for i, f in enumerate(families)}
    table = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(number[f]).alias("at"), F.array(*map(F.lit, b)).alias("b")) for f, b in _template_bigrams()])
    likely = F.filter(table, lambda x: F.get(odds, x["at"]) >= bound)
    found = F.transform(likely, lambda x: F.struct(x["family"].alias("family"), F.get(odds, x["at"]).alias("probability"),
                                                   (F.size(F.array_intersect(two, x["b"])) / F.size(x["b"])).alias("share"),
                                                   F.array_intersect(two, x["b"]).alias("held")))
    sure = F.filter(found, lambda x: x["share"] >= CONFIRM)

    def alone(all_):
        part = lambda x: F.exists(all_, lambda y: (y["family"] != x["family"]) & (F.size(y["held"]) > F.size(x["held"]))
                                  & (F.size(F.array_except(x["held"], y["held"])) == 0))
        return F.transform(F.filter(all_, lambda x: ~part(x)), lambda x: F.struct(x["family"].alias("family"), x["probability"].alias("probability"),
                                                                                 x["share"].alias("share")))
    return F.element_at(F.transform(F.array(sure), alone), 1)


def _features() -> tuple[list[str], list[str]]:
    """The words and the bigrams of the templates."""
    two = {b for _, bs in _template_bigrams() for b in bs}
    return sorted({x for b in two for x in b.split()}), sorted(two)


def _grams(w: Column) -> Column:
    """The template words and bigrams among words ``w``, each once, in one order."""
    ones, twos = _features()
    # words the templates do not have are null, and so are the bigrams of them
    known = F.transform(w, lambda x: F.when(x.isin(ones), x))

    def grams(k):
        pairs = F.zip_with(k, F.slice(k, 2, F.size(k)), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_sort(F.array_union(F.filter(k, lambda x: x.isNotNull()), F.filter(pairs, lambda x: x.isin(twos))))
    return F.element_at(F.transform(F.array(known), grams), 1)


def _vectors(df: DataFrame) -> DataFrame:
    ones, twos = _features()
    return CountVectorizerModel.from_vocabulary(ones + twos, inputCol="grams", outputCol="features", minTF=1.0, binary=True).transform(df)


class Model:
    """Families, fitted regression and the calibrated bound of the unknown class."""

    def __init__(self, families: list[str], fitted, bound: float):
        self.families, self.fitted, self.bound = families, fitted, bound

    def odds(self, df: DataFrame) -> DataFrame:
        """Adds ``odds`` for ``grams``: of each class, its probability against ordinary text alone."""
        scored = self.fitted.transform(_vectors(df)).withColumn("p", vector_to_array("probability"))
        odds = F.transform("p", lambda x: x / (x + F.get(F.col("p"), F.lit(0)) + F.lit(1e-300)))
        return scored.withColumn("odds", odds).drop("grams", "features", "rawPrediction", "probability", "prediction", "p")


def _ordinary(docs: DataFrame) -> DataFrame:
    """``(grams, held, n)``: the distinct lines of all texts, long ones in pieces of
    WIDTH words, but for those like a template, counted by their features; ``held``
    are those that training leaves for the calibration."""
    def pieces(w):
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.size(w), F.lit(WIDTH)), lambda a: F.slice(w, a, WIDTH)))
    lines = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line"))
    lines = lines.select(F.explode(F.element_at(F.transform(F.array(words(F.col("line"))), pieces), 1)).alias("w"))
    # one string of grams takes less of a shuffle than an array
    seen = lines.select(F.xxhash64("w").alias("h"), F.array_join(_grams(F.col("w")), ",").alias("grams")).distinct()
    # written before it is filtered: Spark would take the words again for the filter
    counted = cut(seen.groupBy("grams", (F.pmod("h", F.lit(2)) == 1).alias("held")).agg(F.count(F.lit(1)).alias("n")))
    grams = F.when(F.col("grams") == "", F.array().cast("array<string>")).otherwise(F.split("grams", ","))
    two = F.filter(grams, lambda x: F.contains(x, F.lit(" ")))
    return cut(counted.filter(~F.contains("grams", F.lit(" ")) | (_share(two) < ORDINARY_SHARE)).select(grams.alias("grams"), "held", "n"))


def _variants(spark: SparkSession) -> DataFrame:
    """``(label, grams, i)``: VARIANTS of every template, numbered."""
    texts = [(list(TEMPLATES).index(f) + 1.0, t) for f, ts in TEMPLATES.items() for t in ts]
    base = spark.createDataFrame([(label, t, k) for k, (label, t) in enumerate(texts)], "label double, text string, k int")
    base = base.select("label", words(F.col("text")).alias("w"), "k", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("v"))
    short = (F.when(F.col("v") % 4 == 1, F.expr("filter(w, (x, i) -> i <> v % size(w))"))
             .when((F.col("v") % 4 == 2) & (F.size("w") > 6), F.expr("slice(w, 1, size(w) - 1)"))
             .when((F.col("v") % 4 == 3) & (F.size("w") > 6), F.expr("slice(w, 2, size(w) - 1)")).otherwise(F.col("w")))
    return cut(base.withColumn("w", short).select("label", _grams(F.col("w")).alias("grams"), (F.col("k") * VARIANTS + F.col("v")).alias("i")).coalesce(1))


BINS = 1000


def _bound(values: DataFrame, total: int) -> float:
    """The least value of ``values(value, n)`` that at most ``1 - PURITY`` of the
    ``total`` counts lie over, 0.5 at least.  Exact: the range that holds it is
    narrowed by counts in BINS parts, which are all the driver gets."""
    values, over = values.filter("value > 0.5"), (1 - PURITY) * total
    low, high = values.agg(F.min("value"), F.max("value")).first()
    while low is not None and low < high:
        part = F.floor((F.col("value") - low) / F.lit(high - low) * (BINS - 1))
        for r in sorted(values.filter(F.col("value").between(low, high)).groupBy(part.alias("part")).agg(
                F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect(), reverse=True):
            if r.n > over:
                low, high = r.low, r.high
                break
            over -= r.n
        else:  # all of the values may be over
            return 0.5
    n = values.filter(F.col("value") == low).agg(F.sum("n")).first()[0] if low is not None else None
    return low if n is not None and n > over else 0.5


def train(docs: DataFrame) -> Model:
    """The classifier for ``docs(text)``, learnt from and calibrated on all of its lines."""
    spark = docs.sparkSession
    lines, variants = _ordinary(docs), _variants(spark)
    plain, held = lines.filter(~F.col("held")), lines.filter("held")
    count, rows = plain.agg(F.sum("n"), F.count(F.lit(1))).first()
    notices = len(_template_bigrams()) * VARIANTS
    # a variant weighs one half by itself, one half with the lines around it: each kind of
    # line stands around one variant, or around several if there are more variants
    parts = min(notices, max(rows, 1))
    around = (plain.withColumn("part", F.pmod(F.xxhash64("grams"), F.lit(parts)))
              .join(F.broadcast(variants.select("label", F.col("grams").alias("notice"), F.pmod("i", F.lit(parts)).alias("part"))), "part")
              .select("label", F.array_union("notice", "grams").alias("grams"), F.lit(0.5 * parts / max(rows, 1)).alias("weight")))
    data = (around.union(variants.select("label", "grams", F.lit(0.5)))
            .union(plain.select(F.lit(0.0), "grams", F.col("n") * F.lit(ORDINARY * notices / (count or 1))))
            .union(spark.createDataFrame([(0.0, [], 1.0)], "label double, grams array<string>, weight double")))
    data = cut(_vectors(data).select("label", "features", "weight"))
    fitted = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=0.002, maxIter=30, standardization=False, weightCol="weight").fit(data)
    model = Model([NONE, *TEMPLATES], fitted, 0.5)
    best = F.array_max(F.slice("odds", 2, len(TEMPLATES) + 1))
    scored = cut(model.odds(held).select(best.alias("value"), "n"))
    model.bound = _bound(scored, scored.agg(F.sum("n")).first()[0] or 0)
    return model


def windows(text: Column) -> Column:
    """Array of (paragraph, words) of a text's paragraphs, long ones in overlapping windows."""
    def cut_up(p, i):
        def slices(w):
            many = F.size(w) > WIDTH
            starts = F.when(many, F.sequence(F.lit(0), F.size(w) - WIDTH + STEP - 1, F.lit(STEP))).otherwise(F.array(F.lit(0)))
            return F.transform(starts, lambda a: F.struct(i.alias("paragraph"), F.slice(w, a + 1, WIDTH).alias("w")))
        # a paragraph's words are taken once, not once a window
        return F.element_at(F.transform(F.array(words(p)), slices), 1)
    return F.flatten(F.transform(F.split(text, BLANK_LINES), cut_up))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, n_paragraphs, notices)`` for every row of ``docs(doc_id, text)``:
    the array of ``(paragraph, family, probability, share)`` of its licence notices,
    a family once a paragraph; paragraphs count from 0.

    ``n_paragraphs`` counts the paragraphs with a word.  A null, empty or blank
    text has none.  Very long texts are scanned whole.  Repeated rows are
    answered each, null ids too.  Other columns are ignored; an empty table gives
    no rows.
    """
    model = model or train(docs)
    src = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long_, known = _long_words(), F.array(*map(F.lit, sorted({w for ts in TEMPLATES.values() for t in ts for w in re.findall(WORD, t.lower()) if len(w) >= LONG})))
    likely = F.filter(windows(F.col("text")), lambda x: F.arrays_overlap(x["w"], known))
    none = F.filter(F.array(F.struct(F.lit(0).alias("paragraph"), F.array().cast("array<string>").alias("w"))), lambda x: F.lit(False))
    rows = src.select("row", "doc_id",
                      F.size(F.filter(F.split("text", BLANK_LINES), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))).cast("long").alias("n_paragraphs"),
                      F.explode_outer(F.when(F.rlike("text", F.lit(long_)), likely).otherwise(none)).alias("p"))
    rows = rows.select("row", "doc_id", "n_paragraphs", "p.paragraph", F.coalesce(F.col("p.w"), F.array().cast("array<string>")).alias("w"))
    rows = cut(rows.withColumn("two", bigrams(F.col("w"))))
    scored = model.odds(rows.withColumn("grams", F.concat("w", "two")))
    found = scored.select("row", "doc_id", "n_paragraphs", "paragraph", F.explode_outer(
        _confirmed(F.col("two"), F.col("odds"), model.families, model.bound)).alias("n"))
    # of the overlapping windows of a paragraph the best match of a family counts
    best = found.groupBy("row", "paragraph", "n.family").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_paragraphs").alias("n_paragraphs"), F.max(F.struct("n.share", "n.probability")).alias("m"))
    notice = F.when(F.col("family").isNotNull(), F.struct("paragraph", "family", F.col("m.probability").alias("probability"), F.col("m.share").alias("share")))
    return best.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_paragraphs").alias("n_paragraphs"),
                                   F.array_sort(F.collect_list(notice)).alias("notices")).drop("row")
