"""Licence scans: a trained paragraph classifier with an unknown class, confirmed by templates."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from assetlake.session import pin

UNKNOWN = "unknown"

# Common notices and passages of public licences, by family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v2.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL version 2 or later.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
    ),
}

# Mentions of licences that name none.
OTHERS = (
    "All rights reserved.", "See the license file for details.", "You need a valid license to drive this vehicle.", "The license was renewed in spring.",
    "Licensed premises close at eleven.", "This work is in its second version.", "The software is released every month.", "Copies of the work are for sale.",
    "General rules of the public library.", "Version 2.0 of the document was published.", "A creative license with the facts.", "Free of charge for any person.",
)

# Plain words that stand before, after or within a notice.
FILLER = "the and of to in is for that with as on it by this was are from or at which one all we our their".split()

# A line is classified in runs of at most RUN words; where one may hold a notice, so are shorter pieces of it, as (words, step).
RUN, STEP = 40, 20
PIECES = ((5, 1), (8, 2), (16, 4))

# Every sign by itself: Java looks up a list of signs in one table, and asks the parts of ranges one by one at six times the cost.
_WORD = "[abcdefghijklmnopqrstuvwxyz0123456789.+-]+"


def tokens(text: str | Column) -> Column:
    """Lower-case words; points stay within words and numbers, not at their ends."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    return F.array_remove(F.transform(parts, lambda w: F.when(w.endswith("."), F.rtrim(w, F.lit("."))).otherwise(w)), "")


def grams(words: str, n: int) -> Column:
    """Runs of ``n`` words; a shorter list is one run."""
    size = F.size(words)
    # The list beside itself moved on by a word: a slice for each run would decode the whole list every time.
    moved = [F.slice(words, i + 1, F.greatest(size - n + 1, F.lit(0))) for i in range(n)]
    joined = functools.reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat_ws(" ", x, y)), moved)
    return F.when(size > n, joined).otherwise(F.array(F.array_join(words, " ")))


def runs(words: str, n: int, step: int) -> Column:
    """Overlapping runs of ``n`` words that begin every ``step`` words and cover the whole list; a shorter list is one run."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(words) - n) / step), F.lit(0)).cast("int"))
    return F.transform(starts, lambda i: F.slice(F.col(words), i * step + 1, n))


def _features(df: DataFrame, places: int) -> DataFrame:
    """Adds the vector of hashed words and word pairs of ``words``."""
    pairs = F.when(F.size("words") > 1, grams("words", 2)).otherwise(F.array().cast("array<string>"))
    both = df.withColumn("_terms", F.concat("words", pairs))
    return HashingTF(numFeatures=places, binary=True, inputCol="_terms", outputCol="features").transform(both).drop("_terms")


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    return spark.createDataFrame(rows, "family string, template string")


def training_rows(docs: DataFrame, text: str, plain_rows: int, seed: int = 3) -> DataFrame:
    """``label, words``: templates whole, with words left out and with plain words or corpus words around them, and
    as unknown the other mentions, plain words, and up to ``plain_rows`` lines of the corpus without a
    licence word, chosen by hash. Every variant comes from hashes, so runs agree."""
    spark = docs.sparkSession
    notices = _templates(spark).unionByName(spark.createDataFrame([(UNKNOWN, t) for t in OTHERS], "family string, template string"))
    draw = lambda *x: F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(1000))
    some = F.array(*[F.lit(w) for w in FILLER])
    words = notices.select("family", tokens("template").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i"))
    kept = F.filter("w", lambda x, k: (F.col("i") < 5) | (draw(x, k, "i", "family") >= 8 * F.col("i").cast("int")))
    filler = lambda at: F.transform(
        F.sequence(F.lit(0), F.pmod(F.xxhash64(F.lit(at), "i", "family"), F.lit(6)).cast("int")),
        lambda k: F.element_at(some, (F.pmod(F.xxhash64(F.lit(at), k, "i"), F.lit(len(FILLER))) + 1).cast("int")))
    around = F.when(F.col("i") % 2 == 0, kept).when(F.col("i") % 4 == 1, F.concat(filler(1), kept)).otherwise(F.concat(kept, filler(2)))
    varied = words.select("family", around.alias("words"))
    plain = spark.range(400).select(F.lit(UNKNOWN).alias("family"), F.transform(
        F.sequence(F.lit(0), (F.col("id") % 12).cast("int")),
        lambda k: F.element_at(some, (F.pmod(F.xxhash64(F.lit(3), k, "id"), F.lit(len(FILLER))) + 1).cast("int"))).alias("words"))
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("line")).filter(
        (F.pmod(F.xxhash64("line"), F.lit(64)) == 0) & ~F.lower("line").rlike("licen|copyright|permi|warrant|redistribut|public"))
    corpus = lines.orderBy(F.xxhash64("line"), "line").limit(plain_rows).select(
        F.lit(UNKNOWN).alias("family"), F.slice(tokens("line"), 1, RUN).alias("words"), F.col("line"))
    # At most plain_rows lines, numbered in one task.
    numbered = corpus.filter(F.size("words") > 0).select("words", (F.row_number().over(W.orderBy(F.xxhash64("line"), "line")) - 1).alias("at")).cache()
    lent = notices.select("family", tokens("template").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i")).withColumn(
        "at", draw("w", "i") % F.lit(max(min(numbered.count(), 1000), 1))).join(numbered, "at")
    room = F.greatest(F.lit(RUN) - F.size("w"), F.lit(0))
    before = F.pmod(F.xxhash64("i", "w"), room + 1).cast("int")
    amid = lent.select("family", F.slice(F.concat(F.slice("words", 1, before), "w", F.slice("words", before + 1, F.lit(RUN))), 1, RUN).alias("words"))
    every = varied.unionByName(plain).unionByName(corpus.drop("line")).unionByName(amid)
    names = F.array(*[F.lit(x) for x in (*TEMPLATES, UNKNOWN)])
    return every.select((F.array_position(names, F.col("family")) - 1).cast("double").alias("label"), "words")


@dataclass(frozen=True)
class Classifier:
    """The trained model, the calibration of its chances, and the least chance for a family."""

    model: LogisticRegressionModel
    places: int
    sharpness: float
    least: float

    @property
    def families(self) -> list[str]:
        return [*TEMPLATES, UNKNOWN]

    def chances(self, df: DataFrame) -> DataFrame:
        """Adds ``family``, ``chance`` and ``doubt``, the chance of unknown, to rows with ``words``; below ``least`` the family is unknown."""
        raw = self.model.setPredictionCol("").setProbabilityCol("").transform(_features(df, self.places))
        # Made once per row: an explode of one element is a bound over which no later condition is moved.
        scaled = F.explode(F.array(F.transform(vector_to_array("rawPrediction"), lambda x: x * self.sharpness)))
        top = F.array_max("_s")
        chance = 1 / F.aggregate(F.zip_with("_s", F.array_repeat(top, len(self.families)), lambda x, t: F.exp(x - t)), F.lit(0.0), lambda a, x: a + x)
        best = F.element_at(F.array(*[F.lit(f) for f in self.families]), F.array_position("_s", top).cast("int"))
        named = raw.withColumn("_s", scaled).drop("features", "rawPrediction").withColumn("chance", F.explode(F.array(chance))).withColumn(
            "doubt", F.col("chance") * F.exp(F.element_at("_s", -1) - top))
        return named.withColumn("family", F.when(F.col("chance") >= self.least, best).otherwise(UNKNOWN)).drop("_s")


def train(docs: DataFrame, text: str = "text", places: int = 1 << 14, plain_rows: int = 2000, precision: float = 0.99) -> Classifier:
    """Multinomial logistic regression on hashed words and pairs of the training rows.

    A fifth of the rows is held out. On it one sharpness of all scores is chosen by the least
    log loss, and then the least chance at which at least ``precision`` of what is called a
    family is of that family. The sample of corpus lines is bounded by ``plain_rows``.
    """
    rows = _features(training_rows(docs, text, plain_rows), places).withColumn("_fold", F.pmod(F.xxhash64("words"), F.lit(5))).coalesce(4).cache()
    try:
        model = LogisticRegression(maxIter=40, regParam=2e-4, featuresCol="features", labelCol="label", family="multinomial").fit(rows.filter("_fold <> 0"))
        raw = model.transform(rows.filter("_fold = 0")).select(F.col("label").cast("int").alias("label"), vector_to_array("rawPrediction").alias("s")).cache()
        tried = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0]

        def chance(of: Column, t: float) -> Column:
            top = F.array_max("s")
            return F.exp((of - top) * t) / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp((x - top) * t))

        true = F.element_at("s", F.col("label") + 1)
        losses = raw.agg(*[F.avg(-F.log(F.greatest(chance(true, t), F.lit(1e-12)))) for t in tried]).first()
        sharpness = tried[min(range(len(tried)), key=lambda i: losses[i])]
        right = (F.array_position("s", F.array_max("s")) - 1) == F.col("label")
        called = raw.withColumn("c", chance(F.array_max("s"), sharpness)).withColumn("right", right).filter(
            F.array_position("s", F.array_max("s")) <= len(TEMPLATES))
        steps = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
        held = called.agg(*[F.avg(F.when(F.col("c") >= c, F.col("right").cast("double"))) for c in steps]).first()
        least = next((c for c, h in zip(steps, held) if h is not None and h >= precision), steps[-1])
        raw.unpersist()
        return Classifier(model, places, sharpness, least)
    finally:
        rows.unpersist()


def scan(docs: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text", shared: float = 0.7) -> DataFrame:
    """``key, text_hash, line, family, chance, likeness, confirmed`` for each family that a line, or a run of it, is called.

    Every line of every text is classified in overlapping runs of 40 words, so that the words around a
    notice are few. Where unknown has a chance under 0.9 the shorter pieces of the run are classified too, as it may
    hold several notices. A call is confirmed when some template of the family
    shares enough with the run: ``shared`` of the template's runs of three words, as the run may hold
    more than the notice, or of the run's own, where it has four words or more, as it may be a part of
    a longer passage; a piece is confirmed by the first alone. A null or empty text has no lines to call; other columns are ignored.
    """
    lines = docs.select(F.col(key), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "_body"))
    words = lines.withColumn("_line", F.explode(F.array(tokens("_body")))).filter(F.size("_line") > 0).select(
        key, "text_hash", "line", F.explode(runs("_line", RUN, STEP)).alias("words"))
    kept = [key, "text_hash", "line", "chance", "words", "family"]
    whole = classifier.chances(words).filter((F.col("family") != UNKNOWN) | (F.col("doubt") < 0.9)).select(*kept)
    whole = pin(whole)
    shorter = F.filter(F.flatten(F.array(*[runs("words", n, step) for n, step in PIECES])), lambda w: F.size(w) < F.size("words"))
    pieces = classifier.chances(whole.select(key, "text_hash", "line", F.explode(F.array_distinct(shorter)).alias("words"))).select(*kept)
    called = whole.withColumn("_piece", F.lit(False)).unionByName(pieces.withColumn("_piece", F.lit(True))).filter(F.col("family") != UNKNOWN)
    # The templates above, a few dozen rows.
    forms = F.broadcast(_templates(docs.sparkSession).withColumn("_t", tokens("template")).withColumn("_runs", F.array_distinct(grams("_t", 3))).select("family", "_runs"))
    common = F.size(F.array_intersect("_own", "_runs"))
    part = F.when(~F.col("_piece") & (F.size("words") >= 4), common / F.size("_own")).otherwise(F.lit(0.0))
    likeness = F.greatest(common / F.size("_runs"), part)
    each = called.withColumn("_own", F.array_distinct(grams("words", 3))).join(forms, "family").withColumn("likeness", likeness)
    best = F.max(F.struct((F.col("likeness") >= shared).alias("confirmed"), "chance", "likeness"))
    return each.groupBy(key, "text_hash", "line", "family").agg(best.alias("_best")).select(
        key, "text_hash", "line", "family", "_best.chance", "_best.likeness", "_best.confirmed")


def licences(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``key, families, n_lines, chance, unconfirmed`` for every row of ``docs``: its confirmed families by name.

    ``n_lines`` counts lines with a confirmed family and ``chance`` is the greatest of them, null without any; ``unconfirmed``
    counts lines that are called a family and have none that a template bears out. Repeated rows, and null keys or texts, are rows with their own result.
    """
    found = scan(docs, train(docs, text), key, text, **how)
    sure = F.col("confirmed")
    lines = found.groupBy(key, "text_hash", "line").agg(
        F.collect_set(F.when(sure, F.col("family"))).alias("_families"), F.max(F.when(sure, F.col("chance"))).alias("_chance"), F.max(sure).alias("_sure"))
    per = lines.groupBy(key, "text_hash").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_families")))), ",").alias("families"), F.count(F.when(F.col("_sure"), 1)).alias("n_lines"),
        F.max("_chance").alias("chance"), F.count(F.when(~F.col("_sure"), 1)).alias("unconfirmed"))
    rows, same = docs.select(F.col(key), F.xxhash64(text).alias("text_hash")), per.withColumnRenamed(key, "_key")
    out = rows.join(same.withColumnRenamed("text_hash", "_hash"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select(
        key, F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), "chance",
        F.coalesce("unconfirmed", F.lit(0)).cast("long").alias("unconfirmed"))
