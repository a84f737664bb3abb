"""Licence scans: a trained classifier of paragraphs, confirmed by comparison with templates.

Only DataFrame operations and Spark's own logistic regression. A paragraph is a line, or lines that are
wrapped. It is a candidate if it has a share of some template's word pairs, which depends on the paragraph
alone. Features of the regression are runs of one to three words; its classes are the licence families
and 'unknown', which is trained on background and on parts of templates.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dirgauge.llm.quantiles import quantiles
from dirgauge.session import materialise

#: Notices by family (fixed values).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "Licensed under the GNU General Public License, version 3."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "This document is confidential and proprietary and may not be copied or distributed without prior written permission."),
]
#: A made paragraph (a template with a word left out, a part of one) weighs as much as one in so many paragraphs of background.
MADE_SHARE = 4_000
#: Share of calibration paragraphs of class 'unknown' that may be taken for a licence.
FALSE_ACCEPTS = 0.01
#: Least share of a template's word pairs that a candidate has.
CANDIDATE = 0.3
#: Least share of a template's word pairs that a paragraph must have to be confirmed.
CONTAINED = 0.6
#: Line breaks between paragraphs: after the end of a sentence (or a mark that no wrapped line ends with), and beside blank lines.
BREAK = r"""\n(?<=[^\p{L}\p{N}\s,;:"'()\-]["')\]]{0,2}[ \t\r]{0,8}\n)|\n(?=[ \t\r]*(?:\n|\z))|\n(?<=\n[ \t\r]{0,8}\n)"""


def _words(text: Column) -> Column:
    """Lower-case words without full stops at their ends."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}.]+")
    return F.filter(F.transform(words, lambda w: F.rtrim(w, F.lit("."))), lambda w: w != "")


def _pairs(words: Column) -> Column:
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    both = F.zip_with(words, after, lambda a, b: F.concat(a, F.lit(" "), b))  # NULL for the last word
    return F.filter(both, lambda x: x.isNotNull())


def _runs(words: str, n: int) -> Column:
    last = F.size(words) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(
        F.array().cast("array<string>")
    )


def _grams_of(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _once(column: Column) -> Column:
    """A column that later filters and columns read instead of computing it again."""
    return F.explode(F.array(column))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (number of its first line, from 0), text: wrapped lines are one paragraph.

    A line is wrapped where it ends without the end of a sentence and no blank line follows. NULL texts
    and paragraphs without a letter or digit give no row.
    """
    inner = lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))
    lines = F.flatten(F.transform(F.split("text", BREAK), lambda p: F.concat(F.array(p), F.array_repeat(F.lit(""), inner(p)))))
    return docs.select("doc_id", F.posexplode(lines).alias("paragraph", "text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))


def _templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "family string, text string").withColumn("words", _words(F.col("text")))


class Templates:
    """The word pairs of the templates, a fixed few, as literals."""

    def __init__(self, spark: SparkSession):
        rows = _templates(spark).select("family", "words", F.array_distinct(_pairs(F.col("words"))).alias("pairs")).collect()
        self.words = [r["words"] for r in rows]
        self.families = [r["family"] for r in rows]
        literal = lambda values: F.array(*[F.lit(v) for v in values])
        self.singles = literal(sorted({w for words in self.words for w in words}))
        self.pairs = literal(sorted({x for r in rows for x in r["pairs"]}))
        self.triples = literal(sorted({x for words in self.words for x in _grams_of(words) if x.count(" ") == 2}))
        self.each = F.array(*[F.struct(F.lit(r["family"]).alias("family"), literal(r["pairs"]).alias("pairs")) for r in rows])

    def share(self, hits: str, family: str | None = None) -> Column:
        """The largest share of a template's pairs that are among `hits`, of all templates or of a family's."""
        each = F.filter(self.each, lambda t: t["family"] == F.col(family)) if family else self.each
        share = F.transform(each, lambda t: F.size(F.array_intersect(t["pairs"], F.col(hits))) / F.size(t["pairs"]))
        return F.coalesce(F.array_max(share), F.lit(0.0))

    def compared(self, rows: DataFrame) -> DataFrame:
        """`rows` (words; others stay) with `hits`, their template pairs."""
        return rows.select("*", _once(F.array_intersect(_pairs(F.col("words")), self.pairs)).alias("hits"))

    def grams(self) -> Column:
        """The runs of one to three of `words` that templates have, each once; `hits` are those of two. A run of three has two of them."""
        triples = F.when(F.size("hits") > 1, F.array_intersect(_runs("words", 3), self.triples)).otherwise(F.array().cast("array<string>"))
        return F.sort_array(F.concat(F.array_intersect(F.col("words"), self.singles), F.col("hits"), triples))


def sifted(docs: DataFrame, templates: Templates) -> DataFrame:
    """doc_id, paragraph, candidate, h (hash of the text), grams (of what is no candidate), words and hits (of candidates) of all paragraphs.

    A candidate has `CANDIDATE` of a template's word pairs or more. No count and no sample decides who they are, so
    nothing that could be confirmed is left out.
    """
    texts = paragraphs(docs).select("doc_id", "paragraph", F.xxhash64("text").alias("h"), _once(_words(F.col("text"))).alias("words"))
    share = F.when(F.size("hits") > 0, templates.share("hits")).otherwise(0.0)
    rows = templates.compared(texts).select("*", _once(share >= CANDIDATE).alias("candidate"))
    some = [F.when(F.col("candidate"), F.col(c)).alias(c) for c in ("words", "hits")]
    return rows.select("doc_id", "paragraph", "candidate", "h", F.when(~F.col("candidate"), templates.grams()).alias("grams"), *some)


def candidates(docs: DataFrame, templates: Templates) -> DataFrame:
    """doc_id, paragraph, words, hits of all candidates."""
    return sifted(docs, templates).where("candidate").select("doc_id", "paragraph", "words", "hits")


class Classifier:
    """Templates, vocabulary, regression and threshold."""

    def __init__(self, templates: Templates, vectors: CountVectorizerModel, model: LogisticRegressionModel, classes: list[str], least: float):
        self.templates, self.vectors, self.model, self.classes, self.least = templates, vectors, model, classes, least

    def scored(self, rows: DataFrame) -> DataFrame:
        """`rows` (words; others stay) with the best family and its probability."""
        return _scored(rows, self.vectors, self.model, self.classes)


def _grams(rows: DataFrame) -> DataFrame:
    return rows.withColumn("grams", F.concat(*[_runs("words", n) for n in (1, 2, 3)]))


def _scored(rows: DataFrame, vectors: CountVectorizerModel, model: LogisticRegressionModel, classes: list[str]) -> DataFrame:
    return _probabilities(vectors.transform(_grams(rows)), model, classes)


def _probabilities(features: DataFrame, model: LogisticRegressionModel, classes: list[str]) -> DataFrame:
    found = model.transform(features).select("*", _once(vector_to_array("probability")).alias("p"))
    families = F.slice("p", 1, len(classes) - 1)  # the last class is 'unknown'
    best = F.array_max(families)
    names = F.array(*[F.lit(c) for c in classes])
    return found.withColumn("probability", best).withColumn("family", F.element_at(names, F.array_position(families, best).cast("int")))


def _background(lines: DataFrame, parts: list, templates: Templates, classes: list[str]) -> DataFrame:
    """label, aside, grams, weight: what every different paragraph of `lines` (h, grams) teaches, alike rows summed up.

    Each teaches 'unknown', alone and beside a part of a template; a quarter also the family of a template beside which
    they are put. Half of those of 'unknown' are set `aside`. The hash of the text decides all that.
    """
    once = lines.select("h", "grams").distinct()  # a text that is repeated counts once
    turn, wheel = F.pmod("h", F.lit(4)).alias("turn"), len(parts) * len(templates.words)
    alike = once.groupBy(turn, F.pmod(F.shiftright("h", 3), F.lit(wheel)).cast("int").alias("nth"), "grams").agg(F.count("*").cast("double").alias("weight"))
    beside = lambda values: F.array_union("grams", F.element_at(F.array(*[F.array(*[F.lit(w) for w in v]) for v in values]), F.col("nth") % len(values) + 1))
    unknown = F.lit(len(classes) - 1)
    family = F.element_at(F.array(*[F.lit(classes.index(f)) for f in templates.families]), F.col("nth") % len(templates.words) + 1)
    row = lambda label, grams: F.struct(label.alias("label"), grams.alias("grams"))
    made = F.when(F.col("turn") == 0, row(family, beside([_grams_of(w) for w in templates.words])))
    taught = F.array(row(unknown, F.col("grams")), row(unknown, beside([_grams_of(w) for w in parts])), made)
    rows = alike.select("turn", "weight", F.explode(F.filter(taught, lambda x: x.isNotNull())).alias("x"))
    aside = F.col("turn") % 2 == 1
    return rows.groupBy("x.label", aside.alias("aside"), F.sort_array("x.grams").alias("grams")).agg(F.sum("weight").alias("weight"))


def train(docs: DataFrame, false_accepts: float = FALSE_ACCEPTS) -> Classifier:
    """Fit on made paragraphs of the templates and on all paragraphs of `docs`.

    A family is taught by its templates, whole, with single words left out, and beside background;
    'unknown' by background and by parts of templates (a third of the words, under `CONTAINED` of any
    template), alone and beside background. Half of the background calibrates: the
    threshold is the probability that the best family exceeds for `false_accepts` of it, at least a
    half. Without background it is a half. The vocabulary is the templates' runs of one to three words, so that
    paragraphs alike in these are one row with a weight. Made paragraphs weigh more where there is more
    background (`MADE_SHARE`), so that the size of `docs` does not decide what they count.
    """
    templates = Templates(docs.sparkSession)
    return _fit(sifted(docs, templates).where("NOT candidate"), templates, false_accepts)


def _fit(lines: DataFrame, templates: Templates, false_accepts: float) -> Classifier:
    spark = lines.sparkSession
    classes = sorted(set(templates.families)) + ["unknown"]
    given = _templates(spark).select("family", "words")
    left_out = given.select("family", F.explode(F.sequence(F.lit(0), F.size("words"))).alias("i"), "words").select(
        "family", F.concat(F.slice("words", F.lit(1), F.greatest(F.col("i") - 1, F.lit(0))), F.slice("words", F.col("i") + 1, F.size("words"))).alias("words")
    )
    third = F.ceil(F.size("words") / 3).cast("int")
    parts = given.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - third + 1), lambda i: F.slice("words", i, third))).alias("words"))
    parts = templates.compared(parts.distinct()).where(templates.share("hits") < CONTAINED).select("words")
    parts = [r["words"] for r in parts.orderBy(F.array_join("words", " ")).collect()]  # the same few for every corpus
    background = materialise(_background(lines, parts, templates, classes), "licence-background")
    n = background.where(F.col("label") == len(classes) - 1).agg(F.sum("weight")).first()[0] or 0
    made = left_out.unionByName(spark.createDataFrame([("unknown", w) for w in parts], "family string, words array<string>"))
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")).cast("int") - 1
    made = templates.compared(made).select(label.alias("label"), templates.grams().alias("grams"), F.lit(max(1.0, n / 2 / MADE_SHARE)).alias("weight"))
    # half of 'unknown' is taught; families are of the even hashes
    taught = background.where("NOT aside").drop("aside").unionByName(made).withColumn("label", F.col("label").cast("double"))
    vectors = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=1 << 14).fit(_grams(given))
    model = LogisticRegression(family="multinomial", regParam=0.001, maxIter=60, weightCol="weight").fit(vectors.transform(taught))
    aside = _probabilities(vectors.transform(background.where("aside")), model, classes)
    aside = aside.select(F.lit("").alias("all"), "probability", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))).alias("i"))
    least = quantiles(aside, "all", "probability", [1 - false_accepts], "i").first()
    return Classifier(templates, vectors, model, classes, max(0.5, least["q"][0] if least else 0.0))


def scan(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, paragraph, family, probability, contained: a row per candidate paragraph of `docs`.

    family is 'unknown' where the probability stays under the threshold or no template of the family
    has `CONTAINED` of its word pairs in the paragraph; contained is the largest share. Ties between
    families go to the first by name. Repeated rows give repeated results; NULL texts give none.
    """
    return _judged(candidates(docs, classifier.templates), classifier)


def find(docs: DataFrame, false_accepts: float = FALSE_ACCEPTS) -> DataFrame:
    """The `scan` of `docs` by the classifier that they `train`; texts are read and taken apart once for both."""
    templates = Templates(docs.sparkSession)
    rows = materialise(sifted(docs, templates), "licence-paragraphs")
    return _judged(rows.where("candidate"), _fit(rows.where("NOT candidate"), templates, false_accepts))


def _judged(found: DataFrame, classifier: Classifier) -> DataFrame:
    templates = classifier.templates
    found = classifier.scored(found).select("*", _once(templates.share("hits", "family")).alias("contained"))
    sure = (F.col("probability") >= classifier.least) & (F.col("contained") >= CONTAINED)
    return found.select("doc_id", "paragraph", F.when(sure, F.col("family")).otherwise("unknown").alias("family"), "probability", "contained")
