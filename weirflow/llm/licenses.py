"""Licence families of paragraphs: a trained n-gram classifier, confirmed against templates.

A softmax regression on word 1- to 3-grams is trained on the driver from the
notice templates below (each in several worded variants) and from sentences
that speak of licences without granting one (class ``unknown``).  Its
temperature is calibrated on variants held out from training.  Scoring is
DataFrame operations only: lines with a cue word, and windows over several
lines that hold one, are normalised and collapsed to distinct wordings, their n-grams join the weight table (its size is
that of the templates), scores are summed per wording, and a family counts only
if its calibrated probability and its overlap with a template are high enough.

Null or empty texts have no paragraphs; a paragraph without cue word or known
n-gram is not reported; repeated rows are reported as often as they come.
"""

from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.storage import Scratch

#: Wordings of public licence notices, by family.
TEMPLATES = {
    "MIT": ["released under the mit license", "licensed under the mit license", "this software is distributed under the terms of the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["licensed under the apache license version 2 0", "released under the apache license 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses"],
    "GPL-3.0": ["this work is licensed under the gnu general public license version 3", "released under the gpl version 3", "you can redistribute it and or modify it under the terms of the gnu general public license version 3"],
    "GPL-2.0": ["this work is licensed under the gnu general public license version 2", "released under the gpl version 2", "you can redistribute it and or modify it under the terms of the gnu general public license version 2"],
    "LGPL": ["licensed under the gnu lesser general public license", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "AGPL": ["licensed under the gnu affero general public license", "you can redistribute it and or modify it under the terms of the gnu affero general public license"],
    "BSD": ["released under the bsd license", "licensed under the bsd 3 clause license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "MPL-2.0": ["licensed under the mozilla public license version 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"],
    "ISC": ["released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CC-BY-SA": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CC0": ["released under cc0 1 0", "dedicated to the public domain under cc0 1 0 universal"],
    "proprietary": ["all rights reserved no part may be reproduced without permission", "copyright all rights reserved"],
}
UNKNOWN = [
    "a driver license is required to rent a car", "the bar lost its liquor license last year", "the city may license street vendors", "licensed plumbers and electricians only", "she has a license to teach",
    "the copyright office is closed on sunday", "permission was denied by the court", "the general public is invited to the library", "the apache helicopter landed near the base",
    "he studied at mit and moved to berlin", "version 3 of the report was published", "a creative idea and a common goal", "the terms of the treaty were rejected", "the license expired and was not renewed",
]
CUES = r"(?i)(\blicen[cs]|\bcopyright|\bpermission|\bredistribut|\b[al]?gpl\b|rights\s+reserved|public\s+domain|\bcc0\b)"
CLASSES = (*TEMPLATES, "unknown")
#: Families that only their version tells apart: without its number as a word there is no telling which it is.
VERSIONED = {"GPL-3.0": "3", "GPL-2.0": "2"}


def grams(words: list[str], upto: int = 3) -> list[str]:
    return [" ".join(words[i : i + k]) for k in range(1, upto + 1) for i in range(len(words) - k + 1)]


def variants(text: str, rng: random.Random, n: int) -> list[list[str]]:
    """Worded variants of a notice: the words themselves, with words around them, or with one left out."""
    filler = "the project code text work data and all files of this page by its authors for more see below note".split()
    words, out = text.split(), [text.split()]
    for _ in range(n - 1):
        w = list(words)
        if len(w) > 6 and rng.random() < 0.4:
            w.pop(rng.randrange(len(w)))
        out.append(rng.choices(filler, k=rng.randrange(4)) + w + rng.choices(filler, k=rng.randrange(6)))
    return out


#: Characters of texts with a cue whose windows one task makes.
TASK_CHARS = 1 << 19


def train(seed: int = 5, per_template: int = 12, rounds: int = 200) -> tuple[dict[str, list[float]], list[float], float, float]:
    """(weights by n-gram, bias, temperature, held-out accuracy)."""
    rng, data, held = random.Random(seed), [], []
    for c, name in enumerate(CLASSES):
        for t in TEMPLATES.get(name, UNKNOWN):
            for i, w in enumerate(variants(t, rng, per_template)):
                (held if i % 4 == 3 else data).append((Counter(grams(w)), c))
    k = len(CLASSES)
    w, bias = {}, [0.0] * k

    def logits(x):
        z, norm = list(bias), math.sqrt(sum(v * v for v in x.values())) or 1.0
        for g, v in x.items():
            if g in w:
                z = [a + b * v / norm for a, b in zip(z, w[g], strict=True)]
        return z, norm

    def soft(z):
        top = max(z)
        e = [math.exp(a - top) for a in z]
        return [a / sum(e) for a in e]

    for r in range(rounds // 10):
        rng.shuffle(data)
        rate = 2.0 / (1 + 0.1 * r)
        for x, c in data:
            z, norm = logits(x)
            err = [a - (i == c) for i, a in enumerate(soft(z))]
            bias = [b - 0.02 * e for b, e in zip(bias, err, strict=True)]
            for g, v in x.items():
                w[g] = [a - rate * e * v / norm for a, e in zip(w.get(g, [0.0] * k), err, strict=True)]
    scored = [(logits(x)[0], c) for x, c in held]
    loss = {t: -sum(math.log(max(1e-12, soft([a / t for a in z])[c])) for z, c in scored) for t in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    return w, bias, min(loss, key=loss.get), sum(max(range(k), key=z.__getitem__) == c for z, c in scored) / len(scored)


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def gram_column(words: Column, k: int) -> Column:
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))


def windows(words: Column, size: int, step: int) -> Column:
    """Slices of ``size`` words, one each ``step``: a run of ``size - step`` words lies whole in one."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (size - step), F.lit(1)), F.lit(step)), lambda i: F.slice(words, i, size))


def judge(parts: DataFrame, model: tuple, sure: float, overlap: float) -> DataFrame:
    """``parts`` with family, probability, similarity and confirmed in place of ``norm``; those without a known n-gram go."""
    spark = parts.sparkSession
    weights, bias, heat, _ = model
    table = spark.createDataFrame([(g, [float(x) for x in v]) for g, v in weights.items()], "g string, w array<double>")
    wordings = parts.select("norm").distinct()
    split = F.split("norm", " ")
    g = wordings.select("norm", F.explode(F.concat(*[gram_column(split, k) for k in (1, 2, 3)])).alias("g")).groupBy("norm", "g").agg(F.count("*").alias("n"))
    # n-grams are normalised by the length of the known ones, as in training on short notices
    hits = g.join(F.broadcast(table), "g")  # bounded by the templates
    sums = hits.groupBy("norm").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"), *[F.sum(F.col("n") * F.col("w")[i]).alias(f"z{i}") for i in range(len(CLASSES))])
    z = F.array(*[(F.lit(bias[i]) + F.col(f"z{i}") / F.col("len")) / heat for i in range(len(CLASSES))])
    named = sums.select("norm", z.alias("z")).withColumn("top", F.array_max("z")).withColumn("e", F.transform("z", lambda x: F.exp(x - F.col("top"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    named = named.select("norm", F.element_at(F.lit(list(CLASSES)), F.array_position("z", F.col("top")).cast("int")).alias("best"), (F.lit(1.0) / total).alias("probability"))
    own = gram_column(F.split("norm", " "), 2)
    likeness = F.greatest(*[F.when(F.col("best") == name, F.size(F.array_intersect(own, F.array(*[F.lit(x) for x in t2]))) / len(t2)).otherwise(0.0) for name, ts in TEMPLATES.items() for t in ts if (t2 := sorted({x for x in grams(t.split(), 2) if " " in x}))])
    told = F.lit(True)
    for name, number in VERSIONED.items():
        told = told & ((F.col("best") != name) | F.col("norm").rlike(rf"\bv?{number}\b"))
    judged = named.withColumn("similarity", likeness).withColumn("confirmed", told & (F.col("best") != "unknown") & (F.col("probability") >= sure) & (F.col("similarity") >= overlap))
    judged = judged.select("norm", F.when(F.col("confirmed"), F.col("best")).otherwise("unknown").alias("family"), "probability", "similarity", "confirmed")
    return parts.join(judged, "norm").drop("norm")


def licence_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.5, overlap: float = 0.6, window: int = 60) -> DataFrame:
    """doc_id, paragraph (number of the line, from 0), family, probability, similarity, confirmed.

    Long lines are scored by windows of ``window`` words around their cues so that a notice inside
    running text is seen; a window that is not confirmed has the family ``unknown``.  A notice wrapped
    over lines is sought in windows of the joined lines that are not confirmed alone, and reported once,
    at its first line with a cue; what its lines give by themselves is reported as well.
    """
    s = Scratch(docs.sparkSession, "licences")
    model = train()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).where(F.col("t").rlike(CUES))
    texts = s.save(texts.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split("t", "\n", -1).alias("lines"), F.length("t").alias("size")), "texts")
    lines = texts.select("doc_id", "row", F.posexplode("lines").alias("paragraph", "line")).where(F.col("line").rlike(CUES))
    words = lines.select("doc_id", "row", "paragraph", normal_words(F.col("line")).alias("w"))
    parts = words.select("doc_id", "row", "paragraph", (F.size("w") <= window).alias("short"), F.explode(F.transform(windows(F.col("w"), window, window // 2), lambda x: F.array_join(x, " "))).alias("norm")).where(F.col("norm").rlike(CUES))
    single = s.save(judge(s.save(parts, "parts"), model, sure, overlap), "single")

    # the words of all other lines with their line numbers
    known = single.where("confirmed and short").groupBy("row").agg(F.collect_set("paragraph").alias("known"))
    numbered = F.flatten(F.transform("lines", lambda x, i: F.when(F.coalesce(F.array_contains("known", i), F.lit(False)), F.array().cast("array<struct<i:int,w:string>>")).otherwise(F.transform(normal_words(x), lambda w: F.struct(i.alias("i"), w.alias("w"))))))
    cues = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(CUES), i)), lambda i: i.isNotNull())
    # the windows of a text take far longer than reading it, so tasks follow the characters, not the size of the files
    wrapped = texts.where(F.size("lines") > 1)
    chars = wrapped.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    wrapped = wrapped.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / TASK_CHARS)), "row")
    joined = wrapped.join(known, "row", "left").select("doc_id", "row", numbered.alias("w"), cues.alias("cues")).where(F.size("w") > 0)
    joined = joined.select("doc_id", "row", "cues", F.explode(F.concat(*[windows(F.col("w"), n, k) for n, k in ((window, window // 2), (window * 2 // 3, window // 6), (window // 3, window // 12))])).alias("x"))
    joined = joined.select("doc_id", "row", "cues", F.array_min("x.i").alias("lo"), F.array_max("x.i").alias("hi"), F.array_join("x.w", " ").alias("norm")).where("lo < hi").where(F.col("norm").rlike(CUES))
    first = F.coalesce(F.array_min(F.filter("cues", lambda i: i.between(F.col("lo"), F.col("hi")))), F.col("lo"))
    joined = s.save(joined.select("doc_id", "row", first.alias("paragraph"), "lo", "hi", "norm"), "joined")
    # windows of one family that overlap are one notice; one within a long line has been seen there
    run = Window.partitionBy("row", "family").orderBy("lo", "hi")
    across = judge(joined, model, sure, overlap).where("confirmed").withColumn("before", F.max("hi").over(run.rowsBetween(Window.unboundedPreceding, -1)))
    across = across.withColumn("notice", F.sum(F.when(F.col("lo") <= F.col("before"), 0).otherwise(1)).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    seen = single.where("confirmed and not short").select(F.col("row").alias("_r"), F.col("family").alias("_f"), F.col("paragraph").alias("_p")).distinct()
    across = across.join(seen, (F.col("row") == F.col("_r")) & (F.col("family") == F.col("_f")) & F.col("_p").between(F.col("lo"), F.col("hi")), "left_anti")
    across = across.groupBy("doc_id", "row", "family", "notice", "confirmed").agg(F.min("paragraph").alias("paragraph"), F.max("probability").alias("probability"), F.max("similarity").alias("similarity"))
    cols = ["doc_id", "paragraph", "family", "confirmed", "probability", "similarity"]
    out = single.select(cols).unionByName(across.select(cols)).groupBy("doc_id", "paragraph", "family", "confirmed").agg(F.max("probability").alias("probability"), F.max("similarity").alias("similarity"))
    return out.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), "confirmed")
