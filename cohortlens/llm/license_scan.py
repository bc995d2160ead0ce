"""License scans: a trained paragraph classifier whose predictions templates confirm.

Paragraphs are the blocks between blank lines, their lines joined. Words and word pairs are
hashed once a block; long blocks are read in overlapping windows of these hashes. A sparse
multinomial logistic regression, trained by Spark ML on sentences built from license names,
on sentences of license texts and on paragraphs of the corpus, gives each family a
probability. The unknown class is calibrated for each family: it counts only where its odds
against the unknown class are above those that almost no window of the corpus without a
license name reaches. A prediction stands if the window also contains the words of one of the
family's names or sentences in order; every family is judged by itself. All of it runs on
DataFrame functions in the JVM.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import settle, table

FEATURES = 1 << 13
#: Corpus paragraphs used as examples without a license: about as many, of twice as many drawn.
CLEAN_ROWS = 2000
#: Share of the windows without a license name that may pass as a family.
FALSE_SHARE = 0.001
LEAST_PROBABILITY = 0.5
MOST_PROBABILITY = 0.95
#: Score bins, to one, in which windows are counted for the thresholds.
BINS = 1000
#: Words of a window and from one window to the next; names and sentences fit into what two share.
WINDOW = 96
STRIDE = 64
#: Corpus windows in which each name and sentence is set as an example.
SETTINGS = 16
#: Words of a training paragraph.
EXAMPLE_WORDS = 200
#: Share of a name's words and word pairs that a paragraph has to contain.
CONFIRMED = 0.8
SEED = 42
UNKNOWN = "unknown"

# Names of public licenses by family.
NAMES = {
    "AGPL": ["gnu affero general public license", "affero gpl", "agpl 3.0", "agplv3"],
    "Apache": ["apache license", "apache license version 2.0", "apache 2.0", "asl 2.0"],
    "Artistic": ["artistic license", "artistic license 2.0"],
    "BSD": ["bsd license", "3 clause bsd license", "2 clause bsd license", "bsd 3 clause", "bsd 2 clause", "new bsd license"],
    "BSL": ["boost software license", "boost software license 1.0"],
    "CC-BY": ["creative commons attribution license", "cc by 4.0", "cc by 3.0", "cc attribution 4.0 international"],
    "CC-BY-NC": ["creative commons attribution noncommercial license", "cc by nc 4.0", "cc by nc 3.0", "cc by nc"],
    "CC-BY-NC-SA": ["creative commons attribution noncommercial sharealike license", "cc by nc sa 4.0", "cc by nc sa"],
    "CC-BY-ND": ["creative commons attribution noderivatives license", "cc by nd 4.0", "cc by nd"],
    "CC-BY-SA": ["creative commons attribution sharealike license", "cc by sa 4.0", "cc by sa 3.0", "cc by sa"],
    "EPL": ["eclipse public license", "eclipse public license 2.0", "epl 2.0"],
    "GPL": ["gnu general public license", "gnu general public license version 3", "gnu gpl", "gpl 2.0", "gpl 3.0", "gpl version 2", "gpl version 3", "gplv2", "gplv3"],
    "ISC": ["isc license", "isc licence"],
    "LGPL": ["gnu lesser general public license", "lgpl 2.1", "lgpl 3.0", "lgplv3", "gnu lgpl"],
    "MIT": ["mit license", "mit licence", "the mit license mit", "expat license"],
    "MPL": ["mozilla public license", "mozilla public license 2.0", "mpl 2.0"],
    "proprietary": ["all rights reserved", "proprietary and confidential", "no part may be reproduced without permission"],
    "public-domain": ["public domain", "cc0 1.0 universal", "creative commons zero", "the unlicense", "cc0"],
}
# Characteristic sentences of the license texts.
SENTENCES = {
    "AGPL": ["you can redistribute it and or modify it under the terms of the gnu affero general public license"],
    "Apache": [
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ],
    "Artistic": ["the intent is that the copyright holder maintains some artistic control over the development of that package"],
    "BSD": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
    ],
    "BSL": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "EPL": ["this program and the accompanying materials are made available under the terms of the eclipse public license"],
    "GPL": ["you can redistribute it and or modify it under the terms of the gnu general public license"],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "MIT": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "MPL": ["this source code form is subject to the terms of the mozilla public license"],
    "public-domain": ["this is free and unencumbered software released into the public domain"],
}
# Public identifiers of licenses, which count after the marker of such a line.
IDENTIFIERS = {
    "AGPL": ["agpl 3.0"], "Apache": ["apache 2.0"], "Artistic": ["artistic 2.0"], "BSD": ["bsd 2 clause", "bsd 3 clause"],
    "BSL": ["bsl 1.0"], "CC-BY": ["cc by 4.0"], "CC-BY-NC": ["cc by nc 4.0"], "CC-BY-NC-SA": ["cc by nc sa 4.0"],
    "CC-BY-ND": ["cc by nd 4.0"], "CC-BY-SA": ["cc by sa 4.0"], "EPL": ["epl 2.0"], "GPL": ["gpl 2.0", "gpl 3.0"], "ISC": ["isc"],
    "LGPL": ["lgpl 2.1", "lgpl 3.0"], "MIT": ["mit"], "MPL": ["mpl 2.0"], "public-domain": ["cc0 1.0", "unlicense"],
}
MARKER = "spdx license identifier"
FRAMES = [
    "{}", "the {}", "licensed under {}", "licensed under the {}", "released under the {}", "released under {}",
    "this work is licensed under the {}", "this work is licensed under {}", "distributed under the terms of the {}",
    "spdx license identifier {}", "copyright 2020 the authors {}", "this file is part of a program under the {}",
    "see the file license for the {}", "available under the {} see license for details", "published under {}",
    "you may use this text under the {}", "code is {}", "this software is provided as is under the {}",
]
NO_LICENSE = [
    "licensed under a custom agreement", "the license was renewed at the office", "his driving license expired",
    "released under water", "released last year by the label", "this work is under review", "the general public was invited",
    "a public library opened in the domain of the town", "distributed in the terms of the year", "version 3 of the plan",
    "the rights of all were reserved for later talks", "permission was granted to build", "this work is finished",
    "students of mit won the prize", "the apache helicopter landed", "the mozilla festival was held", "an eclipse is public",
    "terms and conditions apply", "copyright law is hard", "see the file for details", "licensed to drive a bus",
]


def tokens(text: Column) -> Column:
    """Words of a paragraph: runs of ASCII letters and digits in lower case."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(F.length(plain) > 0, F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def _hashes(words: str) -> tuple[Column, Column]:
    """Hashes of the words, and of each word with the next."""
    single = F.transform(words, lambda w: F.xxhash64(w))
    after = F.slice(words, F.lit(2), F.size(words))
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), after, lambda a, b: F.xxhash64(a, b))
    return single, pairs


def _features(df: DataFrame) -> DataFrame:
    """``df`` with the vector of its column ``grams``, hashes of words and pairs."""
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(df)


def _grams(words: list[str]) -> set:
    return {*words, *zip(words, words[1:])}


def _template_words() -> dict[str, list[list[str]]]:
    """The words of every name and sentence, by family."""
    marked = {family: [f"{MARKER} {i}" for i in own] for family, own in IDENTIFIERS.items()}
    return {
        family: [re.findall("[a-z0-9]+", t) for t in names + SENTENCES.get(family, []) + marked.get(family, [])]
        for family, names in NAMES.items()
    }


def templates(spark: SparkSession) -> DataFrame:
    """(family, names, longer): the distinct words and word pairs of every name and sentence of a family, and how many confirm it.

    An identifier after its marker has to stand there whole.

    The pattern ``longer`` matches names of other families that would pass for a name of
    this one, such as the Lesser General Public License for the General one.
    """
    words, rows = _template_words(), []
    for family, own in words.items():
        longer = {
            " ".join(other) for name, others in words.items() if name != family for other in others for mine in own
            if len(_grams(other)) > len(_grams(mine))
            and len(_grams(mine) & _grams(other)) >= CONFIRMED * len(_grams(mine))
        }
        pattern = "|".join(sorted(longer, key=lambda n: (-len(n), n)))
        marker = MARKER.split()
        names = [
            (sorted(g if isinstance(g, str) else " ".join(g) for g in _grams(mine)), 1.0 if mine[:len(marker)] == marker else CONFIRMED)
            for mine in own
        ]
        rows.append((family, names, f"(?<= )({pattern})(?= )" if pattern else "(?!)"))
    return spark.createDataFrame(rows, "family string, names array<struct<grams: array<string>, share: double>>, longer string")


def _named(words: Column) -> Column:
    """Whether the words contain a license name or sentence as it stands."""
    own = [t for texts in _template_words().values() for t in texts]
    plain = F.concat(F.lit(" "), F.concat_ws(" ", words), F.lit(" "))
    found = F.rlike(plain, F.lit(f" ({'|'.join(sorted({' '.join(t) for t in own}))}) "))
    marks = F.array(*[F.lit(w) for w in sorted({max(t, key=len) for t in own})])
    return F.when(F.arrays_overlap(words, marks), found).otherwise(F.lit(False))


def _examples(spark: SparkSession, settings: list[str]) -> DataFrame:
    """Names in frames, sentences, and both before, after and amid corpus text without a license."""
    rows = [(f, frame.format(n)) for f, own in NAMES.items() for n in own for frame in FRAMES]
    rows += [(f, t) for f, own in SENTENCES.items() for t in own for _ in range(len(FRAMES) // 3)]
    rows += [(f, f"{MARKER} {i}") for f, own in IDENTIFIERS.items() for i in own for _ in range(len(FRAMES) // 3)]
    at = 0
    for family, own in _template_words().items():
        for t in own:
            for k in range(SETTINGS if settings else 0):
                around = settings[at % len(settings)].split(" ")
                at += 1
                middle = (len(around), 0, *2 * [(at * 37) % (len(around) + 1)])[k % 4]
                rows.append((family, " ".join([*around[:middle], *t, *around[middle:]])))
    rows += [(UNKNOWN, text) for text in NO_LICENSE for _ in range(3)]
    return spark.createDataFrame(rows, "family string, paragraph string")


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n_lines, block, paragraph): the blocks between blank lines, one null paragraph where there is none."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x)) > 0)
    return (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .select(
            "row", "doc_id", F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
            F.posexplode_outer(F.split("text", r"\n[ \t\x0B\f\r]*(?=\n)", -1)).alias("block", "paragraph"),
        )
    )


def _windows(blocks: DataFrame, *kept: str) -> DataFrame:
    """The ``kept`` columns, words and grams of overlapping windows over ``all`` and its hashes; one where they fit into it."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - (WINDOW - STRIDE) - 1, F.lit(0)), F.lit(STRIDE))
    grams = F.concat(F.slice("single", F.col("at") + 1, F.lit(WINDOW)), F.slice("pairs", F.col("at") + 1, F.lit(WINDOW - 1)))
    return blocks.select(*kept, "all", "single", "pairs", F.explode(starts).alias("at")).select(
        *kept, F.slice("all", F.col("at") + 1, F.lit(WINDOW)).alias("words"), grams.alias("grams")
    )


def train(paragraphs: DataFrame, clean_rows: int = CLEAN_ROWS) -> tuple[LogisticRegressionModel, list[str]]:
    """The classifier and its classes in order.

    Of the corpus, half of ``2 * clean_rows`` distinct paragraphs drawn by hash are used, of these
    the ones that contain no license name.
    """
    spark = paragraphs.sparkSession
    families = [*sorted(NAMES), UNKNOWN]
    # Only hashes are shuffled to find the smallest ones; the paragraphs that have them follow.
    hashed = (
        paragraphs.filter(F.length(F.trim("paragraph")) > 0)
        .select("paragraph", F.xxhash64(F.lit(SEED), "paragraph").alias("order"))
    )
    least = hashed.select("order").distinct().orderBy("order").limit(2 * clean_rows)
    last = least.agg(F.max("order")).first()[0]
    drawn = (
        hashed.filter(F.col("order") <= F.lit(last).cast("long"))
        .select(F.substring_index("paragraph", " ", EXAMPLE_WORDS).alias("paragraph")).distinct()
        .filter(F.pmod(F.xxhash64(F.lit(SEED + 1), "paragraph"), F.lit(2)) == 0)
    )
    clean = settle(drawn.filter(~_named(tokens(F.col("paragraph")))), "license-clean")
    settings = [
        " ".join(r.words) for r in
        clean.select(F.slice(tokens(F.col("paragraph")), 1, WINDOW).alias("words"))
        .filter("size(words) > 0").orderBy(F.xxhash64(F.lit(SEED), "words"), "words").limit(300).collect()
    ]
    examples = _examples(spark, settings).unionByName(clean.select(F.lit(UNKNOWN).alias("family"), "paragraph"))
    label = F.create_map(*[F.lit(x) for pair in ((f, float(i)) for i, f in enumerate(families)) for x in pair])
    rows = settle(examples.select(label[F.col("family")].alias("label"), tokens(F.col("paragraph")).alias("words")).coalesce(2), "license-examples")
    model = LogisticRegression(
        family="multinomial", regParam=1e-4, elasticNetParam=0.1, maxIter=60, standardization=False
    ).fit(_features(rows.withColumn("grams", F.concat(*_hashes("words")))).select("label", "features"))
    return model, families


def scorer(model: LogisticRegressionModel) -> LogisticRegressionModel:
    """The model for scoring: its probability alone, from coefficients in a dense matrix.

    Spark ML keeps the coefficients sparse and then runs through all of them for every window; a
    dense matrix is asked only for the features of the window. The sums add the same terms in the
    same order.
    """
    jvm = model._java_obj
    dense = type(model)(model._new_java_obj(
        "org.apache.spark.ml.classification.LogisticRegressionModel", jvm.uid(),
        jvm.coefficientMatrix().toDense(), jvm.interceptVector(), model.numClasses, True,
    ))
    return dense.setRawPredictionCol("").setPredictionCol("")


def thresholds(scanned: DataFrame, families: list[str]) -> dict[str, float]:
    """The odds from which a family counts: all but ``FALSE_SHARE`` of the windows without a license name are below.

    ``scanned`` lists the windows that reach ``LEAST_PROBABILITY`` for some family and counts all others.
    """
    n_clean = scanned.agg(F.sum("n_clean")).first()[0] or 0
    odds = F.posexplode("found.odds").alias("at", "odds")
    counts = (
        scanned.select(F.explode("windows").alias("found")).filter("NOT found.named").select(odds)
        .filter(F.col("odds") >= LEAST_PROBABILITY)
        .groupBy("at", F.floor(F.col("odds") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    )
    out = {}
    for at, family in enumerate(families[:-1]):
        above, out[family] = 0, LEAST_PROBABILITY
        for bin, n in sorted(((r.bin, r.n) for r in counts if r["at"] == at), reverse=True):
            above += n
            if above > FALSE_SHARE * n_clean:
                out[family] = min((bin + 1) / BINS, MOST_PROBABILITY)
                break
    return out


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clean_rows: int = CLEAN_ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_paragraphs, n_predicted, n_licensed, families, licenses.

    ``families`` are the confirmed license families, sorted and once each; ``licenses`` lists
    (family, probability, paragraph) for each window that names it, the probability against the
    unknown class alone and the window's words. ``n_predicted`` counts the blocks with a
    prediction, also of those that no template confirms, ``n_licensed`` the blocks with a confirmed
    one. ``n_paragraphs`` counts the lines that are not blank; null and empty texts have none.
    Rows that share a doc_id, or have none, are scanned each by itself. Other columns are
    ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    blocks = _blocks(docs, id_col, text_col)
    model, families = train(blocks, clean_rows)
    words = F.coalesce(tokens(F.col("paragraph")), F.array().cast("array<string>"))
    single, pairs = _hashes("all")
    # Few blocks hold a name; only their windows are looked at for one.
    read = _windows(
        blocks.select("row", "doc_id", "n_lines", "block", words.alias("all"))
        .withColumns({"single": single, "pairs": pairs, "some": _named(F.col("all"))}),
        "row", "doc_id", "n_lines", "block", "some",
    )
    scored = scorer(model).transform(_features(read)).select(
        "row", "doc_id", "n_lines", "block", "words", "some", vector_to_array("probability").alias("p")
    )
    known = F.transform(F.slice("p", 1, len(families) - 1), lambda x: x / (x + F.element_at("p", -1)))
    filled = F.size("words") > 0
    scored = (
        scored.withColumn("odds", known).withColumn("named", F.when(F.col("some"), _named(F.col("words"))).otherwise(F.lit(False)))
        .withColumn("listed", filled & (F.array_max("odds") >= LEAST_PROBABILITY))
    )
    # One pass scores all windows; only those that may count go on, a row for each document.
    scanned = settle(
        scored.groupBy("row", "doc_id", "n_lines").agg(
            F.count(F.when(filled & ~F.col("named"), 1)).alias("n_clean"),
            F.collect_list(F.when(F.col("listed"), F.struct("block", "words", "odds", "named"))).alias("windows"),
        ),
        "license-windows",
    )
    least = thresholds(scanned, families)
    bounds = F.array(*[
        F.struct(F.lit(f).alias("family"), F.lit(least[f]).alias("least")) for f in families[:-1]
    ])
    predicted = F.filter(
        F.zip_with(bounds, "found.odds", lambda b, o: F.struct(b["family"].alias("family"), b["least"].alias("least"), o.alias("odds"))),
        lambda x: x["odds"] >= x["least"],
    )
    # Few windows are left; each meets the names of every family that it may belong to.
    own = scanned.select("row", "doc_id", "n_lines", F.explode_outer("windows").alias("found")).select(
        "row", "doc_id", "n_lines", "found.block", "found.words", F.explode_outer(predicted).alias("of")
    )
    plain = F.concat(F.lit(" "), F.concat_ws(" ", "words"), F.lit(" "))
    rest = F.split(F.regexp_replace(plain, F.col("longer"), F.lit("|")), " ")
    judged = (
        own.select("row", "doc_id", "n_lines", "block", "words", "of.family", "of.odds")
        .join(F.broadcast(templates(spark)), "family", "left").withColumn("rest", rest)
        .withColumn("grams", F.concat("rest", F.zip_with("rest", F.slice("rest", F.lit(2), F.size("rest")), lambda x, y: F.concat_ws(" ", x, y))))
        .withColumn("confirmed", F.coalesce(
            F.exists("names", lambda n: F.size(F.array_intersect(n["grams"], F.col("grams"))) >= n["share"] * F.size(n["grams"])), F.lit(False)
        ))
    )
    found = F.when(F.col("confirmed"), F.struct("family", F.col("odds").alias("probability"), F.trim(plain).alias("paragraph")))
    return (
        judged.groupBy("row", "doc_id", "n_lines").agg(
            F.size(F.collect_set(F.when(F.col("family").isNotNull(), F.col("block")))).cast("long").alias("n_predicted"),
            F.size(F.collect_set(F.when(F.col("confirmed"), F.col("block")))).cast("long").alias("n_licensed"),
            F.collect_list(found).alias("licenses"),
        )
        .select(
            "doc_id", F.col("n_lines").alias("n_paragraphs"), "n_predicted", "n_licensed",
            F.array_sort(F.array_distinct(F.col("licenses.family"))).alias("families"), "licenses",
        )
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_paragraphs", "n_predicted", "n_licensed", F.array_join("families", ",").alias("families")
    )
