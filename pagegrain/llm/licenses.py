"""License scans by diagonal voting, in DataFrame functions only.

Every pair of neighbouring words of a text is joined, by hash and words, to the places where a phrase or a template has the
same pair. A hit votes for its diagonal, the text's place less the template's place: the words of one occurrence all lie on
one diagonal. A phrase stands where all its pairs vote for a diagonal. For templates, diagonals a few words apart are
merged (words were put in or left out), and a span is kept if enough of the template's pairs are in it and it is not much
longer than the template.

Results depend on the text alone, so equal texts are counted as one and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagegrain.llm.common import utf8, whole

# Phrases that count wherever their words stand consecutively; fixed values.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Notices of public licenses and the labels they get.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
# Diagonals that are merged, and the part of a template's pairs that a span must have.
NEAR = 3
SHARE = 0.8

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of digits, letters and all beyond ASCII, A-Z in lower case; none for null."""
    # lower() also turns the Kelvin sign into an ASCII k, which only A-Z may become
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")))
    return F.array_remove(F.split(plain, _BREAKS), "")


def _places(spark: SparkSession, phrases, templates) -> DataFrame:
    """One row for each pair of neighbouring words of the phrases and templates; as many as their words."""
    rows = []
    for number, (line, label) in enumerate([*phrases, *templates]):
        own = line.split()
        if len(own) < 2:
            raise ValueError(f"a phrase needs two words: {line}")
        rows += [(number, number < len(phrases), label, len(own), at, a, b) for at, (a, b) in enumerate(zip(own, own[1:], strict=False))]
    names = ("template", "exact", "label", "length", "place", "a", "b")
    array = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])
    return spark.range(1, numPartitions=1).select(F.inline(array)).withColumn("h", F.xxhash64("a", "b"))


def scan(
    docs: DataFrame, text: str = "text", phrases=PHRASES, templates=TEMPLATES, near: int = NEAR, share: float = SHARE
) -> DataFrame:
    """``doc`` (the input row), ``n_words``, ``base`` and ``found``: arrays of (label, first, last, score) of the phrases'
    places and the templates' spans, in order, with words counted from 0.

    Null, empty and wordless texts have no words and no spans; repeated rows get the same result each; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    places = F.broadcast(_places(spark, phrases, templates))
    data = F.col(f"doc.`{text}`")
    rows = whole(docs).select("doc", F.md5(utf8(data)).alias("key"), words(data).alias("words"))
    second = F.expr("slice(words, 2, greatest(size(words) - 1, 0))")
    pairs = rows.select("key", F.posexplode(F.arrays_zip(F.col("words").alias("a"), second.alias("b"))).alias("at", "pair"))
    pairs = pairs.select("key", "at", F.col("pair.a").alias("x"), F.col("pair.b").alias("y"), F.xxhash64("pair.a", "pair.b").alias("hash"))
    hits = pairs.join(places, (F.col("hash") == F.col("h")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")))
    votes = hits.select("key", "template", "exact", "label", "length", "place", (F.col("at") - F.col("place")).alias("diagonal")).distinct()

    by = ["key", "template", "exact", "label", "length"]
    lines = votes.groupBy(*by, "diagonal").agg(F.collect_set("place").alias("places"))
    exact = lines.filter("exact AND size(places) = length - 1").select(
        "key", "exact", "label", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("length") - 1).alias("last"), F.lit(1.0).alias("score")
    )
    along = W.partitionBy("key", "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= near, 0).otherwise(1)
    merged = lines.filter("NOT exact").withColumn("fresh", fresh).withColumn("band", F.sum("fresh").over(along))
    spans = merged.groupBy(*by, "band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("places") + 1).alias("last"),
    )
    spans = spans.withColumn("score", F.col("votes") / (F.col("length") - 1))
    spans = spans.filter((F.col("score") >= share) & (F.col("last") - F.col("first") < F.col("length") + near))
    every = exact.union(spans.select("key", "exact", "label", "first", "last", "score"))
    item = F.struct("label", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "score")
    found = every.groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(F.col("exact"), item))).alias("base"),
        F.array_sort(F.collect_list(F.when(~F.col("exact"), item))).alias("found"),
    )
    counted = rows.select("doc", "key", F.size("words").cast("bigint").alias("n_words"))
    none = F.array().cast("array<struct<label:string,first:bigint,last:bigint,score:double>>")
    joined = counted.join(found, "key", "left")
    return joined.select("doc", "n_words", F.coalesce("base", none).alias("base"), F.coalesce("found", none).alias("found"))
