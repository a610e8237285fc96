"""License scans by diagonal voting, in DataFrame functions alone.

All rolling pairs of words of a document are joined by hash to their positions in the
templates. A pair votes for the diagonal it lies on: its place in the document less its place
in the template. Neighbouring diagonals, where words were put in or left out, are
merged, and verified: the part of the template that their votes cover within a span hardly
longer than the template is the similarity.

A base phrase counts where one diagonal covers it whole, that is, word for word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logstream.functions.rows import computed_once
from logstream.llm.common import BROADCAST_ROWS, stored


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    base: bool = False


# Phrases and labels.
PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
# License notices, in the words that identify them.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("mit", "released under the mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
    Template(
        "unlicense", "this is free and unencumbered software released into the public domain"
    ),
)
TEMPLATES = PHRASES + NOTICES

# Diagonals this far apart are one passage; the part of a notice that must be covered.
GAP = 2
LEAST_COVER = 0.8

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of 0-9, a-z and non-ASCII characters, with A-Z in lower case.

    ``lower`` would also make a plain k of the Kelvin sign, which is no letter here.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("�"))
    return F.array_remove(F.split(F.lower(plain), SEPARATORS), "")


def template_pairs(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """Each pair of a template with its hash, words and place."""
    rows = []
    for number, one in enumerate(templates):
        words = one.words.split()
        for place, (first, second) in enumerate(zip(words, words[1:])):
            rows.append(
                F.struct(
                    F.lit(number).alias("template"),
                    F.lit(one.label).alias("label"),
                    F.lit(one.base).alias("base"),
                    F.lit(len(words) - 1).alias("pairs"),
                    F.lit(place).alias("place"),
                    F.lit(first).alias("first"),
                    F.lit(second).alias("second"),
                )
            )
    pairs = spark.range(1).select(F.inline(F.array(*rows)))
    pairs = pairs.withColumn("hash", F.xxhash64("first", "second"))
    return F.broadcast(pairs) if len(rows) <= BROADCAST_ROWS else pairs


def hits(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Each pair of words of a document that stands in a template, with its start and place.

    A row without a template ends each document and tells n_words; so texts are split once.
    """
    words = F.col("words")
    following = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    hashes = F.transform(following, lambda word, i: F.xxhash64(word, words[i + 1]))
    ended = F.concat(hashes, F.array(F.lit(None).cast("long")))
    start = F.col("start")
    # Equal hashes are not yet equal words.
    same = (words[start] == F.col("first")) & (words[start + 1] == F.col("second"))
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("key", F.xxhash64("text"))
        .select("doc_id", "key", computed_once(F.struct(words_of(F.col("text")).alias("words"))))
        .select("doc_id", "key", "words", F.posexplode(ended).alias("start", "hash"))
        .join(template_pairs(docs.sparkSession, templates), "hash", "left")
        .filter(F.col("hash").isNull() | same)
        .select(
            "doc_id",
            "key",
            F.when(F.col("hash").isNull(), F.size(words).cast("long")).alias("n_words"),
            *("start", "template", "label", "base", "pairs", "place"),
        )
    )


def votes(found: DataFrame) -> DataFrame:
    """For each document, template and diagonal: the template places that its pairs cover."""
    diagonal = (F.col("start") - F.col("place")).alias("diagonal")
    return (
        found.filter(F.col("template").isNotNull())
        .groupBy("doc_id", "key", "template", "label", "base", "pairs", diagonal)
        .agg(
            F.collect_set("place").alias("places"),
            F.min("start").alias("start"),
            (F.max("start") + 2).alias("end"),
        )
    )


def slack(words: int) -> int:
    """Words by which a span may be longer than its template of so many words."""
    return int(words / LEAST_COVER) - words


def spans(voted: DataFrame, longest: int) -> DataFrame:
    """Verified spans: doc_id, key, template, label, base, start, end, cover; one per diagonal
    that begins one.

    Neighbouring diagonals of a template are a passage. As steps from one to the next add
    up, a passage can be far longer than its template; so what counts are the template places
    that are covered within diagonals no further apart than ``slack``, that is, within a span of
    at most 1 / LEAST_COVER times the template's words. ``longest`` is the most words of a
    template.
    """
    by_diagonal = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(by_diagonal)
    passage = F.sum(F.when(step <= GAP, 0).otherwise(1)).over(by_diagonal)
    ahead = (
        Window.partitionBy("doc_id", "key", "template", "passage")
        .orderBy("diagonal")
        .rangeBetween(0, slack(longest))
    )
    words = F.col("pairs") + 1
    most = F.floor(words / F.lit(LEAST_COVER)) - words
    near = F.filter("ahead", lambda one: one["diagonal"] - F.col("diagonal") <= most)
    return (
        voted.withColumn("passage", passage)
        .withColumn("ahead", F.collect_list(F.struct("diagonal", "places", "start", "end")).over(ahead))
        .withColumn("near", near)
        .select(
            *("doc_id", "key", "template", "label", "base"),
            F.array_min("near.start").alias("start"),
            F.array_max("near.end").alias("end"),
            (F.size(F.array_distinct(F.flatten("near.places"))) / F.col("pairs")).alias("cover"),
        )
    )


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Licenses of each document: one row per row of ``docs``.

    doc_id, n_words, n_base (places of the base phrases), first_word and last_word (their
    smallest and largest start), base_labels, labels (with those of notices that a span of
    their length covers well enough), and score, the best cover of a phrase or notice. A NULL or
    empty text has no words and score 0; repeated rows get a row each; other columns are not read.
    """
    found = stored(hits(docs, templates), "license-hits")
    voted = votes(found)
    whole = F.col("base") & (F.size("places") == F.col("pairs"))
    exact = (
        voted.filter(whole)
        .groupBy("doc_id", "key")
        .agg(
            F.count("*").alias("n_base"),
            F.min("diagonal").cast("long").alias("first_word"),
            F.max("diagonal").cast("long").alias("last_word"),
            F.collect_set("label").alias("found"),
            F.lit(1.0).alias("cover"),
        )
    )
    longest = max((len(one.words.split()) for one in templates), default=0)
    notices = (
        spans(voted.filter(~F.col("base")), longest)
        .groupBy("doc_id", "key")
        .agg(
            F.lit(0).cast("long").alias("n_base"),
            F.lit(None).cast("long").alias("first_word"),
            F.lit(None).cast("long").alias("last_word"),
            F.collect_set(F.when(F.col("cover") >= LEAST_COVER, F.col("label"))).alias("found"),
            F.max("cover").alias("cover"),
        )
    )
    both = (
        exact.withColumn("base_found", F.col("found"))
        .unionByName(notices.withColumn("base_found", F.expr("cast(array() as array<string>)")))
        .groupBy("doc_id", "key")
        .agg(
            F.sum("n_base").alias("n_base"),
            F.max("first_word").alias("first_word"),
            F.max("last_word").alias("last_word"),
            _joined("base_found").alias("base_labels"),
            _joined("found").alias("labels"),
            F.max("cover").alias("score"),
        )
    )
    counted = found.filter(F.col("template").isNull()).select("doc_id", "key", "n_words")
    on = F.expr("d.doc_id <=> f.doc_id AND d.key = f.key")
    return counted.alias("d").join(both.alias("f"), on, "left").select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _joined(name: str) -> Column:
    distinct = F.array_distinct(F.flatten(F.collect_list(name)))
    return F.array_join(F.array_sort(distinct), ",")
