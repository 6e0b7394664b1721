"""License scans by diagonal voting.

Templates are license phrases and notices. All rolling GRAM-word hashes of the texts meet the templates' hashes in a
join; a match votes for the diagonal (text position - template position). Votes are summed by text, template and
diagonal; neighbouring diagonals, apart by inserted or left-out words, are merged. In a merged group each stretch of
text that a template may take is compared with it: a template place counts once, however often the text repeats it, and
only in the template's order; the stretch with the most is kept if that is enough of the template. A phrase counts only
whole: on one diagonal, with every vote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

GRAM, DRIFT, LEAST = 2, 3, 0.8
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# fixed values: phrases that must stand whole, by label
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
# fixed values: public notices, which may stand with small changes, by label: openings, and short licenses in full
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license",
    "no-warranty": "the software is provided as is without warranty of any kind",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
    "as published by the free software foundation either version 3 of the license or at your option any later version",
    "apache-2.0-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the "
    "license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for "
    "the specific language governing permissions and limitations under the license",
    "mit-terms": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
    "damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
    "applications and to alter it and redistribute it freely subject to the following restrictions",
}
#: Templates of more runs of words than this are joined by a shuffle, not sent to every task.
SENT = 20_000


def templates(spark: SparkSession, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """label, whole, n_words, at, hash, gram of the given texts, or of those above."""
    rows = [(label, text, whole) for group, whole in ((PHRASES if phrases is None else phrases, True), (NOTICES if notices is None else notices, False)) for label, text in group.items()]
    return template_grams(spark.createDataFrame(rows, "label string, text string, whole boolean"))


def template_grams(texts: DataFrame) -> DataFrame:
    """label, whole, n_words, at, hash, gram: a row per GRAM-word run of each template of a table (label, text, whole).

    Templates of fewer than GRAM words, without text or without a label have none. Of rows with the same label, one
    template each is needed: they must differ in label.
    """
    split = texts.where("label is not null").select("label", F.coalesce("whole", F.lit(False)).alias("whole"), words().alias("_words")).where(F.size("_words") >= GRAM)
    runs = F.transform(F.sequence(F.lit(1), F.size("_words") - (GRAM - 1)), lambda i: F.concat_ws(" ", F.slice("_words", i, GRAM)))
    rows = split.select("label", "whole", F.size("_words").alias("n_words"), F.posexplode(runs).alias("at", "gram"))
    return rows.select("label", "whole", "n_words", "at", F.xxhash64("gram").alias("hash"), "gram")


def words(text: str = "text"):
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def grams(known: DataFrame):
    """place and gram of the GRAM-word runs of _words; where the templates are few, only of runs that have a first and a
    last word of theirs, since the join would drop the others."""
    if known.limit(SENT + 1).count() > SENT:
        return F.transform(F.sequence(F.lit(0), F.size("_words") - GRAM), lambda i: F.struct(i.alias("place"), F.concat_ws(" ", F.slice("_words", i + 1, GRAM)).alias("gram")))
    parts = known.select(F.split("gram", " ").alias("g")).select(F.element_at("g", 1).alias("first"), F.element_at("g", -1).alias("last")).distinct().collect()
    firsts, lasts = sorted({r.first for r in parts}), sorted({r.last for r in parts})
    if not parts:
        return F.array().cast("array<struct<place:int,gram:string>>")
    run = lambda w, i: F.when(
        w.isin(firsts) & F.get("_words", i + GRAM - 1).isin(lasts), F.struct(i.alias("place"), F.concat_ws(" ", F.slice("_words", i + 1, GRAM)).alias("gram"))
    )
    return F.filter(F.transform("_words", run), lambda x: x.isNotNull())


def in_order():
    """The most template places that matches in _ahead (place, back = -at) cover in the order of both text and template."""
    none = F.array_repeat(F.lit(0), F.col("n_words"))  # by template place: the longest run of matches that ends there
    longer = lambda best, at: 1 + F.coalesce(F.array_max(F.slice(best, F.lit(1), at)), F.lit(0))
    # of matches at one text place the highest template place comes first, so that no run takes two of them
    step = lambda best, m: F.transform(best, lambda n, i: F.when(i == -m["back"], F.greatest(n, longer(best, -m["back"]))).otherwise(n))
    return F.array_max(F.aggregate(F.array_sort("_ahead"), none, step))


def candidates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows without _words, with n_words and _grams."""
    keep = [c for c in rows.columns if c != "_words"]
    return rows.select(*keep, F.size("_words").cast("long").alias("n_words"), F.when(F.size("_words") >= GRAM, grams(known)).alias("_grams"))


def spans(rows: DataFrame, known: DataFrame) -> DataFrame:
    """_row, label, whole, start, end (word places, end excluded), score, of candidates() with _row.

    Templates of SENT runs or fewer are broadcast. Only matches are shuffled. A group of neighbouring diagonals gives
    one span, its best.
    """
    met = rows.select("_row", F.explode("_grams").alias("_g")).select("_row", "_g.place", "_g.gram", F.xxhash64("_g.gram").alias("hash"))
    few = known.limit(SENT + 1).count() <= SENT
    met = met.join(F.broadcast(known) if few else known, ["hash", "gram"])  # the words themselves settle a chance hash
    met = met.dropDuplicates(["_row", "place", "label", "at"])  # a repeated row votes once
    votes = met.groupBy("_row", "label", "whole", "n_words", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.collect_list("at").alias("ats")  # a diagonal has each template place once at most
    )
    full = votes.where("whole and votes = n_words - %d" % (GRAM - 1)).select("_row", "label", "whole", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_words")).alias("end"), F.lit(1.0).alias("score"))
    side = Window.partitionBy("_row", "label").orderBy("diagonal")
    loose = votes.where("not whole").withColumn("_new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(side) > DRIFT).cast("int"), F.lit(1)))
    loose = loose.withColumn("_group", F.sum("_new").over(side))
    flat = loose.select("_row", "label", "whole", "n_words", "_group", "diagonal", F.explode("ats").alias("at")).withColumn("place", F.col("diagonal") + F.col("at"))
    longest = known.agg(F.max("n_words")).first()[0] or 0
    reach = Window.partitionBy("_row", "label", "_group").orderBy("place").rangeBetween(0, longest + 2 * DRIFT)
    ahead = F.collect_list(F.struct("place", (-F.col("at")).alias("back"))).over(reach)
    met = flat.withColumn("_ahead", ahead).withColumn("_ahead", F.filter("_ahead", lambda m: m["place"] <= F.col("place") + F.col("n_words") + (2 * DRIFT - GRAM)))
    grams = F.col("n_words") - (GRAM - 1)
    met = met.where(F.size(F.array_distinct(F.transform("_ahead", lambda m: m["back"]))) / grams >= LEAST)
    near = met.withColumn("score", F.round(in_order() / grams, 6)).where(F.col("score") >= LEAST).withColumn("end", F.array_max(F.transform("_ahead", lambda m: m["place"])) + GRAM)
    near = near.groupBy("_row", "label", "whole", "_group").agg(F.max(F.struct("score", (F.col("place") - F.col("end")).alias("_less"), (-F.col("place")).alias("_first"))).alias("m"))
    near = near.select("_row", "label", "whole", (-F.col("m._first")).alias("start"), (-F.col("m._first") - F.col("m._less")).alias("end"), F.col("m.score").alias("score"))
    return full.union(near)


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row per row of docs.

    known is a table of template_grams(), by default that of the phrases and notices above.

    Null text counts as empty: no words, no labels, score 0. Rows are told apart by doc_id and text; rows that repeat
    both get the same values. score is the best span's, 1 for a whole phrase. A text of any length is searched to its end:
    its words are an array in one task, and what leaves it are the places that may be in a span.
    """
    known = known or templates(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text))).alias("_row"))
    rows = cut(candidates(keyed.select("doc_id", "_row", words().alias("_words")), known))
    found = spans(rows, known)
    by_row = found.groupBy("_row").agg(
        F.count(F.when(F.col("whole"), 1)).alias("n_base"),
        F.min(F.when(F.col("whole"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("whole"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    return rows.select("doc_id", "_row", "n_words").join(by_row, "_row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
