"""License scan by diagonal voting.

Every word k-gram of every text meets the k-grams of the templates in one join.
A match votes for the diagonal, its place in the text minus its place in the
template; whole and edited notices alike pile up their votes on one diagonal or a
few neighbouring ones.  Neighbours are merged, and a span counts if enough of the
template's k-grams are in it and it is about as long as the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.runtime import materialise
from .words import TOKEN, occurrences, token, words

MIN_SHARE = 0.8             # of a template's k-grams that a span must hold
SLACK = 3                   # words by which diagonals of one notice may differ

# Exact phrases and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Public license notices.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                 "compliance with the License. You may obtain a copy of the License at "
                 "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                 "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                 "CONDITIONS OF ANY KIND, either express or implied."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
              "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
              "option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
            "list of conditions and the following disclaimer."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
              "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
]


def needles(spark: SparkSession, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """(id, words, token, offset, label, template, at, grams): each phrase whole, each
    template once for each of its k-grams (``at`` is the gram's place, ``grams``
    their number)."""
    whole = spark.createDataFrame([(-1 - i, t, label) for i, (label, t) in enumerate(phrases)], "template int, t string, label string")
    whole = whole.select("template", "label", words(F.col("t")).alias("words"), F.lit(0).alias("at"), F.lit(0).alias("grams"))
    cut = spark.createDataFrame([(i, t, label) for i, (label, t) in enumerate(templates)], "template int, t string, label string")
    cut = cut.select("template", "label", words(F.col("t")).alias("w")).withColumn("grams", F.size("w") - (TOKEN - 1)).filter("grams > 0")
    cut = cut.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)))
    cut = cut.select("template", "label", F.slice("w", F.col("at") + 1, F.lit(TOKEN)).alias("words"), "at", "grams")
    return whole.unionByName(cut).withColumns({
        "id": F.shiftleft(F.col("template").cast("long"), 32) + F.col("at"), "token": token(F.col("words"), F.lit(0)), "offset": F.lit(0)})


def _labels(*names: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(F.concat(*names))), ",")


def licenses(docs: DataFrame, key: str = "doc_id", text: str = "text",
             phrases: list[tuple[str, str]] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(row, key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    ``base_labels`` and the three columns before it come from exact phrases of at
    least three words, ``spans`` and the further ``labels`` from diagonals.
    ``score`` is the largest share of a template found in one span, 1 with an
    exact phrase, 0 with nothing.  A null text counts as empty; texts without a
    notice have empty label strings; repeated rows give a result each.
    """
    listed = materialise(needles(docs.sparkSession, phrases or PHRASES, templates or TEMPLATES))     # a few hundred rows
    found = materialise(occurrences(docs, key, text, listed.select("id", "words", "token", "offset"), [TOKEN]))
    named = found.filter("id is not null").join(F.broadcast(listed.drop("words", "token", "offset")), "id")
    exact = named.filter("template < 0").groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"),
        F.collect_set("label").alias("exact"))
    spans = diagonal_spans(named.filter("template >= 0"))
    verified = F.array_compact(F.collect_list(F.when(F.col("verified"), F.struct("label", "first_word", "last_word", "share"))))
    voted = spans.groupBy("row").agg(F.max("share").alias("share"), F.array_sort(verified).alias("spans"))
    base = found.groupBy("row").agg(F.first("key").alias("key"), F.first("n").alias("n_words"))
    out = base.join(exact, "row", "left").join(voted, "row", "left").withColumns({
        "n_base": F.coalesce("n_base", F.lit(0)).cast("long"),
        "exact": F.coalesce("exact", F.array().cast("array<string>"))})
    method = F.coalesce(F.col("spans.label"), F.array().cast("array<string>"))
    return out.select("row", "key", "n_words", "n_base", "first_word", "last_word",
                      _labels(F.col("exact")).alias("base_labels"), _labels(F.col("exact"), method).alias("labels"),
                      F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), "spans")


def diagonal_spans(matches: DataFrame) -> DataFrame:
    """(row, label, share, verified, first_word, last_word): merged diagonals of
    ``matches`` (row, start, template, label, at, grams)."""
    votes = (matches.withColumn("diagonal", F.col("start") - F.col("at"))
             .groupBy("row", "template", "label", "grams", "diagonal")
             .agg(F.collect_set("at").alias("at"), F.min("start").alias("low"), F.max("start").alias("high")))
    along = Window.partitionBy("row", "template").orderBy("diagonal")            # diagonals of one text
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along), F.lit(0)) > SLACK
    merged = votes.withColumn("gap", gap.cast("int")).withColumn("span", F.sum("gap").over(along))
    merged = merged.groupBy("row", "template", "label", "grams", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("held"),
        F.min("low").alias("first_word"), (F.max("high") + (TOKEN - 1)).alias("last_word"))
    length = F.col("last_word") - F.col("first_word") + 1
    share = F.col("held") / F.col("grams")
    return merged.select("row", "label", share.alias("share"), "first_word", "last_word", (
        (share >= MIN_SHARE) & (length <= (F.col("grams") + TOKEN - 1) * 1.25 + SLACK)).alias("verified"))
