"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are compared with every document.  A window is contained only
if all of its word tokens are, so a prefix of one token, its rarest over all
documents, is the necessary condition: one join on that token gives the
candidates, the token's place in the window gives the start, and the words
themselves decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import materialise
from .words import BLOCK, TOKEN, exploded, in_blocks, occurrences, token, words

WINDOW = 13


def item_windows(items: DataFrame, item: str, text: str, window: int = WINDOW) -> DataFrame:
    """(item, id, words): windows of consecutive words; a shorter item is one window."""
    listed = items.select(F.col(item).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = listed.select("item", "w", F.explode(starts).alias("at"))
    cut = cut.select("item", F.slice("w", F.col("at") + 1, F.lit(window)).alias("words"))
    return cut.withColumn("id", F.array_join("words", " ")).distinct()


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  block: int = BLOCK, row: str | None = None) -> DataFrame:
    """(row, key, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs``.

    A word inside any occurrence of a window counts once.  Null and empty texts
    have no words and are clean; repeated rows give a result each (``row`` keeps
    them apart); items without words and null ids of items take no part in the
    list of items; with no items every document is clean.  ``row`` may name a column that
    numbers the rows of ``docs``, a written table, which then isn't written again.
    """
    members = materialise(item_windows(items, item, item_text, window))
    windows = members.select("id", "words").distinct()
    width = F.least(F.size("words"), F.lit(TOKEN))
    places = windows.withColumn("offset", F.explode(F.sequence(F.lit(0), F.size("words") - width)))
    hashed = F.when(width == TOKEN, token(F.col("words"), F.col("offset")))
    for short in range(1, TOKEN):
        hashed = F.when(width == short, token(F.col("words"), F.col("offset"), short)).otherwise(hashed)
    places = materialise(places.withColumn("token", hashed))
    widths = sorted(r[0] for r in places.select(width).distinct().collect())            # at most TOKEN numbers
    counts = materialise(_counts(docs, text, places.select("token").distinct(), widths, block))
    # A window with a token that no document holds occurs nowhere.
    ranked = places.join(counts, "token", "left").groupBy("id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rare"), F.first("words").alias("words"))
    needles = materialise(ranked.filter("rare.n > 0").select("id", "words", "rare.token", "rare.offset"))
    found = materialise(occurrences(docs, key, text, needles, widths, block, row))
    return _summary(found, members)


def _counts(docs: DataFrame, text: str, tokens: DataFrame, widths: list[int], block: int) -> DataFrame:
    """(token, n): places of each token in all documents."""
    rows = docs.select(words(F.col(text)).alias("_w")).withColumn("_n", F.size("_w"))
    parts = [exploded(rows, widths).select("_token").join(F.broadcast(part.withColumnRenamed("token", "_token")), "_token")
             for part in in_blocks(tokens, "token", block)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(F.col("_token").alias("token")).agg(F.count("*").alias("n"))


def _summary(found: DataFrame, members: DataFrame) -> DataFrame:
    base = found.groupBy("row").agg(F.first("key").alias("key"), F.first("n").alias("n_words"))
    held = found.filter("id is not null").withColumn("end", F.col("start") + F.size(F.split("id", " ")))
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    spans = held.select("row", "start", "end").distinct().withColumn("new", new)
    hits = spans.groupBy("row").agg(F.sum("new").alias("n_hit"))
    names = held.select("row", "id").distinct().join(members.select("id", F.col("item").cast("string").alias("item")), "id")
    names = names.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    joined = base.join(hits, "row", "left").join(names, "row", "left")
    joined = joined.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"),
                                 "items": F.coalesce("items", F.array().cast("array<string>"))})
    return joined.select("row", "key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                         ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
