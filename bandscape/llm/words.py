"""Finding given word sequences in whole texts, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import materialise
from .common import SENT, ascii_lower, numbered

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN = 3                   # words of a token
BLOCK = 100_000             # sequences sent to every executor at once, a few hundred bytes each


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; a null text has none."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def token(sequence: Column, at: Column, width: int = TOKEN) -> Column:
    """Hash of ``width`` words from ``at`` on; beyond the end there are fewer."""
    return F.xxhash64(*[F.get(sequence, at + i) for i in range(width)])


def exploded(rows: DataFrame, widths: list[int], *keep: str) -> DataFrame:
    """The columns ``keep`` of ``rows`` (with words ``_w`` and their number ``_n``) once
    per word, with ``_pos`` and ``_token``; a text without words stays as one row.
    The words themselves aren't kept, as a copy at each word would cost the square of
    a text's length.  Widths besides ``TOKEN`` are those of sequences that are shorter
    than a token."""
    short = [w for w in widths if w != TOKEN]
    hashes = (lambda i: F.array(*[token(F.col("_w"), i, w) for w in (TOKEN, *short)])) if short else (lambda i: token(F.col("_w"), i))
    at = F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0), F.col("_n") - 1), hashes))
    rows = rows.select(*keep, F.posexplode_outer(at).alias("_pos", "_token"))
    return rows.withColumn("_token", F.explode_outer("_token")) if short else rows


def in_blocks(needles: DataFrame, by: str, block: int) -> list[DataFrame]:
    """``needles`` cut by the hash of a unique column into parts of a bounded size."""
    parts = -(-needles.count() // block)
    if parts <= 1:
        return [needles]
    return [needles.filter(F.pmod(F.xxhash64(by), F.lit(parts)) == i) for i in range(parts)]


def occurrences(docs: DataFrame, key: str, text: str, needles: DataFrame, widths: list[int],
                block: int = BLOCK, row: str | None = None) -> DataFrame:
    """Places in ``docs`` of the sequences in ``needles`` (id, words, token, offset).

    ``token`` hashes the words of the sequence from ``offset`` on.  Result: (row,
    key, n, start, id), one row per verified place, plus at least one row with a
    null id for each row of ``docs``.  ``row`` numbers the rows of ``docs``, ``n``
    counts words.  Needles are broadcast in blocks of ``block``; ``docs`` is written
    once, read once per block, and its texts with a matching token once more.  It
    isn't written if ``row`` names a column that numbers the rows of a written table.
    """
    rows = docs.select(*([F.col(row).alias("row")] if row else []), F.col(key).alias("key"), F.col(text).alias("_t"))
    rows = rows if row else numbered(rows, "row")
    split = rows.select("row", "key", words(F.col("_t")).alias("_w")).withColumn("_n", F.size("_w"))
    start, size = F.col("_pos") - F.col("offset"), F.size("words")
    fits = F.coalesce((start >= 0) & (start + size <= F.col("_n")), F.lit(False))
    found = None
    for part in in_blocks(needles, "id", block):
        joined = exploded(split, widths, "row", "key", "_n").join(
            F.broadcast(part.withColumnRenamed("token", "_token")), "_token", "left")
        kept = joined.filter(fits | (F.coalesce("_pos", F.lit(0)) == 0))
        now = kept.select("row", "key", F.col("_n").cast("long").alias("n"), F.when(fits, start).alias("start"),
                          F.when(fits, F.col("id")).alias("id"), F.when(fits, F.col("words")).alias("words"))
        found = now if found is None else found.unionByName(now)
    found = materialise(found)
    every = found.select("row", "key", "n", F.lit(None).cast("long").alias("start"),
                         F.lit(None).cast(needles.schema["id"].dataType).alias("id"))
    return every.distinct().unionByName(_verified(found.filter("id is not null"), rows))


def _verified(places: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of ``places`` at which the words of the text are those of the sequence;
    only texts with a place are split into words again, once each."""
    starts = places.groupBy("row", "key", "n", "id").agg(F.first("words").alias("words"), F.collect_list("start").alias("starts"))
    by_text = materialise(starts.groupBy("row", "key", "n").agg(F.collect_list(F.struct("id", "words", "starts")).alias("_p")))
    few = by_text.count() <= SENT
    wanted = F.broadcast(by_text.select("row")) if few else by_text.select("row")
    texts = rows.join(wanted, "row", "left_semi").select("row", words(F.col("_t")).alias("_w"))
    same = lambda p: F.filter(p["starts"], lambda s: F.slice(F.col("_w"), s + 1, F.size(p["words"])) == p["words"])
    kept = F.transform("_p", lambda p: F.struct(p["id"].alias("id"), same(p).alias("starts")))
    held = by_text.join(texts, "row").select("row", "key", "n", F.explode(kept).alias("_p"))
    return held.select("row", "key", "n", F.explode("_p.starts").alias("start"), F.col("_p.id").alias("id")).withColumn(
        "start", F.col("start").cast("long"))
