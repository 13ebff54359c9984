"""From raw documents to token ids, in stages that are written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandscape.functions.runtime import materialise
from bandscape.llm import contamination, language, repeats, sentencepiece_codec, simhash
from bandscape.llm.common import fresh, numbered, table, without_rows


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; the models learn from the labelled ones.

    Rejected are null texts, texts without a letter, and those that no language's
    model explains.  A missing ``lang`` is filled with the prediction.
    """
    model = language.train(docs, "text", "lang", F.struct("doc_id", F.xxhash64("text")))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])     # whatever the columns are called
    text = plain.columns[docs.columns.index("text")]
    kept = language.predict(plain, model, plain.columns, text).filter("not rejected")
    named = {c: F.coalesce(c, "lang_pred") if name == "lang" else F.col(c) for c, name in zip(plain.columns, docs.columns)}
    return kept.select(*[column.alias(name) for (_, column), name in zip(named.items(), docs.columns)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id."""
    row = fresh(docs, "_row")
    kept = numbered(docs, row)
    groups = materialise(simhash.near_duplicates(kept, row).select(row, "component"))
    ids = materialise(groups.join(kept.select(row, "doc_id"), row))
    first = ids.groupBy("component").agg(F.min_by(row, F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias(row))
    return without_rows(kept, row, ids.join(first.select(row), row, "left_anti")).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more stay in the document with the smallest doc_id alone.

    A document of which nothing is left goes; ``n_chars`` follows the text.
    """
    row, before = fresh(docs, "_row"), fresh(docs, "_before")
    kept = numbered(docs.withColumn(before, F.length(F.trim("text"))), row)
    cut = repeats.without_repeats(kept, row, "doc_id", "text")
    cut = cut.filter((F.coalesce(before, F.lit(0)) == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.length(F.trim("text")) == F.col(before), F.col("n_chars"))
                             .otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth is in windows of the benchmark go."""
    row = fresh(docs, "_row")
    kept = numbered(docs, row)
    found = contamination.contamination(kept, table(spark, sf_dir, "benchmark"), key=row, row=row)
    return without_rows(kept, row, found.filter("contaminated").select(F.col("key").alias(row))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, checked by decoding."""
    return sentencepiece_codec.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", encode),
]

# Models and iterated groups have no counterpart in SQL; tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
