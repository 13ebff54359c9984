"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (centroids, contamination, language, lattice, licenses, merkle, packing, repeats, sentencepiece_codec, sharding,
               simhash, topk, warc)
from .common import numbered, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _remainder(modulus: int) -> Column:
    """Is crc32 of the id as text 2 modulo ``modulus``?  A null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == 2, F.lit(False))


@query
def op1_lattice(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return lattice.score(docs, "doc_id", "text", _remainder(7), F.col("lang")).withColumnRenamed("key", "doc_id").drop("row")


@query
def op2_sharding(spark, sf):
    placed = sharding.assign(table(spark, sf, "documents").select("doc_id", "text"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_language(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return language.identify(docs, _remainder(4))


@query
def op4_maxscore(spark, sf):
    vectors = topk.integer_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, F.col("id") % 20 == 0, 20)


@query
def op5_warc(spark, sf):
    records = warc.round_trip(table(spark, sf, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_decontamination(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    found = contamination.contamination(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return found.withColumnRenamed("key", "doc_id").drop("row")


@query
def op7_sentencepiece(spark, sf):
    return sentencepiece_codec.encode(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op8_licenses(spark, sf):
    found = licenses.licenses(table(spark, sf, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("key", "doc_id").drop("row", "spans")


@query
def op9_repeats(spark, sf):
    docs = numbered(table(spark, sf, "documents").select("doc_id", "text"), "_row")
    return repeats.digest(docs, "_row", "doc_id", "text").withColumnRenamed("key", "doc_id").drop("row")


@query
def op10_simhash(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query
def op11_merkle(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(merkle.document_leaves(docs, even), "doc_id")


@query
def op12_packing(spark, sf):
    cut = packing.pieces(table(spark, sf, "documents").select("doc_id", "text"))
    placed = packing.sequences(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "place")


@query
def op13_centroids(spark, sf):
    vectors = centroids.whole_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")
    order = F.sha2(F.concat(F.lit("3:"), F.col("key").cast("string")), 256)
    return centroids.cluster(vectors, order).withColumnRenamed("key", "vec_id")
