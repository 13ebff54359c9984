"""Exact top-k inner products with MaxScore over shards.

A term is a dimension.  A vector is in the posting of a query's term if its
component has the sign of the query's, that is, if it adds to the score; the
largest such product is the term's bound.  Terms are split: the non-essential ones
are those of smallest bounds whose sum stays under the current k-th score, so a
vector in no essential posting can't enter the result.  Vectors in essential
postings are then probed term by term, and dropped once their partial score plus
the bounds of the terms left can't reach the k-th score.  A task takes a block of
queries through several shards of vectors and hands each query's k-th score on from
shard to shard; the shards' results are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import materialise
from .common import numbered

SCALE = 64
SHARD = 8192                # vectors of a shard
QUERIES = 1024              # queries of a block
PROBE = 8                   # terms probed between two prunings


def integer_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): components as floor(64 x); vectors that are null, empty or hold a
    null or non-finite component take no part, nor do rows without an id.  Rows that
    repeat an id stay, each a vector of its own."""
    x = F.col(vector)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.filter(sound & F.col(key).isNotNull())
            .select(F.col(key).cast("long").alias("id"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v")))


def _packed(vectors: DataFrame, size: int) -> DataFrame:
    """(block, dim, kind, rows, ids, parts): ``vectors`` in blocks of about ``size``.

    Any packing gives the same result, so each partition packs what it holds.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        for rows in batches:
            for dim, same in rows.groupby(rows["v"].str.len()):
                values = np.stack(same["v"].to_numpy())
                kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if (values == values.astype(t)).all())
                yield pd.DataFrame({"block": [block], "dim": [dim], "kind": [kind], "rows": [same["row"].to_numpy("<i8").tobytes()],
                                    "ids": [same["id"].to_numpy("<i8").tobytes()], "parts": [values.astype(kind).tobytes()]})
                block += 1

    spread = vectors.repartition(max(1, -(-vectors.count() // size)))
    return materialise(spread.mapInPandas(work, "block long, dim int, kind string, rows binary, ids binary, parts binary"))


def top_k(vectors: DataFrame, is_query: Column, k: int, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (id, v) that
    ``is_query`` picks, against all rows of the same length but the query's own.

    Ties go to the smaller id; fewer than ``k`` candidates give fewer rows.  Of rows
    with one id each is a candidate, for the others too, and each that ``is_query``
    picks a query.  The queries are a stated set, so each block of them meets each
    shard once.
    """
    vectors = numbered(vectors, "row")
    shards, queries = _packed(vectors, shard), _packed(vectors.filter(is_query), block)
    where = F.broadcast(shards.select(F.col("block").alias("shard"), "dim"))        # two numbers for SHARD vectors
    asked = queries.select("dim", F.struct("block", "kind", "rows", "ids", "parts").alias("q"))
    pairs = asked.join(where, "dim").drop("dim").join(shards.withColumnRenamed("block", "shard"), "shard")
    blocks = queries.count()
    count = shards.count() * blocks
    tasks = max(1, min(count, max(4 * vectors.sparkSession.sparkContext.defaultParallelism, count // 64)))
    chain = F.pmod(F.xxhash64("shard"), F.lit(max(1, tasks // max(1, blocks))))    # shards that a block meets in one task
    found = pairs.repartition(tasks, "q.block", chain).mapInPandas(_searched(k), "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")          # k rows a shard
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _searched(k: int):
    def matrix(rows: bytes, ids: bytes, parts: bytes, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.frombuffer(rows, "<i8")
        return rows, np.frombuffer(ids, "<i8"), np.frombuffer(parts, kind).reshape(len(rows), -1).astype(np.int64)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reached: dict[int, list[np.ndarray]] = {}               # block -> the best scores so far of each of its queries
        for pairs in batches:
            for kind, rows, ids, parts, asked in pairs[["kind", "rows", "ids", "parts", "q"]].itertuples(index=False):
                index = Shard(*matrix(rows, ids, parts, kind))
                own, names, queries = matrix(asked["rows"], asked["ids"], asked["parts"], asked["kind"])
                before = reached.get(asked["block"], [np.zeros(0, np.int64)] * len(own))
                best = [index.top(q, int(i), k, int(b[0]) if len(b) == k else None) for i, q, b in zip(own, queries, before)]
                reached[asked["block"]] = [np.sort(np.concatenate([b, s]))[-k:] for b, (_, s) in zip(before, best)]
                sizes = [len(v) for v, _ in best]
                yield pd.DataFrame({"query": np.repeat(own, sizes), "query_id": np.repeat(names, sizes),
                                    "vec_id": np.concatenate([v for v, _ in best]),
                                    "score": np.concatenate([s for _, s in best]).astype(np.int64)})
    return work


class Shard:
    """Vectors by dimension, with each dimension's extremes and posting lists."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")                 # ties go to the smaller id
        self.rows, self.ids, self.low, self.high = rows[order], ids[order], values.min(0), values.max(0)
        peak = int(np.abs(values).max(initial=0))
        self.exact = np.float64 if peak * peak * values.shape[1] < 1 << 52 else np.int64    # whole numbers in doubles
        self.by_term = np.ascontiguousarray(values[order].T.astype(self.exact))
        self.gain_from = {1: [np.flatnonzero(x > 0) for x in self.by_term], -1: [np.flatnonzero(x < 0) for x in self.by_term]}

    def top(self, query: np.ndarray, own: int, k: int, reached: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows besides ``own``; rows under the score
        ``reached``, which ``k`` rows of other shards have, may be left out."""
        if int(np.abs(query).max(initial=0)) * int(np.abs(self.high - self.low).max(initial=0) + 1) * len(query) >= 1 << 52:
            by_term = self.by_term.astype(np.int64)
        else:
            by_term, query = self.by_term, query.astype(self.exact)
        bound = np.maximum(np.maximum(query * self.low, query * self.high), 0)
        terms = np.argsort(-bound, kind="stable")
        left = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])   # bounds of the terms from i on
        threshold = self._floor(query, by_term, terms, own, k) if reached is None else reached
        if threshold is None:
            essential = terms
        else:                                                  # strictly under: a tie may win by its id
            essential = terms[:int(np.searchsorted(-left, -threshold, side="right"))]
        rows = self._postings(query, essential, own)
        score = np.zeros(len(rows), by_term.dtype)
        for at in range(0, len(terms) + PROBE, PROBE):
            if threshold is not None:
                keep = score + left[min(at, len(terms))] >= threshold
                if not keep.all():
                    rows, score = rows[keep], score[keep]
            some = terms[at:at + PROBE]
            if len(some) and len(rows):
                score = score + query[some] @ by_term[some[:, None], rows]
        if len(rows) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[keep], score[keep]
        best = np.lexsort((rows, -score))[:k]
        return self.ids[rows[best]], score[best].astype(np.int64)

    def _floor(self, query: np.ndarray, by_term: np.ndarray, terms: np.ndarray, own: int, k: int):
        """A score that k vectors reach: the k-th best of those strongest in the leading terms."""
        lead = query[terms[:PROBE]] @ by_term[terms[:PROBE]]
        take = min(len(lead), 4 * k + 1)
        rows = np.argpartition(lead, len(lead) - take)[len(lead) - take:]
        rows = rows[self.rows[rows] != own]
        if len(rows) < k:
            return None
        score = query @ by_term[:, rows]
        return np.partition(score, len(score) - k)[len(score) - k]

    def _postings(self, query: np.ndarray, essential: np.ndarray, own: int) -> np.ndarray:
        """Rows in the posting list of an essential term; all if every term is essential."""
        gains = np.full(len(self.ids), len(essential) == len(query))
        if len(essential) < len(query):
            for t in essential:
                if query[t]:
                    gains[self.gain_from[1 if query[t] > 0 else -1][t]] = True
        gains &= self.rows != own
        return np.flatnonzero(gains)
