import numpy as np
import pytest
from pyspark.sql import functions as F

from bandscape.llm import topk


def slow(vectors, queries, k):
    out = []
    for q in queries:
        score = sorted((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(score[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale,dim", [(3, 4), (40, 64), (100_000, 9), (1 << 28, 3)])
def test_shard_equals_brute_force(scale, dim):
    rng = np.random.default_rng(dim)
    values = rng.integers(-scale, scale + 1, (500, dim))
    values[::7] = values[3]
    values[::5] = np.abs(values[::5])
    ids = rng.permutation(10_000)[:500]
    index = topk.Shard(ids, ids, values)
    vectors = dict(zip(ids.tolist(), values))
    for k in (1, 20, 600):
        for q in ids[:40].tolist():
            vec, score = index.top(vectors[q], q, k)
            assert [(q, n + 1, int(v), int(s)) for n, (v, s) in enumerate(zip(vec, score))] == slow(vectors, [q], k)
            if len(score) > 3:                                  # a score handed on from another shard
                kept = index.top(vectors[q], q, k, int(score[3]))
                at_least = [(int(v), int(s)) for v, s in zip(vec, score) if s >= score[3]]
                assert [(int(v), int(s)) for v, s in zip(*kept)][:len(at_least)] == at_least


def test_few_rows_are_scored_in_full():
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(20, 64)) * 9
    values = np.floor(middle[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 64))).astype(int)
    index = topk.Shard(np.arange(4000), np.arange(4000), values)
    query = values[0].astype(float)
    bound = np.maximum(np.maximum(query * index.low, query * index.high), 0)
    assert index._floor(query, index.by_term, np.argsort(-bound), 0, 20) > 0.5 * query @ query


def test_query(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 400)]
    rows += [(400, None), (401, []), (402, [1.0, None] * 3), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (None, [1.0] * 6),
             (405, [1.0, 2.0]), (406, [2.0, 1.0]), (5, rows[5][1]), (7, rows[7][1]), (10, [9.0] * 6), (11, [-9.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("v", F.lit(2))
    sound = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows
             if i is not None and i not in range(400, 405)]
    want = []
    for row, (q, own) in enumerate(sound):
        if q % 5 == 0:
            score = sorted((-int(np.dot(own, v)), i) for r, (i, v) in enumerate(sound) if r != row and len(v) == len(own))
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(score[:20])]
    got = topk.top_k(topk.integer_vectors(frame, "vec_id", "embedding"), F.col("id") % 5 == 0, 20, 64, 16).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(topk.integer_vectors(frame.limit(0), "vec_id", "embedding"), F.col("id") % 5 == 0, 20).count() == 0
