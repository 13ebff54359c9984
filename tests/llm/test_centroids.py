from hashlib import sha256

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bandscape.llm import centroids as C
from bandscape.llm.workload import QUERIES


def order():
    return F.sha2(F.concat(F.lit("3:"), F.col("key").cast("string")), 256)


def brute_force(rows, k=8, rounds=10):
    kept = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 131072 for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, sha256(f"3:{r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
    mid = [v.tolist() for _, v in first]

    def place():
        out = []
        for _, v in kept:
            gaps = [sum((int(a) - b) ** 2 for a, b in zip(v, m)) for m in mid]
            out.append((gaps.index(min(gaps)), min(gaps)))
        return out

    for _ in range(rounds):
        placed = place()
        for c in range(len(mid)):
            own = [v for (_, v), (p, _) in zip(kept, placed) if p == c]
            if own:
                mid[c] = [int(s) // len(own) for s in sum(own)]
    placed = place()
    total = sum(d for _, d in placed)
    return [(i, c, d, sum(e for b, e in placed if b == c), total, sha256(",".join(map(str, mid[c])).encode()).hexdigest())
            for (i, _), (c, d) in zip(kept, placed)]


def check(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, v int, cluster string")
    as_stored = [(r.vec_id, r.embedding) for r in df.collect()]
    got = C.cluster(C.whole_vectors(df, "vec_id", "embedding"), order()).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_force(as_stored), key=str)
    return got


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) + 3 * (i % 5)).tolist()) for i in range(150)]
    hot = rng.normal(size=64).tolist()
    rows += [(1000 + i, hot) for i in range(120)] + [(7, hot), (7, hot), (None, hot), (None, [0.0] * 64)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None, *[1.0] * 63]), (2004, [float("nan"), *[1.0] * 63]),
             (2005, [float("inf"), *[1.0] * 63]), (2006, [131071.0, *[-131071.0] * 63]), (2007, [1e30, *[1.0] * 63])]
    got = check(spark, rows)
    assert len(got) == 275


@pytest.mark.parametrize("rows", [[], [(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(30)],
                                  [(i, [float(i % 3), *[0.0] * 63]) for i in range(20)],
                                  [(i, [float(i), *[0.0] * 63]) for i in range(40)]])
def test_few_equal_and_collinear_vectors(spark, rows):
    assert len(check(spark, rows)) == len(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, QUERIES["op13_centroids"](spark, DATA).collect())) == sorted(brute_force(rows))


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10_000), st.sampled_from([1, 40, 3000, C.REACH - 1]), st.integers(1, 8))
def test_bounds_hold_and_prune(seed, reach, k):
    rng = np.random.default_rng(seed)
    v = rng.integers(-reach, reach + 1, (60, 64))
    v[:20] = v[:1] + rng.integers(-3, 4, (20, 64))
    pivots = v[rng.integers(0, 60, k)]
    s = C.simplex(pivots)
    a, mid = C.apexes(s, v), v[rng.integers(0, 60, 8)]
    b = C.apexes(s, mid)
    true = np.sqrt(((v[:, None] - mid[None]).astype(float) ** 2).sum(2))
    gap = ((a[:, None, :-2] - b[None, :, :-2]) ** 2).sum(2)
    slack = a[:, None, -1] + b[None, :, -1]
    low = np.sqrt(gap + (a[:, None, -2] - b[None, :, -2]) ** 2) - slack
    high = np.sqrt(gap + (a[:, None, -2] + b[None, :, -2]) ** 2) + slack
    assert (low <= true * (1 + 1e-12)).all() and (true <= high * (1 + 1e-12) + 1e-9).all()
    cluster, distance, _ = C.nearest(v, a, mid, b)
    exact = np.array([[sum(int(x) ** 2 for x in v[i] - m) for m in mid] for i in range(60)], dtype=object)
    assert (cluster == [row.tolist().index(min(row)) for row in exact]).all()
    assert (distance == exact.min(1)).all()


def test_bounds_rule_out_far_centroids():
    rng = np.random.default_rng(1)
    mid = rng.integers(-5000, 5000, (8, 64))
    v = np.repeat(mid, 50, 0) + rng.integers(-20, 21, (400, 64))
    s = C.simplex(mid)
    _, _, compared = C.nearest(v, C.apexes(s, v), mid, C.apexes(s, mid))
    assert compared == len(v)
