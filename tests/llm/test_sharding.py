import heapq
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bandscape.llm import sharding


def slow_loads(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
    return sorted(load for load, _ in heap)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 300)), max_size=12, unique_by=lambda x: x[0]),
       st.integers(1, 7))
def test_runs_give_the_loads_of_single_groups(runs, shards):
    heap = [(0, s) for s in range(shards)]
    for size, n in sorted(runs, reverse=True):
        assert sum(sharding.place_run(heap, size, n)) == n
    assert sorted(load for load, _ in heap) == slow_loads([s for s, n in runs for _ in range(n)], shards)


def check(rows, got, shards):
    assert len(got) == len(rows)
    by_text, slots, loads = {}, {}, [0] * shards
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r.size
    text = {d: t or "" for d, t in rows}
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert by_text.setdefault(text[r.doc_id], r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for _, t in rows:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 1
    assert sorted(loads) == slow_loads(groups.values(), shards)


def test_equals_brute_force(spark):
    rows = [(i, "x" * (i * 37 % 211)) for i in range(400)] + [(1000 + i, "hot" * 50) for i in range(200)]
    rows += [(2000, None), (2001, ""), (2002, None), (2003, "é" * 70_000), (2004, "é" * 70_001)]
    docs = spark.createDataFrame([(d, t, 1, "g") for d, t in rows], "doc_id long, text string, size int, group string")
    check(rows, sharding.assign(docs, 16).collect(), 16)


def test_rounded_runs_stay_near_equal(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EXACT", 16)
    monkeypatch.setattr(sharding, "HEAVY", 1)
    rows = [(i, chr(97 + i % 26) * (3000 + i)) for i in range(500)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    loads = [sum(r.size for r in got if r.shard == s) for s in range(4)]
    assert len(got) == 500 and max(loads) - min(loads) < 6000


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None), (1, "a"), (1, "a")]])
def test_empty_null_and_repeated(spark, rows):
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    assert len(got) == len(rows)
    assert len({(r.shard, r.slot) for r in got}) == len(rows)


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i % 7}" * 9) for i in range(60)], "doc_id long, text string")
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 60 and back.select("shard").distinct().count() == 4
