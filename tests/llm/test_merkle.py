import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from bandscape.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, total int"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(doc, text):
    parts = [*doc[:4], text]
    return h("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def above(nodes):
    return [h("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]


def brute_force(docs):
    groups = {}
    for doc in docs:
        groups.setdefault(doc[1], []).append(doc)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    paths, subroots = [], []
    for q, name in enumerate(names):
        rows = sorted(groups[name], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[4])))
        levels = [[leaf(d, d[4]) for d in rows]]
        while len(levels[-1]) > 1:
            levels.append(above(levels[-1]))
        subroots.append(levels[-1][0])
        paths += [(d, q, i, levels) for i, d in enumerate(rows)]
    top = [subroots]
    while len(top[-1]) > 1:
        top.append(above(top[-1]))
    out = []
    for d, q, i, levels in paths:
        changed = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 and d[4] is not None
        node, proof = leaf(d, d[4].replace("\n", "") if changed else d[4]), ""
        for tree, at in ((levels, i), (top, q)):
            for level in tree[:-1]:
                run = level[at // 3 * 3:at // 3 * 3 + 3]
                proof += "".join(run[:at % 3] + run[at % 3 + 1:])
                run[at % 3] = node
                node, at = h("".join(run)), at // 3
        out.append((d[0], leaf(d, d[4]), subroots[q], top[-1][0], h(proof), node, node == top[-1][0]))
    return out


def documents(n=400):
    docs = [(i, "hot" if i % 3 else f"s{i % 17}", "en", i * 7, f"line {i}\nline\n" if i % 5 else "flat") for i in range(n)]
    docs += [(9000, None, None, None, None), (9001, None, "de", 0, ""), (9002, "", "é", 1, "\n"), (9003, "é", None, 3, "x\n" * 40_000)]
    docs += [(9010, "dup", "en", 1, "same\ntext")] * 5 + [(None, "dup", "en", 1, "a\nb"), (None, "dup", "en", 1, "c")]
    return docs


def key(row):
    return tuple((v is not None, v) for v in row)


def check(spark, docs):
    rows = [(*d, "x", 1, 2) for d in docs]
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    got = merkle.manifest(merkle.document_leaves(spark.createDataFrame(rows, SCHEMA), even), "doc_id").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_force(docs), key=key)
    return got


@pytest.mark.parametrize("height", [1, 2, 6])
def test_equals_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 3 ** height)
    got = check(spark, documents())
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("docs", [[], [(1, "a", "en", 2, "x\ny")], [(2, None, None, None, None)],
                                  [(i, "one", "en", 1, "t") for i in range(4)],
                                  [(i, f"s{i}", "en", 1, "t\n") for i in range(5)]])
def test_small_tables(spark, docs):
    check(spark, docs)


def test_a_changed_proof_fails(spark):
    leaves = merkle.document_leaves(spark.createDataFrame([(*d, "x", 1, 2) for d in documents(30)], SCHEMA), F.lit(False))
    assert merkle.manifest(leaves, "doc_id").filter("not verified").isEmpty()
    other = leaves.withColumn("claimed", F.when(F.col("doc_id") == 7, F.sha2(F.lit("other").cast("binary"), 256)))
    assert [r.doc_id for r in merkle.manifest(other, "doc_id").filter("not verified").collect()] == [7]
