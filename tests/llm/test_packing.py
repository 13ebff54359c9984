import zlib

import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bandscape.llm import packing, word_ids
from bandscape.llm.workload import QUERIES

LIBRARY = Tokenizer.from_file(packing.TOKENIZER)
ENCODER = word_ids.Encoder(packing.TOKENIZER)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


ODD = ["İstanbul İ ΣΑΣ ς", "é ́x", "a\r\nb\tc  d\n\n", "it's we'll 'S 12 3½", " x y　z​",
       "<|endoftext|>", "x<|startoftext|> y", "<|END oftext|>", "", " ", "日本語のテキスト " * 9, "\x00\x0b\x0c\x1c\x85", "🙂👍🏽 ok", "가가"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ENCODER(text).tolist() == ids(text)


@settings(deadline=None, max_examples=300)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\r\n'aA1.sṤ")), max_size=60))
def test_any_text(text):
    assert ENCODER(text).tolist() == ids(text)


def test_long_texts(monkeypatch):
    text = " ".join(f"Wort{i} is{'x' * (i % 90)}" for i in range(3000)) + "y" * 5000
    monkeypatch.setattr(word_ids, "_SLICE", 1000)
    monkeypatch.setattr(word_ids, "_KEPT", 50)
    assert word_ids.Encoder(packing.TOKENIZER)(text).tolist() == ids(text)


def test_whole_corpus():
    """Every text of the documents, as the library encodes it."""
    texts = [text or "" for text in pd.read_parquet(f"{DATA}/../sf0.01/documents.parquet")["text"]]
    got = list(word_ids.Encoder(packing.TOKENIZER).encode(texts))
    assert len(got) == len(texts)
    for text, found in zip(texts, got):
        assert found.tolist() == ids(text)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(st.sampled_from("abcdeilnorstuüßé'09.,-A!"), min_size=1, max_size=40), min_size=1, max_size=30))
def test_merged_words(words):
    assert [i for found in ENCODER.encode(words) for i in found] == ids(" ".join(words))


def test_runs_of_equal_letters():
    for letter in "aeso!0é":
        for n in range(1, 64):
            assert ENCODER(letter * n).tolist() == ids(letter * n)


def test_another_kind_of_file():
    other = packing.TOKENIZER.replace("word_bpe_49k", "byte_bpe_50k")
    text = "Two  words\n and\ttabs <|endoftext|>"
    want = Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids
    assert word_ids.Encoder(other)(text).tolist() == want


@given(st.integers(1, 100_000))
def test_cut(n):
    lengths = packing.cut(n)
    assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 2048 for x in lengths)
    assert lengths == sorted(lengths, reverse=True) and len([x for x in lengths if x < 2048]) == bin(n % 2048).count("1")


def check(docs, got):
    by_row = {}
    for r in got:
        by_row.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = sorted(((d is None, d or 0), zlib.crc32(np.array(body[a:a + n], "<u4").tobytes()), a, n, len(body))
                  for d, t in docs for body in [[*ids(t), 1]]
                  for a, n in zip(np.cumsum([0, *packing.cut(len(body))[:-1]]).tolist(), packing.cut(len(body))))
    assert want == sorted(((r.doc_id is None, r.doc_id or 0), r.ids_crc32, r.start, r.length, r.doc_tokens) for r in got)
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and all(r.offset == 0 for r in got)
    in_order = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in in_order] == sorted((r.length for r in got), reverse=True)
    for n in {r.length for r in got}:
        assert [r.place for r in in_order if r.length == n] == list(range(sum(r.length == n for r in got)))


def packed(docs):
    return packing.sequences(packing.pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")).collect()


def test_documents(spark):
    docs = [(i, f"Some text {i} " * (i % 40)) for i in range(120)] + [(500, "hot one") for _ in range(200)]
    docs += [(600, None), (601, ""), (None, "null key"), (None, None), (700, "many words " * 30_000), (701, "z" * 20_000), *((800 + i, t) for i, t in enumerate(ODD))]
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in docs], "doc_id long, text string, length int, row int, ids string")
    check(docs, packed(df))


def test_empty(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string")) == []


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, QUERIES["op12_packing"](spark, DATA).collect())


def test_written_buckets(spark, tmp_path):
    docs = [(i, f"word{i} and more " * (1 + i % 30)) for i in range(80)]
    packing.write_buckets(spark.createDataFrame(docs, "doc_id long, text string"), f"{tmp_path}/out", tokens=64)
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("doc_id", "start").collect()
    back = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        back[r.doc_id] = [*back.get(r.doc_id, []), *np.frombuffer(r.ids, "<u4").tolist()]
    assert back == {d: [*ids(t), 1] for d, t in docs}
    sizes = {}
    for r in rows:
        sizes[r.length, r.batch] = sizes.get((r.length, r.batch), 0) + 1
    last = {n: max(b for m, b in sizes if m == n) for n, _ in sizes}
    assert all(c == max(64 // n, 1) for (n, b), c in sizes.items() if b < last[n])


def test_limit(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    assert sorted(r.length for r in packing.pieces(docs, limit=4).collect()) == [1, 2, 4, 4]
    with pytest.raises(ValueError):
        packing.pieces(docs, limit=12)
