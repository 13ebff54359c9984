import duckdb
import numpy as np
import pytest
from conftest import DATA
from test_repeats import slow as slow_repeats
from test_simhash import slow_components, slow_fingerprint
from test_words import slow_contamination

import corpus_pipeline as P
from bandscape.functions.runtime import materialise
from bandscape.llm import sentencepiece_codec
from bandscape.llm.pieces import load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in P.STAGES:
        before, docs = docs, materialise(stage(spark, docs, DATA))
        out.append((before.toPandas(), docs.toPandas()))
    return out


def test_language_stage_keeps_clean_documents(stages):
    before, after = stages[0]
    assert list(after.columns) == COLUMNS and after.lang.notna().all()
    gone = before[~before.doc_id.isin(after.doc_id)]
    letters = gone.text.fillna("").map(lambda t: sum(c.isalpha() for c in t))
    assert len(gone) <= 2 and (letters == 0).sum() == (before.text.fillna("").map(lambda t: sum(c.isalpha() for c in t)) == 0).sum()


def test_near_dedup_stage(stages):
    before, after = stages[1]
    rows = before.sort_values("doc_id")
    root = slow_components([slow_fingerprint(t) for t in rows.text])
    want = {rows.doc_id.iloc[i] for i in range(len(rows)) if root[i] == i}
    assert set(after.doc_id) == want and len(after) == len(want) < len(before) and list(after.columns) == COLUMNS


def test_repeats_stage(stages):
    before, after = (x.sort_values("doc_id") for x in stages[2])
    want = slow_repeats(before.text.tolist(), 200, first=True)
    after = after.set_index("doc_id")
    for doc, text, (size, removed, _, _) in zip(before.doc_id, before.text, want):
        left = after.text.get(doc, "")
        assert (left == text) == (not removed) and size - removed <= len(left.encode()) <= size - removed + 6 * text.count("\n") + 40
    assert (after.text.str.len() == after.n_chars).all() and list(after.columns) == COLUMNS[1:]


def test_decontamination_stage(stages):
    before, after = stages[3]
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    flagged = {k for k, *_, bad in slow_contamination(list(zip(before.doc_id, before.text)), items) if bad}
    assert set(after.doc_id) == set(before.doc_id) - flagged and flagged and list(after.columns) == COLUMNS


def test_encoding_stage(stages):
    before, after = stages[4]
    codec = sentencepiece_codec.Codec(load())
    assert len(after) == len(before) and after.round_trip.all()
    ids = after.set_index("doc_id").ids
    for doc, text in zip(before.doc_id, before.text):
        assert codec.decode(np.array(ids[doc], "<i4").tobytes()) == text


ROWS = [(None, None, None, None, None, None), (1, "", "en", "s", 0, "x"), (1, "", "en", "s", 0, "x"), (2, "...", None, None, None, None),
        (3, "the cat sat on the mat " * 40, "en", "s", 1, "y"), (3, "the cat sat on the mat " * 40, "en", "s", 1, "y"),
        (None, "word " * 9000, None, "s", 2, None)]


@pytest.mark.parametrize("rows", [[], ROWS])
def test_odd_rows_and_extra_columns(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        left = out.collect()
        assert len(left) == {"language_id": 3, "simhash_near_dedup": 4, "suffix_array_dedup": 6,
                             "benchmark_decontamination": 7}[name] if rows else not left, name
    assert P.encode(spark, docs, DATA).count() == len(rows)
