import numpy as np
import pyarrow as pa
import pytest

from bandscape.llm.common import lean, portions


def test_portions_cover_all_rows_in_order():
    texts = ["a" * int(k) for k in np.random.default_rng(0).integers(0, 40, 200)] + [None, "é" * 500, "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    parts = list(portions(batch, 1, 100))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(len(p) == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 100 for p in parts)
    assert list(portions(batch.slice(0, 0), 1)) == []


def test_lean_passes_rows_and_errors_on():
    assert list(lean(lambda rows: (2 * r for r in rows))(iter([1, 2]))) == [2, 4]

    def fails(rows):
        yield next(rows)
        raise ValueError("told")

    with pytest.raises(ValueError, match="told"):
        list(lean(fails)(iter([1])))
