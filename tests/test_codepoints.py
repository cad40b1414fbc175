"""Flat arrays of code points: round trips, hashes of runs, slices."""

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from coursemill.functions import codepoints as cp

TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=30)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=12))
def test_round_trip(values):
    column = pa.array(values, pa.string())
    points, offsets = cp.flatten(column)
    valid = np.array([v is not None for v in values], bool)
    assert cp.unflatten(points, offsets, valid).to_pylist() == values
    assert np.diff(offsets).tolist() == [len(v or "") for v in values]


def test_sliced_arrays():
    column = pa.array(["ab", None, "电路", "𝑅x", ""]).slice(1, 3)
    points, offsets = cp.flatten(column)
    assert cp.unflatten(points, offsets).to_pylist() == ["", "电路", "𝑅x"]


@given(st.lists(st.integers(0, 0x10FFFF), min_size=1, max_size=60), st.data())
def test_equal_runs_have_equal_hashes(points, pick):
    array = np.array([*points, 7, *points], np.uint32)
    a = pick.draw(st.integers(0, len(points)))
    b = pick.draw(st.integers(a, len(points)))
    hasher, shift = cp.RunHasher(array), len(points) + 1
    first, second = hasher(np.array([a, a + shift]), np.array([b, b + shift]))
    assert first == second
    if b > a:
        other = array.copy()
        other[a] ^= 1
        assert cp.RunHasher(other)(np.array([a]), np.array([b]))[0] != first


def test_row_slices_bound_the_text():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 5, 40, 0, 3)])], names=["t"])
    parts = list(cp.row_slices(batch, "t", 12))
    assert [p.num_rows for p in parts] == [2, 1, 2]
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist()
    assert list(cp.row_slices(batch.slice(0, 0), "t")) == []
