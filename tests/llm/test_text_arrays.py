import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm.text_arrays import ragged, steps, words_of

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab é漢\n\t\v\f\r .", max_size=20)), max_size=8)


@given(TEXT)
@settings(max_examples=150, deadline=None)
def test_words(texts):
    w = words_of(pa.array(texts, pa.string()))
    want = [(i, x.encode()) for i, t in enumerate(texts) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert list(zip(w.doc.tolist(), w.values().to_pylist())) == want


@given(TEXT, st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_slices(texts, at):
    column = pa.array(texts, pa.string())
    assert words_of(column.slice(at)).values().to_pylist() == words_of(pa.array(texts[at:], pa.string())).values().to_pylist()


def test_steps_cover_every_row():
    column = pa.array(["x" * 10, None, "", "y" * 100, "z"])
    assert list(steps(column, 15)) == [(0, 3), (3, 4), (4, 5)]
    assert list(steps(pa.array([], pa.string()))) == []


def test_ragged():
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert ragged(np.array([], int), np.array([], int)).tolist() == []
