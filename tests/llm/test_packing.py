"""Problem 6: containers."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coursemill.llm import packing as k


def expand(plan, histogram):
    import numpy as np

    lengths = np.array([x for x, n in histogram.items() for _ in range(n)], int)
    ranks = np.array([i for _, n in histogram.items() for i in range(n)], int)
    return lengths, plan.place(lengths, ranks) if len(lengths) else ranks


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(0, 64), st.integers(1, 30), max_size=20), st.integers(0, 3))
def test_plans_are_valid(histogram, separator):
    plan = k.make_plan(dict(histogram), 64, separator)
    lengths, at = expand(plan, histogram)
    used, pieces = Counter(), Counter()
    for length, container in zip(lengths.tolist(), at.tolist()):
        assert 0 <= container < plan.containers
        used[container] += length
        pieces[container] += 1
    assert all(used[c] + (pieces[c] - 1) * separator <= 64 for c in pieces)
    assert len(pieces) == plan.containers


def test_plans_are_tight():
    import random

    rng = random.Random(2)
    histogram = Counter(min(512, int(rng.lognormvariate(4.6, 0.9)) + 1) for _ in range(20_000))
    plan = k.make_plan(dict(histogram), 512, 0)
    assert plan.used / (plan.containers * 512) > 0.99


def test_rows(spark):
    docs = [(i, "电路 test " * (i % 40)) for i in range(300)] + [(900, "long text " * 2000), (901, None), (902, "")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, piece_no int").repartition(7)
    targets = spark.createDataFrame([(1, 64, 0), (2, 256, 2), (3, None, 1), (4, 128, None)], "target_id int, capacity_tokens int, separator_tokens int")
    got = k.pack(df, targets).toPandas()
    count = k.encoder().encode_ordinary
    want = {key: len(count(text or "")) for key, text in docs}
    assert set(got.target_id) == {1, 2, 4}
    for target, cap, sep in ((1, 64, 0), (2, 256, 2), (4, 128, 0)):
        mine = got[got.target_id == target]
        assert mine.groupby("doc_id").piece_tokens.sum().to_dict() == want
        assert not mine.duplicated(["doc_id", "piece_no"]).any()
        assert all(mine[mine.doc_id == d].shape[0] == max(1, -(-n // cap)) for d, n in want.items())
        used = mine.groupby("container_id").piece_tokens.agg(["sum", "size"])
        assert (used["sum"] + (used["size"] - 1) * sep <= cap).all()
    assert k.pack(df.limit(0), targets).count() == 0


def test_squares_find_exact_repeats():
    import numpy as np

    rows, columns, values = np.array([0, 0, 1, 1]), np.array([0, 1, 1, 2]), np.array([1.0, 1.0, 1.0, 2.0])
    x = k.nonnegative_least_squares(rows, columns, values, np.array([10.0, 6.0]), 3, 4000)
    assert np.bincount(rows, values * x[columns], 2) == pytest.approx([10, 6], abs=1e-2) and (x >= 0).all()
