"""Problem 7: leaked evaluation texts, against planted passages and brute force."""

import random

import numpy as np
import pytest

from coursemill.llm import leakage as k

WORDS = "the probe of a rail draws current while gain rises slowly under load and falls back when cold so that output follows input with delay near each stage limit".split()


def item(rng, n=70):
    out = []
    for i in range(n):
        out.append(f"{rng.randint(1, 999)}.{rng.randint(0, 99)}" if i % 9 == 4 else f"QX-{rng.randint(10, 999)}b" if i % 23 == 7 else rng.choice(WORDS) + rng.choice(["", "s", "ed"]))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    items = {100 + i: item(rng) for i in range(25)}
    docs, truth = [], set()
    for d in range(400):
        filler = [item(rng, rng.randint(0, 60)) for _ in range(2)]
        key = rng.choice(list(items))
        words, kind = items[key], d % 8
        passage = []
        if kind == 0:
            passage = words
        elif kind == 1:
            start = rng.randint(0, 25)
            passage = words[start : start + 42]
        elif kind == 2:
            passage = [w if w[0].isdigit() or "-" in w or i % 12 != 5 else "whatever" for i, w in enumerate(words)]
        elif kind == 3:
            passage = words[5:30]  # too short
        elif kind == 4:
            passage = [str(rng.randint(1000, 5000)) if w[0].isdigit() else w for w in words]  # another task
        elif kind == 5:
            passage = [w.upper() if i % 3 else f"<b>{w}</b>" for i, w in enumerate(words)]
        text = " ".join(filler[0]) + "\n" + ("\n" if kind == 5 else " ").join(passage) + "\n" + " ".join(filler[1])
        docs.append((d, text))
        if kind in (0, 1, 2, 5):
            truth.add((d, key))
    return items, docs, truth


def test_planted_passages(spark, corpus):
    items, docs, truth = corpus
    c = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(i, " ".join(w), "z") for i, w in items.items()] + [(1, None, "z"), (2, "...", "z"), (3, "", "z")], "item_id long, text string, doc_id string")
    got = {tuple(r) for r in k.find_leaks(c, e).collect()}
    assert got == truth
    assert {tuple(r) for r in k.find_leaks(c, e, block=7).collect()} == truth
    assert k.find_leaks(c.limit(0), e).count() == 0 and k.find_leaks(c, e.limit(0)).count() == 0


def test_figures_broken_by_marks_and_lines():
    (one,) = k.make_items([(1, "sample 23 of the sensor sits 182.45 V above its case until the QX-515a is pulled out")])
    assert k.passage_share(one, "sample23ofthesensorsits18245vaboveitscaseuntiltheqx515aispulledout") == 1
    assert k.passage_share(one, "sample23ofthesensorsits18246vaboveitscaseuntiltheqx515aispulledout") < 0.7


def test_fingerprints_within_the_radius_always_meet():
    rng = np.random.default_rng(3)
    (one,) = k.make_items([(1, " ".join(item(random.Random(4), 90)))])
    (index,) = k.make_indexes([one])
    for _ in range(300):
        at = rng.integers(len(index.marks))
        mark = index.marks[at]
        for bit in rng.choice(64, k.RADIUS, replace=False):
            mark ^= np.uint64(1) << np.uint64(bit)
        _, entry = index.probe(np.array([mark], np.uint64))
        assert at in entry


def test_strided_fingerprints_are_those_of_all_positions():
    from coursemill.llm.tokens import tokenize

    text = " ".join(item(random.Random(1), 61))
    points = np.frombuffer((text + text).encode("utf-32-le"), np.uint32)
    t = tokenize(points, np.array([0, len(text), 2 * len(text)]))
    marks, first = k.simhash_strided(t, 16)
    every = k.simhash_all(t.hash[: t.offsets[1]], 16)
    inside = [(m, f) for m, f in zip(marks, first) if f + 16 <= t.offsets[1]]
    assert len(inside) > 3 and all(every[f] == m for m, f in inside)
