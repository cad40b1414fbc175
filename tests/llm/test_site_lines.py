"""Problem 5: repeated lines of a source, against brute force and over several deliveries."""

import re
from collections import defaultdict

from coursemill.llm import site_lines as s
from coursemill.llm.canonical import canonical_string


def fold(line):
    return re.sub(r"\d+", "0", "".join(canonical_string(line).lower().split()))


def brute(pages):
    seen, where, of = defaultdict(set), defaultdict(set), defaultdict(set)
    for page, source, text in pages:
        if page is None:
            continue
        source = source or ""
        of[source].add(page)
        for n, line in enumerate((text or "").split("\n"), 1):
            if fold(line):
                seen[source, fold(line)].add(page)
                where[source, fold(line)].add((page, n))
    return {x for k, v in seen.items() if len(v) >= 4 and len(v) * 10 >= len(of[k[0]]) for x in where[k]}


def pages():
    out = []
    for i in range(60):
        lines = [f"line {i} of its own kind {'x' * i}", ""]
        if i % 3 == 0:
            lines += [f"Ｔｅrms of use {i}", "Terms of  USE 7"]
        if i % 9 == 0:
            lines.append(f"第{i}页")
        out.append((f"p{i}", "hot" if i % 4 else None, "\n".join(lines)))
    return [*out, ("e1", "t", None), ("e2", "t", ""), (None, "t", "x"), ("e3", "t", "one\none\none\none")]


def test_found_lines_are_the_brute_force_lines(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id string, source string, text string")
    for cuts in ([1.0], [0.3, 0.3, 0.4]):
        index = s.SiteLines(spark)
        parts = df.randomSplit(cuts, seed=4)
        for part in parts:
            index.merge(part)
        index.merge(df.limit(7))  # delivered again
        assert {tuple(r) for r in index.found().collect()} == brute(rows)


def test_only_pages_with_changed_lines_are_rebuilt(spark):
    schema = "page_id string, source string, text string"
    index = s.SiteLines(spark)
    index.merge(spark.createDataFrame([(f"a{i}", "s", f"own {'y' * i}\nnotice" if i < 3 else f"own {'y' * i}") for i in range(6)], schema))
    assert index.to_rebuild().count() == 0
    index.merge(spark.createDataFrame([("b", "s", "notice")], schema))
    assert {r.page_id for r in index.to_rebuild().collect()} == {"a0", "a1", "a2", "b"}
    index.merge(spark.createDataFrame([("c", "s", "notice\nother")], schema))
    assert index.newly_crossed().count() == 0


def test_pages_without_their_lines(spark):
    df = spark.createDataFrame([("p", "a\nb\nc", 1), ("q", None, 2), ("r", "a", 3)], "page_id string, text string, line_no int")
    found = spark.createDataFrame([("p", 2), ("r", 1)], "page_id string, line_no int")
    assert {r.page_id: (r.text, r.removed_lines) for r in s.without_lines(df, found).collect()} == {"p": ("a\nc", 1), "q": (None, 0), "r": ("", 1)}


def test_empty_table(spark):
    index = s.SiteLines(spark)
    index.merge(spark.createDataFrame([], "page_id string, source string, text string"))
    assert index.found().count() == 0


def test_pages_built_in_parts_are_those_built_at_once(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id string, source string, text string")
    clean = s.CleanPages(s.SiteLines(spark, buckets=4))
    for part in df.randomSplit([0.4, 0.3, 0.3], seed=2):
        clean.merge(part)
    clean.merge(df.limit(5))  # delivered again
    drop = brute(rows)
    want = {p: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (p, n) not in drop) for p, _, t in rows if p}
    got = clean.pages().collect()
    assert len(got) == len(want) and {r.page_id: r.text for r in got} == want


def test_a_merge_leaves_other_buckets_alone(spark):
    schema = "page_id string, source string, text string"
    index = s.SiteLines(spark, buckets=8)
    index.merge(spark.createDataFrame([(f"a{i}", f"s{i % 5}", "notice") for i in range(30)], schema))
    heads = {b: list(v) for b, v in index.heads["counts"].items()}
    index.merge(spark.createDataFrame([("b", "s1", "notice")], schema))
    assert len(heads) > 1 and sum(index.heads["counts"][b] != v for b, v in heads.items()) == 1
