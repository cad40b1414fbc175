"""A whole knowledge base, and outlines."""

import pytest

from coursemill.operators import outline
from coursemill.plans import build, content, tables
from coursemill.sources.store import VersionedStore


def test_build_and_publish(spark, data, tmp_path):
    made = build.build(tables.pages(spark, data), tables.elements(spark, data), content.CONCEPTS)
    audit = {r.rule: r.ok for r in made["audit"].collect()}
    assert audit["chunk has text"] and audit["edge has both ends"] and audit["chunk is no question"]
    store = VersionedStore(spark, f"file://{tmp_path}/kb")
    build.publish(store, made)
    assert store.read("chunks").count() == made["chunks"].count() > 0
    with pytest.raises(ValueError, match="chunk has text"):
        build.publish(store, {**made, "audit": spark.createDataFrame([("chunk has text", 1, 2, False)], made["audit"].schema)})


def test_outline(spark):
    text = "intro。第二句\n# **Plan**\n- a\n- a\n1. [b](x)\n## T\n| x | y |\n|--|--|\n| 1 | 2 |\n"
    got = outline.outline(text)
    assert [(s["level"], s["title"], s["items"]) for s in got] == [(0, "", ["intro。", "第二句"]), (1, "Plan", ["a", "b"]), (2, "T", ["x | y", "1 | 2"])]
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(outline.sections("t").alias("s")).collect()
    assert [len(r.s) for r in rows] == [3, 0, 0] and rows[0].s[1].title == "Plan"
    assert outline.shorten("ab $x^2$ cd", 8) == "ab…" and outline.shorten("ab", 8) == "ab"
