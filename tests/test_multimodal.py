"""Chunks of layout elements, against a plain loop over the rows."""

import json
import re

from coursemill.operators import chunking
from coursemill.plans import build, content, tables

ELEMENT = (
    "id string, source string, page int, source_page int, element_type string, text string, caption string, description string, netlist string, content_hash string, "
    "components array<struct<id:string,type:string,terminals:array<string>>>, nets array<struct<id:string,terminals:array<string>>>"
)


def expected(rows):
    hashes, begins, out = set(), set(), {}
    for r in sorted(rows, key=lambda r: r.id):
        key = (r.source, r.page, r.element_type, r.content_hash)
        if r.element_type == "text" or r.content_hash and key in hashes:
            continue
        hashes.add(key)
        parts = [r.caption, r.text, r.description]
        for label, items in (("元件：", r.components), ("连接网络：", r.nets)):
            parts.append(label + json.dumps([x.asDict() for x in items], ensure_ascii=False) if items else "")
        parts.append("Netlist：\n" + r.netlist if r.netlist else "")
        text = "\n".join(p for p in parts if p).strip()
        begin = (r.source, r.source_page or r.page, r.element_type, re.sub(r"\s+", "", text).lower()[:500])
        if text and begin not in begins:
            begins.add(begin)
            out[r.id] = text
    return out


def planted(spark):
    parts, wires = [("R1", "resistor", ["n1", "n2"]), ('"\\\n', None, None), (None, "x", [None, "é…"])], [("n1", ["R1.1"]), (None, [])]
    base = "a long text that begins alike " * 25
    rows = [
        ("a", "s", 1, 1, "circuit", " ", "图 1", None, "R1 n1 n2", None, parts, wires),
        ("b", "s", 1, 1, "circuit", None, None, None, None, "", parts, None),
        ("c", "s", 1, None, "table", base, None, None, None, "h", [], []),
        ("d", "s", 2, None, "table", base + "x", None, None, None, "h", None, None),
        ("e", "t", 1, None, "table", base, None, None, None, "h", None, None),
        ("f", "s", 1, None, "formula", base, None, None, None, "h", None, None),
        ("g", "s", 1, None, "table", "other", None, None, None, "h", None, None),
        ("h", "s", 1, 0, "table", base.upper() + "　 y", None, None, None, None, None, None),
        ("i", "s", 3, None, "image", None, "", "　\x1f", "", None, None, None),
        ("j", None, None, None, "image", "\xa0U = R\tI ", None, None, None, None, None, None),
        ("k", None, None, None, "image", "u=ri", None, None, None, None, None, None),
        ("l", "s", 1, None, "text", "text", None, None, None, None, parts, wires),
    ]
    return spark.createDataFrame(rows, ELEMENT)


def test_elements_with_any_content_are_kept_page_by_page(spark):
    rows = planted(spark)
    got = {r.id: r.text for r in chunking.multimodal_chunks(rows).collect()}
    assert got == expected(rows.collect())
    assert sorted(got) == ["a", "b", "c", "d", "e", "f", "j"]


def test_elements_of_the_tables(spark, data):
    rows = tables.elements(spark, data)
    assert {r.id: r.text for r in chunking.multimodal_chunks(rows).collect()} == expected(rows.collect())


def test_a_built_graph_has_the_parts_of_plausible_circuits(spark, data):
    pages, elements = tables.pages(spark, data), tables.elements(spark, data)
    made = build.build(pages, elements, content.CONCEPTS)
    kinds = {r.type: r["count"] for r in made["nodes"].groupBy("type").count().collect()}
    edges = {r.type: r["count"] for r in made["edges"].groupBy("type").count().collect()}
    plausible = [r for r in build.verified(elements).collect() if r.element_type == "circuit"]
    assert 0 < len(plausible) < elements.where("element_type = 'circuit'").count()
    assert all(len(r.components) > 1 and r.confidence >= 0.7 for r in plausible)
    assert kinds["component"] == edges["CONTAINS"] == len({(r.id, c.id) for r in plausible for c in r.components})
    assert kinds["net"] == len({(r.id, n.id) for r in plausible for n in r.nets}) and edges["CONNECTED_TO"] > 0


def test_a_circuit_is_judged_by_its_parts(spark):
    two = [("R1", "resistor", ["n1", "n2"]), ("R2", "resistor", ["n2", "n3"])]
    apart = [("R1", "resistor", ["n1", "n2"]), ("R2", "resistor", ["n3", "n4"])]
    rows = [("a", "circuit", "", 0.9, two), ("b", "circuit", "", 0.9, two[:1]), ("c", "circuit", "", 0.9, apart), ("d", "circuit", "放大电路", 0.9, apart), ("e", "circuit", "", 0.5, two), ("f", "circuit", "", None, two), ("g", "table", "", 0.1, None), ("h", "circuit", "", 0.9, None)]
    df = spark.createDataFrame([(*r, None, "", "x") for r in rows], "id string, element_type string, caption string, confidence double, components array<struct<id:string,type:string,terminals:array<string>>>, nets array<struct<id:string,terminals:array<string>>>, description string, netlist string")
    got = {r.id: (r.element_type, r.components is not None, r.netlist) for r in build.verified(df).collect()}
    assert {k for k, v in got.items() if v == ("circuit", True, "x")} == {"a", "d"} and got["g"] == ("table", False, "x")
    assert {k for k, v in got.items() if v == ("image", False, "")} == {"b", "c", "e", "f", "h"}
