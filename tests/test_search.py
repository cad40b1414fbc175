"""Vectors against brute force, the fusion of signals, and joins whose broadcast is bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursemill.operators import joins, search


def test_vectors_in_blocks_are_those_of_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).astype(float).tolist()) for i in range(60)] + [(60, None), (61, []), (62, [1.0, 2.0]), (63, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    asked = df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.vec_id): r.score for r in search.cosine_pairs(df, asked, block=3).collect()}
    vectors = {r.vec_id: np.array(r.embedding or [], float) for r in df.collect()}
    for (q, v), score in got.items():
        a, b = vectors[q], vectors[v]
        want = a @ b / max(np.linalg.norm(a), 1e-12) / max(np.linalg.norm(b), 1e-12) if len(a) == len(b) else 0.0
        assert abs(score - want) < 1e-6
    assert len(got) == 7 * 64
    top = search.vector_topk(df, asked, k=4).collect()
    for q in {r.query_id for r in top}:
        want = sorted(((-s, v) for (a, v), s in got.items() if a == q))[:4]
        assert [(-r.score, r.vec_id) for r in sorted(top, key=lambda r: r.rank) if r.query_id == q] == want
    assert search.cosine_pairs(df, asked.limit(0)).count() == 0 and search.cosine_pairs(df.limit(0), asked).count() == 0


def test_hybrid_pins_pictures_and_changes_weights(spark):
    rows = spark.createDataFrame([("a", "gain", ""), ("b", "gain stage", "gain"), ("c", None, None)], "id string, words string, tags string")
    queries = spark.createDataFrame([(1, "gain"), (2, "gain")], "query_id int, query string")
    score = lambda *r: spark.createDataFrame(list(r), "query_id int, id string, score double")
    signals = {"vector": score((1, "a", 0.9), (1, "c", 0.1), (2, "a", 0.9)), "bm25": score((1, "b", 2.0)), "graph": score((2, "b", 1.0)), "image": score((1, "c", 0.5)), "visual": score((2, "c", 0.8))}
    got = search.hybrid(rows, queries, signals, "id", "query_id", lambda q, w: F.length(F.coalesce(w, F.lit(""))) / 10.0).collect()
    one, two = ([(r.id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (1, 2))
    w, v = search.WEIGHTS, search.IMAGE_WEIGHTS
    assert dict(one) == pytest.approx({"a": w["vector"] + w["token_overlap"] + w["cross"] * 0.4, "b": w["bm25"] + w["token_overlap"] + w["tag_overlap"] + w["cross"], "c": w["image"]}, abs=1e-4)
    assert two[0] == ("c", v["image"]) and dict(two)["b"] == pytest.approx(v["token_overlap"] + v["tag_overlap"] + v["graph"] + v["cross"], abs=1e-4)


def test_a_wide_side_is_not_broadcast(spark, monkeypatch):
    left, right = spark.range(20).withColumn("x", F.lit(1)), spark.range(5).withColumn("wide", F.repeat(F.lit("a"), 100))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(joins.guarded_join(left, right, ["id"]))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 100)
    salted = joins.guarded_join(left, right, ["id"])
    assert "broadcast" not in plan(salted) and salted.count() == 5
