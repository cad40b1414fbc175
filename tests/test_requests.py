"""Requests whose question stands in another column."""

from coursemill.plans import ranking


def test_near_duplicates_have_every_request(spark, tmp_path):
    text = "how does the operating point move when the supply drops by half"
    rows = [(1, text, "", "r"), (2, "", text, "r"), (3, None, text + "!", "r"), (4, " ", None, "r"), (5, "…", "x", "r"), (6, "something else", text, "r"), (2, "", text, "again")]
    df = spark.createDataFrame(rows, "request_id long, question string, content string, received_at string")
    df.selectExpr("*", "cast(null as array<string>) AS attachment_ids").write.parquet(f"{tmp_path}/mistake_requests.parquet")
    got = sorted(tuple(r) for r in ranking.near_dup_questions(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0)]
