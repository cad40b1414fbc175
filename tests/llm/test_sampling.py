"""Samples for fitting are bounded, whatever the number of partitions."""

from coursemill.llm.sampling import bounded_sample


def test_size_does_not_grow_with_partitions(spark):
    rows = spark.range(20_000).selectExpr("id", "concat('text ', id % 7000) AS t")
    one, many = (bounded_sample(rows.repartition(n).select("id", "t"), 300) for n in (1, 40))
    assert one == many and 150 <= len(one) <= 600


def test_copies_are_taken_once(spark):
    rows = spark.range(10_000).selectExpr("'same' AS t")
    assert bounded_sample(rows, 100) in ([], [{"t": "same"}])
    assert bounded_sample(rows.limit(0), 100) == []
