"""Files, versioned tables and streams."""

import json

from pyspark.sql import functions as F

from coursemill.sources import files
from coursemill.sources.store import VersionedStore
from coursemill.streaming import state, windows


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n# One\n## First\nbody\n\n# Two\n\ntext", encoding="utf-8")
    (tmp_path / "bank.json").write_text(json.dumps({"questions": [{"question_text": "Q?"}, {"question_text": " "}]}))
    (tmp_path / "broken.json").write_text("{nothing")
    (tmp_path / "lay.json").write_text(json.dumps([{"type": "equation", "page_idx": 0, "text": "U=RI", "bbox": [0, 0, 1, 1]}, {"text": ""}]))
    (tmp_path / "c.jsonl").write_text('{"id": "1", "text": "t"}\n\nnot json\n')
    found = {r.source: r.use for r in files.discover(spark, str(tmp_path)).collect()}
    assert found["a.md"] == "index" and found["bank.json"] == "bank" and found["c.jsonl"] == "other"
    blocks = [(r.chapter, r.section, r.text) for r in files.read_markdown(spark, str(tmp_path / "a.md")).orderBy("block").collect()]
    assert blocks == [(None, None, "intro"), ("One", "First", "body"), ("Two", "Two", "text")]
    bank = files.read_question_bank(spark, str(tmp_path / "b*.json")).collect()
    assert [(r.question_id, r.question_text, r.difficulty) for r in bank] == [("JSON-001", "Q?", "基础")]
    lay = files.read_layout(spark, str(tmp_path / "lay.json")).first()
    assert (lay.page, lay.element_type, lay.reading_order) == (1, "formula", 100_000)
    assert [r.id for r in files.read_chunks(spark, str(tmp_path / "c.jsonl")).collect()] == ["1"]


def test_versions(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/kb")
    assert store.versions() == []
    store.publish({"t": spark.range(3)})
    store.publish({"t": spark.range(5)})
    assert store.read("t").count() == 5
    store.rollback()
    assert store.read("t").count() == 3


def test_sessions_of_events(spark):
    rows = [(i, 1, f"2024-01-01 00:{m:02d}:00") for i, m in enumerate((0, 10, 50, 55))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.n for r in windows.sessions(events, "user_id", "ts", 1800).orderBy("session").collect()] == [2, 2]


def drain(df, mode):
    df.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a timeout keeps the query going
    query = df.writeStream.outputMode(mode).format("memory").queryName("out").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert not query.exception()
    rows = df.sparkSession.sql("SELECT * FROM out").collect()
    query.stop()
    return rows


def test_bounded_history_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("s", i, f"m{i}") for i in range(7)] + [("t", 1, "x")], "session_id string, seq long, content string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, seq long, content string").json(str(tmp_path / "in"))
    assert {(r.session_id, r.n, r.last) for r in drain(state.bounded_history(stream, 5), "update")} == {("s", 5, "m6"), ("t", 1, "x")}


def test_references_never_show(spark, tmp_path):
    text = "The gain is 3. " * 20 + "\n参考资料：\n1. invented"
    rows = [("r", i, text[i * 7 : i * 7 + 7], False) for i in range(len(text) // 7 + 1)] + [("r", 999, "", True)]
    spark.createDataFrame(rows, "reply_id string, seq long, delta string, final boolean").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("reply_id string, seq long, delta string, final boolean").json(str(tmp_path / "in"))
    assert "".join(r.text for r in drain(state.without_references(stream), "append")).strip() == ("The gain is 3. " * 20).strip()


def test_tumbling_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a", 2.0), (61, "a", 3.0)], "s long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s long, event_type string, value double, ts timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r.total for r in drain(windows.tumbling(stream, "ts", "1 minute", ["event_type"], "1 minute"), "update")) == [2.0, 3.0]
