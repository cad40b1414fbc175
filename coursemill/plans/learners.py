"""Queries of learners: mistakes, sessions, grading, changing tables, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.functions import text as T
from coursemill.operators import changes, context, grading, insights, sessions
from coursemill.plans import tables as t
from coursemill.plans.registry import query
from coursemill.session import read_table
from coursemill.streaming import windows


@query(
    f"""WITH {t.MISTAKES}, x AS (SELECT student_id, source, unnest(list_distinct(tags)) AS tag FROM mistakes WHERE student_id IS NOT NULL),
    n AS (SELECT student_id, tag, count(*) AS n, count(DISTINCT source) AS sources FROM x WHERE trim(tag) <> '' GROUP BY student_id, tag),
    s AS (SELECT *, (10 * n + 5 * greatest(n - 1, 0) + 2 * greatest(sources - 1, 0))::BIGINT AS score FROM n)
    SELECT student_id, tag, n, sources, score, CASE WHEN score >= 35 THEN 'severe' WHEN score >= 20 THEN 'medium' ELSE 'light' END AS severity,
      row_number() OVER (PARTITION BY student_id ORDER BY score DESC, tag) AS priority FROM s QUALIFY priority <= 6"""
)
def weakness_analysis(spark: SparkSession, d: str) -> DataFrame:
    """The weakest areas of every student."""
    return insights.weak_areas(t.mistakes(spark, d))


@query(f"WITH {t.REQUESTS} SELECT source, agent, grouping(source, agent)::BIGINT AS level, count(*) AS n FROM r GROUP BY GROUPING SETS ((source), (agent), ())")
def source_agent_counts(spark: SparkSession, d: str) -> DataFrame:
    """Requests by source, by agent, and in all."""
    return insights.totals(t.requests(spark, d).select("source", "agent"), ["source", "agent"])


@query(
    f"""WITH {t.MISTAKES}, {t.CHUNKS}, g AS (SELECT DISTINCT student_id AS owner, unnest(tags) AS tag FROM mistakes),
    per AS (SELECT chapter, tag, count(DISTINCT id) AS chunks FROM (SELECT id, chapter, unnest(knowledge_tags) AS tag FROM c WHERE chapter IS NOT NULL AND chapter <> '') GROUP BY chapter, tag),
    h AS (SELECT owner, chapter, count(*) AS matched, sum(chunks)::BIGINT AS total FROM g JOIN per USING (tag) GROUP BY owner, chapter)
    SELECT owner, chapter, matched, total FROM h QUALIFY row_number() OVER (PARTITION BY owner ORDER BY matched DESC, total DESC, chapter) = 1"""
)
def location_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The chapter that covers most of the tags of each student's mistakes."""
    tags = t.mistakes(spark, d).select(F.col("student_id").alias("owner"), F.explode("tags").alias("tag"))
    return insights.chapter_of_tags(tags, t.chunks(spark, d))


@query(f"WITH {t.MESSAGES} SELECT session_id, seq, role, content FROM log QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 16")
def session_recent(spark: SparkSession, d: str) -> DataFrame:
    """The last sixteen messages of every session."""
    return sessions.recent(t.message_log(spark, d)).select("session_id", "seq", "role", "content")


@query(
    rf"""WITH {t.MESSAGES}, s AS (SELECT session_id, arg_min(content, seq) FILTER (role = 'user') AS first, count(*) AS n FROM log GROUP BY session_id),
    x AS (SELECT session_id, n, trim(regexp_replace(coalesce(first, ''), '\n\[附件：(?s:.*)', '')) AS first FROM s)
    SELECT session_id, CASE WHEN length(first) > 34 THEN substring(first, 1, 34) || '…' ELSE first END AS title, n FROM x"""
)
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    """Title and size of every session."""
    return sessions.summaries(t.message_log(spark, d)).select("session_id", "title", "n")


@query(
    f"""WITH {t.MESSAGES} SELECT session_id, seq, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM log"""
)
def context_inherit(spark: SparkSession, d: str) -> DataFrame:
    """What the user last said before each message."""
    return sessions.previous_user(t.message_log(spark, d)).select("session_id", "seq", "asked")


@query(f"WITH {t.MESSAGES} SELECT session_id, seq, coalesce(regexp_matches(lower(content), '{sessions.FOLLOWUP}'), false) AS followup FROM log WHERE role = 'user'")
def followup_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether a user's message refers to what was said before."""
    return t.message_log(spark, d).where("role = 'user'").select("session_id", "seq", sessions.is_followup(F.col("content")).alias("followup"))


@query(
    f"""WITH {t.MESSAGES}, x AS (SELECT session_id, seq, coalesce(role, '') || ': ' || substring(coalesce(content, ''), 1, 900) AS line FROM log QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 6)
    SELECT session_id, string_agg(line, chr(10) ORDER BY seq) AS history FROM x GROUP BY session_id"""
)
def history_text(spark: SparkSession, d: str) -> DataFrame:
    """The last six messages of every session as text."""
    return sessions.history_text(t.message_log(spark, d))


@query(
    r"""WITH m AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\[(?:资料)?([0-9]{1,3})\]', 1), lambda x: x::INTEGER), lambda x: x BETWEEN 1 AND 99) AS l FROM documents)
    SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS cited FROM m"""
)
def citation_marks(spark: SparkSession, d: str) -> DataFrame:
    """The source numbers each document cites, in order."""
    return read_table(spark, d, "documents").select("doc_id", F.array_join(T.citations("text", 99), ",").alias("cited"))


@query(
    r"""SELECT doc_id, rtrim(text, ' ') = '' OR len(regexp_extract_all(rtrim(text, ' '), '\$')) % 2 = 1 OR regexp_matches(rtrim(text, ' '), '([+\-*/=,，、：:]|\\[a-z]+)$') OR regexp_matches(rtrim(text, ' '), '(^|\n)#{1,6} [^\n]*$') AS incomplete FROM documents"""
)
def answer_incomplete(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text breaks off."""
    return read_table(spark, d, "documents").select("doc_id", T.is_truncated("text").alias("incomplete"))


# orders stand for submissions, line items for graded items, parts for questions, customers for students


@query("SELECT l_orderkey AS submission, round(sum(l_quantity * (1 - l_discount)), 2) AS score, round(sum(l_quantity), 2) AS max_score, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def homework_totals(spark: SparkSession, d: str) -> DataFrame:
    """Score and maximum of every submission."""
    rows = read_table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "submission")
    return grading.rollup(rows, "submission", F.col("l_quantity") * (1 - F.col("l_discount")), F.col("l_quantity"))


@query("SELECT o_custkey AS student, o_orderkey AS submission FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_submission(spark: SparkSession, d: str) -> DataFrame:
    """The last submission of every student."""
    rows = read_table(spark, d, "orders").select(F.col("o_custkey").alias("student"), F.col("o_orderkey").alias("submission"), "o_orderdate")
    return grading.latest(rows, "student", [F.desc("o_orderdate"), F.desc("submission")]).select("student", "submission")


@query("SELECT p_partkey AS question, p_name AS prompt, p_size AS points FROM part")
def role_masked_view(spark: SparkSession, d: str) -> DataFrame:
    """Questions as a student sees them."""
    rows = read_table(spark, d, "part").select(F.col("p_partkey").alias("question"), F.col("p_name").alias("prompt"), F.col("p_size").alias("points"), F.col("p_type").alias("answer"), F.col("p_retailprice").alias("rubric"))
    return grading.masked(rows, ["answer", "rubric"], teacher=False)


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, floor(o_totalprice * 100 + 0.5) AS whole, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT l_orderkey, l_linenumber, CASE WHEN place < n THEN floor(whole / n + 0.5) ELSE whole - floor(whole / n + 0.5) * (n - 1) END / 100 AS share FROM l"""
)
def point_distribution(spark: SparkSession, d: str) -> DataFrame:
    """A total in equal parts, the rest on the last."""
    rows = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    return grading.distribute(rows, "o_totalprice", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "share")


@query("SELECT o_orderkey AS submission, coalesce(s, 0) AS score, s IS NULL AS absent FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity), 2) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def grading_missing(spark: SparkSession, d: str) -> DataFrame:
    """Every submission with its score; those without any score 0 and are flagged."""
    given = read_table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("submission")).agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    return grading.completed(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("submission")), given, ["submission"], "score")


@query("SELECT l_orderkey, l_linenumber, floor((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) / 8)::BIGINT AS batch FROM lineitem")
def grading_batches(spark: SparkSession, d: str) -> DataFrame:
    """Items in batches of eight."""
    rows = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return grading.batches(rows, "l_suppkey", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "batch")


@query("SELECT l_orderkey AS submission, bool_and(l_linestatus = 'F') AS passed, min(l_discount) AS confidence, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def review_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Whether all items of a submission passed, with the least confidence."""
    rows = read_table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "submission")
    return grading.review(rows, "submission", F.col("l_linestatus") == "F", F.col("l_discount"))


@query(
    r"""SELECT item_id, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(standard_answer, '')), '\\(left|right|,|;|!)', '', 'g'), 'ω|\\omega', 'omega', 'g'), '[ \t\n$\{\}]', '', 'g') AS answer FROM eval_items"""
)
def fixed_answers(spark: SparkSession, d: str) -> DataFrame:
    """The answers of the bank in the form in which they are compared."""
    return read_table(spark, d, "eval_items").select("item_id", T.canonical_answer("standard_answer").alias("answer"))


@query(
    f"""WITH {t.REQUESTS}, a AS (SELECT session_id, request_id, answer, question FROM r WHERE session_id IS NOT NULL)
    SELECT x.session_id, x.request_id, y.request_id AS later FROM a x JOIN a y ON x.session_id = y.session_id AND x.request_id < y.request_id WHERE length(y.question) >= 12 AND contains(x.answer, y.question)"""
)
def answer_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Answers that hold the question of a later request of the session."""
    return grading.leaked_later(t.requests(spark, d).where("session_id IS NOT NULL"), "session_id", "request_id", "answer", "question", 12)


@query(
    f"""WITH {t.REQUESTS}, b AS (SELECT student_id, question, answer, agent, request_id FROM r WHERE student_id IS NOT NULL AND trim(question) <> ''),
    base AS (SELECT student_id, question, answer, agent FROM b WHERE request_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY student_id, question ORDER BY request_id) = 1),
    chg AS (SELECT student_id, question, answer, agent FROM b WHERE request_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY student_id, question ORDER BY request_id DESC) = 1)
    SELECT student_id, question, coalesce(nullif(chg.answer, ''), base.answer) AS answer, coalesce(nullif(chg.agent, ''), base.agent) AS agent FROM base FULL JOIN chg USING (student_id, question)"""
)
def mistake_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The book of mistakes after one half of the requests was merged into the other."""
    rows = t.requests(spark, d).select("student_id", "question", "answer", "agent", "request_id").where("student_id IS NOT NULL AND trim(question) <> ''")
    first = changes.distinct_rows(rows.where("request_id % 2 = 0").withColumn("k", F.struct("student_id", "question")), "k", "request_id").drop("k")
    return changes.upsert(first.drop("request_id"), rows.where("request_id % 2 = 1"), ["student_id", "question"], "request_id")


@query(f"WITH {t.REQUESTS} SELECT request_id, CASE WHEN category_id IN ('lab', 'exam') THEN 'uncategorized' ELSE category_id END AS category_id FROM r")
def category_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Requests after two categories were deleted."""
    gone = spark.createDataFrame([("lab",), ("exam",)], "category_id string")
    return changes.reassign(t.requests(spark, d).select("request_id", "category_id"), gone, "category_id", "uncategorized").select("request_id", "category_id")


@query(
    """WITH x AS (SELECT event_id, user_id, event_type, value FROM events), log AS (SELECT * FROM x WHERE event_id % 3 = 0)
    SELECT event_id, user_id, event_type, value FROM log UNION ALL SELECT event_id, user_id, event_type, value FROM x WHERE event_id NOT IN (SELECT event_id FROM log)"""
)
def idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    """A log to which all events are appended again; those it holds are passed over."""
    rows = read_table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return changes.append_once(rows.where("event_id % 3 = 0"), rows.unionByName(rows), "event_id")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 100")
def retained_history(spark: SparkSession, d: str) -> DataFrame:
    """The last hundred events of every user (the retention of a session)."""
    return changes.keep_last(read_table(spark, d, "events").select("event_id", "user_id"), "user_id", F.desc("event_id"), 100)


@query(
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d'), CASE WHEN event_id % 7 = 0 THEN '99:99' ELSE strftime(ts, '%H:%M') END, event_id) AS place FROM events"""
)
def schedule_order(spark: SparkSession, d: str) -> DataFrame:
    """Items of a schedule by day and time, those without a time at the end of their day."""
    from pyspark.sql import Window

    rows = read_table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("time", F.when(F.col("event_id") % 7 == 0, "").otherwise(F.date_format("ts", "HH:mm")))
    w = Window.partitionBy("user_id").orderBy("day", F.coalesce(F.nullif("time", F.lit("")), F.lit("99:99")), "event_id")
    return rows.select("user_id", "event_id", F.row_number().over(w).cast("bigint").alias("place"))


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type (an extension: event-time windows)."""
    out = windows.tumbling(read_table(spark, d, "events"), "ts", "1 hour", ["event_type"])
    return out.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "event_type", "n", "total")


@query(
    """WITH m AS (SELECT user_id, event_id, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000000, true)::BIGINT AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM m)
    SELECT user_id, session, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n FROM s GROUP BY user_id, session"""
)
def ext_session(spark: SparkSession, d: str) -> DataFrame:
    """Visits of every user, ended by half an hour without events (an extension)."""
    out = windows.sessions(read_table(spark, d, "events"), "user_id", "ts", 1800)
    return out.select("user_id", "session", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended"), "n")


@query("SELECT event_id, user_id, least(max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 100) AS progress FROM events")
def monotone_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress that never falls."""
    return windows.running_max(read_table(spark, d, "events"), "user_id", "event_id", F.col("value")).select("event_id", "user_id", "progress")


@query(
    """WITH e AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), m AS (SELECT DISTINCT date_trunc('month', day)::DATE AS month FROM e),
    g AS (SELECT month, unnest(generate_series(month - (isodow(month) - 1)::INTEGER, month - (isodow(month) - 1)::INTEGER + 41, INTERVAL '1 day'))::DATE AS day FROM m)
    SELECT strftime(month, '%Y-%m-%d') AS month, strftime(g.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM g LEFT JOIN e ON e.day = g.day"""
)
def calendar_grid(spark: SparkSession, d: str) -> DataFrame:
    """Six weeks of every month with events, and the events of each day."""
    out = context.calendar(read_table(spark, d, "events"), "ts")
    return out.select(F.date_format("month", "yyyy-MM-dd").alias("month"), F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query("SELECT item_id, ('0x' || substr(sha1(concat_ws('|', question_code, lang)), 1, 8))::BIGINT AS seed FROM eval_items")
def variation_seeds(spark: SparkSession, d: str) -> DataFrame:
    """A stable number for every question."""
    return read_table(spark, d, "eval_items").select("item_id", context.seed(F.col("question_code"), F.col("lang")).alias("seed"))
