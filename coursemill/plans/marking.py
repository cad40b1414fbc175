"""Queries of marking, of weak areas as a whole, and of tables that change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.functions import marking as M
from coursemill.operators import changes, grading, insights
from coursemill.plans import tables as t
from coursemill.plans.registry import query
from coursemill.session import read_table

# Requests stand for submissions: every third answers a choice, every third a true or false question, the others fill in the answer of the bank, half of them in another form.

_CLEAN = r"substring(regexp_replace(regexp_replace(coalesce({0}, ''), '[ \t]+', ' ', 'g'), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g'), 1, {1})"


def _compared(c: str) -> str:
    out = f"lower(regexp_replace({_CLEAN.format(c, 1000)}, '[。.]+$', ''))"
    out = rf"regexp_replace({out}, '\\(?:mathrm|text)[ \t\n]*\{{([^{{}}]*)\}}', '\1', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '\\left|\\right|\\,', '', 'g'), '\\([a-z]+)', '\1', 'g')"
    return rf"regexp_replace(replace(translate({out}, '，；：', ',;:'), 'ω', 'omega'), '[ \t\n\r\f$\{{\}}]', '', 'g')"


_FILL = rf"trim(regexp_replace({_CLEAN.format('standard', 1000)}, '^{M.BEFORE_ANSWER}[ \t]*[:：][ \t]*', ''))"
_ASKED = f"""{t.REQUESTS}, asked AS (SELECT request_id, question_bank_id AS code, ['choice', 'true_false', 'fill_blank'][(request_id % 3 + 1)::INTEGER] AS kind, CASE WHEN request_id % 6 = 2 THEN '$' || upper(e.standard_answer) || '$。' ELSE r.answer END AS answer, e.standard_answer AS bank FROM r JOIN eval_items e ON e.question_code = r.question_bank_id),
    given AS (SELECT request_id, kind, answer, CASE kind WHEN 'choice' THEN CASE WHEN request_id % 2 = 0 THEN '答案为 ' || chr((65 + request_id % 4)::INTEGER) || '、A' ELSE chr((65 + request_id % 5)::INTEGER) || ', B' END
        WHEN 'true_false' THEN CASE WHEN request_id % 2 = 0 THEN '标准答案：正确' WHEN request_id % 5 = 0 THEN '见解析' ELSE '错误。' END ELSE '答案：' || bank END AS standard,
        CASE kind WHEN 'choice' THEN [chr((97 + request_id % 4)::INTEGER), ' A'] WHEN 'true_false' THEN [CASE WHEN request_id % 7 < 4 THEN '正确' ELSE '错误' END] ELSE [] END AS selected FROM asked)"""


def _marked(spark: SparkSession, d: str) -> DataFrame:
    bank = read_table(spark, d, "eval_items").select(F.col("question_code").alias("question_bank_id"), F.col("standard_answer").alias("bank"))
    rows = t.requests(spark, d).select("request_id", "answer", "question_bank_id").join(bank, "question_bank_id")
    kind = F.element_at(F.array(*map(F.lit, ("choice", "true_false", "fill_blank"))), (F.col("request_id") % 3 + 1).cast("int"))
    letter = lambda base, n: F.char(F.lit(base) + F.col("request_id") % n)
    even = F.col("request_id") % 2 == 0
    choice = F.when(even, F.concat(F.lit("答案为 "), letter(65, 4), F.lit("、A"))).otherwise(F.concat(letter(65, 5), F.lit(", B")))
    true_false = F.when(even, "标准答案：正确").when(F.col("request_id") % 5 == 0, "见解析").otherwise("错误。")
    standard = F.when(kind == "choice", choice).when(kind == "true_false", true_false).otherwise(F.concat(F.lit("答案："), "bank"))
    selected = F.when(kind == "choice", F.array(letter(97, 4), F.lit(" A"))).when(kind == "true_false", F.array(F.when(F.col("request_id") % 7 < 4, "正确").otherwise("错误"))).otherwise(F.array().cast("array<string>"))
    answer = F.when(F.col("request_id") % 6 == 2, F.concat(F.lit("$"), F.upper("bank"), F.lit("$。"))).otherwise(F.col("answer"))
    return rows.select("request_id", kind.alias("kind"), answer.alias("answer"), standard.alias("standard"), selected.alias("selected"))


@query(
    rf"""WITH {_ASKED}, k AS (SELECT *, string_split(regexp_replace(upper(standard), '[ \t\n,，、;/]+', '', 'g'), '') AS compact,
        regexp_extract_all(regexp_extract(upper(standard), '(?:标准答案|正确答案|答案|应选)[ \t\n]*(?:为|是|[:：])?[ \t\n]*([A-Z](?:[ \t\n]*[,，、/ ][ \t\n]*[A-Z])*)', 1), '[A-Z]') AS named,
        regexp_replace(standard, '。+$', '') AS bare, regexp_extract(standard, '{M.BEFORE_ANSWER}[ \t\n]*(?:为|是|[:：])?[ \t\n]*(正确|错误)', 1) AS said, {_FILL} AS stated FROM given),
    x AS (SELECT *, CASE WHEN list_has_all(['A', 'B', 'C', 'D'], compact) THEN list_sort(list_distinct(compact)) WHEN len(named) > 0 AND list_has_all(['A', 'B', 'C', 'D'], named) THEN list_sort(list_distinct(named)) END AS key,
        CASE WHEN bare IN ('正确', '错误') THEN bare ELSE nullif(said, '') END AS truth, CASE WHEN length(standard) <= 160 AND NOT contains(standard, chr(10)) AND NOT regexp_matches(stated, '{M.EXPLAINS}') THEN stated END AS fill FROM k)
    SELECT request_id, kind, CASE kind WHEN 'choice' THEN list_sort(list_distinct(list_transform(selected, lambda s: upper(trim(s))))) = key WHEN 'true_false' THEN selected[1] = truth
        ELSE CASE WHEN fill IS NOT NULL AND {_CLEAN.format('answer', 24000)} <> '' THEN {_compared('answer')} = {_compared('fill')} END END AS passed FROM x"""
)
def fixed_grading(spark: SparkSession, d: str) -> DataFrame:
    """Whether each answer to a question with a fixed solution is right; null where it takes a person to tell."""
    labels = F.array(*map(F.lit, "ABCD"))
    return _marked(spark, d).select("request_id", "kind", M.is_right(F.col("kind"), F.col("standard"), labels, F.col("selected"), F.col("answer")).alias("passed"))


@query(f"SELECT item_id, {_compared('standard_answer')} AS compared, CASE question_type WHEN '计算题' THEN 'calculation' WHEN '简答题' THEN 'short_answer' ELSE 'other' END AS kind, {_CLEAN.format('text', 200)} AS cleaned FROM eval_items")
def answer_forms(spark: SparkSession, d: str) -> DataFrame:
    """The answers of the bank in the form in which they are compared, with the kind of each question and its cleaned text."""
    return read_table(spark, d, "eval_items").select("item_id", M.compared(F.col("standard_answer")).alias("compared"), M.question_kind(F.col("question_type")).alias("kind"), M.clean(F.col("text"), 200).alias("cleaned"))


@query(
    r"""WITH f AS (SELECT DISTINCT text AS fragment FROM eval_items WHERE length(regexp_replace(text, '[ \t\n\r\f]+', '', 'g')) >= 50), h AS (SELECT doc_id, fragment FROM documents JOIN f ON contains(text, fragment) AND trim(text) <> trim(fragment)),
    g AS (SELECT doc_id, list(fragment ORDER BY length(fragment) DESC, fragment) AS found FROM h GROUP BY doc_id)
    SELECT doc_id, len(found)::INTEGER AS removed, list_reduce(list_prepend(text, found), lambda t, x: replace(t, x, '')) AS pruned FROM documents JOIN g USING (doc_id)"""
)
def leakage_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold texts of the bank of 50 characters or more word for word, without these."""
    fragments = read_table(spark, d, "eval_items").select(F.col("text").alias("fragment"))
    return grading.prune_fragments(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", fragments).select("doc_id", "removed", F.col("text").alias("pruned"))


_PLACED = f"""{t.MISTAKES}, {t.CHUNKS}, mt AS (SELECT DISTINCT request_id AS owner, unnest(tags) AS tag FROM mistakes),
    perc AS (SELECT chapter, tag, count(DISTINCT id) AS chunks FROM (SELECT id, chapter, unnest(knowledge_tags) AS tag FROM c WHERE chapter IS NOT NULL AND chapter <> '') GROUP BY chapter, tag),
    hit AS (SELECT owner, chapter, count(*) AS matched, sum(chunks)::BIGINT AS total FROM mt JOIN perc USING (tag) GROUP BY owner, chapter),
    loc AS (SELECT owner, chapter FROM hit QUALIFY row_number() OVER (PARTITION BY owner ORDER BY matched DESC, total DESC, chapter) = 1),
    m AS (SELECT student_id, request_id, coalesce(nullif(source, ''), 'user_uploaded') AS source, coalesce(chapter, '暂未确定') AS chapter, list_distinct(tags) AS tags FROM mistakes LEFT JOIN loc ON owner = request_id WHERE student_id IS NOT NULL)"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    mistakes = t.mistakes(spark, d).where("student_id IS NOT NULL")
    located = insights.chapter_of_tags(mistakes.select(F.col("request_id").alias("owner"), F.explode("tags").alias("tag")), t.chunks(spark, d)).select(F.col("owner").alias("request_id"), "chapter")
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("user_uploaded"))
    return mistakes.join(located, "request_id", "left").select("student_id", "request_id", source.alias("source"), F.coalesce("chapter", F.lit("暂未确定")).alias("chapter"), "tags")


@query(
    f"""WITH {_PLACED}, n AS (SELECT student_id, count(*) AS total, count(*) >= 3 AS sufficient FROM m GROUP BY student_id), x AS (SELECT student_id, request_id, source, chapter, unnest(tags) AS tag FROM m),
    a AS (SELECT student_id, tag, count(*) AS mistakes, count(DISTINCT source) AS sources, min(request_id) AS first FROM x WHERE trim(tag) <> '' GROUP BY student_id, tag),
    md AS (SELECT student_id, tag, chapter FROM (SELECT student_id, tag, chapter, count(*) AS k, max(request_id) AS latest FROM x GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY student_id, tag ORDER BY k DESC, latest DESC, chapter) = 1),
    s AS (SELECT *, (10 * mistakes + 5 * greatest(mistakes - 1, 0) + 2 * greatest(sources - 1, 0))::BIGINT AS score FROM a)
    SELECT student_id, tag, total, sufficient, mistakes, sources, chapter, score, CASE WHEN score >= 35 THEN 'severe' WHEN score >= 20 THEN 'medium' ELSE 'light' END AS severity,
      row_number() OVER (PARTITION BY student_id ORDER BY score DESC, tag) AS priority FROM s JOIN md USING (student_id, tag) JOIN n USING (student_id)"""
)
def weakness_report(spark: SparkSession, d: str) -> DataFrame:
    """All weak areas of every student in the order in which to learn them, with the chapter most of their mistakes are in and whether the student has mistakes enough."""
    return insights.weakness_report(_placed(spark, d))


@query(f"WITH {_PLACED} SELECT student_id, source, chapter, count(*) AS mistakes FROM m GROUP BY GROUPING SETS ((student_id, source), (student_id, chapter))")
def student_totals(spark: SparkSession, d: str) -> DataFrame:
    """Mistakes of every student by source and by chapter."""
    rows = _placed(spark, d)
    keys = [F.col(c) for c in ("student_id", "source", "chapter")]
    return rows.groupingSets([keys[:2], [keys[0], keys[2]]], *keys).agg(F.count("*").alias("mistakes")).select("student_id", "source", "chapter", "mistakes")


_TAG_EDGES = f"""{t.CHUNKS}, pairs AS (SELECT id, list_transform(knowledge_tags, lambda x: lower(x)) AS g FROM c WHERE len(knowledge_tags) > 1),
    e AS (SELECT DISTINCT g[i] AS source, g[i + 1] AS target, CASE WHEN length(g[i]) % 2 = 0 THEN 'PRECEDES' ELSE 'DEPENDS_ON' END AS type FROM (SELECT g, unnest(generate_series(1, len(g) - 1)) AS i FROM pairs) WHERE g[i] <> g[i + 1])"""


@query(
    f"""WITH {_TAG_EDGES}, p AS (SELECT DISTINCT CASE WHEN type = 'PRECEDES' THEN target ELSE source END AS concept, CASE WHEN type = 'PRECEDES' THEN source ELSE target END AS prerequisite FROM e)
    SELECT concept, prerequisite, 0.95::DOUBLE AS confidence, row_number() OVER (PARTITION BY concept ORDER BY prerequisite) AS rank FROM p QUALIFY rank <= 5"""
)
def prerequisites_by_edges(spark: SparkSession, d: str) -> DataFrame:
    """The concepts that edges of the graph name as prerequisites of each concept, at most five (edges between neighbouring tags stand for them)."""
    g = t.chunks(spark, d).where(F.size("knowledge_tags") > 1).select(F.transform("knowledge_tags", lambda x: F.lower(x)).alias("g"))
    pairs = g.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("g") - 1), lambda i: F.struct(F.element_at("g", i).alias("source"), F.element_at("g", i + 1).alias("target")))).alias("p")).select("p.*")
    edges = pairs.where("source <> target").distinct().withColumn("type", F.when(F.length("source") % 2 == 0, "PRECEDES").otherwise("DEPENDS_ON"))
    return insights.prerequisites_by_edges(edges)


# tables that change: requests are the book, categories its folders, orders and their items homework and submissions


_BOOK = f"{t.REQUESTS}, b AS (SELECT request_id, category_id, agent FROM r)"


def _book(spark: SparkSession, d: str) -> DataFrame:
    return t.requests(spark, d).select("request_id", "category_id", "agent")


@query(f"WITH {_BOOK} SELECT request_id, CASE WHEN request_id % 5 = 0 THEN 'exam' ELSE category_id END AS category_id, agent FROM b")
def mistake_update(spark: SparkSession, d: str) -> DataFrame:
    """The book after a fifth of its rows got another category, twice, and rows that it does not hold were changed too."""
    book = _book(spark, d)
    moved = book.where("request_id % 5 = 0").select("request_id", F.lit("exam").alias("category_id")).unionByName(spark.range(3).select((-1 - F.col("id")).alias("request_id"), F.lit("lab").alias("category_id")))
    return changes.update(changes.update(book, moved, ["request_id"]), moved, ["request_id"])


@query(f"WITH {_BOOK}, have AS (SELECT DISTINCT category_id AS name FROM b WHERE category_id <> ''), new AS (SELECT DISTINCT agent AS name FROM b UNION SELECT upper(name) FROM have) SELECT name FROM have UNION ALL SELECT name FROM new WHERE name IS NOT NULL AND lower(name) NOT IN (SELECT lower(name) FROM have)")
def category_create(spark: SparkSession, d: str) -> DataFrame:
    """The categories after new ones were made; names that differ in case only are taken."""
    have = _book(spark, d).where("category_id <> ''").select(F.col("category_id").alias("name")).distinct()
    new = _book(spark, d).where("agent IS NOT NULL").select(F.col("agent").alias("name")).unionByName(have.select(F.upper("name").alias("name")))
    return changes.insert_unique(have, new, "name")


@query(f"WITH {_BOOK}, have AS (SELECT DISTINCT category_id AS name FROM b WHERE category_id <> '') SELECT name AS id, CASE WHEN name = 'lab' THEN 'bench' WHEN name = 'exam' AND NOT EXISTS (SELECT 1 FROM have WHERE name = 'homework') THEN 'homework' ELSE name END AS name FROM have")
def category_rename(spark: SparkSession, d: str) -> DataFrame:
    """The categories after two were renamed; a name that another one has is refused."""
    have = _book(spark, d).where("category_id <> ''").select(F.col("category_id").alias("id"), F.col("category_id").alias("name")).distinct()
    return changes.rename(have, spark.createDataFrame([("lab", "bench"), ("exam", "homework"), ("gone", "x")], "id string, name string"), "id", "name")


_NOTES = f"{t.REQUESTS}, b AS (SELECT request_id, messages FROM r)"


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return t.requests(spark, d).select("request_id", "messages")


@query(f"WITH {_NOTES} SELECT request_id, array_to_string(list_transform(coalesce(messages, []), lambda m: coalesce(CASE WHEN m.role = 'user' THEN 'seen' ELSE m.content END, '')), '|') AS notes FROM b")
def annotation_update(spark: SparkSession, d: str) -> DataFrame:
    """The notes of every row after those of one writer were replaced."""
    rows = changes.change_elements(_notes(spark, d), "messages", lambda m: m["role"] == "user", lambda m: m.withField("content", F.lit("seen")))
    return rows.select("request_id", F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), "|").alias("notes"))


@query(f"WITH {_NOTES} SELECT request_id, len(list_filter(coalesce(messages, []), lambda m: NOT coalesce(m.role = 'assistant', false)))::INTEGER AS notes FROM b")
def annotation_delete(spark: SparkSession, d: str) -> DataFrame:
    """The number of notes of every row after those of one writer were deleted."""
    return changes.drop_elements(_notes(spark, d), "messages", lambda m: m["role"] == "assistant").select("request_id", F.size("messages").alias("notes"))


@query("SELECT event_id, user_id, event_id % 4 = 0 AS completed FROM events UNION ALL SELECT max(event_id) + 1, 0, false FROM events")
def schedule_changes(spark: SparkSession, d: str) -> DataFrame:
    """A schedule to which an item was added and of which every fourth was completed."""
    items = read_table(spark, d, "events").select("event_id", "user_id", F.lit(False).alias("completed"))
    added = items.agg((F.max("event_id") + 1).alias("event_id")).select("event_id", F.lit(0).cast(items.schema["user_id"].dataType).alias("user_id"), F.lit(False).alias("completed"))
    done = items.where("event_id % 4 = 0").select("event_id", F.lit(True).alias("completed"))
    return changes.update(changes.append_once(items, added, "event_id"), done, ["event_id"])


@query("SELECT 'orders' AS tbl, count(*) AS n FROM orders WHERE o_custkey % 10 <> 3 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)")
def homework_delete(spark: SparkSession, d: str) -> DataFrame:
    """What stays after some homework was deleted with all its submissions."""
    orders, items = read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    gone = orders.where("o_custkey % 10 = 3")
    left = changes.delete_cascade({"orders": orders, "lineitem": items}, gone, ["o_orderkey"])
    return left["orders"].agg(F.lit("orders").alias("tbl"), F.count("*").alias("n")).unionByName(left["lineitem"].agg(F.lit("lineitem").alias("tbl"), F.count("*").alias("n")))


@query("SELECT l_orderkey AS bank, count(*) FILTER (l_linenumber <> 1) AS questions, coalesce(sum(l_quantity) FILTER (l_linenumber <> 1), 0)::DOUBLE AS max_score FROM lineitem GROUP BY l_orderkey")
def bank_question_delete(spark: SparkSession, d: str) -> DataFrame:
    """The banks after the first question of each was deleted, with their points counted anew; a bank may be left empty."""
    items = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bank"), "l_linenumber", "l_quantity")
    left = changes.delete(items, items.where("l_linenumber = 1").select("bank", "l_linenumber"), ["bank", "l_linenumber"])
    counted = left.groupBy("bank").agg(F.count("*").alias("questions"), F.sum("l_quantity").cast("double").alias("max_score"))
    return items.select("bank").distinct().join(counted, "bank", "left").select("bank", F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("max_score", F.lit(0.0)).alias("max_score"))


@query("SELECT l_orderkey AS submission, l_partkey AS question, min(l_linenumber) AS line, l_partkey % 7 <> 0 AS valid FROM lineitem GROUP BY l_orderkey, l_partkey")
def submission_create(spark: SparkSession, d: str) -> DataFrame:
    """New answers, one a question, and whether the question is one of the homework."""
    given = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("submission"), F.col("l_partkey").alias("question"), F.col("l_linenumber").alias("line"))
    known = read_table(spark, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("question"))
    return changes.referenced(given.groupBy("submission", "question").agg(F.min("line").alias("line")), known, ["question"], "valid")
