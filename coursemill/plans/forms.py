"""Queries of functions on texts, tags, formulas, components, boxes and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursemill.functions import components as C
from coursemill.functions import entries as E
from coursemill.functions import formulas, headings
from coursemill.functions import text as T
from coursemill.operators import context, graph, layout, questions
from coursemill.plans import tables as t
from coursemill.plans.registry import query
from coursemill.session import read_table

_ELEMENTS = "e AS (SELECT DISTINCT id, source, page, element_type, bbox, text, caption, components, confidence FROM layout_elements)"


def _in(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _first_use(items: str) -> str:
    """SQL of the different entries of a list in order of first use."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


@query(
    rf"""WITH {_ELEMENTS}, f AS (SELECT id, coalesce(text, '') AS text FROM e)
    SELECT id, length(text) <= 500 AND len(regexp_extract_all(text, '[=+\-*/^<>≈≤≥±∑∫√·×÷_\\]')) >= 2 AND regexp_matches(text, '[A-Za-z0-9]') AS formula,
      len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) >= 3 AND len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '' AND regexp_matches(x, '\t|  | \| '))) >= 2 AS tabular,
      lower(regexp_replace(regexp_replace(text, '\\[A-Za-z]+', '', 'g'), '[^A-Za-z0-9]', '', 'g')) AS skeleton,
      array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: contains(x, '=') AND length(x) <= 240 AND len(regexp_extract_all(x, '[一-鿿]')) <= 3), '|') AS candidates,
      concat_ws('|', {", ".join(f"CASE WHEN regexp_matches(lower(regexp_replace(text, '[\\{{}}_ \t\n]', '', 'g')), '{'|'.join(v)}') THEN '{k}' END" for k, v in formulas.SIGNS.items())}) AS concepts FROM f"""
)
def formula_tests(spark: SparkSession, d: str) -> DataFrame:
    """What of each element's text is formula or table, its skeleton, the lines that may be formulas, and the concepts of its signs."""
    c = F.col("text")
    return t.regions(spark, d).select(
        "id", formulas.looks_like_formula(c).alias("formula"), formulas.looks_like_table(c).alias("tabular"), formulas.skeleton(c).alias("skeleton"),
        F.array_join(formulas.candidates(c), "|").alias("candidates"), F.array_join(formulas.concepts(c), "|").alias("concepts"),
    )


@query(
    rf"""WITH {_ELEMENTS}, s AS (SELECT id, text, '{{' || text || '}}' AS other FROM e WHERE element_type = 'formula' AND text <> ''), k AS (SELECT id, text, other, lower(regexp_replace(regexp_replace(text, '\\[A-Za-z]+', '', 'g'), '[^A-Za-z0-9]', '', 'g')) AS a FROM s)
    SELECT id, CASE WHEN a <> '' THEN other ELSE text END AS text FROM k"""
)
def formula_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Recognised formulas replaced by those of the page that differ in braces only."""
    rows = t.regions(spark, d).where("element_type = 'formula' AND text <> ''")
    return rows.select("id", formulas.reconcile(F.col("text"), F.concat(F.lit("{"), "text", F.lit("}"))).alias("text"))


_TABLE = lambda entries: "CASE " + " ".join(f"WHEN {{0}} = '{k}' THEN '{v}'" for k, v in entries.items()) + " END"
_PART = rf"""{_ELEMENTS}, p AS (SELECT id, unnest(components) AS c FROM e), s AS (SELECT id, trim(c.id) AS symbol, lower(trim(c.type)) AS kind, lower(regexp_replace(c.id, '[ \t\n_{{}}''’′-]', '', 'g')) AS short FROM p),
    r AS (SELECT *, coalesce({_TABLE({k: v for k, v in C.SYMBOLS.items() if not k.endswith('%')}).format('short')}, CASE WHEN regexp_matches(short, '^r0[0-9]*$') THEN '输出电阻' END,
      {_TABLE({k[:-1]: v for k, v in C.SYMBOLS.items() if k.endswith('%')}).format("regexp_extract(short, '^([a-z]+)[0-9]*$', 1)")}, {_TABLE(C.KINDS).format('kind')}, '{C.UNKNOWN_ROLE}') AS role FROM s)"""


@query(f"WITH {_PART} SELECT id, symbol, short, role, role || ' ' || symbol AS label FROM r")
def component_labels(spark: SparkSession, d: str) -> DataFrame:
    """The symbol of every component in one form, its role, and its label."""
    c = t.elements(spark, d).select("id", F.explode("components").alias("c")).select("id", F.col("c.id").alias("s"), F.col("c.type").alias("k"))
    return c.select("id", F.trim("s").alias("symbol"), C.canonical_symbol(F.col("s")).alias("short"), C.role(F.col("s"), F.col("k")).alias("role"), C.label(F.col("s"), F.col("k")).alias("label"))


@query(
    f"""WITH {_ELEMENTS}, p AS (SELECT id, unnest(components) AS c, generate_subscripts(components, 1) AS pos FROM e), l AS (SELECT id, pos, trim(c.id) AS name, lower(trim(c.type)) AS kind, list_filter(list_transform(coalesce(c.terminals, []), lambda x: trim(x)), lambda x: x <> '') AS nodes,
      coalesce({_TABLE(C.PREFIXES).format("lower(trim(c.type))")}, 'X') AS prefix FROM p),
    n AS (SELECT id, pos, CASE WHEN kind = 'port' THEN concat_ws(' ', '* PORT', name, nullif(array_to_string(nodes, ' '), '')) ELSE concat_ws(' ', CASE WHEN starts_with(upper(name), prefix) THEN name ELSE prefix || name END, CASE WHEN len(nodes) > 0 THEN array_to_string(nodes, ' ') ELSE 'UNKNOWN_NODE' END, 'UNKNOWN') END AS line FROM l)
    SELECT id, string_agg(line, chr(10) ORDER BY pos) AS netlist FROM n GROUP BY id"""
)
def component_netlists(spark: SparkSession, d: str) -> DataFrame:
    """A netlist of every element with components."""
    return t.elements(spark, d).where(F.size("components") > 0).select("id", C.netlist(F.col("components")).alias("netlist"))


@query(f"WITH {_ELEMENTS}, p AS (SELECT id, unnest(components) AS c FROM e), x AS (SELECT id, unnest(list_distinct(c.terminals)) AS terminal FROM p) SELECT id, terminal, count(*) AS parts FROM x GROUP BY id, terminal")
def terminal_counts(spark: SparkSession, d: str) -> DataFrame:
    """By how many components each terminal of an element is named."""
    c = t.elements(spark, d).select("id", F.explode("components").alias("c")).select("id", F.explode(F.array_distinct("c.terminals")).alias("terminal"))
    return c.groupBy("id", "terminal").agg(F.count("*").alias("parts"))


@query(
    rf"""WITH {_ELEMENTS}, f AS (SELECT id, coalesce(caption, '') || '（b）' AS c, coalesce(caption, '') AS text FROM e), g AS (SELECT id, c, regexp_extract_all(text || ' ' || text, '((?:图|Fig\. ?)\s*[0-9]+(?:[.-][0-9]+)*)', 1) AS l FROM f)
    SELECT id, trim(regexp_replace(c, '\s*[(（][a-z][)）]\s*$', '')) AS base, regexp_extract(c, '[(（]([a-z])[)）]\s*$', 1) AS part, array_to_string({_first_use("l")}, '|') AS figures FROM g"""
)
def figure_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions without the letter of a part, the letter, and the figures they name, each once."""
    text = F.coalesce("caption", F.lit(""))
    c = F.concat(text, F.lit("（b）"))
    return t.regions(spark, d).select("id", headings.caption_base(c).alias("base"), headings.caption_part(c).alias("part"), F.array_join(headings.captions(F.concat_ws(" ", text, text)), "|").alias("figures"))


@query(
    r"""WITH k AS (SELECT item_id, question_code AS key, (item_id % 40)::VARCHAR || '.' || (item_id % 3)::VARCHAR AS printed, text || '（' || (item_id % 9)::VARCHAR || '.5分）' AS text FROM eval_items), o AS (SELECT *, regexp_extract(key, '([0-9]+(?:\.[0-9]+)*)$', 1) AS own FROM k)
    SELECT item_id, own, CASE WHEN own <> printed THEN regexp_replace(key, '[0-9]+(\.[0-9]+)*$', '') || printed ELSE key END AS repaired, regexp_replace('（' || printed || '）.', '[()（）\[\].．、:：\s]', '', 'g') AS label,
      TRY_CAST(regexp_extract(substring(text, 1, 500), '([0-9]+(?:\.[0-9]+)?)\s*(?:分|points?)', 1) AS DOUBLE) AS points FROM o"""
)
def question_keys(spark: SparkSession, d: str) -> DataFrame:
    """The number in each key, the key repaired by a printed number, a label without brackets, and the points a text names."""
    rows = read_table(spark, d, "eval_items").select("item_id", F.col("question_code").alias("key"), F.concat((F.col("item_id") % 40).cast("string"), F.lit("."), (F.col("item_id") % 3).cast("string")).alias("printed"), F.concat("text", F.lit("（"), (F.col("item_id") % 9).cast("string"), F.lit(".5分）")).alias("text"))
    key, printed = F.col("key"), F.col("printed")
    return rows.select("item_id", headings.question_number(key).alias("own"), headings.repaired_key(key, printed).alias("repaired"), headings.part_label(F.concat(F.lit("（"), printed, F.lit("）."))).alias("label"), headings.points(F.col("text")).alias("points"))


@query(
    r"""WITH p AS (SELECT DISTINCT page_id, text FROM page_documents), l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM p),
    h AS (SELECT page_id, line_no, regexp_extract(line, '^\s*([0-9]+(?:\.[0-9]+){1,3})\s+(.{2,30}?)\s*$', 1) AS number, regexp_extract(line, '^\s*([0-9]+(?:\.[0-9]+){1,3})\s+(.{2,30}?)\s*$', 2) AS title FROM l)
    SELECT page_id, line_no, number || ' ' || title AS heading, starts_with(number, '1.') AS first FROM h WHERE number <> '' AND NOT regexp_matches(title, '[。！？；]$')"""
)
def section_headings(spark: SparkSession, d: str) -> DataFrame:
    """The lines of pages that are headings of sections."""
    lines = t.pages(spark, d).select("page_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    found = lines.select("page_id", (F.col("at") + 1).cast("bigint").alias("line_no"), headings.section_heading(F.col("line")).alias("heading")).where("heading IS NOT NULL")
    return found.withColumn("first", F.startswith("heading", F.lit("1.")))


@query(
    rf"""WITH c AS (SELECT DISTINCT id, section, knowledge_tags FROM text_chunks), j AS (SELECT id, section, array_to_string(coalesce(knowledge_tags, []), '；') || ' ,， a|b、' AS joined, coalesce(knowledge_tags, []) || [section] AS named FROM c),
    s AS (SELECT id, list_filter(list_transform(string_split_regex(joined, '[,，、;；|]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS tags, named FROM j),
    m AS (SELECT id, tags, list_filter(named, lambda x: x IS NOT NULL) AS named FROM s)
    SELECT id, array_to_string(tags, '|') AS tags, array_to_string(list_transform({_first_use("named")}, lambda x: 'custom:' || substr(sha1(trim(x, ' ')), 1, 16)), '|') AS ids FROM m"""
)
def tag_lists(spark: SparkSession, d: str) -> DataFrame:
    """Tags of a delimited string as a list, and the ids of tags and section together, each once."""
    rows = read_table(spark, d, "text_chunks").select("id", "section", "knowledge_tags").distinct()
    tags = F.concat(F.array_join(F.coalesce("knowledge_tags", F.array().cast("array<string>")), "；"), F.lit(" ,， a|b、"))
    named = E.joined_once(F.col("knowledge_tags"), F.array("section"))
    return rows.select("id", F.array_join(T.split_tags(tags), "|").alias("tags"), F.array_join(F.transform(named, E.custom_tag), "|").alias("ids"))


_POINTS = "[" + ", ".join(f"'{p}'" for p in E.POINTS) + "]"


@query(f"WITH f AS (SELECT doc_id, list_slice(list_filter({_POINTS}, lambda x: contains(lower(coalesce(text, '')), lower(x))), 1, {E.MOST_POINTS}) AS found FROM documents) SELECT doc_id, CASE WHEN len(found) > 0 THEN array_to_string(found, '|') ELSE '{E.NO_POINT}' END AS points FROM f")
def fallback_points(spark: SparkSession, d: str) -> DataFrame:
    """The known points each document names, or the default."""
    return read_table(spark, d, "documents").select("doc_id", F.array_join(E.points_or_default(F.col("text")), "|").alias("points"))


@query(
    rf"""WITH v AS (SELECT DISTINCT name FROM (SELECT unnest(knowledge_tags) AS name FROM text_chunks UNION ALL SELECT section FROM text_chunks UNION ALL SELECT element_type FROM text_chunks UNION ALL SELECT source FROM text_chunks UNION ALL SELECT unnest(extra.ocr_concepts) FROM page_documents) WHERE name IS NOT NULL),
    b AS (SELECT name, trim(name, ' ') AS bare, trim(regexp_replace(trim(name, ' '), '^[0-9]+(\.[0-9]+)*[ \t]*', ''), ' ') AS plain FROM v)
    SELECT name, bare <> '' AND lower(bare) NOT IN ({_in(E.NO_CONCEPTS)}) AND NOT regexp_matches(bare, '(?i)(pages?|页)[_-]?[0-9]+[_-][0-9]+') AND NOT (contains(bare, '_') AND NOT regexp_matches(bare, '[一-鿿]'))
      AND length(plain) <= 60 AND regexp_matches(plain, '[一-鿿A-Za-z]') AND NOT regexp_matches(plain, '^[0-9]+ *[-—~] *[0-9]+$') AS concept FROM b"""
)
def concept_tests(spark: SparkSession, d: str) -> DataFrame:
    """Which tags, sections and names may be concepts."""
    chunks, pages = read_table(spark, d, "text_chunks"), read_table(spark, d, "page_documents")
    names = [chunks.select(F.explode("knowledge_tags").alias("name")), *(chunks.select(F.col(c).alias("name")) for c in ("section", "element_type", "source")), pages.select(F.explode("extra.ocr_concepts").alias("name"))]
    rows = names[0]
    for other in names[1:]:
        rows = rows.unionByName(other)
    return rows.where("name IS NOT NULL").distinct().select("name", E.is_concept(F.col("name")).alias("concept"))


@query(
    rf"""WITH {t.REQUESTS} SELECT request_id, regexp_replace(array_to_string(list_transform(string_split(coalesce(question, '') || '  ' || chr(10) || coalesce(answer, '') || ' ', chr(10)), lambda x: regexp_replace(x, '[ \t\r\f]+$', '')), chr(10)), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') AS note,
      CASE WHEN request_id % 6 IN (1, 2, 4) THEN (request_id % 6)::INTEGER ELSE 1 END AS option_columns, CASE WHEN source = 'question_bank' THEN 'before_question' ELSE 'after_question' END AS position,
      round(coalesce(TRY_CAST(category_id AS DOUBLE), request_id % 100 / 7.0), 2) AS number, coalesce(lower(trim(agent)) IN ('true', '1', 'yes', '是'), false) OR request_id % 2 = 1 AS flag FROM r"""
)
def entry_fields(spark: SparkSession, d: str) -> DataFrame:
    """Notes as they are stored, and fields with a default."""
    rows = t.requests(spark, d)
    note = F.concat(F.coalesce("question", F.lit("")), F.lit("  \n"), F.coalesce("answer", F.lit("")), F.lit(" "))
    place = F.when(F.col("source") == "question_bank", " before_question ").otherwise(F.col("source"))
    number = F.coalesce(F.col("category_id").try_cast("double"), F.col("request_id") % 100 / 7.0)
    flag = T.as_flag("agent") | T.as_flag((F.col("request_id") % 2).cast("string"))
    return rows.select("request_id", E.stored_note(note).alias("note"), E.option_columns(F.col("request_id") % 6).alias("option_columns"), E.figure_position(place).alias("position"), T.as_number(number).alias("number"), flag.alias("flag"))


@query(
    f"""WITH {_ELEMENTS}, b AS (SELECT id, list_transform(bbox, lambda x: greatest(0.0, least(1000.0, x))) AS c FROM e WHERE len(bbox) = 4), o AS (SELECT id, [least(c[1], c[3]), least(c[2], c[4]), greatest(c[1], c[3]), greatest(c[2], c[4])] AS c FROM b)
    SELECT id, round(c[1], 2) AS x0, round(c[2], 2) AS y0, round(c[3], 2) AS x1, round(c[4], 2) AS y1, round_even(round(c[1], 2) * 1280 / 1000, 0)::INTEGER AS left, round_even(round(c[4], 2) * 960 / 1000, 0)::INTEGER AS bottom FROM o WHERE round(c[3], 2) - round(c[1], 2) >= 3 AND round(c[4], 2) - round(c[2], 2) >= 3"""
)
def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with their corners in order, without those that are too small, and their corners in pixels."""
    rows = t.regions(spark, d).select("id", layout.clean_box(F.col("bbox")).alias("b")).where("b IS NOT NULL").withColumn("p", layout.to_pixels(F.col("b"), F.lit(1280), F.lit(960)))
    return rows.select("id", *[F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.col("p")[0].alias("left"), F.col("p")[3].alias("bottom"))


@query(
    r"""WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) AS p, generate_subscripts(string_split_regex(text, '\n\s*\n'), 1) AS pos FROM documents), q AS (SELECT doc_id, pos, p, unnest(generate_series(0, (length(p) - 1) // 420)) AS i FROM p WHERE trim(p, ' ') <> '')
    SELECT doc_id, count(*)::INTEGER AS slices, md5(string_agg(substring(p, (i * 420 + 1)::BIGINT, 420), chr(31) ORDER BY pos, i)) AS content FROM q GROUP BY doc_id"""
)
def reply_slices(spark: SparkSession, d: str) -> DataFrame:
    """Texts as slices of their paragraphs, none over 420 characters: their number and a digest of them."""
    rows = read_table(spark, d, "documents").select("doc_id", context.response_slices(F.col("text")).alias("s")).where(F.size("s") > 0)
    return rows.select("doc_id", F.size("s").alias("slices"), F.md5(F.array_join("s", "\x1f")).alias("content"))


@query(
    r"""WITH c AS (SELECT DISTINCT id, source, chapter, section, page_start, text FROM text_chunks WHERE source IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS rank FROM c QUALIFY rank <= 3),
    b AS (SELECT source, rank, '[资料' || rank || '] 来源=' || concat_ws(' · ', nullif(source, ''), nullif(nullif(chapter, ''), source), nullif(section, ''), page_start::VARCHAR) || chr(10) || coalesce(text, '') AS block FROM k) SELECT source AS grp, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM b GROUP BY source"""
)
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The first three chunks of every source as numbered blocks."""
    rows = read_table(spark, d, "text_chunks").where("source IS NOT NULL").select("id", "source", "chapter", "section", F.col("page_start").alias("page"), "text").distinct()
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("id"))).where("rank <= 3").withColumn("grp", F.col("source"))
    return context.context(ranked, "grp", "rank")


@query(
    f"""WITH c AS (SELECT DISTINCT id, knowledge_tags FROM text_chunks), o AS (SELECT id, list_transform(coalesce(knowledge_tags, []), lambda x, i: {{'l': chr((64 + i)::INTEGER), 't': trim(x, ' ')}}) AS o FROM c)
    SELECT id, array_to_string(list_transform(list_filter(o, lambda x: x.t <> ''), lambda x: x.l || '. ' || x.t), '|') AS options, '题' || CASE WHEN len(o) > 0 THEN chr(10) || array_to_string(list_transform(o, lambda x: '(' || x.l || ') ' || x.t), chr(10)) ELSE chr(10) END AS composed FROM o"""
)
def labelled_options(spark: SparkSession, d: str) -> DataFrame:
    """Lists as labelled options, and as one text."""
    o = read_table(spark, d, "text_chunks").select("id", "knowledge_tags").distinct().select("id", questions.options(F.col("knowledge_tags")).alias("o"))
    return o.select("id", F.array_join(F.transform("o", lambda x: F.concat(x["label"], F.lit(". "), x["text"])), "|").alias("options"), questions.compose(F.lit("题"), F.col("o")).alias("composed"))


@query(
    f"""WITH {t.MESSAGES}, s AS (SELECT session_id, max(created_at) AS last, count(*) AS n FROM log GROUP BY session_id) SELECT session_id, n, row_number() OVER (ORDER BY last DESC, session_id) AS place FROM s QUALIFY place <= 30"""
)
def session_list(spark: SparkSession, d: str) -> DataFrame:
    """The thirty sessions used last, in order (a list that is cut at thirty)."""
    s = t.message_log(spark, d).groupBy("session_id").agg(F.max("created_at").alias("last"), F.count("*").alias("n"))
    top = s.orderBy(F.desc("last"), "session_id").limit(30)
    return top.select("session_id", "n", F.row_number().over(Window.orderBy(F.desc("last"), "session_id")).cast("bigint").alias("place"))


@query(f"WITH {t.CHUNKS}, {t.MENTIONS[len(t.CHUNKS) + 2 :]}, n AS (SELECT count(DISTINCT id) AS chunks FROM c WHERE doc_type = 'textbook' OR doc_type IS NOT NULL), m AS (SELECT count(DISTINCT lower(name)) AS concepts FROM mentions) SELECT chunks, concepts, NOT (chunks >= 12 AND concepts <= 1) AS ok FROM n, m")
def graph_validation(spark: SparkSession, d: str) -> DataFrame:
    """Whether the graph of the chunks names concepts enough."""
    chunks = t.chunks(spark, d)
    counted = chunks.where("doc_type IS NOT NULL").agg(F.count("*").alias("chunks"))
    named = graph.mentions(chunks).agg(F.countDistinct(F.lower("name")).alias("concepts"))
    return counted.crossJoin(named).withColumn("ok", ~((F.col("chunks") >= 12) & (F.col("concepts") <= 1)))


@query("SELECT doc_id, sha256(text) AS sha, substr(sha1(text), 1, 8) AS short FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The digest of every text."""
    return read_table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.sha1("text"), 1, 8).alias("short"))
