"""Queries of pages, chunks and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.functions import text as T
from coursemill.operators import chunking, cleaning, context, layout, quality
from coursemill.plans import build
from coursemill.plans import tables as t
from coursemill.plans.registry import query
from coursemill.session import read_table
from coursemill.sources import files

_PAGES = "p AS (SELECT DISTINCT page_id, source, page, chapter, section, text, source_page FROM page_documents)"
_LINES = (
    _PAGES
    + r""", l0 AS (SELECT page_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM p),
    lines AS (SELECT page_id, source, line_no, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '[\x{200B}\x{FEFF}]', '', 'g'),
      'https?://[A-Za-z0-9./?=&_%-]+|www\.[A-Za-z0-9./?=&_%-]+', '', 'g'), '([A-Za-z])[ \t]+([一-鿿])', '\1\2', 'g'), '([一-鿿])[ \t]+([A-Za-z0-9一-鿿])', '\1\2', 'g'), '[ \t\x{3000}\x{A0}]+', ' ', 'g')) AS line FROM l0)"""
)
_NOISE = "length(line) = 0 OR regexp_matches(line, '^[-—·•~\\[\\] ]*[0-9]{1,4}[-—·•~\\[\\] ]*$') OR len(regexp_extract_all(line, '�')) > 1 OR " + " OR ".join(f"contains(lower(line), '{a}')" for a in T.ADVERTS)
_EDGE = """placed AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS a, row_number() OVER (PARTITION BY page_id ORDER BY line_no DESC) AS z FROM lines WHERE line <> ''),
    counted AS (SELECT source, line, sum((a <= 2)::BIGINT + (z <= 2)::BIGINT)::BIGINT AS n FROM placed WHERE length(line) <= 80 GROUP BY source, line),
    edge AS (SELECT counted.* FROM counted JOIN (SELECT source, count(DISTINCT page_id) AS pages FROM p GROUP BY source) USING (source) WHERE n > 0 AND n >= greatest(3, floor(pages * 0.08::DOUBLE)))"""


@query(f"WITH {_LINES} SELECT page_id, line_no, line FROM lines")
def normalize_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every page, normalised."""
    return cleaning.page_lines(t.pages(spark, d)).select("page_id", "line_no", "line")


@query(f"WITH {_LINES}, {_EDGE} SELECT source, line, n FROM edge")
def edge_noise(spark: SparkSession, d: str) -> DataFrame:
    """Lines repeated at the edges of a source's pages."""
    return cleaning.edge_noise(t.pages(spark, d))


@query(f"WITH {_LINES}, {_EDGE} SELECT page_id, line_no, line FROM lines WHERE NOT ({_NOISE}) AND (source, line) NOT IN (SELECT source, line FROM edge)")
def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines that are neither noise nor repeated at edges."""
    return cleaning.clean_lines(t.pages(spark, d)).select("page_id", "line_no", "line")


@query()
def nfkc_lines(spark: SparkSession, d: str) -> DataFrame:
    """normalize_lines of the texts under NFKC, which DuckDB has not."""
    return cleaning.page_lines(cleaning.composed(t.pages(spark, d))).select("page_id", "line_no", "line")


@query()
def nfkc_edge_noise(spark: SparkSession, d: str) -> DataFrame:
    """edge_noise of the texts under NFKC."""
    return cleaning.edge_noise(cleaning.composed(t.pages(spark, d)))


@query()
def nfkc_clean_lines(spark: SparkSession, d: str) -> DataFrame:
    """clean_lines of the texts under NFKC."""
    return cleaning.clean_lines(cleaning.composed(t.pages(spark, d))).select("page_id", "line_no", "line")


@query()
def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as paragraphs of their clean lines."""
    return cleaning.clean_pages(t.pages(spark, d))


_OPENS, _CLOSES = "习题|Exercises|实验报告", "^(第[0-9]+章|Chapter [0-9]+)"


@query(
    f"""WITH {_PAGES}, m AS (SELECT *, CASE WHEN regexp_matches(text, '{_CLOSES}') THEN 1 WHEN regexp_matches(text, '{_OPENS}') THEN 0 END AS mark FROM p)
    SELECT page_id, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY source ORDER BY page, page_id ROWS UNBOUNDED PRECEDING), 1) = 1 AS keep FROM m"""
)
def page_keep(spark: SparkSession, d: str) -> DataFrame:
    """Pages outside ranges of exercises, which end at a chapter heading."""
    rows = cleaning.keep_decisions(t.pages(spark, d), F.col("text").rlike(_OPENS), F.col("text").rlike(_CLOSES))
    return rows.select("page_id", "keep")


@query(
    f"""WITH {_PAGES} SELECT page_id, last_value(nullif(trim(coalesce(section, '')), '') IGNORE NULLS) OVER (PARTITION BY source ORDER BY page, page_id ROWS UNBOUNDED PRECEDING) AS section FROM p"""
)
def heading_carry(spark: SparkSession, d: str) -> DataFrame:
    """The section of each page, carried forward from the last page that names one."""
    own = F.when(F.trim(F.coalesce("section", F.lit(""))) != "", F.trim("section"))
    return cleaning.carry_forward(t.pages(spark, d).withColumn("_own", own).drop("section"), "source", ["page", "page_id"], "_own", "section").select("page_id", "section")


@query(
    f"""WITH {_PAGES}, toc AS (SELECT source, min(page) AS page, chapter FROM p WHERE chapter <> '' GROUP BY source, chapter)
    SELECT p.page_id, (SELECT max_by(toc.chapter, (toc.page, toc.chapter)) FROM toc WHERE toc.source = p.source AND toc.page <= p.page) AS toc_chapter FROM p"""
)
def toc_asof(spark: SparkSession, d: str) -> DataFrame:
    """The chapter of each page by the last entry of the table of contents at or before it."""
    pages = t.pages(spark, d)
    toc = pages.where("chapter <> ''").groupBy("source", "chapter").agg(F.min("page").alias("page"))
    toc = toc.groupBy("source", "page").agg(F.max("chapter").alias("toc_chapter"))
    return cleaning.as_of(pages.select("source", "page", "page_id"), toc, "source", "page", ["toc_chapter"]).select("page_id", "toc_chapter")


@query()
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages packed into chunks."""
    return chunking.chunk_pages(t.pages(spark, d))


@query(f"WITH {_PAGES} SELECT page_id, substr(sha1(concat_ws('|', coalesce(source, ''), coalesce(page::VARCHAR, ''), coalesce(section, ''), coalesce(substring(text, 1, 120), ''))), 1, 16) AS id FROM p")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """The id of the first chunk of every page."""
    return chunking.with_chunk_ids(t.pages(spark, d)).select("page_id", "id")


@query(
    r"""WITH e AS (SELECT DISTINCT id, element_type, text, content_hash FROM layout_elements WHERE element_type <> 'text' AND trim(text) <> ''),
    a AS (SELECT *, substring(regexp_replace(lower(text), '[ \t\n]+', '', 'g'), 1, 500) AS same FROM e QUALIFY row_number() OVER (PARTITION BY coalesce(content_hash, 'id:' || id) ORDER BY id) = 1)
    SELECT id, element_type, text FROM a QUALIFY row_number() OVER (PARTITION BY same ORDER BY id) = 1"""
)
def element_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Layout elements that become chunks by their text alone, each content once in the whole table; multimodal_chunks has all."""
    return chunking.element_chunks(t.regions(spark, d)).select("id", "element_type", "text")


@query()
def multimodal_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Layout elements that become chunks, with the text of all their fields, each content of a page and kind once."""
    return chunking.multimodal_chunks(t.elements(spark, d)).select("id", "element_type", "text")


@query("SELECT 'question-' || item_id AS id, concat_ws(chr(10), '题目：' || text, '标准答案：' || standard_answer, '难度：' || coalesce(difficulty, '基础')) AS text, 'question' AS doc_type FROM eval_items")
def question_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The bank as hidden chunks."""
    return chunking.question_chunks(read_table(spark, d, "eval_items")).select("id", "text", "doc_type")


#: Names of concepts looked for in texts.
CONCEPTS = ["静态工作点", "电压增益", "输入电阻", "输出电阻", "通频带", "截止频率", "相位裕度", "失调电压", "共模抑制比", "纹波电压", "转换效率", "温度漂移", "bandwidth", "phase margin", "offset voltage", "ripple voltage", "efficiency", "rise time", "cutoff frequency", "operating point"]
_LIST = "[" + ", ".join(f"'{c}'" for c in CONCEPTS) + "]"


@query(f"SELECT doc_id, array_to_string(list_slice(list_filter({_LIST}, lambda x: contains(lower(text), lower(x))), 1, 12), '|') AS tags FROM documents")
def concept_tags(spark: SparkSession, d: str) -> DataFrame:
    """The concepts each document names, at most twelve."""
    return read_table(spark, d, "documents").select("doc_id", F.array_join(T.contained(CONCEPTS, "text"), "|").alias("tags"))


@query(
    """SELECT count(*) AS total, count(*) FILTER (element_type = 'circuit') AS circuits, count(*) FILTER (element_type = 'formula') AS formulas, count(*) FILTER (element_type = 'table') AS tables,
    count(*) FILTER (uncertain) AS uncertain, count(*) FILTER (bbox IS NULL) AS unplaced FROM (SELECT DISTINCT id, element_type, uncertain, bbox FROM layout_elements)"""
)
def index_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counts of what was extracted."""
    kinds = {name: F.col("element_type") == kind for name, kind in (("circuits", "circuit"), ("formulas", "formula"), ("tables", "table"))}
    return quality.counters(t.regions(spark, d), {**kinds, "uncertain": F.col("uncertain"), "unplaced": F.col("bbox").isNull()})


@query(
    """WITH e AS (SELECT DISTINCT id, bbox, confidence, page, text FROM layout_elements), n AS (SELECT count(*) AS total,
    count(*) FILTER (NOT coalesce(len(bbox) = 4, false)) AS box, count(*) FILTER (NOT coalesce(confidence BETWEEN 0 AND 1, false)) AS conf, count(*) FILTER (NOT coalesce(page >= 1, false)) AS pg FROM e)
    SELECT 'box has four numbers' AS rule, box AS failed, total, box = 0 AS ok FROM n UNION ALL SELECT 'confidence is a part', conf, total, conf = 0 FROM n UNION ALL SELECT 'page is positive', pg, total, pg = 0 FROM n"""
)
def build_validation(spark: SparkSession, d: str) -> DataFrame:
    """Expectations on the extracted elements."""
    return quality.expect(t.regions(spark, d), {"box has four numbers": F.size("bbox") == 4, "confidence is a part": F.col("confidence").between(0, 1), "page is positive": F.col("page") >= 1})


@query()
def region_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Elements that stay after suppressing overlapping ones of the same kind on a page."""
    return layout.suppress(t.regions(spark, d), ["source", "page", "element_type"])


_BOXES = "b AS (SELECT DISTINCT id, source, page, element_type, bbox, caption FROM layout_elements WHERE len(bbox) = 4 AND bbox[3] > bbox[1] AND bbox[4] > bbox[2] AND source IS NOT NULL AND page IS NOT NULL)"


@query(
    f"""WITH {_BOXES}, pairs AS (SELECT l.id, r.id AS other, greatest(0.0, r.bbox[2] - l.bbox[4], l.bbox[2] - r.bbox[4]) AS distance FROM b l JOIN b r ON l.source = r.source AND l.page = r.page AND l.id <> r.id
      WHERE l.element_type IN ('circuit', 'formula') AND r.element_type = 'text' AND r.bbox[1] <= l.bbox[3] + 48 AND r.bbox[3] >= l.bbox[1] - 48)
    SELECT id, other, round(distance, 2)::DOUBLE AS distance, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM pairs WHERE distance <= 72 QUALIFY rank <= 3"""
)
def nearby_text(spark: SparkSession, d: str) -> DataFrame:
    """The three texts nearest to each circuit and formula."""
    e = t.regions(spark, d)
    return layout.nearest(e.where("element_type IN ('circuit', 'formula')"), e.where("element_type = 'text'"), ["source", "page"])


@query(
    f"""WITH {_BOXES}, pairs AS (SELECT l.id, r.id AS other, greatest(0.0, least(l.bbox[3], r.bbox[3]) - greatest(l.bbox[1], r.bbox[1])) * greatest(0.0, least(l.bbox[4], r.bbox[4]) - greatest(l.bbox[2], r.bbox[2])) / ((l.bbox[3] - l.bbox[1]) * (l.bbox[4] - l.bbox[2])) AS part
      FROM b l JOIN b r ON l.source = r.source AND l.page = r.page AND l.id <> r.id) SELECT id, other, round(part, 4)::DOUBLE AS part FROM pairs WHERE round(part, 4) > 0"""
)
def overlapping_regions(spark: SparkSession, d: str) -> DataFrame:
    """Elements that cover a part of another on the same page."""
    e = t.regions(spark, d)
    return layout.overlapping(e, e, ["source", "page"])


@query(
    f"""WITH {_PAGES}, w AS (SELECT source, page, page_id, coalesce(chapter, '') <> coalesce(lag(chapter) OVER x, '') AND coalesce(chapter, '') <> '' AS ch, coalesce(section, '') <> coalesce(lag(section) OVER x, '') AND coalesce(section, '') <> '' AS se FROM p WINDOW x AS (PARTITION BY source ORDER BY page, page_id))
    SELECT source, count(*) AS pages, count(*) FILTER (ch) AS chapter_headings, count(*) FILTER (se) AS section_headings FROM w GROUP BY source"""
)
def markdown_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings that a source needs as Markdown, where chapter or section changes."""
    lines = files.markdown_lines(t.pages(spark, d))
    has = lambda mark: F.count_if(F.col("line").rlike(mark))
    return lines.groupBy("source").agg(F.count("*").alias("pages"), has(r"^## ").alias("chapter_headings"), has(r"^(## [^\n]*\n)?### ").alias("section_headings"))


@query(
    f"""WITH {_BOXES}, pairs AS (SELECT l.id, r.id AS caption_id, greatest(0.0, r.bbox[2] - l.bbox[4], l.bbox[2] - r.bbox[4]) AS v, abs((l.bbox[1] + l.bbox[3]) - (r.bbox[1] + r.bbox[3])) / 2 AS h, greatest(24.0, 1.5::DOUBLE * (l.bbox[4] - l.bbox[2])) AS reach
      FROM b l JOIN b r ON l.source = r.source AND l.page = r.page AND l.id <> r.id WHERE l.element_type IN ('circuit', 'image') AND r.element_type IN ('text', 'title'))
    SELECT id, caption_id, round(v + 0.05::DOUBLE * h, 4) AS cost FROM pairs WHERE v <= reach QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(v + 0.05::DOUBLE * h, 4), caption_id) = 1"""
)
def nearest_captions(spark: SparkSession, d: str) -> DataFrame:
    """The text or title nearest to each circuit and image."""
    e = t.regions(spark, d)
    return layout.nearest_caption(e.where("element_type IN ('circuit', 'image')"), e.where("element_type IN ('text', 'title')"), ["source", "page"])


@query()
def largest_regions(spark: SparkSession, d: str) -> DataFrame:
    """Elements of a page and kind that lie in no larger one."""
    return layout.keep_largest(t.regions(spark, d), ["source", "page", "element_type"])


@query(
    """WITH c AS (SELECT DISTINCT id, source, chapter, section, page_start, text, knowledge_tags FROM text_chunks)
    SELECT id, substring(text, 1, 360) AS excerpt, array_to_string(list_slice(coalesce(knowledge_tags, []), 1, 8), '|') AS tags,
      concat_ws(' · ', nullif(source, ''), nullif(nullif(chapter, ''), source), nullif(section, ''), page_start::VARCHAR) AS reference FROM c"""
)
def hit_projection(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as hits, with excerpt, tags and reference."""
    rows = read_table(spark, d, "text_chunks").select("id", "source", "chapter", "section", "page_start", "text", "knowledge_tags").distinct()
    shown = context.hits(rows, [])
    parts = [F.col(c) for c in ("source", "chapter", "section", "page_start")]
    return shown.select("id", "excerpt", F.array_join("tags", "|").alias("tags"), context.reference(*parts).alias("reference"))


@query()
def kb_audit(spark: SparkSession, d: str) -> DataFrame:
    """A knowledge base built from all pages and elements, and the rules it keeps."""
    elements = t.elements(spark, d)
    return build.build(t.pages(spark, d), elements, CONCEPTS)["audit"]
