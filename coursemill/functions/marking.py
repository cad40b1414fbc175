"""Answers with a fixed solution: what is expected, in which form answers are compared, and how they are marked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of kinds of questions, and the kinds.
KIND_NAMES = {
    "multiple_choice": "choice", "single_choice": "choice", "选择题": "choice", "calculation": "calculation", "计算题": "calculation", "short_answer": "short_answer", "简答题": "short_answer",
    "fill_blank": "fill_blank", "填空题": "fill_blank", "true_false": "true_false", "判断题": "true_false", "design": "design", "设计题": "design",
}
KINDS = ("choice", "fill_blank", "true_false", "calculation", "short_answer", "design", "other")
#: Words of an answer that explains instead of stating.
EXPLAINS = "解[：:]?|因为|所以|故|步骤|解析|说明|或|均可|任意|不唯一"
#: What stands before the answer in a longer text.
BEFORE_ANSWER = "(?:标准答案|正确答案|答案)"
BLANK = "[ \\t\\n\\r\\f]"


def clean(text: Column, limit: int = 24_000) -> Column:
    """A text with runs of blanks as one, trimmed, at most limit characters; null is empty."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t]+", " "), f"^{BLANK}+|{BLANK}+$", ""), 1, limit)


def question_kind(name: Column) -> Column:
    """The kind of a question by any of its names; other where it has none."""
    low = F.lower(clean(name, 40))
    table = F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair])
    return F.coalesce(table[low], F.when(low.isin(*KINDS), low), F.lit("other"))


def compared(text: Column) -> Column:
    """The form in which fixed answers are compared: lower case, no LaTeX commands, blanks, dollar signs and braces."""
    out = F.lower(F.regexp_replace(clean(text, 1000), "[。.]+$", ""))
    out = F.regexp_replace(out, r"\\(?:mathrm|text)[ \t\n]*\{([^{}]*)\}", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\\left|\\right|\\,", ""), r"\\([a-z]+)", "$1")
    return F.regexp_replace(F.replace(F.translate(out, "，；：", ",;:"), F.lit("ω"), F.lit("omega")), r"[ \t\n\r\f$\{\}]", "")


def choice_key(text: Column, labels: Column) -> Column:
    """The sorted distinct labels that a text names as right: by nothing but labels, or after the word for answer; null where it names none.

    A label that is no option makes the text unusable.
    """
    upper = F.upper(clean(text, 2000))
    compact = F.split(F.regexp_replace(upper, "[ \\t\\n,，、;/]+", ""), "")
    compact = F.filter(compact, lambda x: x != "")
    after = F.regexp_extract(upper, r"(?:标准答案|正确答案|答案|应选)[ \t\n]*(?:为|是|[:：])?[ \t\n]*([A-Z](?:[ \t\n]*[,，、/ ][ \t\n]*[A-Z])*)", 1)
    named = F.regexp_extract_all(after, F.lit("([A-Z])"), F.lit(1))
    known = lambda x: (F.size(x) > 0) & (F.size(F.array_except(x, labels)) == 0)
    return F.when(known(compact), F.array_sort(F.array_distinct(compact))).when(known(named), F.array_sort(F.array_distinct(named)))


def true_false_key(text: Column) -> Column:
    """正确 or 错误 where a text says so alone or after the word for answer, else null."""
    bare = F.regexp_replace(clean(text, 2000), "。+$", "")
    found = F.regexp_extract(clean(text, 2000), BEFORE_ANSWER + r"[ \t\n]*(?:为|是|[:：])?[ \t\n]*(正确|错误)", 1)
    return F.when(bare.isin("正确", "错误"), bare).otherwise(F.nullif(found, F.lit("")))


def fill_key(text: Column) -> Column:
    """A short answer in one line that states and does not explain, without the word for answer before it, else null."""
    bare = clean(text, 1000)
    stated = F.trim(F.regexp_replace(bare, "^" + BEFORE_ANSWER + r"[ \t]*[:：][ \t]*", ""))
    return F.when((bare != "") & (F.length(bare) <= 160) & ~F.contains(bare, F.lit("\n")) & ~stated.rlike(EXPLAINS) & (stated != ""), stated)


def is_right(kind: Column, key: Column, labels: Column, selected: Column, answer: Column) -> Column:
    """Whether a fixed answer is right: choices as sets of labels, true or false by the one that is selected, fills in compared form.

    Null where it takes a person to tell: another kind, no usable key, nothing answered.
    """
    chosen = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(selected, F.array().cast("array<string>")), lambda x: F.upper(clean(x, 12))), lambda x: x != "")))
    marks = F.filter(F.transform(F.coalesce(selected, F.array().cast("array<string>")), lambda x: clean(x, 12)), lambda x: x != "")
    choice = F.when(F.size(chosen) > 0, chosen == choice_key(key, labels))
    true_false = F.when(F.size(marks) == 1, F.try_element_at(marks, F.lit(1)) == true_false_key(key))
    fill = F.when(clean(answer) != "", compared(answer) == compared(fill_key(key)))
    return F.when(kind == "choice", choice).when(kind == "true_false", true_false).when((kind == "fill_blank") & fill_key(key).isNotNull(), fill)
