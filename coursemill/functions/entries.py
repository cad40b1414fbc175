"""Fields of entries: values with a default, tags that are concepts, notes as they are stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coursemill.functions import text as T

#: Tags that name kinds of elements and no concepts.
NO_CONCEPTS = ("text", "image", "figure", "formula", "table", "circuit", "multimodal", "component", "net", "port", "vsource", "isource", "resistor", "capacitor", "inductor", "npn", "pnp", "bjt", "mosfet")
#: Points to fall back on where none is named, and the one where none of them stands in the text either.
POINTS = ["PN结", "二极管", "稳压二极管", "晶体管", "三极管", "场效应管", "静态工作点", "共射放大电路", "相量", "复阻抗", "功率因数", "有功功率", "无功功率", "RLC", "谐振", "KCL", "KVL", "戴维南定理", "诺顿定理"]
NO_POINT, MOST_POINTS = "电路基础", 8
#: Where a figure may stand, and how many columns options may have.
POSITIONS = ("before_question", "after_question", "after_options")
COLUMNS = (1, 2, 4)


def stored_note(text: Column) -> Column:
    """A note without blanks at the ends of its lines and of the whole."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"[ \t\r\f]+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def option_columns(value: Column) -> Column:
    """The number of columns if it may be that, else 1."""
    number = value.cast("string").try_cast("double").cast("int")
    return F.when(number.isin(*COLUMNS), number).otherwise(1)


def figure_position(value: Column) -> Column:
    """The place if it is one, else after the question."""
    return F.when(F.trim(value).isin(*POSITIONS), F.trim(value)).otherwise(POSITIONS[1])


def custom_tag(name: Column) -> Column:
    """The id of a tag that the ontology does not have."""
    return F.concat(F.lit("custom:"), F.substring(F.sha1(F.trim(name)), 1, 16))


def is_concept(name: Column) -> Column:
    """Whether a tag may be a concept: no kind of element, no range of pages, no identifier, and a name of a section or concept."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    code = F.contains(bare, F.lit("_")) & ~bare.rlike("[一-鿿]")
    pages = bare.rlike("(?i)(pages?|页)[_-]?[0-9]+[_-][0-9]+")
    return (bare != "") & ~F.lower(bare).isin(*NO_CONCEPTS) & ~pages & ~code & (T.meaningful_section(bare) != "")


def points_or_default(text: Column) -> Column:
    """The first known points that a text names, or the default."""
    found = T.contained(POINTS, text, MOST_POINTS)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_POINT)))


def joined_once(*lists: Column) -> Column:
    """The entries of several arrays, each once, in order of first use; nulls are passed over."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(x, empty) for x in lists])))
