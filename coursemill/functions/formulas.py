"""Formulas and tables in extracted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MATH = r"[=+\-*/^<>≈≤≥±∑∫√·×÷_\\]"


def looks_like_formula(text: Column) -> Column:
    """At most 500 characters, two signs of mathematics, and a letter or figure."""
    c = F.coalesce(text, F.lit(""))
    return (F.length(c) <= 500) & (F.regexp_count(c, F.lit(_MATH)) >= 2) & c.rlike(r"[A-Za-z0-9]")


def looks_like_table(text: Column) -> Column:
    """Three lines with content, two of them with columns."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return (F.size(lines) >= 3) & (F.size(F.filter(lines, lambda x: x.rlike(r"\t|  | \| "))) >= 2)


def skeleton(latex: Column) -> Column:
    """Letters and figures of a formula without its commands, in lower case: two formulas with one skeleton are one."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(latex, F.lit("")), r"\\[A-Za-z]+", ""), r"[^A-Za-z0-9]", ""))


def reconcile(recognised: Column, candidate: Column) -> Column:
    """The candidate of the page where both have one skeleton, else what was recognised."""
    return F.when((skeleton(candidate) != "") & (skeleton(recognised) == skeleton(candidate)), candidate).otherwise(recognised)


def candidates(text: Column) -> Column:
    """Lines of a page that may be formulas: an equals sign, at most 240 characters and three ideographs."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: F.contains(x, F.lit("=")) & (F.length(x) <= 240) & (F.regexp_count(x, F.lit("[一-鿿]")) <= 3))


#: Symbols and the quantities they stand for.
QUANTITIES = {"A_v": "电压增益", "A_u": "电压增益", "R_i": "输入电阻", "R_o": "输出电阻", "f_L": "下限频率", "f_H": "上限频率", "I_b": "基极电流", "I_c": "集电极电流", "U_o": "输出电压", "U_i": "输入电压"}


def quantities(latex: Column) -> Column:
    """Quantities whose symbol stands in a formula, each once."""
    plain = F.regexp_replace(F.coalesce(latex, F.lit("")), r"[{}]", "")
    found = F.array(*[F.when(F.contains(plain, F.lit(k)), F.lit(v)) for k, v in QUANTITIES.items()])
    return F.array_distinct(F.array_compact(found))

#: Signs of formulas without blanks, braces and underscores, and the concepts they define.
SIGNS = {"静态工作点": ("ibq", "icq", "ubeq", "uceq"), "电流放大": ("beta", "β"), "直流电源": ("vcc", "vbb"), "电阻": ("rb", "rc")}


def concepts(text: Column) -> Column:
    """The concepts whose signs stand in a formula."""
    bare = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\\{}_ \t\n]", ""))
    return F.array_compact(F.array(*[F.when(bare.rlike("|".join(signs)), F.lit(name)) for name, signs in SIGNS.items()]))
