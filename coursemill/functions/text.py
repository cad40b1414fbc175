"""Column functions on text: tokens, normalisation, headings, labels, numbers.

All are built-in expressions that stay in generated code; null in, null out unless said otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words of letters and figures, and single ideographs.
TOKEN = r"[a-z0-9_]+|[一-鿿]"
#: Parts of lines that only advertise.
ADVERTS = ("扫码", "扫描下方二维码", "公众号", "关注", "版权所有", "all rights reserved", "www.", "http")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once a row however often body uses it (the planner would repeat a plain expression)."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column | str) -> Column:
    """Lower-case tokens in order; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def search_text(*parts: Column | str) -> Column:
    """Parts joined by one blank; nulls are passed over."""
    return F.concat_ws(" ", *[_c(p) for p in parts])


@F.pandas_udf(StringType())
def nfkc(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition, which Spark has no built-in for."""
    for batch in values:
        yield batch.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalize_line(line: Column | str, profile: str = "cjk") -> Column:
    """A page line without invisible blanks and addresses, runs of blanks as one; profile cjk also closes gaps between letters, as a scanner leaves in formulas, latin keeps word gaps."""
    out = F.regexp_replace(_c(line), "[\\x{200B}\\x{FEFF}]", "")
    out = F.regexp_replace(out, r"https?://[A-Za-z0-9./?=&_%-]+|www\.[A-Za-z0-9./?=&_%-]+", "")
    if profile == "cjk":
        out = F.regexp_replace(out, r"([A-Za-z])[ \t]+([一-鿿])", "$1$2")
        out = F.regexp_replace(out, r"([一-鿿])[ \t]+([A-Za-z0-9一-鿿])", "$1$2")
    return F.trim(F.regexp_replace(out, r"[ \t\x{3000}\x{A0}]+", " "))


def is_line_noise(line: Column | str) -> Column:
    """Empty lines, bare page numbers, advertisements, and lines with undecodable characters."""
    adverts = "|".join(re.escape(part) for part in ADVERTS)
    return _c(line).rlike(rf"(?i)^$|^[-—·•~\[\] ]*[0-9]{{1,4}}[-—·•~\[\] ]*$|�[^\n]*�|{adverts}")


def chapter_marker(text: Column | str) -> Column:
    """The leading "第N章" or "Chapter N" of a heading, or an empty string."""
    return F.regexp_extract(F.coalesce(_c(text), F.lit("")), r"^(第[0-9一二三四五六七八九十]+章|Chapter [0-9]+)", 1)


def normalize_concept(name: Column | str) -> Column:
    """A concept without a leading section number, trimmed."""
    return F.trim(F.regexp_replace(_c(name), r"^[0-9]+(\.[0-9]+)*[ \t]*", ""))


def meaningful_section(section: Column | str) -> Column:
    """The section without its number where it is a name of at most 60 characters, else an empty string."""
    name = normalize_concept(F.coalesce(_c(section), F.lit("")))
    return F.when((F.length(name) <= 60) & name.rlike("[一-鿿A-Za-z]") & ~name.rlike(r"^[0-9]+ *[-—~] *[0-9]+$"), name).otherwise("")


def comparison_text(text: Column | str) -> Column:
    """Letters, figures and ideographs only, in lower case."""
    return F.regexp_replace(F.lower(_c(text)), r"[^0-9a-z一-鿿]+", "")


def split_tags(text: Column | str) -> Column:
    """Tags of a delimited string, trimmed, empty ones dropped."""
    parts = F.transform(F.split(F.coalesce(_c(text), F.lit("")), r"[,，、;；|]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def contained(names: list[str], text: Column | str, limit: int = 12) -> Column:
    """The names that stand in text, in the order of the list, at most limit."""
    if not names:
        return F.array().cast("array<string>")
    found = lambda hay: F.array_compact(F.array(*[F.when(F.contains(hay, F.lit(n.lower())), F.lit(n)) for n in names]))
    return F.slice(let(F.lower(F.coalesce(_c(text), F.lit(""))), found), 1, limit)


def overlap(query: Column | str, other: Column | str) -> Column:
    """Part of the distinct query tokens that the other tokens hold."""
    q = F.array_distinct(_c(query))
    return F.size(F.array_intersect(q, _c(other))) / F.greatest(F.lit(1), F.size(q))


def canonical_answer(text: Column | str) -> Column:
    """An answer in lower case without blanks, dollar signs, braces and LaTeX spacing."""
    out = F.lower(F.coalesce(_c(text), F.lit("")))
    for a, b in (("\\\\(left|right|,|;|!)", ""), ("ω|\\\\omega", "omega"), ("[ \\t\\n$\\{\\}]", "")):
        out = F.regexp_replace(out, a, b)
    return out


def choice_labels(text: Column | str) -> Column:
    """Sorted distinct option letters of an answer such as "A, C"."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(_c(text), F.lit(""))), F.lit(r"\b([A-H])\b"), F.lit(1))))


def citations(text: Column | str, sources: Column | int) -> Column:
    """Distinct valid source numbers of marks like [2] or [资料2], in order of first use."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"\[(?:资料)?([0-9]{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))
    most = F.lit(sources) if isinstance(sources, int) else sources
    return F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= most)))


def is_truncated(text: Column | str) -> Column:
    """Empty, an odd number of dollar signs, or a trailing operator, command or heading."""
    c = F.rtrim(F.coalesce(_c(text), F.lit("")))
    return (c == "") | (F.regexp_count(c, F.lit(r"\$")) % 2 == 1) | c.rlike(r"([+\-*/=,，、：:]|\\[a-z]+)$") | c.rlike(r"(^|\n)#{1,6} [^\n]*$")


def as_number(text: Column | str, default: float = 0.0) -> Column:
    """A number rounded to two places, or the default."""
    return F.round(F.coalesce(F.expr("try_cast({} as double)".format(text)) if isinstance(text, str) else text.try_cast("double"), F.lit(default)), 2)


def as_flag(text: Column | str) -> Column:
    """Whether a string says yes."""
    return F.coalesce(F.lower(F.trim(_c(text))).isin("true", "1", "yes", "是"), F.lit(False))


def short_hash(*parts: Column | str, size: int = 16) -> Column:
    """The first characters of the SHA-1 of the parts joined by bars; nulls count as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])), 1, size)
