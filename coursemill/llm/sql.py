"""The consistent form of problem 1 as a SQL expression, made from the same tables, for comparison in another engine."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from coursemill.llm.canonical import mapping


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(1)
def _parts() -> tuple[str, str, str, list[tuple[str, str]]]:
    m = mapping()
    changed = np.flatnonzero((m.single != np.arange(len(m.single))) & ~m.drop & ~m.is_long)
    dropped = np.flatnonzero(m.drop)
    longer = [(chr(p), "".join(map(chr, t.tolist()))) for p, t in m.long.items()]
    return "".join(map(chr, changed)), "".join(chr(int(m.single[p])) for p in changed), "".join(map(chr, dropped)), longer


def canonical_sql(column: str, texts_with: str = "℃℉") -> str:
    """SQL of the consistent form of a column; of the longer targets only those of the given signs are spelt out."""
    source, target, dropped, longer = _parts()
    out = f"translate({column}, {_quoted(source + dropped)}, {_quoted(target)})"
    for sign, text in longer:
        if sign in texts_with:
            out = f"replace({out}, {_quoted(sign)}, {_quoted(text)})"
    return f"nfc_normalize({out})"


def p1_sql() -> str:
    parts = []
    for table, key in (("page_documents", "page_id"), ("text_chunks", "id")):
        parts.append(f"SELECT DISTINCT '{table}' AS tbl, {key} AS k, text, {canonical_sql('text')} AS form FROM {table} WHERE text IS NOT NULL")
    rows = " UNION ALL ".join(parts)
    return f"WITH t AS ({rows}) SELECT DISTINCT a.tbl, a.k AS key_a, b.k AS key_b FROM t a JOIN t b ON a.tbl = b.tbl AND a.form = b.form AND a.text <> b.text AND a.k < b.k"


def p5_sql() -> str:
    form = canonical_sql("line")
    return f"""WITH p AS (SELECT DISTINCT page_id, coalesce(source, '') AS source, text FROM page_documents),
    l AS (SELECT page_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM p),
    f AS (SELECT page_id, source, line_no, regexp_replace(regexp_replace(lower({form}), '[\\s\\x{{3000}}\\x{{2001}}\\x{{2003}}\\x{{85}}\\x{{2028}}\\x{{2029}}]+', '', 'g'), '[0-9]+', '0', 'g') AS line FROM l),
    n AS (SELECT source, line, count(DISTINCT page_id) AS pages FROM f WHERE line <> '' GROUP BY source, line),
    r AS (SELECT n.source, n.line FROM n JOIN (SELECT source, count(DISTINCT page_id) AS of FROM p GROUP BY source) USING (source) WHERE pages >= 4 AND pages * 10 >= of)
    SELECT page_id, line_no::INTEGER AS line_no FROM f JOIN r USING (source, line)"""
