"""Circuits described as components and nets: roles, labels, netlists, plausibility.

Columns hold components as array<struct<id,type,terminals>> and nets as array<struct<id,terminals>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the first letters of a symbol stand for, and the letter of its netlist line.
ROLES = {"RV": "可调电阻", "TP": "测试点", "R": "电阻", "C": "电容", "L": "电感", "D": "二极管", "Q": "三极管", "T": "三极管", "M": "场效应管", "U": "集成电路", "V": "电压源", "I": "电流源", "K": "继电器", "F": "保险丝"}
PREFIXES = {"resistor": "R", "capacitor": "C", "inductor": "L", "diode": "D", "bjt": "Q", "transistor": "Q", "mosfet": "M", "opamp": "U", "voltage_source": "V", "current_source": "I", "switch": "S"}
LEAST_CONFIDENCE, LEAST_PARTS = 0.7, 2


def canonical_symbol(symbol: Column) -> Column:
    """A symbol without subscript marks, blanks and braces, in upper case."""
    return F.upper(F.regexp_replace(symbol, r"[_{}$\s\\]", ""))


def role(symbol: Column, kind: Column) -> Column:
    """What a component is by its symbol, else by its kind, else an unknown part."""
    letters = F.regexp_extract(canonical_symbol(symbol), r"^([A-Z]{1,2})", 1)
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(table[letters], table[F.substring(letters, 1, 1)], F.nullif(F.trim(kind), F.lit("")), F.lit("元件"))


def label(symbol: Column, kind: Column) -> Column:
    """Role and symbol."""
    return F.concat_ws(" ", role(symbol, kind), F.nullif(F.trim(symbol), F.lit("")))


def netlist(components: Column) -> Column:
    """One line per component: prefixed symbol, its terminals (UNKNOWN where none is given), its type."""
    table = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])

    def line(c: Column) -> Column:
        prefix = F.coalesce(table[F.lower(c["type"])], F.lit("X"))
        name = F.when(F.startswith(F.upper(c["id"]), prefix), c["id"]).otherwise(F.concat(prefix, F.lit("_"), c["id"]))
        ends = F.when(F.coalesce(F.size(c["terminals"]), F.lit(0)) > 0, F.array_join(c["terminals"], " ", "UNKNOWN")).otherwise(F.lit("UNKNOWN UNKNOWN"))
        return F.concat_ws(" ", name, ends, F.coalesce(c["type"], F.lit("part")))

    return F.array_join(F.transform(F.coalesce(components, F.array()), line), "\n")


def shared_terminal(components: Column) -> Column:
    """Whether some terminal is named by two components."""
    ends = F.flatten(F.transform(components, lambda c: F.array_distinct(F.coalesce(c["terminals"], F.array().cast("array<string>")))))
    return F.coalesce(F.size(ends) > F.size(F.array_distinct(ends)), F.lit(False))


def is_circuit(components: Column, confidence: Column, words: Column) -> Column:
    """Whether a description is a circuit: two components, enough confidence, and a shared terminal or words that say so."""
    says = F.coalesce(words.rlike("电路|等效模型|通路|circuit|schematic"), F.lit(False)) & ~F.coalesce(words.rlike("不是电路|not a circuit|block diagram|方框图"), F.lit(False))
    return (F.coalesce(F.size(components), F.lit(0)) >= LEAST_PARTS) & (F.coalesce(confidence, F.lit(0.0)) >= LEAST_CONFIDENCE) & (shared_terminal(components) | says)
