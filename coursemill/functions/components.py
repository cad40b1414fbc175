"""Components of circuits: what a symbol stands for, how a component is labelled, and its line in a netlist.

Columns hold components as array<struct<id,type,terminals>>.  circuits has an earlier, shorter form of these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a symbol stands for; % is any figures.
SYMBOLS = {
    "rl%": "负载电阻", "rb1": "基极分压电阻", "rb2": "基极分压电阻", "rb%": "基极偏置电阻", "rc%": "集电极电阻", "re%": "发射极电阻", "rs%": "信号源内阻", "rg%": "栅极电阻", "rd%": "漏极电阻",
    "rds%": "漏源等效电阻", "rbe%": "基极-发射极等效电阻", "ri%": "输入电阻", "ro%": "输出电阻", "r0%": "输出电阻", "rf%": "反馈电阻", "ce%": "发射极旁路电容", "cs%": "源极旁路电容", "ci": "输入耦合电容",
    "c1": "输入耦合电容", "co": "输出耦合电容", "c2": "输出耦合电容", "vbb%": "基极偏置电源", "vcc%": "集电极直流电源", "vgg%": "栅极偏置电源", "vdd%": "漏极直流电源", "vee%": "发射极负电源", "vaa%": "直流电源",
    "us%": "输入信号源", "vs%": "输入信号源", "ui%": "输入电压", "vi%": "输入电压", "uo%": "输出电压", "vo%": "输出电压", "dz%": "稳压二极管", "q%": "晶体管", "t%": "晶体管", "m%": "场效应管", "d%": "二极管", "s%": "开关",
}
#: What a kind of component is called.
KINDS = {
    "resistor": "电阻", "capacitor": "电容", "inductor": "电感", "diode": "二极管", "zener": "稳压二极管", "npn": "晶体管", "pnp": "晶体管", "bjt": "晶体管", "bipolar_junction_transistor": "晶体管", "mosfet": "场效应管",
    "vsource": "电压源", "voltage_source": "电压源", "isource": "电流源", "current_source": "电流源", "switch": "开关", "port": "信号端口",
}
#: Roles that stand beside a symbol in a text.
IN_CONTEXT = [
    "基极-发射极等效电阻", "发射极旁路电容", "源极旁路电容", "基极分压电阻", "基极偏置电阻", "集电极直流电源", "基极偏置电源", "栅极偏置电源", "漏极直流电源", "输入耦合电容", "输出耦合电容", "信号源内阻", "集电极电阻",
    "发射极电阻", "负载电阻", "反馈电阻", "输入电阻", "输出电阻", "栅极电阻", "漏极电阻", "晶体管", "场效应管", "稳压二极管", "二极管", "直流电源", "输入信号源",
]
#: The letter of the netlist line of a kind.
PREFIXES = {
    "resistor": "R", "capacitor": "C", "inductor": "L", "diode": "D", "voltage_source": "V", "vsource": "V", "current_source": "I", "isource": "I", "bjt": "Q", "bipolar_junction_transistor": "Q", "npn": "Q", "pnp": "Q", "mosfet": "M",
}
UNKNOWN_ROLE = "电路元件"


def canonical_symbol(symbol: Column) -> Column:
    """A symbol without subscript marks, quotes, hyphens, blanks and braces, in lower case."""
    return F.lower(F.regexp_replace(symbol, r"[ \t\n_{}'’′-]", ""))


def _table(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def role(symbol: Column, kind: Column, explicit: Column | None = None, context: Column | None = None) -> Column:
    """What a component is: by the role it is given, by a role beside its symbol in a text, by its symbol, by its kind.

    A given role counts without the symbol and up to 24 characters.  The longest entry of the tables whose
    figures stand for any wins; a null symbol or kind is an empty one.
    """
    symbol, kind = F.trim(F.coalesce(symbol, F.lit(""))), F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    short = canonical_symbol(symbol)
    stem = F.regexp_extract(short, "^([a-z]+)[0-9]*$", 1)
    exact = _table({k: v for k, v in SYMBOLS.items() if not k.endswith("%")})
    numbered = _table({k[:-1]: v for k, v in SYMBOLS.items() if k.endswith("%")})
    zero = F.when(short.rlike("^r0[0-9]*$"), F.lit(SYMBOLS["r0%"]))
    found = [exact[short], zero, numbered[stem], _table(KINDS)[kind], F.lit(UNKNOWN_ROLE)]
    if context is not None:
        beside = lambda r: F.contains(context, F.concat(F.lit(r), symbol)) | F.contains(context, F.concat(F.lit(r + " "), symbol)) | F.contains(context, F.concat(symbol, F.lit("为" + r))) | F.contains(context, F.concat(symbol, F.lit("是" + r)))
        found.insert(0, F.when(symbol != "", F.coalesce(*[F.when(beside(r), F.lit(r)) for r in IN_CONTEXT])))
    if explicit is not None:
        given = F.trim(F.regexp_replace(F.replace(F.coalesce(explicit, F.lit("")), symbol, F.lit("")), "^[ ：:，,（）()]+|[ ：:，,（）()]+$", ""))
        found.insert(0, F.when((F.length(given) <= 24) & ~F.lower(given).isin("", "null", "none", "unknown", "component", "元件", "器件"), given))
    return F.coalesce(*found)


def label(symbol: Column, kind: Column, explicit: Column | None = None, context: Column | None = None) -> Column:
    """Role and symbol."""
    return F.concat_ws(" ", role(symbol, kind, explicit, context), F.coalesce(F.nullif(F.trim(symbol), F.lit("")), F.lit("未标注")))


def netlist(components: Column) -> Column:
    """One line per component: its name with the letter of its kind before it, its terminals (UNKNOWN_NODE where none is given), and UNKNOWN for its value; ports are comments."""
    table = _table(PREFIXES)

    def line(c: Column, at: Column) -> Column:
        kind, place = F.lower(F.trim(F.coalesce(c["type"], F.lit("")))), (at + 1).cast("string")
        name, prefix = F.trim(F.coalesce(c["id"], F.lit(""))), F.coalesce(table[kind], F.lit("X"))
        nodes = F.filter(F.transform(F.coalesce(c["terminals"], F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
        full = F.when(name == "", F.concat(prefix, place)).when(F.startswith(F.upper(name), prefix), name).otherwise(F.concat(prefix, name))
        port = F.array_join(F.concat(F.array(F.lit("* PORT"), F.when(name == "", place).otherwise(name)), nodes), " ")
        ends = F.when(F.size(nodes) > 0, F.array_join(nodes, " ")).otherwise(F.lit("UNKNOWN_NODE"))
        return F.when(kind == "port", port).otherwise(F.concat_ws(" ", full, ends, F.lit("UNKNOWN")))

    return F.array_join(F.transform(F.coalesce(components, F.array().cast("array<struct<id:string,type:string,terminals:array<string>>>")), line), "\n")
