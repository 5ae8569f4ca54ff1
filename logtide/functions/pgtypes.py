"""Text values to types. Lenient types give null and keep the text aside; strict ones stop the query without the value."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import brace_depth, nested_array

# Fixed values of the server's catalog: object ids of types.
OIDS = {
    16: "bool", 17: "bytea", 18: "char", 19: "name", 20: "int8", 21: "int2", 22: "int2vector", 23: "int4", 24: "regproc",
    25: "text", 26: "oid", 27: "tid", 28: "xid", 29: "cid", 30: "oidvector", 114: "json", 142: "xml", 199: "_json", 600: "point",
    601: "lseg", 602: "path", 603: "box", 604: "polygon", 628: "line", 650: "cidr", 700: "float4", 701: "float8", 718: "circle",
    774: "macaddr8", 790: "money", 791: "_money", 829: "macaddr", 869: "inet", 1000: "_bool", 1001: "_bytea", 1002: "_char",
    1003: "_name", 1005: "_int2", 1006: "_int2vector", 1007: "_int4", 1009: "_text", 1014: "_bpchar", 1015: "_varchar",
    1016: "_int8", 1021: "_float4", 1022: "_float8", 1028: "_oid", 1040: "_macaddr", 1041: "_inet", 1042: "bpchar",
    1043: "varchar", 1082: "date", 1083: "time", 1114: "timestamp", 1115: "_timestamp", 1182: "_date", 1183: "_time",
    1184: "timestamptz", 1185: "_timestamptz", 1186: "interval", 1187: "_interval", 1231: "_numeric", 1266: "timetz",
    1270: "_timetz", 1560: "bit", 1562: "varbit", 1700: "numeric", 2950: "uuid", 2951: "_uuid", 3220: "pg_lsn",
    3614: "tsvector", 3615: "tsquery", 3802: "jsonb", 3807: "_jsonb",
}
NUMERIC_DEFAULT = "decimal(38,18)"
STRICT = {"numeric", "decimal", "bytea", "_numeric", "_decimal", "_bytea"}
MONEY = r"\A-?\$?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?\z"
SPECIAL = r"\A(?:NaN|-?Infinity)\z"
_ELEMENTS = {"int2": "bigint", "int4": "bigint", "int8": "bigint", "float4": "double", "float8": "double", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "date": "date", "money": "decimal(38,18)", "numeric": NUMERIC_DEFAULT, "decimal": NUMERIC_DEFAULT, "bool": "boolean"}


def type_name(oid: Column) -> Column:
    """The name of an object id; an unknown id as its digits."""
    names = F.create_map(*(F.lit(x) for pair in OIDS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, oid.cast("int")), oid.cast("string"))


def decimal_of(typmod: int | None) -> str:
    """The decimal type of a numeric type modifier; the default where none fits."""
    if typmod is None or typmod < 4:
        return NUMERIC_DEFAULT
    precision, scale = (typmod - 4) >> 16, (typmod - 4) & 0xFFFF
    return f"decimal({precision},{scale})" if scale <= precision <= 38 else NUMERIC_DEFAULT


def typmod(formatted: Column) -> Column:
    """The type modifier of a formatted type: numeric packs precision and scale, lengths add 4, arrays and the rest have none."""
    number = lambda pattern, group: F.regexp_extract(formatted, pattern, group).try_cast("int")
    numeric, text, other = r"^(?:numeric|decimal)\((\d+)(?:,(\d+))?\)$", r"^(?:character varying|varchar|character|char|bpchar)\((\d+)\)$", r"^[a-z ]+\((\d+)\)"
    return (
        F.when(formatted.endswith("]"), F.lit(-1))
        .when(formatted.rlike(numeric), F.shiftleft(number(numeric, 1), 16) + F.coalesce(number(numeric, 2), F.lit(0)) + 4)
        .when(formatted.rlike(text), number(text, 1) + 4)
        .when(formatted.rlike(other), number(other, 1))
        .otherwise(F.lit(-1))
    )


def _stop() -> Column:
    return F.raise_error(F.lit("decode_failure"))


def cast_expr(text: Column, kind: str, modifier: int | None = None) -> Column:
    """The typed value of a column's text. Null text is null; a lenient failure is null too.

    An array type is a name with _ before it, and :2 and so on behind it for more
    than one dimension. A literal of other dimensions is no failure, but null.
    """
    if kind.startswith("_"):
        name, _, depth = kind.partition(":")
        return _array(text, name, int(depth or 1))
    if kind == "bool":
        return F.when(text.isin("t", "true"), True).when(text.isin("f", "false"), False)
    if kind in ("int2", "int4", "int8"):
        return F.coalesce(text.try_cast("bigint"), F.regexp_extract(text, r"^[+-]?\d+", 0).try_cast("bigint"))
    if kind in ("float4", "float8"):
        return F.coalesce(text.try_cast("double"), F.regexp_extract(text, r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", 0).try_cast("double"))
    if kind in ("numeric", "decimal"):
        target = decimal_of(modifier)
        scale = int(target.rstrip(")").split(",")[1])
        exact = text.try_cast(target)
        surplus = F.length(F.regexp_extract(text, r"\.(\d*?)0*$", 1)) > scale
        number = text.rlike(r"\A[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\z")
        return F.when(number & ~surplus, exact).when(text.isNull() | number | text.rlike(SPECIAL), F.lit(None).cast(target)).otherwise(_stop().cast(target))
    if kind == "timestamp":
        return text.try_cast("timestamp_ntz")
    if kind == "timestamptz":
        return text.try_cast("timestamp")
    if kind == "date":
        return text.try_cast("date")
    if kind in ("json", "jsonb"):
        return F.try_parse_json(text)
    if kind == "money":
        return F.when(text.rlike(MONEY), F.regexp_replace(text, "[$,]", "").try_cast("decimal(38,18)"))
    if kind == "bytea":
        body = F.try_to_binary(F.substring(text, 3, 1 << 30), F.lit("hex"))
        return F.when(text.startswith("\\x"), F.when(body.isNull(), _stop().cast("binary")).otherwise(body))
    return text


def _array(text: Column, kind: str, depth: int) -> Column:
    elements = F.when(brace_depth(text) == depth, nested_array(text, "string", depth))

    def typed(values: Column, level: int) -> Column:
        return F.transform(values, lambda v: typed(v, level - 1)) if level else cast_expr(values, kind[1:])

    def lost(values: Column, own: Column, level: int) -> Column:
        """Whether a text has no value."""
        return F.exists(F.arrays_zip(values.alias("t"), own.alias("v")), lambda p: lost(p["t"], p["v"], level - 1)) if level else values.isNotNull() & own.isNull()

    out = typed(elements, depth)
    if kind in STRICT:
        broken = text.isNotNull() & brace_depth(text).isNull()
        return F.when(broken | ((brace_depth(text) == depth) & elements.isNull()), _stop().cast(typed_name(f"{kind}:{depth}"))).otherwise(out)
    return F.when(~lost(elements, out, depth), out)


def typed_name(kind: str) -> str:
    """The Spark type of a type name."""
    if kind.startswith("_"):
        name, _, depth = kind.partition(":")
        element = "binary" if name == "_bytea" else _ELEMENTS.get(name[1:], "string")
        return "array<" * int(depth or 1) + element + ">" * int(depth or 1)
    if kind in ("json", "jsonb"):
        return "variant"
    return {"bool": "boolean", "bytea": "binary"}.get(kind, _ELEMENTS.get(kind, "string"))


def cast_columns(df: DataFrame, kinds: Mapping[str, str], fallback: str = "_cast_fallback") -> DataFrame:
    """df with its text columns typed, and a map of the texts that a lenient type refused."""
    typed = {name: cast_expr(F.col(name), kind) for name, kind in kinds.items()}
    refused = F.map_filter(F.create_map(*(x for name in kinds for x in (F.lit(name), F.when(typed[name].isNull(), F.col(name))))), lambda _, v: v.isNotNull()) if kinds else F.create_map().cast("map<string,string>")
    return df.select(*(typed[c].alias(c) if c in typed else F.col(c) for c in df.columns), refused.alias(fallback))


def commit_time(micros: Column) -> Column:
    """Microseconds since 2000-01-01 as a timestamp."""
    return F.timestamp_micros(micros + F.lit(946_684_800_000_000))


def identity_name(letter: Column) -> Column:
    return F.when(letter == "d", "default").when(letter == "n", "nothing").when(letter == "f", "all_columns").when(letter == "i", "index")
