"""Array literals: nested braces, quoted elements, NULL."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quoted element, a bare one, or a mark; one step of the scanner each.
_LEXEME = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)"|([^{}",\\]+)|([{},])', re.DOTALL)
_ESCAPE = re.compile(r'\\(["\\])')


def parse_array(text: str) -> list:
    """Nested lists of strings and None. ValueError for what is no literal; text after the closing brace doesn't matter."""
    if not text.startswith("{"):
        raise ValueError("array_literal")
    stack: list[list] = []
    at, expect = 0, "value"  # value: an element must come; either: or the brace may close; mark: a comma or a brace
    while True:
        m = _LEXEME.match(text, at)
        if m is None:
            raise ValueError("array_literal")
        at = m.end()
        quoted, bare, mark = m.groups()
        if mark == "{":
            if stack and expect == "mark":
                raise ValueError("array_literal")
            own: list = []
            if stack:
                stack[-1].append(own)
            stack.append(own)
            expect = "either"
        elif mark == "}":
            if expect == "value":
                raise ValueError("array_literal")
            done = stack.pop()
            if not stack:
                return done
            expect = "mark"
        elif mark == ",":
            if expect != "mark":
                raise ValueError("array_literal")
            expect = "value"
        else:
            if expect == "mark":
                raise ValueError("array_literal")
            if quoted is None:
                stack[-1].append(None if bare == "NULL" else bare)
            else:
                if re.search(r'\\[^"\\]', quoted.replace("\\\\", "")):
                    raise ValueError("array_literal")
                stack[-1].append(_ESCAPE.sub(r"\1", quoted))
            expect = "mark"


def _as_json(literals: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(parse_array(text))
        except (ValueError, IndexError):
            return None

    return literals.map(one)


def array_json(literal: Column) -> Column:
    """The literal as JSON text, or null where it is none."""
    return F.pandas_udf(_as_json, "string")(literal)


def brace_depth(literal: Column) -> Column:
    """The dimensions of a literal by its opening braces; null where it does not begin with one."""
    return F.nullif(F.length(F.regexp_extract(literal, r"\A\{*", 0)), F.lit(0))


def flat_array(literal: Column, kind: str) -> Column:
    """ARRAY<kind> of a flat unquoted literal, in the JVM alone; null elsewhere."""
    flat = literal.rlike(r'\A\{[^{}",\\]+(?:,[^{}",\\]+)*\}\z')
    elements = F.split(F.regexp_replace(literal, r"^\{|\}$", ""), ",")
    typed = F.transform(elements, lambda e: F.when(e != "NULL", e.try_cast(kind)))
    return F.when(literal == "{}", F.array().cast(f"array<{kind}>")).when(flat, typed)


def nested_array(literal: Column, kind: str, depth: int) -> Column:
    """ARRAY<...ARRAY<kind>> of any literal of this depth; null where it is none."""
    as_text = "array<" * depth + "string" + ">" * depth
    typed = "array<" * depth + kind + ">" * depth
    return F.from_json(array_json(literal), as_text).try_cast(typed)
