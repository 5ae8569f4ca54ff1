"""What may become part of a statement or an option, and nothing else."""

from __future__ import annotations

import re

from pyspark.sql import Column

IDENTIFIER = r"[a-z_][a-z0-9_]{0,62}"
SNAPSHOT_NAME = r"[0-9A-Fa-f]+(-[0-9A-Fa-f]+)*"
OPTION_KEY = r'[A-Za-z_][A-Za-z0-9_.\-]*|"[A-Za-z_][A-Za-z0-9_.\-]*"'
OPTION_VALUE = r"[A-Za-z0-9_.,:*/\- ]*"


def _ok(pattern: str, text: object) -> bool:
    return isinstance(text, str) and re.fullmatch(pattern, text) is not None


def is_identifier(text: object) -> bool:
    return _ok(IDENTIFIER, text)


def is_snapshot_name(text: object) -> bool:
    return _ok(SNAPSHOT_NAME, text)


def is_option(key: object, value: object) -> bool:
    return _ok(OPTION_KEY, key) and _ok(OPTION_VALUE, value)


def valid_identifier(text: Column) -> Column:
    """As is_identifier; \\z, unlike $, refuses a line feed at the end."""
    return text.rlike(rf"\A(?:{IDENTIFIER})\z")
