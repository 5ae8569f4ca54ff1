"""Log positions: 64-bit integers, written as two hexadecimal halves."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF = 1 << 32
_TEXT = re.compile(r"[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}")


def format_lsn(lsn: Column) -> Column:
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(HALF - 1))))


def parse_lsn(text: Column) -> Column:
    """The position, or null where text is no position or is beyond a signed long."""
    half = lambda i: F.conv(F.get(F.split(text, "/"), F.lit(i)), 16, 10).cast("decimal(20,0)")
    whole = half(0) * F.lit(HALF).cast("decimal(20,0)") + half(1)
    return F.when(text.rlike(r"\A[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}\z"), whole.try_cast("bigint"))


def parse(text: str) -> int:
    """The position of a text; ValueError('invalid_lsn') otherwise, without the text."""
    if not _TEXT.fullmatch(text):
        raise ValueError("invalid_lsn")
    high, low = (int(x, 16) for x in text.split("/"))
    return high * HALF + low


def show(lsn: int) -> str:
    return f"{lsn // HALF:X}/{lsn % HALF:X}"
