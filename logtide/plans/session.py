"""The session beside the log: who the server is, what is said to it, and how its text values read."""

from __future__ import annotations

import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.identifiers import is_identifier, is_option, is_snapshot_name
from ..functions.lsn import parse, show

EPOCH_US = 946_684_800_000_000


@dataclass(frozen=True)
class SessionIdentity:
    system_identifier: str
    timeline: int
    current_lsn: int
    database: str

    @classmethod
    def of(cls, system_identifier: object, timeline: object, current_lsn: object, database: object) -> SessionIdentity:
        """ValueError('invalid_session_identity') for any field out of its bounds."""
        number = lambda v: int(v) if isinstance(v, str) and v.isascii() and v.isdigit() else v if type(v) is int else -1
        try:
            at = parse(current_lsn) if isinstance(current_lsn, str) else -1
        except ValueError:
            at = -1
        fits = isinstance(system_identifier, str) and 0 <= number(system_identifier) < 1 << 64 and 0 <= number(timeline) < 1 << 63
        if not fits or at < 0 or not isinstance(database, str) or not database:
            raise ValueError("invalid_session_identity")
        return cls(system_identifier, number(timeline), at, database)

    def same_server(self, other: SessionIdentity) -> bool:
        return (self.system_identifier, self.database) == (other.system_identifier, other.database)


def _names(*names: str) -> None:
    if not all(is_identifier(n) for n in names):
        raise ValueError("invalid_identifier")


IDENTIFY_SYSTEM = "IDENTIFY_SYSTEM"


def start_command(slot: str, lsn: int, options: Mapping[str, str]) -> str:
    """The command that starts a stream with a plugin's options."""
    _names(slot)
    if not 0 <= lsn < 1 << 64:
        raise ValueError("invalid_start_lsn")
    if not all(is_option(k, v) for k, v in options.items()):
        raise ValueError("invalid_option")
    told = ", ".join(f"{k} '{v}'" for k, v in options.items())
    return f"START_REPLICATION SLOT {slot} LOGICAL {show(lsn)}" + (f" ({told})" if told else "")


def publication_options(publications: Sequence[str], streaming: bool = False, messages: bool = False) -> dict[str, str]:
    _names(*publications)
    version = {"proto_version": "2", "streaming": "on"} if streaming else {"proto_version": "1"}
    return version | {"publication_names": ",".join(publications)} | ({"messages": "true"} if messages else {})


def slot_command(slot: str, plugin: str = "pgoutput", export: bool = False, failover: bool = False, version: int = 150_000) -> str:
    """The command that makes a slot. Before version 15 of the server there is one form, which always exports; version 0 is not known and counts as new for a durable slot."""
    _names(slot, plugin)
    old = version < 150_000 and (export or version > 0)
    word, quoted = ("EXPORT_SNAPSHOT", "export") if export else ("NOEXPORT_SNAPSHOT", "nothing")
    tail = "" if old else f" (FAILOVER, SNAPSHOT '{quoted}')" if failover else f" {word}"
    return f"CREATE_REPLICATION_SLOT {slot} LOGICAL {plugin}{tail};"


def adopt_snapshot(name: str) -> str:
    if not is_snapshot_name(name):
        raise ValueError("invalid_snapshot_name")
    return f"SET TRANSACTION SNAPSHOT '{name}'"


def status_update(lsn: int, now_us: int) -> bytes:
    """34 bytes: a position as written, flushed and applied, the time since 2000, and no wish for a reply."""
    return b"r" + struct.pack(">QQQqB", lsn, lsn, lsn, now_us - EPOCH_US, 0)


def text_bool(value: Column) -> Column:
    return F.when(value == "t", True).when(value == "f", False)


def text_int(value: Column) -> Column:
    return value.try_cast("bigint")
