"""What a pipeline does when it connects: a decision table, as a function and as an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (slot, checkpoint, mode, stage, what follows); the first row that fits decides. * fits all.
DECISIONS = [
    ("unpromoted", "*", "*", "*", "halt:slot_synced_unpromoted"),
    ("invalidated", "*", "*", "*", "halt:slot_invalidated"),
    ("absent", "present", "*", "*", "halt:data_gap"),
    ("absent", "fault", "snapshot", "*", "halt:checkpoint_unreadable"),
    ("absent", "fault", "*", "*", "halt:data_gap"),
    ("absent", "empty", "incremental", "in_flight", "halt:data_gap"),
    ("absent", "empty", "incremental", "complete", "halt:data_gap"),
    ("absent", "empty", "incremental", "fault", "halt:progress_invalid"),
    ("absent", "empty", "incremental", "*", "create_slot_and_backfill"),
    ("absent", "empty", "snapshot", "*", "create_exporting_slot"),
    ("absent", "empty", "*", "*", "create_slot"),
    ("present", "*", "incremental", "complete", "stream"),
    ("present", "*", "incremental", "in_flight", "resume_backfill"),
    ("present", "*", "incremental", "pending", "restart_backfill"),
    ("present", "*", "incremental", "fault", "halt:progress_invalid"),
    ("present", "present", "incremental", "none", "stream"),
    ("present", "*", "incremental", "none", "halt:snapshot_incomplete"),
    ("present", "fault", "snapshot", "*", "halt:checkpoint_unreadable"),
    ("present", "empty", "snapshot", "*", "halt:snapshot_incomplete"),
    ("present", "*", "*", "*", "stream"),
]


def decide(slot: str, checkpoint: str, mode: str, stage: str) -> str:
    own = (slot, checkpoint, mode, stage)
    return next(row[4] for row in DECISIONS if all(a in ("*", b) for a, b in zip(row[:4], own, strict=True)))


def decision(slot: Column, checkpoint: Column, mode: Column, stage: Column) -> Column:
    out = None
    for row in DECISIONS:
        fits = F.lit(True)
        for want, own in zip(row[:4], (slot, checkpoint, mode, stage), strict=True):
            if want != "*":
                fits = fits & (own == want)
        out = F.when(fits, row[4]) if out is None else out.when(fits, row[4])
    return out


#: What the server gives as the reason of an invalidation, and the class it stands for. Any other reason is `invalidated`.
REASONS = {"wal_removed": "wal_lost", "rows_removed": "rows_removed", "wal_level_insufficient": "wal_level_insufficient"}


def slot_status(version: Column, wal_status: Column, conflicting: Column, reason: Column) -> Column:
    """ok or a class of invalidation. Lost log comes first, then a conflict, then a reason; older servers tell less."""
    named = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair)), reason), F.lit("invalidated"))
    return (
        F.when(wal_status == "lost", "wal_lost")
        .when((version >= 160000) & F.coalesce(conflicting, F.lit(False)), "conflict")
        .when((version >= 170000) & (F.coalesce(reason, F.lit("")) != ""), named)
        .otherwise("ok")
    )


def retry(permanent: bool, attempts: int, limit: int) -> str:
    """What a failed store call leads to."""
    return "halt" if permanent or attempts > limit else "retry"


class Watchdog:
    """Counts command errors in a row; any frame clears them. Past the limit the pipeline halts."""

    def __init__(self, limit: int):
        self.limit, self.errors = limit, 0

    def error(self) -> str:
        self.errors += 1
        return "halt:command_error" if self.errors > self.limit else "reconnect"

    def frame(self) -> None:
        self.errors = 0


def origin(checkpoint: int | None, confirmed_flush: int | None) -> int | None:
    """Where an append sink's log begins: the later of its checkpoint and what the slot has confirmed."""
    return max((x for x in (checkpoint, confirmed_flush) if x is not None), default=None)
