"""Progress of a backfill as a value."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

VERSION = 1


@dataclass(frozen=True)
class Progress:
    floor_lsn: int
    pending: tuple[str, ...]
    current: str | None = None
    bound: tuple[str, ...] | None = None
    done: tuple[str, ...] = ()

    @classmethod
    def new(cls, floor_lsn: int, tables: Sequence[str], keyless: Sequence[str] = ()) -> Progress:
        """Tables with keys come before those without."""
        return cls(floor_lsn, tuple(sorted(tables, key=lambda t: t in set(keyless))))

    @property
    def complete(self) -> bool:
        return self.current is None and not self.pending

    @property
    def tables(self) -> frozenset[str]:
        return frozenset([*self.done, *self.pending, *([self.current] if self.current else [])])

    def next_table(self) -> Progress:
        return self if self.current or not self.pending else replace(self, current=self.pending[0], pending=self.pending[1:], bound=None)

    def advance(self, bound: Sequence[str]) -> Progress:
        return replace(self, bound=tuple(bound))

    def redo(self) -> Progress:
        return replace(self, bound=None)

    def finish(self) -> Progress:
        return replace(self, current=None, bound=None, done=(*self.done, self.current)) if self.current else self

    def resume(self, present: Sequence[str]) -> Progress:
        """Against the tables found now: what is gone is skipped, what is new waits."""
        there = [t for t in present if t not in self.tables]
        keep = lambda own: tuple(t for t in own if t in set(present))
        current = self.current if self.current in set(present) else None
        return replace(self, pending=(*keep(self.pending), *there), done=keep(self.done), current=current, bound=self.bound if current else None)

    def encode(self) -> str:
        return json.dumps({"version": VERSION, **asdict(self)}, sort_keys=True)

    @classmethod
    def decode(cls, token: str) -> Progress:
        """ValueError('progress_invalid') for anything that encode() does not make."""
        try:
            raw = json.loads(token)
            strings = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
            if set(raw) != {"version", "floor_lsn", "pending", "current", "bound", "done"} or raw["version"] != VERSION or type(raw["floor_lsn"]) is not int or raw["floor_lsn"] < 0:
                raise ValueError
            if not (strings(raw["pending"]) and strings(raw["done"]) and (raw["bound"] is None or strings(raw["bound"])) and (raw["current"] is None or isinstance(raw["current"], str))):
                raise ValueError
        except (ValueError, TypeError, AttributeError):
            raise ValueError("progress_invalid") from None
        return cls(raw["floor_lsn"], tuple(raw["pending"]), raw["current"], None if raw["bound"] is None else tuple(raw["bound"]), tuple(raw["done"]))


def stage(progress: Progress | None) -> str:
    if progress is None:
        return "none"
    if progress.complete:
        return "complete"
    return "pending" if progress.current is None and not progress.done else "in_flight"
