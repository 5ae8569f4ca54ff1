"""Configuration: one frozen value, or the reason of the first rule that fails."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from ..functions.identifiers import is_identifier

DECODERS = ("pgoutput", "pglogical", "wal2json")
TABLE_SET = {"pgoutput": "publication", "pglogical": "replication_sets", "wal2json": "tables"}
#: What a decoder can't do.
LACKING = {"pgoutput": frozenset(), "pglogical": frozenset({"streaming", "messages", "failover"}), "wal2json": frozenset({"streaming", "failover"})}
MIB = 1 << 20


class ConfigError(ValueError):
    """Its text is the reason, from a closed set."""


@dataclass(frozen=True)
class Config:
    slot: str
    sink: Any
    table_set: tuple[str, ...]
    decoder: str = "pgoutput"
    snapshot: str = "none"  # none, full, incremental
    chunk_rows: int = 1000
    max_pending_chunks: int = 4
    max_inflight_lag: int = 64 * MIB
    max_command_retries: int = 5
    failover: bool = False
    messages: bool = False
    allow_keyless_tables: bool = False
    schema_check_interval: int = 30_000
    max_concurrent_txns: int | None = None
    max_spill_bytes: int | None = None
    batch: Mapping[str, int] | None = None
    store: Mapping[str, Any] | None = None
    go_forward_only: bool = False
    extra: Mapping[str, Any] = field(default_factory=dict)


def _whole(value: Any, least: int) -> bool:
    return type(value) is int and value >= least


def _has(sink: Any, *names: str) -> bool:
    return all(callable(getattr(sink, n, None)) for n in names)


def _names(value: Any) -> tuple[str, ...] | None:
    own = [value] if isinstance(value, str) else value
    if not isinstance(own, list | tuple) or not own or not all(is_identifier(p) for x in own for p in str(x).split(".")):
        return None
    return tuple(dict.fromkeys(own))


def _batch(raw: Any, inflight: int) -> Mapping[str, int]:
    own = {"max_transactions": 100, "max_delay_ms": 1000, "max_span": inflight // 4} | (raw if isinstance(raw, Mapping) else {})
    if set(own) != {"max_transactions", "max_delay_ms", "max_span"} or not all(_whole(v, 1) for v in own.values()):
        raise ConfigError("config_invalid")
    return own


def _read_snapshot(raw: Any) -> tuple[str, int, int]:
    if raw in (False, None):
        return "none", 1000, 4
    if raw is True:
        return "full", 1000, 4
    if isinstance(raw, Mapping) and raw.get("mode") == "incremental" and set(raw) <= {"mode", "chunk_rows", "max_pending_chunks"}:
        rows, pending = raw.get("chunk_rows", 1000), raw.get("max_pending_chunks", 4)
        if _whole(rows, 1) and _whole(pending, 1):
            return "incremental", rows, pending
    raise ConfigError("config_invalid")


def from_options(options: Mapping[str, Any]) -> Config:
    """The configuration, checked in a fixed order."""
    raw = dict(options)
    refuse: Callable[[bool, str], None] = lambda bad, reason: (_ for _ in ()).throw(ConfigError(reason)) if bad else None
    decoder = raw.pop("decoder", "pgoutput")
    refuse(decoder not in DECODERS, "config_invalid")
    refuse(any(k in raw for d, k in TABLE_SET.items() if d != decoder), "config_invalid")
    slot, tables = raw.pop("slot", None), _names(raw.pop(TABLE_SET[decoder], None))
    refuse(not is_identifier(slot) or tables is None, "config_invalid")
    only_json = {k: raw.pop(k) for k in ("allow_keyless_tables", "schema_check_interval") if k in raw}
    refuse(bool(only_json) and decoder != "wal2json", "config_invalid")
    keyless, interval = only_json.get("allow_keyless_tables", False), only_json.get("schema_check_interval", 30_000)
    refuse(type(keyless) is not bool or not _whole(interval, 1), "config_invalid")
    flags = {k: raw.pop(k, False) for k in ("failover", "messages", "go_forward_only")}
    refuse(any(type(v) is not bool for v in flags.values()), "config_invalid")
    streaming = raw.pop("streaming", None)
    wanted = {k for k in ("failover", "messages") if flags[k]} | ({"streaming"} if streaming else set())
    refuse(bool(wanted & LACKING[decoder]), "decoder_capability_unsupported")
    inflight, retries = raw.pop("max_inflight_lag", 64 * MIB), raw.pop("max_command_retries", 5)
    refuse(not _whole(inflight, 1) or not _whole(retries, 0), "config_invalid")
    snapshot, rows, pending = _read_snapshot(raw.pop("snapshot", False))
    refuse(flags["go_forward_only"] and snapshot != "none", "conflicting_start_mode")
    sink, store = raw.pop("sink", None), raw.pop("checkpoint_store", None)
    concurrent = spill = None
    if streaming:
        own = streaming if isinstance(streaming, Mapping) else {}
        concurrent, spill = own.get("max_concurrent_txns", 64), own.get("spill")
        refuse(not _whole(concurrent, 1) or not set(own) <= {"max_concurrent_txns", "spill"}, "config_invalid")
        if spill is not None:
            spill = spill.get("max_spill_bytes", 16 * inflight) if isinstance(spill, Mapping) else 16 * inflight
            refuse(not _whole(spill, 1), "config_invalid")
    refuse("batch" in raw, "config_invalid")
    delivery = raw.pop("batch_delivery", None)
    refuse(bool(delivery) and store is not None, "config_invalid")
    batch = None
    if store is not None:
        refuse(not isinstance(store, Mapping) or not is_identifier(store.get("table", "checkpoints")), "config_invalid")
        batch = _batch(store["batch"], inflight) if "batch" in store else None
    elif delivery:
        batch = _batch(delivery, inflight)
        refuse(not _has(sink, "handle_batch"), "batch_unsupported")
    refuse(not _has(sink, "handle_transaction") and not (delivery and _has(sink, "handle_batch")), "invalid_sink")
    refuse(store is None and not _has(sink, "checkpoint"), "invalid_sink")
    refuse(flags["messages"] and not _has(sink, "handle_message"), "messages_unsupported")
    needs = {"none": (), "full": ("handle_snapshot", "handle_snapshot_complete"), "incremental": ("handle_snapshot", "snapshot_progress")}[snapshot]
    refuse(not _has(sink, *needs), "snapshot_unsupported")
    refuse(bool(raw), "config_invalid")
    return Config(slot, sink, tables, decoder, snapshot, rows, pending, inflight, retries, flags["failover"], flags["messages"], keyless, interval, concurrent, spill, batch, store, flags["go_forward_only"])


def guard_start(kind: str, checkpoint: str, config: Config) -> None:
    """A mirror that starts from nothing, without a snapshot, must be told so. An unreadable checkpoint passes."""
    if kind == "state_mirror" and checkpoint == "empty" and config.snapshot == "none" and not config.go_forward_only:
        raise ConfigError("go_forward_required")
