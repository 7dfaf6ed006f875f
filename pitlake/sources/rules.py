"""The quality policy: a YAML document of row rules, foreign keys, deduplication and batch checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

import yaml


@dataclass(frozen=True)
class RowRule:
    name: str
    expr: str  # any Spark SQL expression; a row is valid where it is true
    reason: str


@dataclass(frozen=True)
class ForeignKey:
    name: str
    column: str
    table: str
    reference: str
    reason: str


@dataclass(frozen=True)
class Dedup:
    key: str
    order_by: str
    keep: str
    reason: str


@dataclass(frozen=True)
class BatchCheck:
    name: str
    metric: str
    severity: str
    min: float | None = None
    max: float | None = None
    column: str | None = None
    columns: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class Policy:
    rows: tuple[RowRule, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    dedup: Dedup | None = None
    checks: tuple[BatchCheck, ...] = field(default=())


DEFAULT = Path(__file__).parent.parent / "config" / "quality_rules.yaml"


def _reason(entry: dict) -> str:
    """A file may say reject_reason or reason; the label is taken as it stands there."""
    return entry["reject_reason"] if "reject_reason" in entry else entry["reason"]


def load_policy(source: str | Path | dict = DEFAULT, now: datetime | None = None) -> Policy:
    """Read a policy; keys may be spelt ref_table, ref_column and reject_reason, or reference_table, reference_column and reason. `:now` in an expression stands for the run's time, so a rule gives the same verdict on a second look."""
    doc = source if isinstance(source, dict) else yaml.safe_load(Path(source).read_text())
    doc = doc or {}
    at = f"TIMESTAMP '{now:%Y-%m-%d %H:%M:%S}'" if now else "current_timestamp()"
    rows = tuple(RowRule(r["name"], r["expr"].replace(":now", at), _reason(r)) for r in doc.get("row_validations") or ())
    keys = tuple(ForeignKey(r["name"], r["column"], r.get("ref_table") or r["reference_table"], r.get("ref_column") or r["reference_column"], _reason(r)) for r in doc.get("referential_checks") or ())
    d = doc.get("deduplication")
    checks = tuple(BatchCheck(c["name"], c["metric"], c.get("severity", "warn"), c.get("min"), c.get("max"), c.get("column"), tuple(c.get("columns") or ()), c.get("description", "")) for c in doc.get("batch_checks") or ())
    for c in checks:
        if c.severity not in ("critical", "warn"):
            raise ValueError(f"check {c.name}: severity must be critical or warn")
    return Policy(rows, keys, Dedup(d["key"], d["order_by"], d.get("keep", "latest"), _reason({"reason": "duplicate"} | d)) if d else None, checks)
