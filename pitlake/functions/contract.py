"""The feature contract: a named function from a context to a column, registered by a decorator.

The context hands out windows that never hold the current row or anything after it. Rows of one second have no order in
a RANGE window, so they don't see each other there; in `history` and `ordered` they are ordered by `TIE_BREAK`, so a run
can be repeated.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

EVENT_TIME = "_event_unix"
TIE_BREAK = "transaction_id"


def window_label(seconds: int) -> str:
    """3600 -> 1h, 300 -> 5min, 90 -> 90s"""
    for unit, n in (("h", 3600), ("min", 60)):
        if seconds % n == 0:
            return f"{seconds // n}{unit}"
    return f"{seconds}s"


def first_seen(column: str) -> str:
    """The helper column that marks the first row of an entity with this value of `column`."""
    return f"_first_{column}"


@dataclass(frozen=True)
class Ctx:
    """What a feature function sees."""

    entity: str = "customer_id"
    window_seconds: int | None = None
    cells: tuple[str, ...] = ()  # further keys of the windows, where rows have been dealt by time too

    @property
    def _by(self) -> WindowSpec:
        return Window.partitionBy(self.entity, *self.cells)

    @property
    def ordered(self) -> WindowSpec:
        """Partitioned and ordered, without a frame: for lag."""
        return self._by.orderBy(EVENT_TIME, TIE_BREAK)

    @property
    def history(self) -> WindowSpec:
        """All earlier rows."""
        return self.ordered.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def window(self) -> WindowSpec:
        """The last `window_seconds` seconds before this second; all earlier rows without a window."""
        if self.window_seconds is None:
            return self.history
        return self._by.orderBy(EVENT_TIME).rangeBetween(-self.window_seconds, -1)

    def col(self, name: str) -> Column:
        return F.col(name)

    def is_first(self, column: str) -> Column:
        """Whether the entity shows this value for the first time; the feature must name the column in `first_seen`."""
        return F.col(first_seen(column))


@dataclass(frozen=True)
class Probe(Ctx):
    """Notes what a feature function asks for."""

    asked: set[str] = field(default_factory=set)

    def _note(self, what: str) -> None:
        self.asked.add(what)

    @property
    def ordered(self) -> WindowSpec:
        self._note("history")
        return Ctx.ordered.fget(self)

    @property
    def history(self) -> WindowSpec:
        self._note("history")
        return Ctx.history.fget(self)

    def is_first(self, column: str) -> Column:
        self._note("history")
        return super().is_first(column)


FeatureFn = Callable[[Ctx], Column]


@dataclass(frozen=True)
class FeatureDef:
    name: str
    tier: str
    owner: str | None
    entity: str
    window_seconds: int | None
    description: str
    fn: FeatureFn
    first_seen: tuple[str, ...] = ()

    def column(self, entity: str | None = None, cells: tuple[str, ...] = ()) -> Column:
        return self.fn(Ctx(entity or self.entity, self.window_seconds, cells))

    def asks(self) -> tuple[set[str], set[str]]:
        """What the function uses besides its window (`history` or nothing), and the words of its expression."""
        probe = Probe(self.entity, self.window_seconds)
        words = set(re.findall(r"\w+", str(self.fn(probe))))
        return probe.asked, words


@dataclass
class Registry:
    defs: list[FeatureDef] = field(default_factory=list)
    reserved: frozenset[str] = frozenset()

    def add(self, d: FeatureDef) -> None:
        """A function registered again from the same module replaces its definition (a reload); another one must not take its name."""
        for k, old in enumerate(self.defs):
            if old.name == d.name:
                if (old.fn.__module__, old.fn.__qualname__) != (d.fn.__module__, d.fn.__qualname__):
                    raise ValueError(f"feature {d.name} is registered already")
                self.defs[k] = d
                return
        if d.name in self.reserved:
            raise ValueError(f"feature {d.name} has the name of a base column")
        self.defs.append(d)

    def registered(self, tier: str | None = None, owner: str | None = None) -> list[FeatureDef]:
        """In the order of registration."""
        return [d for d in self.defs if (tier is None or d.tier == tier) and (owner is None or d.owner == owner)]

    def owners(self) -> list[str]:
        return sorted({d.owner for d in self.defs if d.owner})


BASE_COLUMNS = frozenset({"transaction_id", "event_timestamp", "event_date", "customer_id", "merchant_id", "card_id", "amount", "currency", "channel", "country", "device_id", "is_fraud", "fraud_type", "label_timestamp", "home_country", "signup_date", "account_tier", "age_band", "merchant_category", "risk_band", "label_known", "is_trainable"})
REGISTRY = Registry(reserved=BASE_COLUMNS)


def feature(*, tier: str = "model", owner: str | None = None, entity: str = "customer_id", window: int | None = None, windows: Sequence[int] | None = None, name: str | None = None, description: str = "", first_seen: Sequence[str] = (), registry: Registry | None = None) -> Callable[[FeatureFn], FeatureFn]:
    """Register a feature; with `windows`, one per window, named after it."""
    if window is not None and windows is not None:
        raise ValueError("give window or windows, not both")
    if tier not in ("shared", "model"):
        raise ValueError(f"tier must be shared or model, not {tier!r}")
    if tier == "model" and not owner:
        raise ValueError("a model feature has an owner")
    if windows is not None and not windows:
        raise ValueError("windows is empty")
    if any(w is not None and w <= 0 for w in (*(windows or ()), window)):
        raise ValueError("a window has a positive number of seconds")

    into = REGISTRY if registry is None else registry

    def definition(fn: FeatureFn, seconds: int | None, label: str) -> FeatureDef:
        doc = inspect.getdoc(fn) or ""
        return FeatureDef(name=(name or fn.__name__) + label, tier=tier, owner=owner, entity=entity, window_seconds=seconds, description=description or doc.partition("\n")[0], fn=fn, first_seen=tuple(first_seen))

    def register(fn: FeatureFn) -> FeatureFn:
        if windows is None:
            into.add(definition(fn, window, ""))
        for seconds in windows or ():
            into.add(definition(fn, seconds, f"_{window_label(seconds)}"))
        return fn

    return register


def registered(tier: str | None = None, owner: str | None = None) -> list[FeatureDef]:
    return REGISTRY.registered(tier, owner)
