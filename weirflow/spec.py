"""Declarative reads: what to read, as a value that can be stored, compared and compiled."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")


def identifier(name: str) -> str:
    """The name, if it is one: letters, digits, underscores and dots."""
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def order_terms(order: Sequence[str] | str | None) -> tuple[tuple[str, bool], ...]:
    """(column, ascending) pairs; ``-name`` is descending, blank terms are skipped."""
    terms = [order] if isinstance(order, str) else list(order or ())
    out = []
    for t in (t.strip() for t in terms if t and t.strip() not in ("", "-")):
        out.append((identifier(t.lstrip("-")), not t.startswith("-")))
    return tuple(out)


@dataclass(frozen=True)
class QuerySpec:
    """A table or a raw query, with fields, filters, order, limit and offset.

    Negative limits and offsets count as zero.
    """

    table: str | None = None
    fields: tuple[str, ...] = ()
    filters: Mapping[str, Any] = field(default_factory=dict)
    order: tuple[str, ...] = ()
    limit: int | None = None
    offset: int | None = None
    query: str | None = None
    params: tuple = ()

    def __post_init__(self) -> None:
        if (self.table is None) == (self.query is None):
            raise ValueError("give a table or a query, not both")
        if self.table is not None:
            identifier(self.table)
        for f in self.fields:
            identifier(f)
        order_terms(self.order)
        for name in ("limit", "offset"):
            value = getattr(self, name)
            if value is not None:
                object.__setattr__(self, name, max(int(value), 0))
        object.__setattr__(self, "fields", tuple(self.fields))
        object.__setattr__(self, "order", (self.order,) if isinstance(self.order, str) else tuple(self.order))
        object.__setattr__(self, "params", tuple(self.params))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=str)

    @classmethod
    def from_json(cls, text: str) -> QuerySpec:
        got = json.loads(text)
        subs = {k: [cls(**s) if isinstance(s, dict) else s for s in (v if isinstance(v, list) else [v])] if k.endswith("_subquery") else v for k, v in got["filters"].items()}
        return cls(**got | {"filters": subs})
