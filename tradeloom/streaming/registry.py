"""Schemas of stream records: registration, lookup and the backward check."""

from __future__ import annotations

from typing import Any

#: The two versions of the trade event (fixed values of the wire format).
_FIELDS_V1 = [("trade_id", "long"), ("symbol", "string"), ("price", "double"), ("quantity", "double"), ("quote_quantity", "double"), ("trade_timestamp", "long"), ("is_buyer_maker", "boolean")]
TRADE_V1 = {"type": "record", "name": "TradeEvent", "fields": [{"name": n, "type": t} for n, t in _FIELDS_V1]}
TRADE_V2 = {**TRADE_V1, "fields": [*TRADE_V1["fields"], {"name": "trade_type", "type": ["string", "null"], "default": "MARKET"}]}
SUBJECT = "market.trades-value"


class IncompatibleSchema(ValueError):
    """A reader's field that old records lack has no default."""


def check_backward(reader: dict[str, Any], writer: dict[str, Any]) -> None:
    """A reader must find each of its fields in the writer's schema or have a default for it."""
    have = {f["name"] for f in writer["fields"]}
    lost = [f["name"] for f in reader["fields"] if f["name"] not in have and "default" not in f]
    if lost:
        raise IncompatibleSchema(f"no default for {', '.join(lost)}")


class Registry:
    def __init__(self, preload: bool = True) -> None:
        self.by_id: dict[int, dict[str, Any]] = {}
        self.subjects: dict[str, list[int]] = {}
        if preload:
            self.register(SUBJECT, TRADE_V1)
            self.register(SUBJECT, TRADE_V2)

    def register(self, subject: str, schema: dict[str, Any]) -> int:
        """Id of the schema: the one it has, or a new one after the backward check against the latest."""
        for i in self.subjects.get(subject, []):
            if self.by_id[i] == schema:
                return i
        if self.subjects.get(subject):
            check_backward(schema, self.latest(subject)[1])
        new = max(self.by_id, default=0) + 1
        self.by_id[new] = schema
        self.subjects.setdefault(subject, []).append(new)
        return new

    def latest(self, subject: str) -> tuple[int, dict[str, Any]]:
        i = self.subjects[subject][-1]
        return i, self.by_id[i]
