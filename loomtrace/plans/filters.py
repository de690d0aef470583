"""Filters of the search API: lists of allowed values, a range of dates, a folder, and a call that must be absent.

Everything becomes one condition on the events and one on the sessions, so that Catalyst can push the first into the
scan and plan the second as a semi-join.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains
from ..model import Store
from .compiler import with_call_facts

#: Names of list filters, the column each one reads, and the name of a single value.
LISTS = {"source_ids": "source_id", "harnesses": "harness", "session_ids": "session_id", "run_ids": "run_id", "kinds": "kind", "roles": "role", "statuses": "status", "action_kinds": "action_of", "tool_names": "tool_of"}
SINGLE = {"source_id": "source_ids", "harness": "harnesses", "session_id": "session_ids", "run_id": "run_ids", "kind": "kinds", "role": "roles", "status": "statuses", "action_kind": "action_kinds", "tool_name": "tool_names"}


@dataclass(frozen=True)
class Filters:
    """What a search is limited to.  Dates are exclusive; a result has its call's tool and action; an empty list and None
    limit nothing."""

    source_ids: tuple[str, ...] = ()
    harnesses: tuple[str, ...] = ()
    session_ids: tuple[str, ...] = ()
    run_ids: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    action_kinds: tuple[str, ...] = ()
    tool_names: tuple[str, ...] = ()
    after: datetime | None = None
    before: datetime | None = None
    cwd: str | None = None
    without_call: str | None = None

    @classmethod
    def of(cls, **options) -> Filters:
        """From keywords: ``kind="tool_call"``, ``statuses=["failure"]``; an unknown name is an error."""
        known, out = {f.name for f in fields(cls)}, {}
        for name, value in options.items():
            full = SINGLE.get(name, name)
            if full not in known:
                raise TypeError(f"Unknown search filter: {name}")
            out[full] = (value,) if full in LISTS and isinstance(value, str) else tuple(value) if full in LISTS else value
        return cls(**out)

    def _listed(self, only: tuple[str, ...], names: dict[str, str]) -> list[Column]:
        return [F.coalesce(F.col(names.get(n, LISTS[n])).isin(*getattr(self, n)), F.lit(False)) for n in only if getattr(self, n)]

    def sessions(self, store: Store) -> DataFrame:
        """The sessions that the filters leave."""
        keep = self._listed(("source_ids", "harnesses", "session_ids"), {"session_ids": "id"})
        if self.after is not None:
            keep.append(F.col("started_at") > F.lit(self.after))
        if self.before is not None:
            keep.append(F.col("started_at") < F.lit(self.before))
        if self.cwd is not None:
            folder = self.cwd.rstrip("/")
            keep.append((F.col("cwd") == (folder or "/")) | F.startswith("cwd", F.lit(f"{folder}/")))
        out = store.sessions.where(reduce(Column.__and__, keep)) if keep else store.sessions
        if self.without_call:
            called = store.events.where((F.col("kind") == "tool_call") & F.contains(F.lower("text"), F.lit(self.without_call.lower())))
            out = out.join(called.select(F.col("session_id").alias("id")).distinct(), "id", "left_anti")
        return out

    def events(self, store: Store) -> DataFrame:
        """The events that the filters leave."""
        linked = self.tool_names or self.action_kinds
        rows = with_call_facts(store.events) if linked else store.events
        if keep := self._listed(tuple(LISTS), {}):
            rows = rows.where(reduce(Column.__and__, keep))
        if self.after is not None or self.before is not None:
            dated = Filters(after=self.after, before=self.before).sessions(store)
            rows = rows.join(dated.select(F.col("id").alias("session_id")), "session_id", "left_semi")
        return rows.select(store.events.columns)


def search(store: Store, text: str | None = None, *, ids: DataFrame | None = None, sensitive: bool = False, **options) -> DataFrame:
    """Events that the filters leave and whose text holds ``text``; ``ids`` (id) limits a search to what was found before.
    Nothing runs until the result is read."""
    found = Filters.of(**options).events(store)
    if text:
        found = found.where(contains(F.col("text"), text, sensitive))
    return found if ids is None else found.join(ids.select("id").distinct(), "id", "left_semi")


def listing(sessions: DataFrame, *, limit: int = 100, offset: int = 0) -> DataFrame:
    """Sessions by their end, those without one first, then by id; a page of them."""
    return sessions.orderBy(F.coalesce(F.col("ended_at").cast("string"), F.lit("")), "id").offset(offset).limit(limit)
