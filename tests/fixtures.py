"""Literal traces for tests."""

from __future__ import annotations

from spanloom import schema
from spanloom.plans.trace import AgentTrace
from spanloom.sources.tables import TraceTables

MS = 1_000_000


class Fixture:
    """Builds raw trace tables row by row; capture ``c`` lives on root track ``c``."""

    def __init__(self, spark, vendor: str = "spanloom"):
        self.spark, self.vendor = spark, vendor
        self.rows: dict[str, list] = {name: [] for name in schema.TABLES}
        self._captures: set[int] = set()

    def capture(self, c: int, session: str | None = None, **attrs):
        if c in self._captures:
            return
        self._captures.add(c)
        self.rows["track"].append((c, None, f"{self.vendor}.capture", None, 4096 + c))
        self.rows["track"].append((1000 + c, c, "Agent", None, None))
        self.raw(
            10**6 + c, None, 1000 + c, 0, 0, "tracing", "pi.metadata",
            kind="capture", capture_id=format(4096 + c, "x"), session_id=session or f"session-{c}", **attrs,
        )

    def raw(self, id, parent, track, ts, dur, name, category, **attrs):
        self.rows["slice"].append(
            {"id": id, "parent_id": parent, "track_id": track, "ts": ts, "dur": dur, "name": name, "category": category, "attrs": attrs}
        )

    def add(self, id, kind, start, dur, capture=1, parent=None, name=None, incomplete=False, track=None, **attrs):
        """A slice in milliseconds; ``dur`` below zero is an open slice."""
        self.capture(capture)
        if incomplete:
            attrs["incomplete"] = 1
        self.raw(
            id, parent, track or 1000 + capture, int(start * MS), dur if dur < 0 else int(dur * MS), name or kind, "pi.x",
            kind=kind, **attrs,
        )

    def table(self, name, *rows):
        self.rows[name].extend(rows)

    def trace(self, **options) -> AgentTrace:
        frames = {
            name: self.spark.createDataFrame(rows, schema.struct_type(name)) for name, rows in self.rows.items() if rows
        }
        return AgentTrace(TraceTables(self.spark, frames, self.vendor), **options)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is not None, v) for v in r))
