"""The trace facade: named, lazily planned and memoised frames."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators.blocks import BLOCK_ROWS, NO_BLOCKS, Blocks, plan_blocks
from spanloom.session import cut_lineage, shared_folder
from spanloom.sources.tables import TraceTables, read_trace_tables

VIEWS: dict[str, Callable[["AgentTrace"], DataFrame]] = {}
_KEPT: set[str] = set()


def view(*, keep: bool = False):
    """Register a function ``(trace) -> DataFrame`` as the frame of its name.

    ``keep`` marks the few frames that several others read.
    """

    def register(build: Callable[["AgentTrace"], DataFrame]):
        VIEWS[build.__name__] = build
        if keep:
            _KEPT.add(build.__name__)
        return build

    return register


class AgentTrace:
    """Analysis of one set of trace tables.

    ``trace["turns"]`` plans a frame once; nothing runs before an action, save
    the tree walks and the kept frames.  A kept frame is written as a table
    below ``store`` (by default in ``spark.checkpoint.dir``) and read back: it
    survives the loss of executors, and later queries prune its columns.
    """

    def __init__(self, tables: TraceTables, *, store: str | None = None, block_rows: int = BLOCK_ROWS):
        self.tables = tables
        self.spark: SparkSession = tables.spark
        self.vendor = tables.vendor
        self.store = store
        self.block_rows = block_rows
        self._frames: dict[str, DataFrame] = {}
        self._blocks: dict[str, Blocks] = {}
        self._rows: int | None = None

    @classmethod
    def read(cls, spark: SparkSession, path: str, **options) -> "AgentTrace":
        return cls(read_trace_tables(spark, path), **options)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._load_modules()
            frame = VIEWS[name](self)
            if name in _KEPT:
                frame = self._keep(name, frame)
            self._frames[name] = frame
        return self._frames[name]

    def override(self, **frames: DataFrame) -> "AgentTrace":
        """Put ready-made frames in place of derived ones."""
        self._frames.update(frames)
        return self

    def _keep(self, name: str, frame: DataFrame) -> DataFrame:
        if self.store is None:
            self.store = f"{shared_folder(self.spark)}/trace-{uuid.uuid4().hex}"
        return cut_lineage(frame, f"{self.store}/{name}")

    def register(self, prefix: str = "", names: tuple[str, ...] | None = None) -> list[str]:
        """Make frames temp views for ``spark.sql``, all of them unless named; returns the names."""
        self._load_modules()
        if names is None:
            self.tables.register(prefix)
        for name in VIEWS if names is None else names:
            self[name].createOrReplaceTempView(prefix + name)
        return sorted(VIEWS if names is None else names)

    # ---------------------------------------------------------- hot-key layout
    def slice_rows(self) -> int:
        if self._rows is None:
            self._rows = self.tables.slice_rows() if self.tables.slice_rows else self.tables["slice"].count()
        return self._rows

    def blocks(self, by: str = "capture_id") -> Blocks:
        """Cut points over starts and ends of all slices, per ``by``.

        ``by`` is ``capture_id``, ``root_capture_id`` or ``""`` for one global
        order.  Small traces are not cut, which costs nothing to find out.
        """
        if by not in self._blocks:
            if self.slice_rows() <= self.block_rows:
                self._blocks[by] = NO_BLOCKS
            else:
                source = self["slices"]
                if by == "root_capture_id":
                    source = source.join(self["capture_hierarchy"], "capture_id")
                ends = source.selectExpr(
                    *([by] if by else []), "inline(array(struct(ts, id), struct(ts + greatest(dur, 0L) as ts, id)))"
                )
                self._blocks[by] = plan_blocks(
                    ends, [by] if by else [], ["ts", "id"], rows=2 * self.slice_rows(), block_rows=self.block_rows
                )
        return self._blocks[by]

    @staticmethod
    def _load_modules() -> None:
        from spanloom.plans import activity, captures, context, models, runtime, sessions, tools, turns  # noqa: F401
