"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(df: DataFrame, path: str, *, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    """Write a result as ``parquet``, ``json``, ``csv`` (with a header) or ``orc``.

    Files are written by the tasks that hold the rows; nothing is gathered.
    """
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def markdown_table(df: DataFrame, limit: int | None = None) -> str:
    """A report as Markdown text, all rows unless a ``limit`` is given.

    A report is read by people: its text is built on the driver, partition by
    partition.  Results of any size go through :func:`write_results`.
    """
    rows = (df if limit is None else df.limit(limit)).toLocalIterator()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("Unavailable" if v is None else str(v) for v in row) + " |" for row in rows]
    return "\n".join(lines)
