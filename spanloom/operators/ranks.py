"""Exact order statistics per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from spanloom.operators.blocks import BLOCK_ROWS, Run, plan_blocks, running


def median_and_rank(
    df: DataFrame, keys: Sequence[str], value: str, percent: int, *, rows: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``keys, median, ranked``: the mean of the two middle values and the
    value at rank ``ceil(percent / 100 * n)``, over non-null values.

    Small inputs use the built-in exact percentiles.  Those keep one counter per
    distinct value of a group in one task, so when a group may be large the
    distinct values are ranked by an ordered scan that can cut the group.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    if rows <= block_rows:
        return known.groupBy(*keys).agg(
            F.expr(f"percentile_cont(0.5) within group (order by {value}) as median"),
            F.expr(f"percentile_disc({percent / 100}) within group (order by {value}) as ranked"),
        )
    # one struct key: null fields compare equal, also in the carry join
    counts = known.select(F.struct(*keys).alias("_of"), value).groupBy("_of", value).agg(F.count(F.lit(1)).alias("_n"))
    blocks = plan_blocks(counts, ["_of"], [value], rows=rows, block_rows=block_rows)
    ranked = running(counts, ["_of"], [value], {"_to": Run("sum", F.col("_n"))}, blocks)
    sizes = counts.groupBy("_of").agg(F.sum("_n").alias("_size"))
    placed = ranked.join(sizes, "_of").withColumn("_from", F.col("_to") - F.col("_n"))

    def holds(rank: str) -> str:
        return f"max({value}) filter (where _from < {rank} and {rank} <= _to)"

    low, high = "((_size + 1) div 2)", "((_size + 2) div 2)"
    return placed.groupBy("_of").agg(
        F.expr(f"({holds(low)} + {holds(high)}) / 2D as median"),
        F.expr(f"{holds(f'(({percent} * _size + 99) div 100)')} as ranked"),
    ).select("_of.*", "median", "ranked")
