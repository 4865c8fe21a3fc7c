"""Interval algebra: sweeps, unions, islands, bins and as-of joins.

Intervals are half-open ``[start, end)`` with LONG nanosecond bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.operators.blocks import Blocks, Run, plan_blocks, running
from spanloom.session import cut_lineage


def interval_sweep(
    intervals: DataFrame,
    keys: Sequence[str],
    classes: Sequence[str],
    *,
    start: str = "ts",
    end: str = "end_ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Cut time into segments with the concurrency of each class.

    Returns ``keys, ts, dur, <classes>``: from ``ts`` for ``dur`` nanoseconds
    exactly that many intervals of each class are open.  The last segment of a
    key has a null ``dur``.  Coincident starts and ends cancel before counting.
    """
    keys, classes = list(keys), list(classes)
    # both boundaries from one pass over the rows, not from a union of two scans
    edges = F.array(
        F.struct(F.col(start).alias("ts"), *[F.col(c).cast("long").alias(c) for c in classes]),
        F.struct(F.col(end).alias("ts"), *[(-F.col(c).cast("long")).alias(c) for c in classes]),
    )
    if blocks is None:
        blocks = plan_blocks(intervals.select(*keys, F.inline(edges)), keys, ["ts"])
    if keys and not blocks.split:
        # every key is small: one exchange of whole intervals on the key serves the sums and the window
        intervals = intervals.select(*dict.fromkeys([*keys, start, end, *classes])).repartition(*keys)
    # otherwise partial sums meet a hot instant before the exchange
    boundaries = intervals.select(*keys, F.inline(edges))
    deltas = boundaries.groupBy(*keys, "ts").agg(*[F.sum(c).alias(c) for c in classes])
    runs = {"_next": Run("lead", F.col("ts"))}
    runs |= {f"_open_{c}": Run("sum", F.col(c)) for c in classes}
    swept = running(deltas, keys, ["ts"], runs, blocks)
    return swept.select(
        *keys, "ts", (F.col("_next") - F.col("ts")).alias("dur"), *[F.col(f"_open_{c}").alias(c) for c in classes]
    )


def covered(*conditions: Column) -> Column:
    """Sum of ``dur`` over the segments where all conditions hold, 0 if none."""
    hit = conditions[0]
    for c in conditions[1:]:
        hit = hit & c
    return F.sum(F.when(hit, F.col("dur")).otherwise(F.lit(0)))


def interval_union_length(
    intervals: DataFrame, keys: Sequence[str], *, start: str = "ts", end: str = "end_ts", blocks: Blocks | None = None
) -> DataFrame:
    """Length of the union of each key's intervals: ``keys, active_ns, peak``."""
    marked = intervals.filter(F.col(end) > F.col(start)).withColumn("_one", F.lit(1))
    segments = interval_sweep(marked, keys, ["_one"], start=start, end=end, blocks=blocks)
    return segments.groupBy(*keys).agg(
        covered(F.col("_one") > 0).alias("active_ns"),
        F.coalesce(F.max(F.when(F.col("dur") > 0, F.col("_one"))), F.lit(0)).alias("peak"),
    )


def peak_concurrency(
    intervals: DataFrame, keys: Sequence[str], *, start: str = "ts", end: str = "end_ts", blocks: Blocks | None = None
) -> DataFrame:
    """Largest number of intervals open at once, ends before starts at ties."""
    return interval_union_length(intervals, keys, start=start, end=end, blocks=blocks).drop("active_ns")


def islands(
    df: DataFrame,
    keys: Sequence[str],
    *,
    start: str,
    end: str,
    tie: str,
    blocks: Blocks | None = None,
    out: str = "cluster_id",
) -> DataFrame:
    """Number the groups of overlapping rows: a row that starts at or after
    the largest end seen so far opens a new group."""
    if blocks is None:
        blocks = plan_blocks(df, keys, [start, tie])
    seen = running(df, keys, [start, tie], {"_seen_end": Run("max_before", F.col(end))}, blocks)
    opens = (F.col("_seen_end").isNull() | (F.col(start) >= F.col("_seen_end"))).cast("long")
    return running(seen.withColumn("_opens", opens), keys, [start, tie], {out: Run("sum", F.col("_opens"))}, blocks).drop(
        "_seen_end", "_opens"
    )


def bin_edge(start: Column, extent: Column, n: Column, bins: int) -> Column:
    """Left edge of bin ``n`` when ``extent`` is cut into ``bins`` in integers.

    ``extent * n`` stays inside LONG for extents up to about six years.
    """
    return start + integer_div(extent * n, F.lit(bins))


def integer_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def asof_last(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_ts: str,
    right_ts: str,
    right_tie: str,
    value: Column,
    out: str,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Add to each left row the ``value`` of the latest right row of the same
    key with ``right_ts <= left_ts`` (ties: largest ``right_tie``); null if none.

    One union, one shuffle and one sort instead of a range join.  ``left`` needs
    a column ``id`` that makes its order total; ``right_tie`` must be unique.
    The keys stay columns of their own, so grouping the result by them and more
    needs no further shuffle.
    """
    keys = list(keys)
    carried_columns = [c for c in left.columns if c not in keys]
    carried = left.select(
        *keys,
        F.col(left_ts).alias("_ts"),
        F.lit(1).alias("_side"),
        F.col("id").cast("long").alias("_tie"),
        F.struct(*carried_columns).alias("_row"),
    )
    offered = right.select(
        *keys,
        F.col(right_ts).alias("_ts"),
        F.lit(0).alias("_side"),
        F.col(right_tie).cast("long").alias("_tie"),
        F.struct(value.alias("v")).alias("_offer"),
    )
    both = carried.unionByName(offered, allowMissingColumns=True)
    found = running(
        both, keys, ["_ts", "_side", "_tie"], {"_found": Run("last", F.col("_offer"))}, blocks, block_order=["_ts"]
    )
    columns = [F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in left.columns]
    return found.filter("_side = 1").select(*columns, F.col("_found")["v"].alias(out))


def count_overlaps(
    left: DataFrame, right: DataFrame, keys: Sequence[str], *, blocks: Blocks | None = None
) -> DataFrame:
    """For each left interval the number of right intervals of its key that it
    overlaps: ``id, overlaps, only_id``, where ``only_id`` is the right id when
    there is exactly one.

    Both sides have ``id, ts, end_ts`` and the keys.  An instant overlaps an
    interval it lies in and an equal instant.  The count is (rights started
    before the left end) - (rights ended by the left start), and the difference
    of the id sums names a lone partner, so no pair is ever built.
    """
    keys = list(keys)
    # doubled positions give an instant a width of one half step
    opens, closes = "2 * ts", "if(end_ts > ts, 2 * end_ts, 2 * ts + 1)"
    # order at one position: right ends, left start, left end, right starts
    rights = right.selectExpr(
        *keys, "id",
        f"""inline(array(
            struct({closes} as _pos, 0 as _phase, end_ts as _ts, 0L as _started, 1L as _ended),
            struct({opens} as _pos, 3 as _phase, ts as _ts, 1L as _started, 0L as _ended)))""",
    )
    lefts = left.selectExpr(
        *keys, "id",
        f"""inline(array(
            struct({opens} as _pos, 1 as _phase, ts as _ts, 0L as _started, 0L as _ended),
            struct({closes} as _pos, 2 as _phase, end_ts as _ts, 0L as _started, 0L as _ended)))""",
    )
    points = rights.unionByName(lefts)
    wide = "cast(id as decimal(20, 0))"
    totals = running(
        points,
        keys,
        ["_pos", "_phase", "id"],
        {
            "_n_started": Run("sum", F.col("_started")),
            "_n_ended": Run("sum", F.col("_ended")),
            "_id_started": Run("sum", F.expr(f"if(_started = 1, {wide}, 0)")),
            "_id_ended": Run("sum", F.expr(f"if(_ended = 1, {wide}, 0)")),
        },
        blocks,
        block_order=["_ts"],
    )
    at_start, at_end = "filter (where _phase = 1)", "filter (where _phase = 2)"
    return (
        totals.filter("_phase in (1, 2)")
        .groupBy("id")
        .agg(
            F.expr(f"max(_n_started) {at_end} - max(_n_ended) {at_start} as overlaps"),
            F.expr(f"max(_id_started) {at_end} - max(_id_ended) {at_start} as _ids"),
        )
        .selectExpr("id", "overlaps", "if(overlaps = 1, cast(_ids as bigint), null) as only_id")
    )


def _dyadic(lo: str, hi: str) -> str:
    """SQL: the aligned stretches of length 2^k that make up [lo, hi), as (_level, _node); at most two of a length."""
    first, last = f"shiftright({lo} + shiftleft(1L, k) - 1, k)", f"shiftright({hi}, k)"
    return f"""inline(flatten(transform(sequence(0, cast(ceil(log2({hi} - {lo} + 1)) as int)), k -> filter(
        array(named_struct('_level', k, '_node', {first}), named_struct('_level', k, '_node', {last} - 1)),
        (n, i) -> {first} < {last} and if(i = 0, {first} % 2 = 1, {last} % 2 = 1)))))"""


def innermost(
    intervals: DataFrame, keys: Sequence[str], *, group: str, start: str, end: str, id_col: str, blocks: Blocks | None = None
) -> DataFrame:
    """Which interval of a key is the innermost one at every point.

    It must start last and end first among those that contain the point.
    ``group`` numbers sets of overlapping intervals inside a key (see
    :func:`islands`).  Returns ``keys, edge_ts, at, after`` for each instant where
    an interval starts or ends: the smallest and the largest innermost id at the
    instant (one without extent counts there) and in the stretch up to the next
    edge, as an array of ``(low, high)`` structs.

    The edges of a group are numbered; an interval is the sum of aligned
    stretches of 2^k edges, of which a stretch keeps the latest start and the
    earliest end only; an edge then looks at the one stretch of each length around
    it.  So ``n`` intervals make ``n log n`` rows however they nest, and no list of
    members exists.  Intervals, edges and stretches are read several times, so each
    is written once.
    """
    keys = [*keys, group]
    # equal intervals are one, with its smallest and largest id
    rows = intervals.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(id_col).alias("_id"))
    rows = rows.groupBy(*keys, "_s", "_e").agg(F.struct(F.min("_id").alias("low"), F.max("_id").alias("high")).alias("_ids"))
    rows = cut_lineage(rows)
    edges = rows.select(*keys, F.explode(F.array("_s", "_e")).alias("_t")).distinct()
    edges = running(edges, keys, ["_t"], {"_n": Run("row_number")}, blocks, block_order=["_t"]).withColumn("_r", F.col("_n") - 1).drop("_n")
    edges = cut_lineage(edges)
    wide = rows.filter("_e > _s")
    placed = (
        wide.join(edges.withColumnsRenamed({"_t": "_s", "_r": "_lo"}), [*keys, "_s"])
        .join(edges.withColumnsRenamed({"_t": "_e", "_r": "_hi"}), [*keys, "_e"])
    )
    stretches = placed.selectExpr(*keys, "_s", "_e", _dyadic("_lo", "_hi")).groupBy(*keys, "_level", "_node").agg(F.max("_s").alias("_s"), F.min("_e").alias("_e"))
    stretches = cut_lineage(stretches)
    # the longest stretch of a group bounds the lengths its edges look at
    longest = stretches.groupBy(*keys).agg(F.max("_level").alias("_longest"))
    around = edges.join(longest, keys).selectExpr(*keys, "_t", "_r", "explode(sequence(0, _longest)) as _level").withColumn("_node", F.expr("shiftright(_r, _level)"))
    best = around.join(stretches, [*keys, "_level", "_node"]).groupBy(*keys, "_t").agg(F.max("_s").alias("_s"), F.min("_e").alias("_e"))
    after = best.join(wide, [*keys, "_s", "_e"]).selectExpr(*keys, "_t", "_ids as _after")
    here = rows.filter("_e = _s").selectExpr(*keys, "_s as _t", "_ids as _at")
    # one without extent is alone at its instant; elsewhere the instant belongs to the stretch
    choice = edges.join(after, [*keys, "_t"], "left").join(here, [*keys, "_t"], "left")
    both = choice.select(*keys[:-1], F.col("_t").alias("edge_ts"), F.coalesce("_at", "_after").alias("_at"), "_after")
    return both.groupBy(*keys[:-1], "edge_ts").agg(F.collect_list("_at").alias("at"), F.collect_list("_after").alias("after"))


#: Rows of one side that meet in one cell of :func:`overlap_pairs`.
CELL_ROWS = 2_000


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], *, cell_rows: int = CELL_ROWS) -> DataFrame:
    """All pairs of a left and a right interval of the same key that overlap: ``keys, left_id, right_id``.

    Both sides have ``id, ts, end_ts`` and the keys; instants count as in
    :func:`count_overlaps`.  Time is cut into aligned buckets of 2^k units; an
    interval touches at most two buckets of the level of its own length or of any
    longer one.  A pair meets on the level of the longer one, in the bucket where
    the later one starts, so it is found there and nowhere else, and intervals far
    apart never meet.  A bucket with many rows is dealt into cells of at most
    ``cell_rows`` rows of each side; no task gets a bucket whole.
    """
    keys = list(keys)
    # doubled places give an instant a width of one half step; the level is the bit length of the extent
    shaped = []
    for side, df in (("l", left), ("r", right)):
        placed = df.selectExpr(*keys, "id as _id", "2 * ts as _from", "if(end_ts > ts, 2 * end_ts, 2 * ts + 1) as _to")
        shaped.append(placed.withColumn("_own", F.expr("if(_to - _from <= 1, 0, length(bin(_to - _from - 1)))")))
    # levels of either side: 64 at most
    levels = [sorted(r[0] for r in df.select("_own").distinct().collect()) for df in shaped]
    if not all(levels):
        return left.select(*keys, F.col("id").alias("left_id")).join(right.select(*keys, F.col("id").alias("right_id")), keys).limit(0)
    met = []
    for df, others in zip(shaped, reversed(levels), strict=True):
        above = F.concat(F.array("_own"), F.filter(F.array(*[F.lit(n) for n in others]), lambda n: n > F.col("_own")))
        both = df.withColumn("_level", F.explode(above)).withColumn("_bucket", F.expr("explode(array_distinct(array(shiftright(_from, _level), shiftright(_to - 1, _level))))"))
        met.append(both)
    bucket = [*keys, "_level", "_bucket"]
    counts = [m.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias(n)) for m, n in zip(met, ("_rows", "_cols"), strict=True)]
    cells = counts[0].join(counts[1], bucket)
    a = met[0].join(cells, bucket).withColumn("_i", F.expr("cast(pmod(xxhash64(_id), _rows) as int)")).withColumn("_j", F.expr("explode(sequence(0, _cols - 1))"))
    b = met[1].join(cells, bucket).withColumn("_j", F.expr("cast(pmod(xxhash64(_id), _cols) as int)")).withColumn("_i", F.expr("explode(sequence(0, _rows - 1))"))
    a = a.select(*bucket, "_i", "_j", F.col("_id").alias("left_id"), F.col("_from").alias("_from1"), F.col("_to").alias("_to1"), F.col("_own").alias("_own1"))
    b = b.select(*bucket, "_i", "_j", F.col("_id").alias("right_id"), F.col("_from").alias("_from2"), F.col("_to").alias("_to2"), F.col("_own").alias("_own2"))
    once = "greatest(_own1, _own2) = _level and shiftright(greatest(_from1, _from2), _level) = _bucket"
    return a.join(b, [*bucket, "_i", "_j"]).filter(f"_from1 < _to2 and _from2 < _to1 and {once}").select(*keys, "left_id", "right_id")
