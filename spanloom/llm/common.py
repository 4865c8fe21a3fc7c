"""What the operators of this subpackage share: folders, safe columns, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.session import cut_lineage, shared_folder

PREFIX = "__op_"


#: Bytes of an Arrow batch that goes to a Python worker, so that 10,000 long texts never do at once.
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a written table, with ``options`` of the Parquet writer: lineage ends here and nothing is computed twice."""
    path = scratch(df.sparkSession, name)
    out = cut_lineage(df, path, **options)
    out._table = path
    return out


def superseded(*frames: DataFrame) -> None:
    """Delete the tables of :func:`kept` frames that no later job reads."""
    for df in frames:
        spark, path = df.sparkSession, df._table
        location = spark._jvm.org.apache.hadoop.fs.Path(path)
        location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


def _signature(edges: DataFrame) -> tuple:
    row = edges.select(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of an edge list ``(a, b)`` of longs.

    Alternating large-star and small-star rounds: every node points its larger
    neighbours at the smallest node it sees, then itself and its smaller ones.
    Each round is two grouped minima with a join back; a hub with a third of all
    edges is pre-aggregated before the shuffle and its join partition is one that
    adaptive execution can split.  Rounds end when the edge list repeats, after a
    number of rounds logarithmic in the longest chain.  Self loops and nulls are
    ignored; an empty list gives an empty table.  Returns ``(node, component)``
    for nodes with at least one edge.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = kept(e, "cc")
    before = _signature(e)
    if not before[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).distinct()
        e = kept(small, "cc")
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
