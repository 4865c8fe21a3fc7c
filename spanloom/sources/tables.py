"""Trace tables: the relations every analysis reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom import schema


@dataclass
class TraceTables:
    """The raw trace relations, one DataFrame per table in ``schema.TABLES``.

    A value may be a function that plans the frame when it is first used; a
    missing table is empty.
    """

    spark: SparkSession
    frames: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    #: Namespace of the recorder's own tracks and categories.
    vendor: str = "spanloom"
    #: Number of slices, or an upper bound, when it is cheap to know.
    slice_rows: Callable[[], int] | None = None

    def __getitem__(self, name: str) -> DataFrame:
        frame = self.frames.get(name)
        if frame is None:
            frame = self.spark.createDataFrame([], schema.struct_type(name))
        elif not isinstance(frame, DataFrame):
            frame = frame()
        self.frames[name] = frame
        return frame

    def register(self, prefix: str = "") -> None:
        for name in schema.TABLES:
            self[name].createOrReplaceTempView(prefix + name)


def read_trace_tables(spark: SparkSession, path: str, *, vendor: str = "spanloom", fmt: str = "parquet") -> TraceTables:
    """Read trace tables from ``path/<table>`` with the declared schema.

    A table that was not written (a trace without counters, say) is empty.
    """
    frames = {}
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for name in schema.TABLES:
        location = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if location.getFileSystem(conf).exists(location):
            frames[name] = spark.read.format(fmt).schema(schema.struct_type(name)).load(f"{path}/{name}")
    return TraceTables(spark, frames, vendor)


def write_trace_tables(tables: TraceTables, path: str, *, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    for name in schema.TABLES:
        tables[name].write.format(fmt).mode(mode).save(f"{path}/{name}")


def _one(keys: list[str], sql_type: str) -> Column:
    """First recorded key in order, as a mergeable aggregate."""
    shown = F.coalesce(F.col("int_value").cast("string"), F.col("string_value"))
    picks = [F.max(F.when(F.col("flat_key") == f"debug.{k}", shown)).try_cast(sql_type) for k in keys]
    return F.coalesce(*picks)


def pivot_attributes(args: DataFrame, *, legacy_prefix: str | None = None) -> DataFrame:
    """Turn key/value arguments into the typed struct: ``arg_set_id, attrs``.

    ``args`` has ``arg_set_id, key, flat_key, string_value, int_value,
    display_value``.  Current keys win over legacy ones; ``legacy_prefix`` is
    the vendor prefix of older recordings.  One argument set belongs to one
    slice, so the collected lists are as small as one event.
    """
    aggregates, fields = [], []
    for name, (sql_type, keys) in schema.ATTRIBUTES.items():
        used = [k.format(v=legacy_prefix) for k in keys if legacy_prefix or "{v}" not in k]
        aggregates.append(_one(used, sql_type).alias(f"a_{name}"))
        fields.append(F.col(f"a_{name}").alias(name))
    for name, sql_type in schema.CONTEXT_FIELDS.items():
        aggregates.append(_one([f"context.{name}"], sql_type).alias(f"c_{name}"))
    key = F.col("key")
    item = F.regexp_extract(key, r"^debug\.context\.changes\[(\d+)\]\.(\w+)$", 1)
    shown = F.coalesce(F.col("display_value"), F.col("string_value"), F.col("int_value").cast("string"))
    arg_name = F.when(key == "debug.args", F.lit("value")).when(key.startswith("debug.args["), F.substring(key, 11, 1 << 20)).otherwise(
        F.substring(key, 12, 1 << 20)
    )
    is_arg = (key == "debug.args") | key.startswith("debug.args.") | key.startswith("debug.args[")
    aggregates += [
        F.array_sort(F.collect_list(F.when(key.startswith("debug.session_labels["), F.col("string_value")))).alias("labels"),
        F.collect_list(F.when(is_arg, F.struct(arg_name.alias("k"), shown.alias("v")))).alias("arg_pairs"),
        F.collect_list(
            F.when(
                key.startswith("debug.context.categories."),
                F.struct(F.substring(key, len("debug.context.categories.") + 1, 1 << 20).alias("k"), F.col("int_value").alias("v")),
            )
        ).alias("categories"),
        F.collect_list(
            F.when(
                item != "",
                F.struct(
                    item.cast("int").alias("i"),
                    F.regexp_extract(key, r"\.(\w+)$", 1).alias("f"),
                    F.coalesce(F.col("int_value").cast("string"), F.col("string_value")).alias("v"),
                ),
            )
        ).alias("items"),
    ]
    grouped = args.groupBy("arg_set_id").agg(*aggregates)

    def change(i: Column) -> Column:
        def value(name: str) -> Column:
            hits = F.filter("items", lambda x: (x["i"] == i) & (x["f"] == name))
            return F.get(hits, F.lit(0))["v"].try_cast(schema.CHANGE_FIELDS[name]).alias(name)

        return F.struct(*[value(n) for n in schema.CHANGE_FIELDS])

    with_id = F.array_sort(F.array_distinct(F.transform(F.filter("items", lambda x: x["f"] == "id"), lambda x: x["i"])))
    context = F.struct(
        *[F.col(f"c_{n}").alias(n) for n in schema.CONTEXT_FIELDS],
        F.when(F.size("categories") > 0, F.map_from_entries("categories")).alias("categories"),
        F.transform(with_id, change).alias("changes"),
    )
    fields += [
        F.when(F.size("labels") > 0, F.col("labels")).alias("session_labels"),
        F.when(F.size("arg_pairs") > 0, F.map_from_entries("arg_pairs")).alias("args"),
        F.when(F.col("c_version").isNotNull(), context).alias("context"),
    ]
    return grouped.select("arg_set_id", F.struct(*fields).alias("attrs"))


def attach_attributes(slices: DataFrame, args: DataFrame, *, legacy_prefix: str | None = None) -> DataFrame:
    """Raw slices (``arg_set_id``) plus key/value arguments -> typed ``slice`` table."""
    pivoted = pivot_attributes(args, legacy_prefix=legacy_prefix)
    return slices.join(pivoted, "arg_set_id", "left").select(
        "id", "parent_id", "track_id", "ts", "dur", "name", "category", F.col("attrs").cast(schema.ATTRS_TYPE).alias("attrs")
    )
