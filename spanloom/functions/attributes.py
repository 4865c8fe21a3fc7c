"""Attribute columns: typed access and construction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from spanloom import schema


def attr(name: str) -> Column:
    """A typed attribute of a slice."""
    return F.col(f"attrs.{name}")


def attrs_sql(**given: str) -> str:
    """SQL of the ``attrs`` struct with the given field expressions; the others
    are null.  One parsed expression is far cheaper to build than fifty columns."""
    unknown = set(given) - set(schema.ATTRIBUTE_TYPES)
    if unknown:
        raise ValueError(f"unknown attributes: {sorted(unknown)}")
    fields = (f"'{n}', cast({given.get(n, 'null')} as {t})" for n, t in schema.ATTRIBUTE_TYPES.items())
    return "named_struct(" + ", ".join(fields) + ")"


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_agent_category(category: Column, vendor: str) -> Column:
    """Slices that belong to a recorder, by category namespace."""
    return category.rlike(r"^(" + "|".join((*schema.HARNESSES, vendor)) + r")\.")


def is_metadata_category(category: Column, vendor: str) -> Column:
    return category.isin([f"{h}.metadata" for h in (*schema.HARNESSES, vendor)])


def is_marker_name(name: Column) -> Column:
    return name.isin(list(schema.MARKER_NAMES)) | name.rlike(schema.PROFILE_PATTERN)


def is_configuration_name(name: Column) -> Column:
    return is_marker_name(name) | (name == schema.CONFIGURATION_NAME)


def total_sql(value: str, where: str | None = None) -> str:
    """SQL of the sum of a long as a double, by way of decimals: nanoseconds of many
    overlapping operations add up to more than a long holds."""
    only = f" filter (where {where})" if where else ""
    return f"cast(sum(cast({value} as decimal(19, 0))){only} as double)"


def ms(ns: Column) -> Column:
    """Nanoseconds as double milliseconds."""
    return ns.cast("double") / F.lit(1e6)


def slice_end() -> Column:
    """Observed end of a slice; an open one ends where it starts."""
    return F.col("ts") + F.greatest(F.col("dur"), F.lit(0))


def flag(condition: Column) -> Column:
    """Boolean as the 0/1 integer that result tables carry."""
    return condition.cast("int")


def kind_of(vendor_track: Column) -> Column:
    """Kind of a slice: scripts first, then the recorded kind, then the names
    older recordings used.  ``vendor_track`` is the recorded track name."""
    name, category = F.col("name"), F.col("category")
    legacy = (
        F.when(F.concat(F.lit(","), category, F.lit(",")).contains(",pi.agent,") & (name == "prompt"), "prompt")
        .when((category == "pi.agent") & (name == "turn"), "turn")
        .when((category == "pi.llm") & name.isin("request", "provider-request"), "provider-request")
        .when(
            (category == "pi.tools") & (vendor_track.isin("tools", "Tools") | vendor_track.startswith("tools.lane.")),
            "tool-execution",
        )
        .when((category == "pi.llm") & name.startswith("assistant ttft="), "assistant-message")
        .otherwise("other")
    )
    return F.coalesce(F.when((name == "codemode") & (category == "pi.tools"), "script"), attr("kind"), legacy)
