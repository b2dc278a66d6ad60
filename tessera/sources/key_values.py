"""Keyed JSON state: local storage rows (key, json) and cookies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import loop_bounds


def json_of(json: Column) -> Column:
    """A variant; null for malformed text."""
    return F.try_parse_json(json)


def stored(table: DataFrame, key: str) -> DataFrame:
    return table.filter(F.col("key") == key).select("key", json_of(F.col("json")).alias("value"))


def written(table: DataFrame, key: str, value: Column) -> DataFrame:
    """The table with one key set."""
    row = table.sparkSession.range(1).select(F.lit(key).alias("key"), F.to_json(value).alias("json"))
    return table.filter(F.col("key") != key).select("key", "json").unionByName(row)


def without(table: DataFrame, keys: list[str], prefixes: list[str]) -> DataFrame:
    """The table without keys, named or by their beginning."""
    gone = F.col("key").isin(keys)
    for p in prefixes:
        gone = gone | F.col("key").startswith(p)
    return table.filter(~gone)


def cookie(jar: Column, name: str) -> Column:
    """The decoded value of the first cookie of this name; split at its first equals sign."""
    parts = F.filter(F.transform(F.split(jar, ";"), lambda p: F.trim(p)), lambda p: F.substring_index(p, "=", 1) == name)
    return text.uri_decoded(F.regexp_extract(F.get(parts, F.lit(0)), "^[^=]*=?(.*)$", 1))


def cookie_pair(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), text.uri_encoded(F.to_json(value)))


def kind_of(value: Column, key: str) -> Column:
    """The type of a field of a variant, as its schema tells; null if it is missing."""
    return F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))


def text_in(value: Column, key: str) -> Column:
    """A field that is a string, else null."""
    return F.when(kind_of(value, key) == "STRING", F.try_variant_get(value, f"$.{key}", "string"))


def filters(value: Column) -> Column:
    """Struct of plane, seq_id and enabled_dates of stored filters: fields of another type are null, entries that are no strings go."""
    dates = F.try_variant_get(value, "$.enabledDates", "array<variant>")
    told = F.transform(F.filter(dates, lambda d: F.schema_of_variant(d) == "STRING"), lambda d: F.try_variant_get(d, "$", "string"))
    return F.struct(text_in(value, "plane").alias("plane"), text_in(value, "seqId").alias("seq_id"), told.alias("enabled_dates"))


def overlay(value: Column) -> Column:
    """Struct of view_mode (overlay or grid), overlay_date and play_speed (a finite number) of a stored overlay state, null where they are not valid."""
    mode = text_in(value, "viewMode")
    speed = F.when(kind_of(value, "playSpeed").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(value, "$.playSpeed", "double"))
    return F.struct(F.when(mode.isin("overlay", "grid"), mode).alias("view_mode"), text_in(value, "overlayDate").alias("overlay_date"), speed.alias("play_speed"))


def playback(value: Column) -> Column:
    """Struct of loop_start, loop_end and loop_speed of a variant; null unless both bounds are finite numbers."""
    number = lambda key: F.when(kind_of(value, key).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(value, f"$.{key}", "double"))
    start, end, speed = number("loopStart"), number("loopEnd"), number("loopSpeed")
    bounds = loop_bounds(start, end)
    parsed = F.struct(bounds["start"].alias("loop_start"), bounds["end"].alias("loop_end"), F.when(speed.isin(2.0, 4.0), speed.cast("int")).otherwise(F.lit(1)).alias("loop_speed"))
    return F.when(start.isNotNull() & end.isNotNull(), parsed)


def playback_of(local: Column, jar: Column) -> Column:
    """The local value, else the cookie's."""
    return F.coalesce(playback(local), playback(jar))
