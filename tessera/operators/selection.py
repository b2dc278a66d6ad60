"""Selections over the comparison matrix: filters, defaults, best matches and neighbouring dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

DEFAULT_DATES = 4


def plane_key(plane: Column) -> Column:
    return F.when(F.trim(plane) != "", plane).otherwise(F.lit("Other"))


def plane_list(data_planes: DataFrame, combos: DataFrame) -> DataFrame:
    """All planes, Other last."""
    both = data_planes.select("plane").union(combos.select(plane_key(F.col("plane")).alias("plane"))).distinct()
    return both.orderBy(F.col("plane") == "Other", "plane")


def default_plane(planes: DataFrame) -> DataFrame:
    """Axial, else the first that is not Other, else the first."""
    rank = F.when(F.col("plane") == "Axial", 0).when(F.col("plane") != "Other", 1).otherwise(2)
    return planes.agg(F.min_by("plane", F.struct(rank.alias("rank"), F.col("plane").alias("name"))).alias("plane"))


def combos_of_plane(combos: DataFrame, plane: str) -> DataFrame:
    return combos.filter(plane_key(F.col("plane")) == plane).orderBy(F.desc("label"))


def default_dates(dates: DataFrame, n: int = DEFAULT_DATES) -> DataFrame:
    return dates.orderBy(F.desc("date_iso")).limit(n)


def enabled_dates(dates: DataFrame, stored: list[str] | None) -> DataFrame:
    """The stored dates that exist; the newest ones if none were ever stored; none for an empty list."""
    return default_dates(dates) if stored is None else dates.filter(F.col("date_iso").isin(stored))


def of_combo(matrix: DataFrame, combo: str | DataFrame) -> DataFrame:
    """The matrix' rows of one combo, given by its id or as a table of one row."""
    return matrix.join(F.broadcast(combo.limit(1)), "combo_id", "left_semi") if isinstance(combo, DataFrame) else matrix.filter(F.col("combo_id") == combo)


def cells(enabled: DataFrame, matrix: DataFrame, combo: str | DataFrame, how: str = "left") -> DataFrame:
    """Enabled dates with the combo's series; left keeps dates without one."""
    return enabled.join(of_combo(matrix, combo), "date_iso", how).orderBy(F.desc("date_iso"))


def combos_with_data(combos: DataFrame, matrix: DataFrame, enabled: DataFrame) -> DataFrame:
    return combos.join(matrix.join(enabled, "date_iso", "left_semi"), "combo_id", "left_semi")


def selectable_dates(dates: DataFrame, matrix: DataFrame, combo: str | DataFrame) -> DataFrame:
    """The dates on which a combo has a series: what selecting all dates selects."""
    return dates.join(of_combo(matrix, combo), "date_iso", "left_semi")


def no_dates(dates: DataFrame) -> DataFrame:
    """What selecting no dates selects: an empty selection, which is not that of none stored."""
    return dates.limit(0)


def target_dates(cells: DataFrame, reference: str | DataFrame) -> DataFrame:
    """The cells of other dates than the reference's, given as a date or as a table of one row."""
    if isinstance(reference, DataFrame):
        return cells.join(F.broadcast(reference.limit(1)), "date_iso", "left_anti")
    return cells.filter(F.col("date_iso") != reference)


def active_panel(enabled: Column, chosen: Column | None = None) -> Column:
    """The chosen date if it is among an array of enabled ones, else the newest; null if none is enabled."""
    newest = F.array_max(enabled)
    return newest if chosen is None else F.when(F.array_contains(enabled, chosen), chosen).otherwise(newest)


def place_of(dates: Column, stored: Column) -> Column:
    """The place from 0 of a stored date in an array of shown ones; null if it is not shown."""
    at = F.array_position(dates, stored)
    return F.when(at > 0, at - 1).cast("int")


def new_dates(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous, "date_iso", "left_anti")


def toggled(selected: Column, one: Column) -> Column:
    """A sorted array with one element put in or taken out."""
    single = F.array(one)
    return F.sort_array(F.array_except(F.array_union(selected, single), F.array_intersect(selected, single)))


def nearest_dates(dates: DataFrame, by: list[str], day: str = "date_iso", strict: bool = False) -> DataFrame:
    """Of each date the nearer of its neighbours, the older if equally near.

    strict reads only plain y-m-d dates, as the original does; others then always get the older one.
    """
    order = Window.partitionBy(*by).orderBy(day)
    millis = text.utc_millis if strict else (lambda d: text.utc_millis(F.substring_index(d, "T", 1)))
    older, newer = F.lag(day).over(order), F.lead(day).over(order)
    at = dates.withColumn("older", older).withColumn("newer", newer)
    back, ahead = millis(F.col(day)) - millis(F.col("older")), millis(F.col("newer")) - millis(F.col(day))
    closer = F.when(F.col("older").isNull(), F.col("newer")).when(F.col("newer").isNull() | back.isNull() | ahead.isNull() | (back <= ahead), F.col("older")).otherwise(F.col("newer"))
    return at.withColumn("nearest", closer).drop("older", "newer")


def best_match(combos: DataFrame, current: DataFrame) -> DataFrame:
    """For each (current_id, new_plane) of current: the combo of that plane most like the current one.

    Same weight and sequence, else same weight, else the plane's first, else the first of all. Combos are
    told apart by rank in their order; those of an unknown current_id are matched by plane alone.
    """
    listed = combos.select("combo_id", plane_key(F.col("plane")).alias("plane_key"), "weight", "sequence", F.struct(F.coalesce("plane", F.lit("")), "first_series").alias("place"))
    mine = listed.select(F.col("combo_id").alias("current_id"), F.col("weight").alias("own_weight"), F.col("sequence").alias("own_sequence"), F.lit(True).alias("known"))
    wanted = current.join(mine, "current_id", "left")
    first = listed.agg(F.min_by("combo_id", "place").alias("fallback"))
    score = F.when(F.col("known") & F.col("weight").eqNullSafe(F.col("own_weight")) & F.col("sequence").eqNullSafe(F.col("own_sequence")), 0).when(F.col("known") & F.col("weight").eqNullSafe(F.col("own_weight")), 1).otherwise(2)
    matched = wanted.join(listed, F.col("new_plane") == F.col("plane_key"), "left").groupBy("current_id", "new_plane").agg(F.min_by("combo_id", F.struct(score.alias("score"), "place")).alias("found"))
    return matched.join(F.broadcast(first)).select("current_id", "new_plane", F.coalesce("found", "fallback").alias("combo_id"))


def shown_count(selected: Column, overlay: Column, grid: Column) -> Column:
    """The number of slices to navigate: of the selected cell, of any in the overlay, of any in the grid, each if over 1; else 1."""
    over = lambda c: F.when(c > 1, c)
    first = lambda a: F.get(F.filter(a, lambda n: n > 1), F.lit(0))
    return F.coalesce(over(selected), first(overlay), first(grid), F.lit(1))
