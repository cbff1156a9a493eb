"""Folds that replace upserts: logs of lines are merged by key, in the order in which the lines arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TOKENS

ORDER = ("batch_id", "path", "offset")


def arrival() -> Column:
    return F.struct(*ORDER)


def effective(lines: DataFrame) -> DataFrame:
    """Adds effective: the first line of its key, or one with more of some token than all lines before it."""
    by_key = Window.partitionBy("dedupe_key").orderBy(*ORDER)
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    grew = F.lit(False)
    for t in TOKENS:
        grew = grew | (F.col(t) > F.max(t).over(before))
    return lines.withColumn("effective", (F.row_number().over(by_key) == 1) | F.coalesce(grew, F.lit(False)))


def requests(lines: DataFrame) -> DataFrame:
    """One row for each key: tokens by maximum, speed and place by the first effective line that has one, all else from
    the first line. The result is itself a valid first line, so merging goes on from it."""
    marked = effective(lines)
    first = lambda c: F.min_by(c, arrival()).alias(c)
    some = lambda c: F.min_by(c, F.when(F.col("effective") & F.col(c).isNotNull(), arrival())).alias(c)
    merged = marked.groupBy("dedupe_key").agg(
        F.min(arrival()).alias("seq"), *map(first, ("session_id", "project_dir", "model", "ts", "source")), *[F.max(t).alias(t) for t in TOKENS], *map(some, ("speed", "inference_geo"))
    )
    return merged.select("seq.*", "dedupe_key", "session_id", "project_dir", "model", "ts", *TOKENS, "source", "speed", "inference_geo")


def request_totals(lines: DataFrame) -> DataFrame:
    """As requests, without speed and place: a plain aggregation that combines before the shuffle."""
    first = lambda c: F.min_by(c, arrival()).alias(c)
    merged = lines.groupBy("dedupe_key").agg(*map(first, ("session_id", "project_dir", "model", "ts", "source")), *[F.max(t).alias(t) for t in TOKENS])
    return merged.select("dedupe_key", "session_id", "project_dir", "model", "ts", *TOKENS, "source")


def change_count(lines: DataFrame, batch_id: int | None = None) -> DataFrame:
    """One row: how many lines, of one batch or all, inserted a request or made one grow."""
    marked = effective(lines)
    if batch_id is not None:
        marked = marked.filter(F.col("batch_id") == batch_id)
    return marked.agg(F.count_if("effective").alias("changed"))


def sessions(lines: DataFrame, folded: DataFrame | None = None) -> DataFrame:
    """One row for each session over all its lines, duplicates too: first and last second, and the first folder that
    arrived. folded are rows of this result, to go on from."""
    each = lines.filter("session_id IS NOT NULL").select("session_id", "project_dir", F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), *ORDER)
    if folded is not None:
        each = each.unionByName(folded)
    named = F.when(F.col("project_dir").isNotNull(), arrival())
    merged = each.groupBy("session_id").agg(
        F.min_by("project_dir", named).alias("project_dir"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.coalesce(F.min(named), F.min(arrival())).alias("seq")
    )
    return merged.select("session_id", "project_dir", "first_seen", "last_seen", "seq.*")


def latest_cost(snapshots: DataFrame) -> DataFrame:
    """The snapshot of each session that arrived last."""
    rest = [c for c in snapshots.columns if c != "session_id"]
    return snapshots.groupBy("session_id").agg(F.max_by(F.struct(*rest), arrival()).alias("s")).select("session_id", "s.*")


def latest_cursors(cursors: DataFrame) -> DataFrame:
    rest = [c for c in cursors.columns if c != "path"]
    return cursors.groupBy("path").agg(F.max_by(F.struct(*rest), "batch_id").alias("s")).select("path", "s.*")


def paths(usage: DataFrame) -> DataFrame:
    """(id, path) of the paths of usage lines: a path's number is a hash of it, so writers need not agree on any."""
    return usage.select("path").filter("path IS NOT NULL").distinct().select(F.xxhash64("path").alias("id"), "path")


def used_paths(known: DataFrame, requests: DataFrame) -> DataFrame:
    """The paths that requests still refer to."""
    return known.join(requests.select("path"), "path", "left_semi").select("id", "path")


LIMIT_COLUMNS = ("five_hour_pct", "five_hour_resets_at", "seven_day_pct", "seven_day_resets_at")


def limit_changes(observations: DataFrame) -> DataFrame:
    """Observations that differ from the one before, the last of those of one second.

    Observations without either window must have been left out before; see observed_limits. Days are compared in
    parallel, and each day's first with the last day before it that has any: no task sees more than a day's rows.
    """
    latest = observations.groupBy("ts").agg(F.max_by(F.struct(*LIMIT_COLUMNS), "batch_id").alias("s"), F.max("batch_id").alias("batch_id"))
    day = latest.withColumn("day", F.floor(F.col("ts") / 86400))
    within = Window.partitionBy("day").orderBy("ts")
    marked = day.withColumn("before", F.lag("s").over(within)).withColumn("rank", F.row_number().over(within))
    ends = day.groupBy("day").agg(F.max_by("s", "ts").alias("end"))
    # one row a day: a window over all days stays small
    carried = ends.withColumn("carried", F.lag("end").over(Window.orderBy("day"))).withColumn("any", F.lag("day").over(Window.orderBy("day")).isNotNull()).select("day", "carried", "any")
    joined = marked.join(carried, "day")
    first = (F.col("rank") == 1) & ~F.col("any")
    before = F.when(F.col("rank") == 1, F.col("carried")).otherwise(F.col("before"))
    return joined.filter(first | ~F.col("s").eqNullSafe(before)).select("ts", "s.*", "batch_id")


def observed_limits(frame: DataFrame, ts: Column, batch_id: int | Column = 0) -> DataFrame:
    """Observations in payloads; a payload without either window is none, one with an empty window is one of nulls."""
    limits = F.col("payload")["rate_limits"]
    five, seven = limits["five_hour"], limits["seven_day"]
    return frame.filter(five.isNotNull() | seven.isNotNull()).select(
        ts.cast("long").alias("ts"), five["used_percentage"].alias("five_hour_pct"), five["resets_at"].alias("five_hour_resets_at"),
        seven["used_percentage"].alias("seven_day_pct"), seven["resets_at"].alias("seven_day_resets_at"), F.lit(batch_id).cast("long").alias("batch_id"),
    )
