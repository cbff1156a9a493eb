"""Ingestion of transcripts into a store: in bounded batches until a deadline, for a whole folder, or as a stream."""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, parse
from ..sources import transcripts
from ..sources.store import Store, arrival, batch_of

#: Lines of a file in one batch.
BATCH_LINES = 500
#: Batches that are read and written at once, at most, and bytes of a file that a task then decodes.
ROUND, RANGE = 1024, 16 << 20


@dataclass
class Report:
    """Counts of what was read. changed: requests inserted, and lines that made one grow."""

    lines: int = 0
    usage: int = 0
    cost: int = 0
    dropped: int = 0
    malformed: int = 0
    changed: int = 0
    exhausted: bool = True

    def add(self, other: Report) -> None:
        for name in ("lines", "usage", "cost", "dropped", "malformed", "changed"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.exhausted = other.exhausted


def register(spark: SparkSession) -> None:
    spark.dataSource.register(transcripts.TranscriptSource)


def known_cursors(store: Store, root: str) -> dict[str, dict]:
    """Cursors of the files that are there now: as many as files, not as lines."""
    rows = store.cursors().select("path", "byte_offset", "file_id", "head_hash")
    here = store.spark.createDataFrame([(p,) for p in transcripts.discover(root)], "path string")
    return {r["path"]: {"byte_offset": r["byte_offset"], "file_id": r["file_id"], "head_hash": r["head_hash"]} for r in rows.join(here, "path").collect()}


def changes(store: Store, batches: list[int]) -> int:
    """How many lines of these batches inserted a request or made one grow; looks at the requests they touch, which are
    all where nothing else is stored."""
    alone = store.manifest()["snapshot"] is None and set(store.committed()) <= set(batches)
    log = store.log("usage")
    ours = batch_of(F.col("batch_id")).isin(batches)
    touched = log if alone else log.join(log.filter(ours).select("dedupe_key").distinct(), "dedupe_key", "left_semi")
    return merge.effective(touched).filter(ours).agg(F.count_if("effective").alias("changed")).first()["changed"]


def write_batch(store: Store, raw: DataFrame, batch_id: int, now: int, count_changes: bool = True) -> Report:
    """Parses raw lines and appends usage, costs and cursors as one batch, whose steps raw may tell; nothing is written
    without lines."""
    decoded = parse.recorded(parse.decoded(raw)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = parse.counters(decoded).first()
        report = Report(**counts.asDict())
        if not report.lines:
            return report
        number = arrival(batch_id, F.col("step") if "step" in raw.columns else 0)
        cursors = decoded.groupBy("path").agg(F.max_by(F.struct(F.col("end").alias("byte_offset"), "file_id", "head_hash"), "end").alias("c"))
        tables = {"cursors": cursors.select("path", "c.*", F.lit(now).cast("long").alias("last_seen"), arrival(batch_id).alias("batch_id"))}
        if report.usage:
            tables["usage"] = parse.usage_lines(decoded, number)
        if report.cost:
            tables["cost_state"] = parse.cost_lines(decoded, now, number)
        store.append(batch_id, tables)
        if count_changes and report.usage:
            report.changed = changes(store, [batch_id])
        return report
    finally:
        decoded.unpersist()


def _width(width: int, took: float, left: float | None) -> int:
    """How many batches to take at once after so many that took so long: what the time that is left allows, but at most
    twice as many, and as many as may be without a deadline."""
    return ROUND if left is None else max(1, min(2 * width, ROUND, int(width * left / max(took, 1e-3))))


def drain(store: Store, root: str, *, now: int | None = None, budget: float | None = None, batch_lines: int | None = BATCH_LINES, count_changes: bool = True) -> Report:
    """Batches of at most so many lines of each file until nothing is new or the budget of seconds is over. Batches are
    taken many at once, in one commit, as far as the budget allows, and fold as if they came one after the other. Whatever
    was committed stays, so that every call gets further. Changes are counted once, at the end, and only when asked."""
    spark, now = store.spark, int(time.time()) if now is None else now
    register(spark)
    deadline, total, batches = None if budget is None else time.monotonic() + budget, Report(), []
    width = ROUND if budget is None else 1

    def ended(exhausted: bool) -> Report:
        total.exhausted = exhausted
        if count_changes and total.usage:
            total.changed = changes(store, batches)
        return total

    while True:
        options = {"cursors": json.dumps(known_cursors(store, root)), "rangeBytes": str(RANGE)}
        if batch_lines:
            options |= {"maxLinesPerBatch": str(batch_lines), "maxBatches": str(width)}
        raw = spark.read.format("transcripts").options(**options).load(root)
        batch, start = store.next_batch(), time.monotonic()
        report = write_batch(store, raw, batch, now, count_changes=False)
        total.add(report)
        if not report.lines:
            store.files.delete(f"claims/{batch}")
            return ended(True)
        batches.append(batch)
        if deadline is not None and time.monotonic() >= deadline:
            return ended(False)
        width = _width(width, time.monotonic() - start, None if deadline is None else deadline - time.monotonic())


def backfill(store: Store, root: str | None = None, *, now: int | None = None) -> Report:
    """All files from their cursors to their ends, files and ranges in parallel; then cursors of files that are gone are
    forgotten and the log is compacted."""
    report = drain(store, root or transcripts.default_root(), now=now, batch_lines=None)
    store.delete_cursors(stale_cursors(store))
    store.compact()
    return report


def stale_cursors(store: Store) -> list[str]:
    return [r["path"] for r in store.cursors().select("path").toLocalIterator() if not os.path.exists(r["path"])]


def stream(store: Store, root: str, checkpoint: str, *, batch_lines: int | None = BATCH_LINES, trigger: dict | None = None):
    """A running query that ingests what is appended. A batch that is run again keeps the number that it has claimed, and
    so replaces itself: its effect comes once."""
    register(store.spark)
    name = f"streams/{hash_of(checkpoint)}"
    options = {"cursors": json.dumps(known_cursors(store, root))} | ({"maxLinesPerBatch": str(batch_lines)} if batch_lines else {})
    source = store.spark.readStream.format("transcripts").options(**options).load(root)

    def write(df: DataFrame, k: int) -> None:
        batch = store.files.read(f"{name}-{k}")
        if batch is None:
            batch = str(store.next_batch())
            store.files.write(f"{name}-{k}", batch)
        write_batch(store, df, int(batch), int(time.time()), count_changes=False)
        store.files.delete(f"{name}-{k - 2}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def hash_of(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=7).digest(), "big")


def record_limits(store: Store, payload_frame: DataFrame, now: int) -> bool:
    """Appends the payload's limits if it has a window and differs from the last observation."""
    batch = store.next_batch()
    seen = merge.observed_limits(payload_frame, F.lit(now), arrival(batch))
    row = seen.first()
    if row is None:
        return False
    last = store.limits().orderBy(F.desc("ts")).limit(1).first()
    if last is not None and all(last[c] == row[c] for c in merge.LIMIT_COLUMNS):
        return False
    store.append(batch, {"limits": seen})
    return True
