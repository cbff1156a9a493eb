"""Command line: python -m talliq.cli COMMAND. Reports, backfill, prune, export, settings, and the status line."""

from __future__ import annotations

import argparse
import datetime
import os
import sys
import time
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import buckets, render
from .operators import parse
from .plans import reports, text
from .sources import git, transcripts
from .sources.store import Store
from .streaming import ingest


def local_zone() -> str:
    link = os.path.realpath("/etc/localtime")
    named = os.environ.get("TZ") or (link.split("zoneinfo/")[1] if "zoneinfo/" in link else "UTC")
    try:
        ZoneInfo(named)
    except (KeyError, ValueError, OSError):
        return "UTC"
    return named


def session() -> SparkSession:
    return SparkSession.builder.appName("talliq").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="talliq")
    parser.add_argument("--store")
    parser.add_argument("--zone", default=local_zone())
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("summary", "daily", "weekly", "monthly", "export"):
        p = commands.add_parser(name)
        p.add_argument("--since")
        p.add_argument("--until")
        if name == "export":
            p.add_argument("--format", choices=("csv", "json"), default="csv")
            p.add_argument("--to", required=True, help="folder of the files")
        else:
            p.add_argument("--cost", action="store_true")
        if name in ("daily", "weekly", "monthly"):
            p.add_argument("--by", choices=("model", "project"))
    commands.add_parser("sessions").add_argument("--project")
    commands.add_parser("backfill").add_argument("--root")
    p = commands.add_parser("prune")
    p.add_argument("--before", required=True)
    p.add_argument("--yes", action="store_true")
    commands.add_parser("install").add_argument("--exe", default="talliq-statusline")
    p = commands.add_parser("statusline")
    p.add_argument("--short", action="store_true")
    p.add_argument("--cost", action="store_true")
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, stdin=None, now: int | None = None) -> list[str]:
    """Runs a command; its lines are printed and returned."""
    a = _arguments().parse_args(arguments)
    lines = [text.settings(a.exe)] if a.command == "install" else _run(a, spark or session(), stdin or sys.stdin, int(time.time()) if now is None else now)
    print("\n".join(lines))
    return lines


def _day(ts: int, zone: str) -> str:
    return datetime.datetime.fromtimestamp(ts, ZoneInfo(zone)).strftime("%Y-%m-%d")


def _run(a, spark: SparkSession, stdin, now: int) -> list[str]:
    store, home = Store(spark, a.store), os.path.expanduser("~")
    if a.command == "statusline":
        return [status_line(store, stdin.read(), now=now, zone=a.zone, home=home, short=a.short, by_cost=a.cost)]
    if a.command == "backfill":
        return backfill_lines(store, a.root or transcripts.default_root(), now)
    if a.command == "prune":
        return prune_lines(store, a.before, a.zone, a.yes)
    if a.command == "sessions":
        rows = reports.session_list(store.requests(), store.sessions(), a.project).collect()
        return text.sessions(rows, lambda ts: _day(ts, a.zone), home)
    since, until = reports.resolve(a.since, a.until, a.zone)
    ledger = reports.rows(store.requests(since, until), store.sessions(), since, until)
    if a.command == "export":
        (reports.write_csv if a.format == "csv" else reports.write_json)(ledger, a.to)
        return [f"Exported to {a.to}"]
    if a.command == "summary":
        rows = reports.summary(ledger).collect()
        total = next((r for r in rows if r["kind"] == "total"), None)
        first, last = (_day(total[c], a.zone) for c in ("first_ts", "last_ts")) if total else ("", "")
        cover = reports.coverage(store.requests(), store.cost_state()).first() if total else None
        return text.summary(rows, cover, first, last, home, a.cost)
    period = {"daily": "day", "weekly": "week", "monthly": "month"}[a.command]
    return text.breakdown(reports.breakdown(ledger, period, a.by, a.zone, home).collect(), a.cost, a.by is not None)


def backfill_lines(store: Store, root: str, now: int) -> list[str]:
    out = [f"Scanning {len(transcripts.discover(root))} transcripts under {root}"]
    before = set(ingest.stale_cursors(store))
    r = ingest.backfill(store, root, now=now)
    out.append(f"Added {r.changed} new requests ({reports.request_count(store.requests()).first()['requests']} total in ledger).")
    if r.malformed:
        out.append(f"Skipped {r.malformed} unparseable lines.")
    if r.dropped:
        out.append(f"Warning: {r.dropped} billed requests lack an id, model or timestamp and are in no total.")
    out += [f"note: session {d['session_id']} appears in {d['transcripts']} transcripts" for d in reports.duplicate_sources(store.requests()).orderBy("session_id").toLocalIterator()]
    if before:
        out.append(f"Dropped {len(before)} cursors whose transcript no longer exists.")
    return out


def prune_lines(store: Store, before: str, zone: str, yes: bool) -> list[str]:
    cutoff = buckets.parse_date(before, zone)
    if cutoff is None:
        raise ValueError(f"--before is not a YYYY-MM-DD date: {before}")
    counts = reports.prune_preview(store.requests(), store.limits(), store.cost_state(), cutoff).first()
    n = text.thousands
    out = [f"Older than {before}: {n(counts['requests'])} requests, {n(counts['limits'])} rate-limit observations, {n(counts['cost_state'])} session cost snapshots."]
    if not any(counts):
        return [*out, "Nothing to prune."]
    size, rows = store.bytes(), max(1, reports.request_count(store.requests()).first()["requests"])
    out.append(f"The ledger has {text.bytes_human(size)} now; removing those would free roughly {text.bytes_human(counts['requests'] * (size // rows))}.")
    if not yes:
        return [*out, "", "Nothing was deleted. Run again with --yes to apply; what is pruned is gone for good."]
    store.compact(before=cutoff)
    after = store.bytes()
    return [
        *out, f"Deleted {n(counts['requests'])} requests, {n(counts['limits'])} limits, {n(counts['cost_state'])} cost snapshots.",
        f"Ledger {text.bytes_human(size)} → {text.bytes_human(after)}, {text.bytes_human(max(0, size - after))} reclaimed.",
    ]


def status_line(store: Store, payload: str, *, now: int, zone: str, home: str, short: bool = False, by_cost: bool = False, budget: float = 30.0) -> str:
    """Renders first, then ingests the payload's transcript and limits within the budget. Always gives a line."""
    spark = store.spark
    try:
        frame = parse.payloads(spark.createDataFrame([(payload,)], "json string"))
        folder = frame.select(render.display_dir(F.col("payload")).alias("dir"), F.col("payload")["transcript_path"].alias("path")).first()
        start = buckets.start_of_day(datetime.datetime.fromtimestamp(now, ZoneInfo(zone)).date(), zone)
        totals = reports.today(store.requests(start), start)
        branch = git.branch(folder["dir"]) if folder["dir"] else None
        shown = frame.crossJoin(totals).select(  # one row each
            render.line(F.col("payload"), F.col("tokens"), F.col("cost"), F.lit(branch).cast("string"), F.lit(now), home=home, short=short, by_cost=by_cost).alias("line")
        ).first()["line"]
    except Exception:
        return f"{render.GREY}{render.NAME}{render.RESET}"
    try:
        ingest.record_limits(store, frame, now)
        if folder["path"] and os.path.isfile(folder["path"]):
            ingest.drain(store, folder["path"], now=now, budget=budget, count_changes=False)
    except Exception as e:  # the line is out already; the next run catches up
        print(f"ingest: {e}", file=sys.stderr)
    return shown


if __name__ == "__main__":
    main()
