"""Registered queries of sources, ingestion, maintenance and dates: events are written as transcript files, and what the
engine makes of them is compared with SQL over the same events.

Files lie in a folder of their own below the shared folder, and go when the process ends.
"""

from __future__ import annotations

import atexit
import datetime
import glob
import json
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buckets, render
from ..operators import parse
from ..sources import git, transcripts
from ..sources.store import Store
from ..streaming import ingest
from . import reports, text

#: Files that the events are dealt to, lines of a batch, and the longest line where long ones are to be skipped.
FILES, BATCH, LONGEST = 4, 800, 215
#: Tasks that write these files.
SPREAD = 24
#: A cutoff within the events' month, in UTC seconds.
CUTOFF = 1_706_000_000


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors see."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    shared = shared.removeprefix("file://") if shared and "://" not in shared.removeprefix("file://") else None
    if shared:
        os.makedirs(shared, exist_ok=True)
    folder = tempfile.mkdtemp(prefix="talliq-queries-", dir=shared)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, file, line): a line for each event; some aren't JSON, some blank, some snapshots of costs. In a file, lines are
    in the order of k. Two events in a row share a key."""
    ts = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01'"), F.col("ts").cast("timestamp_ntz"))
    k = F.col("k")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("k"), ts.alias("ts"))
    usage = F.concat(
        F.lit('{"type":"assistant","sessionId":"s'), k % 9, F.lit('","cwd":"/pä'), k % 3, F.lit('","timestamp":"'), buckets.rfc3339(F.col("ts")), F.lit('","message":{"id":"m'),
        F.floor(k / 2), F.lit('","model":"claude-opus-5","usage":{"input_tokens":'), k % 50, F.lit(',"output_tokens":'), k * 7 % 700, F.lit("}}}"),
    )
    cost = F.concat(F.lit('{"type":"cost-state","sessionId":"s'), k % 9, F.lit('","totalCostUSD":'), k % 100, F.lit(',"modelUsage":{"a":{"inputTokens":'), k, F.lit("}}}"))
    line = F.when(k % 41 == 3, "not json").when(k % 43 == 5, "").when(k % 47 == 7, cost).otherwise(usage)
    return events.select("k", (k % FILES).cast("int").alias("file"), line.alias("line"))


def write(rows: DataFrame, folder: str) -> str:
    """Writes (k, file, line) as one file for each file number: ranges of lines side by side, which are then joined."""
    spread = rows.repartitionByRange(SPREAD, "file", "k").sortWithinPartitions("file", "k")
    spread.select("file", "line").write.partitionBy("file").text(f"{folder}/parts")
    os.makedirs(f"{folder}/t/inner")
    for parts in glob.glob(f"{folder}/parts/file=*"):
        number = int(os.path.basename(parts).partition("=")[2])
        first, *more = sorted(glob.glob(f"{parts}/part-*"))
        with open(first, "ab") as out:
            for part in more:
                with open(part, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 22)
                os.remove(part)
        os.rename(first, f"{folder}/t/{'inner/' if number % 2 else ''}{number}.jsonl")
    shutil.rmtree(f"{folder}/parts")
    return f"{folder}/t"


def _files(spark, sf_dir) -> str:
    ingest.register(spark)
    return write(lines(spark, sf_dir), workspace(spark))


def _read(spark, root: str, **options) -> DataFrame:
    return spark.read.format("transcripts").options(**options).load(root)


def _number():
    return F.regexp_extract("path", r"(\d+)\.jsonl$", 1).cast("int").alias("file")


def scanned_lines(spark, sf_dir):
    """All files, in ranges of a few kilobytes."""
    return _read(spark, _files(spark, sf_dir), rangeBytes="5000").select(_number(), "offset", "end", "line", "too_long")


def overlong_lines(spark, sf_dir):
    return _read(spark, _files(spark, sf_dir), maxLineBytes=str(LONGEST)).select(_number(), "offset", "end", F.length("line").alias("length"), "too_long")


def _cursors(rows: DataFrame) -> dict[str, dict]:
    """Cursors behind what was read: one for each file."""
    got = rows.groupBy("path").agg(F.max(F.struct("end", "file_id", "head_hash")).alias("c")).collect()
    return {r["path"]: {"byte_offset": r["c"]["end"], "file_id": r["c"]["file_id"], "head_hash": r["c"]["head_hash"]} for r in got}


def resumed_lines(spark, sf_dir):
    """What a second scan reads from the cursors of a first one that took some lines of each file."""
    root = _files(spark, sf_dir)
    cursors = _cursors(_read(spark, root, maxLinesPerBatch="100"))
    return _read(spark, root, cursors=json.dumps(cursors)).select(_number(), "offset", "line")


def replaced_lines(spark, sf_dir):
    """Cursors at the end of files, of which one has another first line, one is shorter than before and one is another file."""
    root = _files(spark, sf_dir)
    cursors = _cursors(_read(spark, root))
    for path, cursor in cursors.items():
        number = int(os.path.basename(path).partition(".")[0])
        if number < 3:
            cursor[("head_hash", "byte_offset", "file_id")[number]] += 1
    return _read(spark, root, cursors=json.dumps(cursors)).groupBy(_number()).agg(F.count("*").alias("lines"), F.min("offset").alias("first"), F.max("end").alias("last"))


def _drained(spark, sf_dir) -> tuple[Store, ingest.Report, str]:
    folder = workspace(spark)
    ingest.register(spark)
    root = write(lines(spark, sf_dir), folder)
    store = Store(spark, f"{folder}/store")
    return store, ingest.drain(store, root, now=CUTOFF, batch_lines=BATCH), root


_REQUEST = ("dedupe_key", "session_id", "project_dir", "model", "ts", "input", "output")


def drained_requests(spark, sf_dir):
    """Requests after bounded batches."""
    return _drained(spark, sf_dir)[0].requests().select(*_REQUEST)


def drain_report(spark, sf_dir):
    """What a drain counts, and what a second one finds."""
    store, first, root = _drained(spark, sf_dir)
    again = ingest.drain(store, root, now=CUTOFF)
    row = (first.lines, first.usage, first.cost, first.dropped, first.malformed, first.changed, first.exhausted, again.lines)
    return spark.createDataFrame([row], "lines long, usage long, cost long, dropped long, malformed long, changed long, exhausted boolean, again long")


def budgeted_drain(spark, sf_dir):
    """A drain whose time is over after its first batch, and the one that takes the rest."""
    folder = workspace(spark)
    ingest.register(spark)
    root, store = write(lines(spark, sf_dir), folder), Store(spark, f"{folder}/store")
    first = ingest.drain(store, root, now=CUTOFF, batch_lines=BATCH, budget=0.0)
    rest = ingest.drain(store, root, now=CUTOFF, batch_lines=None)
    return spark.createDataFrame([(first.lines, first.exhausted, rest.lines, rest.exhausted, len(store.committed()))], "first long, first_exhausted boolean, rest long, rest_exhausted boolean, batches int")


def stored_cursors(spark, sf_dir):
    return _drained(spark, sf_dir)[0].cursors().select(_number(), "byte_offset", "last_seen")


def stored_sessions(spark, sf_dir):
    return _drained(spark, sf_dir)[0].sessions().select("session_id", "project_dir", "first_seen", "last_seen")


def stored_costs(spark, sf_dir):
    return _drained(spark, sf_dir)[0].cost_state().select("session_id", "cost_usd", "input", "captured_at")


def stored_paths(spark, sf_dir):
    """Paths that requests came from, by an id of each."""
    return _drained(spark, sf_dir)[0].transcripts().select(_number(), (F.col("id") == F.xxhash64("path")).alias("known"))


def compacted_requests(spark, sf_dir):
    """Half of each file, a snapshot, the rest, and another snapshot: the same requests as without."""
    folder = workspace(spark)
    ingest.register(spark)
    root, store = write(lines(spark, sf_dir), folder), Store(spark, f"{folder}/store")
    ingest.drain(store, root, now=CUTOFF, batch_lines=BATCH, budget=0.0)
    store.compact()
    ingest.drain(store, root, now=CUTOFF, batch_lines=None)
    store.compact()
    return store.requests().select(*_REQUEST)


def ranged_requests(spark, sf_dir):
    """A range of a snapshot and what came after it."""
    folder = workspace(spark)
    ingest.register(spark)
    root, store = write(lines(spark, sf_dir), folder), Store(spark, f"{folder}/store")
    ingest.drain(store, root, now=CUTOFF, batch_lines=BATCH, budget=0.0)
    store.compact()
    ingest.drain(store, root, now=CUTOFF, batch_lines=None)
    return store.requests(CUTOFF - 500_000, CUTOFF).select(*_REQUEST)


def pruned_store(spark, sf_dir):
    """Rows that stay of each table after pruning, with a cursor of a file that is gone, and lines that a drain reads then."""
    store, _, root = _drained(spark, sf_dir)
    os.remove(f"{root}/2.jsonl")
    store.compact(before=CUTOFF)
    store.delete_cursors(ingest.stale_cursors(store))
    again = ingest.drain(store, root, now=CUTOFF)
    counts = [store.requests().agg(F.count("*").alias("n"), F.lit("requests").alias("name")), store.sessions().agg(F.count("*").alias("n"), F.lit("sessions").alias("name")), store.cursors().agg(F.count("*").alias("n"), F.lit("cursors").alias("name")), spark.range(1).select(F.lit(again.lines).cast("long").alias("n"), F.lit("read again").alias("name"))]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def backfilled_requests(spark, sf_dir):
    """All files at once, compacted, with the size of the store."""
    folder = workspace(spark)
    root, store = write(lines(spark, sf_dir), folder), Store(spark, f"{folder}/store")
    ingest.backfill(store, root, now=CUTOFF)
    return store.requests().select(*_REQUEST).withColumn("stored", F.lit(store.bytes() > 0 and not store.committed()))


def streamed_requests(spark, sf_dir):
    """A stream that is stopped and started again on its checkpoint, over files that grow meanwhile."""
    folder = workspace(spark)
    ingest.register(spark)
    root, store = write(lines(spark, sf_dir), folder), Store(spark, f"{folder}/store")
    rest = {}
    for path in transcripts.discover(root):
        with open(path, "rb") as f:
            data = f.read()
        half = data.find(b"\n", len(data) // 2) + 20  # within a line, which is left for later
        rest[path] = data[half:]
        with open(path, "r+b") as f:
            f.truncate(half)
    for _ in range(2):
        query = ingest.stream(store, root, f"{folder}/checkpoint", batch_lines=None)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        for path, data in rest.items():
            with open(path, "ab") as f:
                f.write(data)
        rest = {}
    return store.requests().select(*_REQUEST)


def concurrent_drains(spark, sf_dir):
    """Two writers at once."""
    from concurrent.futures import ThreadPoolExecutor

    folder = workspace(spark)
    ingest.register(spark)
    root = write(lines(spark, sf_dir), folder)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda _: ingest.drain(Store(spark, f"{folder}/store"), root, now=CUTOFF, batch_lines=BATCH * 2, count_changes=False), range(2)))
    return Store(spark, f"{folder}/store").requests().select("dedupe_key", "session_id", "input", "output")


def recorded_limits(spark, sf_dir):
    """Payloads of the first events, one after the other: only those that differ from the last are kept."""
    store = Store(spark, f"{workspace(spark)}/store")
    for k in range(6):
        window = "null" if k == 3 else json.dumps({"used_percentage": k // 2 * 10.5, "resets_at": 1000})
        frame = parse.payloads(spark.createDataFrame([(f'{{"rate_limits":{{"five_hour":{window}}}}}',)], "json string"))
        ingest.record_limits(store, frame, 100 + k)
    return store.limits().select("ts", "five_hour_pct", "five_hour_resets_at", "seven_day_pct")


def payload_values(spark, sf_dir):
    """Accessors of decoded payloads, of which some lack folders and some have wrong types."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("k"))
    k = F.col("k")
    folders = F.struct(F.when(k % 3 != 0, F.concat(F.lit("/w"), k)).alias("current_dir"), F.when(k % 5 == 0, F.lit("/project")).alias("project_dir"))
    payload = F.to_json(F.struct(F.concat(F.lit("/c"), k).alias("cwd"), F.when(k % 4 != 0, folders).alias("workspace"), F.struct((k % 7 - 1).alias("total_lines_added")).alias("cost")))
    got = parse.payloads(events.withColumn("json", F.when(k % 11 == 0, "[]").otherwise(payload)))
    p = F.col("payload")
    return got.select(k, p.isNull().alias("bad"), render.display_dir(p).alias("shown"), render.project_dir(p).alias("project"), p["cost"]["total_lines_added"].alias("added"))


def converted_requests(spark, sf_dir):
    """Requests of two older stores, one with paths written out and one with numbers of them, taken over as batches."""
    folder = workspace(spark)
    k = F.col("k")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("k"), F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01'"), F.col("ts").cast("timestamp_ntz")).alias("ts"))
    base = events.select(
        "k", F.concat(F.lit("m"), F.floor(k / 2)).alias("dedupe_key"), F.concat(F.lit("s"), k % 9).alias("session_id"), F.lit("/p").alias("project_dir"), F.lit("claude-opus-5").alias("model"), "ts",
        (k % 50).alias("input"), (k * 7 % 700).alias("output"), F.lit(0).alias("cache_create"), F.lit(0).alias("cache_read"), (k % FILES).alias("number"),
    )
    base.filter("k % 2 = 0").drop("k").withColumn("transcript", F.concat(F.lit("/t/"), "number")).drop("number").write.parquet(f"{folder}/one/requests")
    base.filter("k % 2 = 1").drop("k").withColumn("thinking", F.lit(3)).withColumnRenamed("number", "path_id").write.parquet(f"{folder}/two/requests")
    spark.range(FILES).select("id", F.concat(F.lit("/t/"), "id").alias("path")).write.parquet(f"{folder}/two/paths")
    store = Store(spark, f"{folder}/store")
    store.convert(f"{folder}/one")
    store.convert(f"{folder}/two")
    store.convert(f"{folder}/two")  # the same again changes nothing
    known = store.paths().select(F.col("id").alias("path_id"), "path")
    return store.requests().join(known, "path").select(*_REQUEST, "thinking", "path", (F.col("path_id") == F.xxhash64("path")).alias("known"))


def command_lines(spark, sf_dir):
    """What the command line prints: a backfill, its sessions, and a status line from standard input before and after."""
    import contextlib
    import io

    from .. import cli

    folder = workspace(spark)
    root = write(lines(spark, sf_dir), folder)
    out = []

    def run(*arguments, stdin=""):
        with contextlib.redirect_stdout(io.StringIO()):
            return cli.main(["--store", f"{folder}/store", "--zone", "UTC", *arguments], spark, stdin=io.StringIO(stdin), now=CUTOFF)

    out += run("statusline", stdin='{"cwd":"/x"}') + run("statusline", stdin="nonsense")
    out += run("backfill", "--root", root)[1:3]
    out += run("statusline", "--short", stdin='{"cwd":"/x"}')
    out += run("sessions", "--project", "/pä1")
    return spark.createDataFrame(list(enumerate(out)), "place int, line string")


#: Zones whose clocks change at different times of a day; in Santiago a midnight is missing.
ZONES = ("UTC", "America/New_York", "Pacific/Auckland", "America/Santiago")


def resolved_dates(spark, sf_dir):
    """The first second of each local day of a year, and of texts that aren't dates."""
    days = [(datetime.date(2026, 1, 1) + datetime.timedelta(days=d)).isoformat() for d in range(365)] + ["2026-02-30", "x", "2026-1-1"]
    return spark.createDataFrame([(zone, day, reports.resolve(day, None, zone)[0] if day[:2] == "20" and len(day) == 10 and day != "2026-02-30" else buckets.parse_date(day, zone)) for zone in ZONES for day in days], "zone string, day string, ts long")


def settings_line(spark, sf_dir):
    """What to put into the host's settings, and the branch of a folder below a repository."""
    folder = workspace(spark)
    os.makedirs(f"{folder}/repo/.git")
    os.makedirs(f"{folder}/repo/a/b")
    with open(f"{folder}/repo/.git/HEAD", "w") as f:
        f.write("ref: refs/heads/some/branch\n")
    return spark.createDataFrame([(text.settings('none "x"'), git.branch(f"{folder}/repo/a/b"), git.branch(folder))], "settings string, branch string, other string")


def json_elements(spark, sf_dir):
    from .queries import _ledger

    return reports.json_elements(_ledger(spark, sf_dir)).drop("ts")


def printed_reports(spark, sf_dir):
    """Lines of the summary, with costs and coverage, and of the days."""
    from . import testbed
    from .queries import _ledger

    rows = reports.summary(_ledger(spark, sf_dir)).collect()
    cover = reports.coverage(testbed.requests(spark, sf_dir), testbed.cost_state(spark, sf_dir)).first()
    out = text.summary(rows, cover, "first", "last", "/home/user", True)
    days = reports.breakdown(_ledger(spark, sf_dir), "day", None, "UTC").collect()
    out += text.breakdown(days, False, False)
    return spark.createDataFrame(list(enumerate(out)), "place int, line string")


QUERIES = {
    f.__name__: f
    for f in (
        scanned_lines, overlong_lines, resumed_lines, replaced_lines, drained_requests, drain_report, budgeted_drain, stored_cursors, stored_sessions, stored_costs, stored_paths, compacted_requests,
        ranged_requests, pruned_store, backfilled_requests, streamed_requests, concurrent_drains, recorded_limits, payload_values, resolved_dates, settings_line, json_elements, printed_reports, converted_requests, command_lines,
    )
}

# --- the same in SQL ------------------------------------------------------------------------------------------------

_LINES = f"""WITH e AS (SELECT event_id AS k, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events),
kinds AS (SELECT *, CASE WHEN k % 41 = 3 THEN 'bad' WHEN k % 43 = 5 THEN 'blank' WHEN k % 47 = 7 THEN 'cost' ELSE 'usage' END AS kind FROM e),
texts AS (SELECT *, k % {FILES} AS file, CASE kind WHEN 'bad' THEN 'not json' WHEN 'blank' THEN ''
  WHEN 'cost' THEN '{{"type":"cost-state","sessionId":"s' || (k % 9) || '","totalCostUSD":' || (k % 100) || ',"modelUsage":{{"a":{{"inputTokens":'
 || k || '}}}}}}'
  ELSE '{{"type":"assistant","sessionId":"s' || (k % 9) || '","cwd":"/pä' || (k % 3) || '","timestamp":"' || strftime(make_timestamp(ts * 1000000),
 '%Y-%m-%dT%H:%M:%S') || '+00:00'
    || '","message":{{"id":"m' || (k // 2) || '","model":"claude-opus-5","usage":{{"input_tokens":' || (k % 50) || ',"output_tokens":'
 || (k * 7 % 700) || '}}}}}}' END AS line FROM kinds),
placed AS (SELECT *, strlen(line) + 1 AS size, row_number() OVER f - 1 AS rank, CAST(sum(strlen(line) + 1) OVER f AS BIGINT) AS "end" FROM texts
 WINDOW f AS (PARTITION BY file ORDER BY k)),
lines AS (SELECT *, "end" - size AS "offset", CASE WHEN file % 2 = 1 THEN 'inner/' ELSE '' END || file AS path FROM placed)
"""
_USAGE = """, usage AS (SELECT *, {seq} AS seq, 'm' || (k // 2) AS dedupe_key, 's' || (k % 9) AS session_id, '/pä' || (k % 3) AS project_dir, k % 50 AS input,
 k * 7 % 700 AS output FROM lines WHERE kind = 'usage'),
requests AS (SELECT dedupe_key, arg_min(session_id, seq) AS session_id, arg_min(project_dir, seq) AS project_dir, 'claude-opus-5' AS model,
 arg_min(ts, seq) AS ts, max(input) AS input, max(output) AS output FROM usage GROUP BY dedupe_key)
"""
#: Arrival: the batch, then the path, then the place in the file.
_BATCHED = _LINES + _USAGE.format(seq=f"(rank // {BATCH}, path, rank)")
_WHOLE = _LINES + _USAGE.format(seq="(0, path, rank)")
#: A first batch of some lines, then the rest.
_TWO = _LINES + _USAGE.format(seq=f"(least(rank // {BATCH}, 1), path, rank)")


def _ledger_sql(query: str) -> str:
    from .testbed import ORACLE

    return ORACLE + query


def _printed() -> str:
    """The printed lines in SQL, as a list in order."""
    from .testbed import ORACLE, TOTALS

    columns = (("requests", 8), ("input", 12), ("output", 12), ("cache_create", 13), ("cache_read", 13), ("total", 14))
    number = lambda c: f"replace(format('{{:,}}', CAST({c} AS BIGINT)), ',', ' ')"
    right = lambda x, w: f"(repeat(' ', greatest({w} - length({x}), 0)) || {x})"
    left = lambda x, w: f"({x} || repeat(' ', greatest({w} - strlen({x}), 0)))"
    usd = lambda c: f"CASE WHEN {c} = 0 THEN '$0.00' WHEN abs({c}) < 0.01 THEN '$' || printf('%.4f', {c}) ELSE '$' || printf('%.2f', {c}) END"
    cells = " || ' ' || ".join(right(number(c), w) for c, w in columns)
    head = lambda title, width, cost: f"{left(title, width)} || ' {' '.join(f'{c.replace('_', '-'):>{w}}' for c, w in columns)}{f' {'API Cost':>12}' if cost else ''}'"
    row = lambda name, width, cost: f"{left(name, width)} || ' ' || {cells}" + (f" || ' ' || {right(usd('cost'), 12)}" if cost else "")
    short = "CASE WHEN starts_with(project_root, '/home/user') THEN '~' || substr(project_root, 11) ELSE project_root END"
    share = lambda c: f"CASE WHEN cost > 0 THEN {right(f"printf('%.1f', {c} / cost * 100)", 5)} || '%' ELSE '    -' END"
    part = lambda place, name, c: f"SELECT 4, {place}, '', '  {name:<12} ' || {right(usd(c), 12)} || '  ' || {share(c)} FROM whole"
    plain = lambda section, place, line: f"SELECT {section}, {place}, '', '{line}'"
    parts = [
        "SELECT 0 AS section, 0 AS place, '' AS name, 'first .. last   ' || requests || ' requests' AS line FROM whole", plain(0, 1, ""),
        f"SELECT 1, 0, '', {head("'model'", 'w_model', True)} FROM widths", f"SELECT 1, 1, model, {row('model', 'w_model', True)} FROM models, widths", plain(1, 2, ""),
        f"SELECT 2, 0, '', {head("'project'", 'w_project', True)} FROM widths", f"SELECT 2, 1, project_root, {row('shown', 'w_project', True)} FROM projects, widths", plain(2, 2, ""),
        f"SELECT 3, 0, '', {row("'TOTAL'", 'w_project', True)} FROM whole, widths", plain(4, 0, ""), plain(4, 1, "API cost: an estimate of what this usage would have cost at list prices."),
        plain(4, 2, "It is not what a subscription charges, and is made from local transcripts."), plain(4, 3, ""),
        part(4, "input", "cost_input"), part(5, "output", "cost_output"), part(6, "cache write", "cost_write"), part(7, "cache read", "cost_read"),
        f"SELECT 4, 8, '', '  TOTAL        ' || {right(usd('cost'), 12)} FROM whole", "SELECT 4, 9, '', '' FROM whole WHERE unpriced > 0",
        f"SELECT 4, 10, '', '  note: ' || {number('unpriced')} || ' tokens came from models without a price' FROM whole WHERE unpriced > 0", "SELECT 4, 11, '', '  and are not in the figures above.' FROM whole WHERE unpriced > 0",
        plain(5, 0, ""), "SELECT 5, 1, '', 'Coverage: ' || printf('%.1f', ours / theirs * 100) || '% of the tokens that the host counted itself in ' || sessions || ' session(s).' FROM cover",
        plain(5, 2, "The rest never reached a transcript, such as retries and aborted turns."),
        f"SELECT 6, 0, '', {head("''", 'w_day', False)} FROM widths", f"SELECT 6, 1, day, {row('day', 'w_day', False)} FROM days, widths", f"SELECT 6, 2, '', {row("'TOTAL'", 'w_day', False)} FROM whole, widths",
    ]
    return ORACLE + f""", whole AS (SELECT {TOTALS} FROM priced), models AS (SELECT model, {TOTALS} FROM priced GROUP BY model), projects AS (SELECT project_root,
 {short} AS shown, {TOTALS} FROM priced GROUP BY project_root),
days AS (SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS day, {TOTALS} FROM priced GROUP BY 1),
widths AS (SELECT greatest(5, (SELECT max(strlen(model)) FROM models)) AS w_model, greatest(7, (SELECT max(strlen(shown))
 FROM projects)) AS w_project, greatest(5, (SELECT max(strlen(day)) FROM days)) AS w_day),
cover AS (SELECT (SELECT sum(total) FROM requests WHERE session_id IN (SELECT session_id FROM cost_state)) AS ours,
 sum(input + output + cache_read + cache_create) AS theirs, count(*) AS sessions FROM cost_state),
printed AS ({' UNION ALL '.join(parts)})
SELECT CAST(row_number() OVER (ORDER BY section, place, name) - 1 AS INTEGER) AS place, line FROM printed"""


_R = "dedupe_key, session_id, project_dir, model, ts, input, output"
ORACLES = {
    "scanned_lines": _LINES + 'SELECT CAST(file AS INTEGER) AS file, "offset", "end", line, FALSE AS too_long FROM lines',
    "overlong_lines": _LINES + f'SELECT CAST(file AS INTEGER) AS file, "offset", "end", CASE WHEN size <= {LONGEST} THEN CAST(length(line) AS INTEGER) END AS length, size > {LONGEST} AS too_long FROM lines',
    "resumed_lines": _LINES + 'SELECT CAST(file AS INTEGER) AS file, "offset", line FROM lines WHERE rank >= 100',
    "replaced_lines": _LINES + 'SELECT CAST(file AS INTEGER) AS file, count(*) AS lines, min("offset") AS "first", max("end") AS "last" FROM lines WHERE file < 3 GROUP BY file',
    "drained_requests": _BATCHED + f"SELECT {_R} FROM requests",
    "drain_report": _BATCHED + """, marked AS (SELECT *, row_number() OVER w = 1 OR input > max(input) OVER b OR output > max(output) OVER b AS effective FROM usage
  WINDOW w AS (PARTITION BY dedupe_key ORDER BY seq), b AS (PARTITION BY dedupe_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT count(*) AS lines, count(*) FILTER (WHERE kind = 'usage') AS usage, count(*) FILTER (WHERE kind = 'cost') AS cost, 0::BIGINT AS dropped,
 count(*) FILTER (WHERE kind = 'bad') AS malformed,
  (SELECT count(*) FROM marked WHERE effective) AS changed, TRUE AS exhausted, 0::BIGINT AS again FROM lines""",
    "budgeted_drain": _LINES + f"""SELECT count(*) FILTER (WHERE rank < {BATCH}) AS \"first\", FALSE AS first_exhausted, count(*) FILTER (WHERE rank >= {BATCH}) AS rest,
 TRUE AS rest_exhausted, CAST(CASE WHEN max(rank) >= {BATCH} THEN 2 ELSE 1 END AS INTEGER) AS batches FROM lines""",
    "stored_cursors": _LINES + f"""SELECT CAST(file AS INTEGER) AS file, CAST(sum(size) AS BIGINT) AS byte_offset, {CUTOFF}::BIGINT AS last_seen FROM lines GROUP BY file""",
    "stored_sessions": _BATCHED + """SELECT session_id, arg_min(project_dir, seq) AS project_dir, min(ts) AS first_seen, max(ts) AS last_seen FROM usage GROUP BY session_id""",
    "stored_costs": _LINES + f"""SELECT 's' || (k % 9) AS session_id, CAST(arg_max(k % 100, (rank // {BATCH}, path, rank)) AS DOUBLE) AS cost_usd, arg_max(k, (rank // {BATCH}, path,
 rank)) AS input, {CUTOFF}::BIGINT AS captured_at FROM lines WHERE kind = 'cost' GROUP BY k % 9""",
    "stored_paths": _BATCHED + """, firsts AS (SELECT arg_min(file, seq) AS file FROM usage GROUP BY dedupe_key) SELECT DISTINCT CAST(file AS INTEGER) AS file, TRUE AS known
 FROM firsts""",
    "compacted_requests": _TWO + f"SELECT {_R} FROM requests",
    "ranged_requests": _TWO + f"SELECT {_R} FROM requests WHERE ts >= {CUTOFF - 500_000} AND ts < {CUTOFF}",
    "pruned_store": _BATCHED + f"""SELECT count(*) AS n, 'requests' AS name FROM requests WHERE ts >= {CUTOFF} UNION ALL SELECT count(DISTINCT session_id), 'sessions' FROM usage
 UNION ALL SELECT {FILES - 1}, 'cursors' UNION ALL SELECT 0, 'read again'""",
    "backfilled_requests": _WHOLE + f"SELECT {_R}, TRUE AS stored FROM requests",
    "concurrent_drains": _WHOLE + "SELECT dedupe_key, session_id, input, output FROM requests",
    "recorded_limits": """SELECT CAST(ts AS BIGINT) AS ts, pct AS five_hour_pct, 1000::BIGINT AS five_hour_resets_at, CAST(NULL AS DOUBLE) AS seven_day_pct FROM (VALUES (100,
 0.0::DOUBLE), (102, 10.5::DOUBLE), (104, 21.0::DOUBLE)) AS t(ts, pct)""",
    "payload_values": """WITH e AS (SELECT event_id AS k, event_id % 11 = 0 OR event_id % 7 = 0 AS bad FROM events)
SELECT k, bad, CASE WHEN bad THEN NULL WHEN k % 4 <> 0 AND k % 3 <> 0 THEN '/w' || k ELSE '/c' || k END AS shown, CASE WHEN bad THEN NULL
 WHEN k % 4 <> 0 AND k % 5 = 0 THEN '/project' WHEN k % 4 <> 0 AND k % 3 <> 0 THEN '/w' || k ELSE '/c' || k END AS project,
  CASE WHEN NOT bad THEN k % 7 - 1 END AS added FROM e""",
    "resolved_dates": "WITH days AS (SELECT unnest(range(DATE '2026-01-01', DATE '2027-01-01', INTERVAL 1 DAY)) AS d), zones(zone) AS (VALUES " + ", ".join(f"('{z}')" for z in ZONES) + """),
good AS (SELECT zone, strftime(d, '%Y-%m-%d') AS day, CAST(epoch(CAST(d AS TIMESTAMP) AT TIME ZONE zone) AS BIGINT) AS ts FROM days, zones)
SELECT zone, day, ts FROM good UNION ALL SELECT zone, day, NULL FROM zones, (VALUES ('2026-02-30'), ('x'), ('2026-1-1')) AS b(day)""",
    "settings_line": """SELECT '"statusLine": {"type": "command", "command": "none \\"x\\""}' AS settings, 'some/branch' AS branch, CAST(NULL AS VARCHAR) AS other""",
    "json_elements": _ledger_sql("""SELECT CASE WHEN row_number() OVER (ORDER BY ts, dedupe_key) = 1 THEN '' ELSE ',' END || '{"timestamp":"' || strftime(make_timestamp(ts * 1000000),
 '%Y-%m-%dT%H:%M:%S') || '+00:00","model":"' || model || '","project_root":"' || project_root || '","project_dir":"' || project_dir
 || '","input":' || input || ',"output":' || output || ',"cache_create":' || cache_create || ',"cache_read":' || cache_read || ',"total":' || total
 || '}' AS line, dedupe_key FROM ledger"""),
    "printed_reports": _printed(),
}
ORACLES["converted_requests"] = f"""WITH e AS (SELECT event_id AS k, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events)
SELECT 'm' || (k // 2) AS dedupe_key, 's' || (arg_min(k, (k % 2, k)) % 9) AS session_id, '/p' AS project_dir, 'claude-opus-5' AS model, arg_min(ts,
 (k % 2, k)) AS ts, max(k % 50) AS input, max(k * 7 % 700) AS output,
  max(CASE WHEN k % 2 = 1 THEN 3 ELSE 0 END)::BIGINT AS thinking, '/t/' || (arg_min(k, (k % 2, k)) % {FILES}) AS path, TRUE AS known FROM e
 GROUP BY k // 2"""
_TODAY = f"(SELECT coalesce(sum(input + output), 0) FROM requests WHERE ts >= {CUTOFF // 86400 * 86400})"
_KILO = f"""CASE WHEN {_TODAY} >= 1000000 THEN printf('%.1f', {_TODAY} / 1e6::DOUBLE) || 'M' WHEN {_TODAY} >= 100000
 THEN CAST(round({_TODAY} / 1000.0::DOUBLE) AS BIGINT) || 'k'
  WHEN {_TODAY} >= 10000 THEN printf('%.0f', {_TODAY} / 1000.0::DOUBLE) || 'k' ELSE printf('%.1f', {_TODAY} / 1000.0::DOUBLE) || 'k' END"""
_PLACE = f"{render.CYAN}/x{render.RESET}{render.GREY} • {render.RESET}{render.GREY}{render.ICON_TOKENS} today {render.RESET}"
ORACLES["command_lines"] = _WHOLE + f""", marked AS (SELECT *, row_number() OVER w = 1 OR input > max(input) OVER b OR output > max(output) OVER b AS effective FROM usage
  WINDOW w AS (PARTITION BY dedupe_key ORDER BY seq), b AS (PARTITION BY dedupe_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sessions AS (SELECT session_id, arg_min(project_dir, seq) AS project_dir, max(ts) AS last_seen FROM usage GROUP BY session_id),
tokens AS (SELECT session_id, CAST(sum(input + output) AS BIGINT) AS tokens FROM requests GROUP BY session_id),
shown AS (SELECT s.session_id, coalesce(tokens, 0) AS tokens, last_seen, project_dir FROM sessions s LEFT
 JOIN tokens t ON s.session_id = t.session_id WHERE project_dir = '/pä1'),
printed(section, place, name, line) AS (SELECT 0, 0, '', '{_PLACE}0.0k' UNION ALL SELECT 1, 0, '', '{render.GREY}{render.NAME}{render.RESET}'
  UNION ALL SELECT 2, 0, '', 'Added ' || (SELECT count(*) FROM marked WHERE effective) || ' new requests (' || (SELECT count(*) FROM requests)
 || ' total in ledger).'
  UNION ALL SELECT 3, 0, '', 'Skipped ' || (SELECT count(*) FROM lines WHERE kind = 'bad') || ' unparseable lines.'
  UNION ALL SELECT 4, 0, '', '{render.CYAN}/x{render.RESET}' || CASE WHEN {_TODAY} > 0 THEN '{_PLACE.removeprefix(f"{render.CYAN}/x{render.RESET}")}'
 || {_KILO} ELSE '' END
  UNION ALL SELECT 5, 0, '', CASE WHEN count(*) = 0 THEN 'No sessions recorded.' ELSE '{"session":<38} {"tokens":>12} {"last seen":>12}  project' END
 FROM shown
  UNION ALL SELECT 6, -last_seen, session_id, session_id || repeat(' ', 38 - length(session_id)) || ' ' || lpad(replace(format('{{:,}}', tokens),
 ',', ' '), 12, ' ') || ' ' || lpad(strftime(make_timestamp(last_seen * 1000000), '%Y-%m-%d'), 12, ' ') || '  ' || project_dir FROM shown)
SELECT CAST(row_number() OVER (ORDER BY section, place, name) - 1 AS INTEGER) AS place, line FROM printed"""
#: A stream takes the half of each file that is there, then the rest.
ORACLES["streamed_requests"] = (
    _LINES.rstrip()
    + ', halves AS (SELECT file, sum(size) AS whole FROM placed GROUP BY file), cuts AS (SELECT l.file, min(l."end") AS cut FROM lines l JOIN halves h ON l.file = h.file WHERE l."end" > h.whole // 2 GROUP BY l.file)'
    + _USAGE.format(seq='(CASE WHEN "end" <= (SELECT cut FROM cuts WHERE cuts.file = lines.file) THEN 0 ELSE 1 END, path, rank)')
    + f"SELECT {_R} FROM requests"
)
