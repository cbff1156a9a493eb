"""Reports over merged requests, sessions and cost snapshots. Every report is one plan; zones are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import buckets, formats, pricing

UNKNOWN = "unknown"
GROUPS = (None, "model", "project")
_SUMS = ("input", "output", "cache_create", "cache_read", "cache_1h", "cache_5m")


def in_range(frame: DataFrame, since: int | None = None, until: int | None = None, column: str = "ts") -> DataFrame:
    """Half-open in UTC seconds; an end left out is open. A request's time is known after its lines are merged, so this
    filters merged rows; Store.requests takes a range itself and reads only the days of it."""
    if since is not None:
        frame = frame.filter(F.col(column) >= since)
    return frame if until is None else frame.filter(F.col(column) < until)


def resolve(since: str | None, until: str | None, zone: str) -> tuple[int | None, int | None]:
    """Local dates as UTC seconds; a bad date names its option."""
    out = []
    for name, text in (("--since", since), ("--until", until)):
        at = None if text is None else buckets.parse_date(text, zone)
        if text is not None and at is None:
            raise ValueError(f"{name} is not a YYYY-MM-DD date: {text}")
        out.append(at)
    return out[0], out[1]


def rows(requests: DataFrame, sessions: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Requests of a range with project_root, the folder in which their session began."""
    root = sessions.select(F.col("session_id").alias("_session"), F.col("project_dir").alias("session_dir"))
    # requests without a session match none; a key of their own spreads them
    key = F.coalesce("session_id", F.concat(F.lit("\0"), F.col("dedupe_key")))
    joined = in_range(requests, since, until).withColumn("_key", key).join(root, F.col("_key") == F.col("_session"), "left").drop("_key", "_session")
    return joined.withColumn("project_root", F.coalesce("session_dir", "project_dir", F.lit(UNKNOWN))).withColumn("project_dir", F.coalesce("project_dir", F.lit(UNKNOWN))).drop("session_dir")


def _priced_groups(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Integer sums by keys and model, priced once for each: what leaves for the second aggregation is a few rows."""
    sums = frame.groupBy(*dict.fromkeys([*keys, "model"])).agg(
        F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in _SUMS], F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return pricing.priced(sums)


def _totals() -> list[Column]:
    tokens = [F.sum(c).alias(c) for c in ("requests", "input", "output", "cache_create", "cache_read")]
    total = F.sum(pricing.total_tokens()).alias("total")
    dollars = [pricing.dollars(F.sum(c)).alias(c) for c in pricing.PARTS]
    whole = None
    for c in pricing.PARTS:
        whole = F.coalesce(F.col(c), F.lit(0).cast("decimal(38,4)")) if whole is None else whole + F.coalesce(F.col(c), F.lit(0).cast("decimal(38,4)"))
    return [*tokens, total, *dollars, pricing.dollars(F.sum(whole.cast("decimal(38,4)"))).alias("cost"), F.sum("unpriced").alias("unpriced")]


def summary(ledger: DataFrame) -> DataFrame:
    """By model, by project root, and in all, in one pass: kind is model, project or total. Empty without requests."""
    grouped = _priced_groups(ledger, ["model", "project_root"]).withColumn("one", F.lit(1))
    sets = grouped.groupingSets([["model"], ["project_root"], ["one"]], "model", "project_root", "one")
    got = sets.agg(F.grouping("model").alias("no_model"), F.grouping("project_root").alias("no_project"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), *_totals())
    kind = F.when(F.col("no_model") == 0, "model").when(F.col("no_project") == 0, "project").otherwise("total")
    name = F.when(F.col("no_model") == 0, F.col("model")).when(F.col("no_project") == 0, F.col("project_root")).otherwise(F.lit("TOTAL"))
    return got.select(kind.alias("kind"), name.alias("name"), *[c for c in got.columns if c not in ("model", "project_root", "one", "no_model", "no_project")])


def breakdown(ledger: DataFrame, period: str, by: str | None, zone: str, home: str = "") -> DataFrame:
    """By local day, week or month and by nothing, model or shortened project root, with one TOTAL row."""
    group = {None: F.lit(""), "model": F.col("model"), "project": formats.shorten_home(F.col("project_root"), home)}[by]
    labelled = ledger.withColumns({"bucket": buckets.label(F.col("ts"), zone, period), "grp": group})
    grouped = _priced_groups(labelled, ["bucket", "grp"]).withColumn("one", F.lit(1))
    sets = grouped.groupingSets([["bucket", "grp"], ["one"]], "bucket", "grp", "one")
    got = sets.agg(F.grouping("bucket").alias("all"), *_totals())
    is_all = F.col("all") == 1
    return got.select(
        F.when(is_all, "TOTAL").otherwise(F.col("bucket")).alias("bucket"), F.when(is_all, "").otherwise(F.col("grp")).alias("grp"),
        *[c for c in got.columns if c not in ("bucket", "grp", "one", "all")],
    ).orderBy(F.col("bucket") == "TOTAL", "bucket", "grp")


def row_costs(ledger: DataFrame) -> DataFrame:
    """Cost of each request in dollars; null without a price."""
    priced = pricing.priced(ledger)
    whole = F.col(pricing.PARTS[0]) + F.col(pricing.PARTS[1]) + F.col(pricing.PARTS[2]) + F.col(pricing.PARTS[3])
    return priced.select("dedupe_key", "model", (whole.cast("decimal(38,4)").cast("double") / F.lit(1e6)).alias("cost"), "unpriced")


def cost_shares(total: DataFrame) -> DataFrame:
    """(part, usd, share) of a total row: shares in percent, null without any cost."""
    names = ("input", "output", "cache write", "cache read")
    each = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias("part"), F.col(c).alias("usd")) for k, (n, c) in enumerate(zip(names, pricing.PARTS, strict=True))])
    got = total.select("cost", F.explode(each).alias("p")).select("cost", "p.*")
    return got.select("place", "part", "usd", formats.percent(F.col("usd"), F.col("cost")).alias("share"))


def today(requests: DataFrame, day_start: int) -> DataFrame:
    """One row from the start of a day on, without an upper end: tokens of all models, cost of those with prices."""
    recent = in_range(requests, day_start)
    total = _priced_groups(recent, ["model"]).agg(F.sum("requests").alias("requests"), F.sum(pricing.total_tokens()).alias("tokens"), *[pricing.dollars(F.sum(c)).alias(c) for c in pricing.PARTS])
    cost = sum((F.col(c) for c in pricing.PARTS[1:]), F.col(pricing.PARTS[0]))
    return total.select(F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("tokens", F.lit(0)).alias("tokens"), cost.alias("cost"))


def coverage(requests: DataFrame, cost_state: DataFrame) -> DataFrame:
    """One row: sessions with accounting of their own, its tokens, the ledger's tokens of the same, and the percentage."""
    own = cost_state.agg(F.count("*").alias("sessions"), F.coalesce(F.sum(pricing.total_tokens()), F.lit(0)).alias("host_tokens"))
    ours = requests.join(cost_state.select("session_id"), "session_id", "left_semi").agg(F.coalesce(F.sum(pricing.total_tokens()), F.lit(0)).alias("ledger_tokens"))
    both = own.crossJoin(ours)  # one row each
    return both.withColumn("percent", formats.percent(F.col("ledger_tokens"), F.col("host_tokens")))


def session_list(requests: DataFrame, sessions: DataFrame, project: str | None = None) -> DataFrame:
    """Sessions with their tokens, the last seen first. A project must match exactly; unknown folders never do."""
    tokens = requests.groupBy("session_id").agg(F.sum(pricing.total_tokens()).alias("tokens"))
    chosen = sessions if project is None else sessions.filter(F.col("project_dir") == project)
    joined = chosen.join(tokens, "session_id", "left")
    return joined.select("session_id", F.coalesce("project_dir", F.lit(UNKNOWN)).alias("project_dir"), "first_seen", "last_seen", F.coalesce("tokens", F.lit(0)).alias("tokens")).orderBy(F.desc("last_seen"), "session_id")


def duplicate_sources(requests: DataFrame) -> DataFrame:
    """Sessions whose requests came from more than one transcript."""
    return requests.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.count_distinct("path").alias("transcripts")).filter("transcripts > 1")


def request_count(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count("*").alias("requests"))


def prune_preview(requests: DataFrame, limits: DataFrame, cost_state: DataFrame, cutoff: int) -> DataFrame:
    """One row: how many rows of each table are older than the cutoff."""
    older = lambda df, c, name: df.agg(F.count_if(F.col(c) < cutoff).alias(name))
    return older(requests, "ts", "requests").crossJoin(older(limits, "ts", "limits")).crossJoin(older(cost_state, "captured_at", "cost_state"))


def unused_paths(paths: DataFrame, requests: DataFrame) -> DataFrame:
    """Paths that no request refers to."""
    return paths.select("path").distinct().join(requests.select("path").filter("path IS NOT NULL"), "path", "left_anti")


EXPORT = ("timestamp", "model", "project_root", "project_dir", "input", "output", "cache_create", "cache_read", "total")


def export_rows(ledger: DataFrame) -> DataFrame:
    """The exported columns, and ts and dedupe_key to order by."""
    return ledger.select(buckets.rfc3339(F.col("ts")).alias("timestamp"), *EXPORT[1:-1], pricing.total_tokens().alias("total"), "ts", "dedupe_key")


def csv_lines(ledger: DataFrame) -> DataFrame:
    """(line, ts, dedupe_key): lines of the export, without its header."""
    got = export_rows(ledger)
    texts = [formats.csv_field(F.col(c)) if c in ("model", "project_root", "project_dir") else F.col(c).cast("string") for c in EXPORT]
    return got.select(F.concat_ws(",", *texts).alias("line"), "ts", "dedupe_key")


def write_csv(ledger: DataFrame, folder: str) -> None:
    """Text files in order of time; the first line of the first is the header."""
    spark = ledger.sparkSession
    header = spark.range(1).select(F.lit(",".join(EXPORT)).alias("line"), F.lit(None).cast("long").alias("ts"), F.lit(None).cast("string").alias("dedupe_key"))
    ordered = header.unionByName(csv_lines(ledger)).orderBy(F.asc_nulls_first("ts"), F.asc_nulls_first("dedupe_key"))
    ordered.select("line").write.mode("overwrite").text(folder)


def json_elements(ledger: DataFrame) -> DataFrame:
    """(line, ts, dedupe_key): elements of one JSON array, the first without a comma before it, without the brackets."""
    got = export_rows(ledger)
    first = got.agg(F.min(F.struct("ts", "dedupe_key")).alias("least"))  # one row
    is_first = F.struct("ts", "dedupe_key").eqNullSafe(F.col("least"))
    element = F.to_json(F.struct(*EXPORT), {"ignoreNullFields": "false"})
    return got.crossJoin(F.broadcast(first)).select(F.concat(F.when(is_first, "").otherwise(","), element).alias("line"), "ts", "dedupe_key")


def write_json(ledger: DataFrame, folder: str) -> None:
    """Text files that, one after the other, are one JSON array in order of time."""
    spark = ledger.sparkSession
    bracket = lambda text, place: spark.range(1).select(F.lit(place).alias("place"), F.lit(text).alias("line"), F.lit(None).cast("long").alias("ts"), F.lit(None).cast("string").alias("dedupe_key"))
    whole = bracket("[", 0).unionByName(json_elements(ledger).withColumn("place", F.lit(1))).unionByName(bracket("]", 2))
    whole.orderBy("place", "ts", "dedupe_key").select("line").write.mode("overwrite").text(folder)


def model_coverage(requests: DataFrame, cost_state: DataFrame) -> DataFrame:
    """Whether a session's snapshot has all models that its requests use; names lose a context mark in brackets."""
    used = requests.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.array_sort(F.collect_set("model")).alias("used"))
    named = F.transform(F.split("models", ","), lambda m: F.regexp_replace(m, r"\[1m\]$", ""))
    return used.join(cost_state.select("session_id", named.alias("named")), "session_id").select("session_id", (F.size(F.array_except("used", "named")) == 0).alias("covered"))
