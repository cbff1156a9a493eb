"""Raw transcript lines to usage lines, cost snapshots and counters, and payload text to a struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import buckets

#: What a line is: usage, cost, a billed line that can't be recorded, one that can't be read, or none of these.
USAGE, COST, DROPPED, MALFORMED, OTHER = "usage", "cost", "dropped", "malformed", "other"
_SPACE = "^[ \\t\\n\\r\\f]*$"
#: Texts that may be the text of another type, so that the type must be looked at, which is slow.
_MAYBE_OTHER = r"^[\[{]|^[-+0-9.eE]+$|^(true|false|NaN|[-+]?Infinity)$"


def _field(root: Column, path: str) -> Column:
    for part in path.split("."):
        root = root[part]
    return root


def _wrong_text(root: Column, path: str) -> Column:
    """Whether a field that must be text or null is something else."""
    kind = F.schema_of_variant(_field(root, path))
    return F.coalesce(~kind.isin("STRING", "VOID"), F.lit(False))


def _wrong_known(text: Column, root: Column, path: str) -> Column:
    """As _wrong_text, with the field's text known."""
    return F.coalesce(text.rlike(_MAYBE_OTHER), F.lit(False)) & _wrong_text(root, path)


def _as_text(field: Column) -> Column:
    return F.variant_get(field, "$", "string")


def _unclosed(text: Column) -> Column:
    """Whether more than white space follows the object. Where one object seems to follow another, a strict parse decides."""
    two = text.rlike(r"\}\s*\{") & F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNull()
    return ~(text.endswith("}") | F.rtrim(F.translate(text, "\t\n\r", "   ")).endswith("}")) | two


def _once(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: behind a generator, since the optimiser puts a plain expression in place
    of its name wherever it is used."""
    return frame.withColumn(name, F.explode(F.array(value)))


def decoded(raw: DataFrame) -> DataFrame:
    """Adds j, the decoded line, t, its text fields, ts and status. Blank lines are none of the kinds and not malformed."""
    j = F.from_json("line", schemas.LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    top, t, ts = F.col("j"), F.col("t"), F.col("ts")
    got = _once(_once(raw, "j", j), "t", F.struct(*[_as_text(_field(top, path)).alias(_name(path)) for path in schemas.LINE_TEXTS]))
    got = _once(got, "ts", buckets.parse_rfc3339(t["timestamp"]))
    wrong = F.lit(False)
    for path in schemas.LINE_TEXTS:
        wrong = wrong | _wrong_known(t[_name(path)], top, path)
    blank = F.col("line").rlike(_SPACE)
    bad = top.isNull() | top["_corrupt"].isNotNull() | wrong | _unclosed(F.col("line"))
    billed = (t["type"] == "assistant") & top["message"]["usage"].isNotNull()
    known = t["id"].isNotNull() & t["model"].isNotNull() & ts.isNotNull()
    cost = (t["type"] == "cost-state") & t["sessionId"].isNotNull() & top["modelUsage"].isNotNull()
    status = (
        F.when(F.col("too_long"), MALFORMED)
        .when(F.col("line").isNull() | blank, OTHER)
        .when(F.coalesce(bad, F.lit(True)), MALFORMED)
        .when(F.coalesce(cost, F.lit(False)), COST)
        .when(~F.coalesce(billed, F.lit(False)), OTHER)
        .when(~known, DROPPED)
        .when(t["model"].startswith("<"), OTHER)  # placeholders, not calls
        .otherwise(USAGE)
    )
    return _once(got, "status", status)


def _name(path: str) -> str:
    return path.rpartition(".")[2]


def _usage() -> list[Column]:
    """What is recorded of a decoded line with usage."""
    top, t, usage = F.col("j"), F.col("t"), F.col("j")["message"]["usage"]
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return [
        t["id"].alias("dedupe_key"), t["sessionId"].alias("session_id"), t["cwd"].alias("project_dir"), t["model"].alias("model"), F.col("ts"),
        count(usage["input_tokens"]).alias("input"), count(usage["output_tokens"]).alias("output"),
        count(usage["cache_creation_input_tokens"]).alias("cache_create"), count(usage["cache_read_input_tokens"]).alias("cache_read"),
        count(usage["output_tokens_details"]["thinking_tokens"]).alias("thinking"),
        count(usage["cache_creation"]["ephemeral_1h_input_tokens"]).alias("cache_1h"), count(usage["cache_creation"]["ephemeral_5m_input_tokens"]).alias("cache_5m"),
        F.when(F.coalesce(top["isSidechain"], F.lit(False)), "subagent").otherwise("main").alias("source"),
        t["speed"].alias("speed"), t["inference_geo"].alias("inference_geo"),
    ]


def _cost() -> list[Column]:
    """What is recorded of a decoded line with costs: sums over its models, whose sorted names are kept."""
    top = F.col("j")
    of = lambda field: F.aggregate(F.map_values(top["modelUsage"]), F.lit(0).cast("long"), lambda n, m: n + F.coalesce(m[field], F.lit(0))).cast("long")
    return [
        F.coalesce(top["totalCostUSD"], F.lit(0.0)).alias("cost_usd"),
        of("inputTokens").alias("input"), of("outputTokens").alias("output"), of("thinkingTokens").alias("thinking"),
        of("cacheReadInputTokens").alias("cache_read"), of("cacheCreationInputTokens").alias("cache_create"),
        F.array_join(F.array_sort(F.map_keys(top["modelUsage"])), ",").alias("models"),
    ]


def recorded(decoded_lines: DataFrame) -> DataFrame:
    """Decoded lines as what is recorded of them, without their text, so that they can be kept while several tables are made:
    usage_lines and cost_lines take them too."""
    rest = [c for c in decoded_lines.columns if c not in ("line", "too_long", "j", "t", "ts")]
    return decoded_lines.select(*rest, *_usage(), F.when(F.col("status") == COST, F.struct(*_cost())).alias("cost"))


def usage_lines(decoded_lines: DataFrame, batch_id: int | Column = 0) -> DataFrame:
    """One row for each line with recorded usage; missing counts are 0."""
    own = schemas.names(schemas.USAGE)[3:] if "cost" in decoded_lines.columns else _usage()
    return decoded_lines.filter(F.col("status") == USAGE).select(F.lit(batch_id).cast("long").alias("batch_id"), "path", "offset", *own)


def cost_lines(decoded_lines: DataFrame, captured_at: int, batch_id: int | Column = 0) -> DataFrame:
    """Cost snapshots: sums over the models of a line, whose sorted names are kept."""
    own = ["session_id", "cost.*"] if "cost" in decoded_lines.columns else [F.col("t")["sessionId"].alias("session_id"), *_cost()]
    return decoded_lines.filter(F.col("status") == COST).select(
        *own, F.lit(captured_at).cast("long").alias("captured_at"), F.lit(batch_id).cast("long").alias("batch_id"), "path", "offset"
    )


def counters(decoded_lines: DataFrame) -> DataFrame:
    """One row: lines, usage lines, cost lines, dropped and malformed."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return decoded_lines.agg(F.count("*").alias("lines"), *map(count, (USAGE, COST, DROPPED, MALFORMED)))


def payloads(frame: DataFrame, column: str = "json") -> DataFrame:
    """Adds payload, null if the text isn't an object with the right types throughout."""
    got = _once(frame, "_p", F.from_json(column, schemas.PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    p = F.col("_p")
    bad = p.isNull() | p["_corrupt"].isNotNull() | _unclosed(F.col(column))
    for path in schemas.PAYLOAD_TEXTS:
        bad = bad | _wrong_text(p, path)
    for path in schemas.PAYLOAD_COUNTS:
        bad = bad | F.coalesce(_field(p, path) < 0, F.lit(False))
    text = lambda path: _as_text(_field(p, path)).alias(path.rpartition(".")[2])
    plain = F.struct(
        text("session_id"), text("transcript_path"), text("cwd"),
        F.when(p["model"].isNotNull(), F.struct(text("model.id"), text("model.display_name"))).alias("model"),
        F.when(p["workspace"].isNotNull(), F.struct(text("workspace.current_dir"), text("workspace.project_dir"))).alias("workspace"),
        p["cost"].alias("cost"), p["context_window"].alias("context_window"),
        F.when(p["effort"].isNotNull(), F.struct(text("effort.level"))).alias("effort"), p["rate_limits"].alias("rate_limits"),
    )
    return _once(got, "payload", F.when(~F.coalesce(bad, F.lit(True)), plain)).drop("_p")
