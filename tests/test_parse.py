import json

import pytest

from ledger_data import NOON, SESSION, USAGE_LINES, cost_state, line
from pyspark.sql import functions as F
from talliq import schemas
from talliq.operators import parse


def decoded(spark, lines):
    rows = [("f", i, i + 1, x, x is None, 0, 0) for i, x in enumerate(lines)]
    return parse.decoded(spark.createDataFrame(rows, schemas.RAW))


@pytest.mark.parametrize(
    ("text", "status"),
    [
        (line(), "usage"), ("", "other"), (" \t", "other"), ("{{{", "malformed"), ("[]", "malformed"), ("5", "malformed"), ('{"type":5}', "malformed"), (line() + " tail", "malformed"), (line() + line(), "malformed"), (line() + " {}", "malformed"), ('{"type":"x","cwd":"}{"}', "other"), ("{}", "other"),
        (line(kind="user"), "other"), (line(usage={}), "usage"), ('{"type":"assistant","message":{"id":"x"}}', "other"), (line(key=None), "dropped"), (line(model=None), "dropped"), (line(ts="2026-03-17"), "dropped"),
        (line(ts="nonsense"), "dropped"), (line(model="<synthetic>"), "other"), (line(model="<synthetic>", ts="x"), "dropped"), (line(usage={"input_tokens": "5"}), "malformed"), (line(usage={"input_tokens": 1.5}), "malformed"),
        (line(usage={"input_tokens": None}), "usage"), (cost_state(), "cost"), ('{"type":"cost-state","modelUsage":{}}', "other"), ('{"type":"cost-state","sessionId":"s"}', "other"), (None, "malformed"), (line(session=None, cwd=None), "usage"),
    ],
)
def test_status(spark, text, status):
    assert decoded(spark, [text]).first()["status"] == status


def test_all_statuses_together(spark):
    got = parse.counters(decoded(spark, [*SESSION, "bad", line(key=None)])).first()
    assert tuple(got) == (len(SESSION) + 2, USAGE_LINES, 1, 1, 1)


def test_fields(spark):
    text = line("m", sidechain=True, input=6, output=15, cache_create=31, cache_read=8, thinking=9, cache_1h=27, cache_5m=4, speed="fast", ts="2026-03-17T10:30:00.999+02:00")
    r = parse.usage_lines(decoded(spark, [text]), 3).first()
    assert (r["ts"], r["source"], r["batch_id"], r["speed"], r["inference_geo"]) == (NOON, "subagent", 3, "fast", None)
    assert [r[t] for t in schemas.TOKENS] == [6, 15, 31, 8, 9, 27, 4]


def test_cost_snapshot_sums_models(spark):
    text = cost_state(cost=None, **{"b": {"inputTokens": 1, "outputTokens": None}, "a[1m]": {"inputTokens": 2, "thinkingTokens": 3}})
    r = parse.cost_lines(decoded(spark, [text, cost_state()]), 9).orderBy("offset").collect()
    assert (r[0]["cost_usd"], r[0]["input"], r[0]["output"], r[0]["thinking"], r[0]["models"], r[0]["captured_at"]) == (0.0, 3, 0, 3, "a[1m],b", 9)
    assert (r[1]["input"], r[1]["models"]) == (0, "")


@pytest.mark.parametrize(
    ("text", "good"),
    [("{}", True), ('{"cwd":"/a"}', True), ('{"cwd":5}', False), ("", False), ("[1]", False), ("{}x", False), ('{"model":"x"}', False), ('{"cost":{"total_lines_added":-1}}', False), ('{"unknown":[1],"context_window":{"used_percentage":5}}', True), ('{"rate_limits":{"five_hour":null}}', True), ('{"context_window":{"context_window_size":"9"}}', False)],
)
def test_payload(spark, text, good):
    row = parse.payloads(spark.createDataFrame([(text,)], "json string")).first()
    assert (row["payload"] is not None) == good


def test_payload_fields(spark):
    text = json.dumps({"cwd": "/c", "model": {"id": "i"}, "workspace": {"project_dir": "/p"}, "effort": {"level": "high"}})
    p = parse.payloads(spark.createDataFrame([(text,)], "json string")).select(F.col("payload")).first()["payload"]
    assert (p["cwd"], p["model"]["id"], p["workspace"]["current_dir"], p["effort"]["level"]) == ("/c", "i", None, "high")


def test_lines_are_decoded_once(spark):
    frame = decoded(spark, SESSION)
    for df in (parse.usage_lines(frame), parse.cost_lines(frame, 1), parse.counters(frame), parse.payloads(spark.createDataFrame([("{}",)], "json string"))):
        assert df._jdf.queryExecution().executedPlan().toString().count("from_json") == 1


@pytest.mark.parametrize("field", ["session", "cwd", "key", "model"])
def test_types_of_texts(spark, field):
    texts, others = ["5", "-1.5e3", "true", "NaN", "{x", "[", "0a-1", "Infinity", ""], [5, -1.5, 1e300, True, False, {}, {"a": "b"}, [], ["x"]]
    got = [r["status"] for r in decoded(spark, [line(**{field: x}) for x in texts + others]).orderBy("offset").collect()]
    assert got == ["usage"] * len(texts) + ["malformed"] * len(others)


def test_what_is_kept_of_lines_has_no_text_and_says_the_same(spark):
    frame = decoded(spark, [*SESSION, cost_state("s2", **{"a": {"inputTokens": 2}}), "bad", "", line(key=None)])
    kept = parse.recorded(frame)
    assert not {"line", "j", "t"} & set(kept.columns)
    for make in (parse.usage_lines, lambda f: parse.cost_lines(f, 9, 3), parse.counters):
        assert make(kept).schema.names == make(frame).schema.names and sorted(map(str, make(kept).collect())) == sorted(map(str, make(frame).collect()))
