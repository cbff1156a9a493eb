import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from ledger_data import usage_frame
from pyspark.sql import functions as F
from talliq import schemas
from talliq.operators import merge, parse


def requests(spark, rows):
    return {r["dedupe_key"]: r for r in merge.requests(usage_frame(spark, rows)).collect()}


def test_partial_then_full_then_partial(spark):
    rows = [{"output": 1}, {"output": 589}, {"output": 1}]
    assert requests(spark, rows)["k"]["output"] == 589
    assert [merge.change_count(usage_frame(spark, rows[: n + 1])).first()[0] for n in range(3)] == [1, 2, 2]


def test_first_line_wins_but_tokens_grow(spark):
    r = requests(spark, [{"model": "a", "ts": 5, "session_id": None, "input": 3, "cache_1h": 1}, {"model": "b", "ts": 1, "session_id": "x", "input": 2, "cache_1h": 9}])["k"]
    assert (r["model"], r["ts"], r["session_id"], r["input"], r["cache_1h"]) == ("a", 5, None, 3, 9)


def test_speed_only_from_lines_that_grow(spark):
    rows = [{"output": 5}, {"output": 5, "speed": "ignored"}, {"output": 6, "speed": "taken"}, {"output": 7, "speed": "late"}]
    assert requests(spark, rows)["k"]["speed"] == "taken"


def test_sessions_fold_all_lines(spark):
    rows = [{"ts": 10}, {"ts": 30, "project_dir": "/p"}, {"ts": 50, "project_dir": "/p/www", "dedupe_key": "other"}, {"ts": 99}]
    s = merge.sessions(usage_frame(spark, rows)).first()
    assert (s["project_dir"], s["first_seen"], s["last_seen"]) == ("/p", 10, 99)
    assert merge.sessions(usage_frame(spark, [{"session_id": None}])).count() == 0


_line = st.fixed_dictionaries({
    "dedupe_key": st.sampled_from("ab"), "ts": st.integers(0, 5), "input": st.integers(0, 3), "output": st.integers(0, 3), "thinking": st.integers(0, 2),
    "project_dir": st.sampled_from([None, "x", "y"]), "speed": st.sampled_from([None, "f", "s"]), "session_id": st.sampled_from([None, "s"]),
})


def fold(rows):
    """The merge as an upsert, one line at a time."""
    table = {}
    for r in rows:
        old = table.get(r["dedupe_key"])
        if old is None:
            table[r["dedupe_key"]] = dict(r)
        elif any(r[t] > old[t] for t in ("input", "output", "thinking")):
            for t in ("input", "output", "thinking"):
                old[t] = max(old[t], r[t])
            old["speed"] = old["speed"] if old["speed"] is not None else r["speed"]
    return table


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_line, min_size=1, max_size=12), st.data())
def test_merge_equals_upserts_and_goes_on_from_itself(spark, rows, data):
    want = fold(rows)
    frame = usage_frame(spark, rows)
    got = requests(spark, rows)
    keys = ("ts", "input", "output", "thinking", "project_dir", "speed", "session_id")
    assert {k: [v[c] for c in keys] for k, v in want.items()} == {k: [v[c] for c in keys] for k, v in got.items()}
    cut = data.draw(st.integers(0, len(rows)))
    part = merge.requests(frame.filter(F.col("offset") < cut)).select(*frame.columns)
    again = {r["dedupe_key"]: r for r in merge.requests(part.unionByName(frame.filter(F.col("offset") >= cut))).collect()}
    assert {k: tuple(v) for k, v in again.items()} == {k: tuple(v) for k, v in got.items()}
    sessions = merge.sessions(frame).collect()
    split = merge.sessions(frame.filter(F.col("offset") >= cut), merge.sessions(frame.filter(F.col("offset") < cut))).collect()
    assert sessions == split


def test_tokens_do_not_depend_on_order(spark):
    rows = [{"input": k % 5, "output": k % 3, "dedupe_key": f"k{k % 2}"} for k in range(12)]
    tokens = lambda rows: {k: (r["input"], r["output"]) for k, r in requests(spark, rows).items()}
    shuffled = random.Random(3).sample(rows, len(rows))
    assert tokens(rows) == tokens(shuffled) == tokens(rows + rows)


def test_latest_cost(spark):
    rows = [("s", float(k), 0, 0, 0, 0, 0, "", k, k, "p", 0) for k in (3, 1, 2)]
    assert merge.latest_cost(spark.createDataFrame(rows, schemas.COST_STATE)).first()["cost_usd"] == 3.0


def limits(spark, rows):
    return [tuple(r)[:5] for r in merge.limit_changes(spark.createDataFrame(rows, schemas.LIMITS)).orderBy("ts").collect()]


def test_limits_keep_changes_across_days(spark):
    rows = [(1, 12.5, None, None, None, 0), (2, 12.5, None, None, None, 1), (3, 13.0, None, None, None, 2), (90000, 13.0, None, None, None, 3), (90001, None, None, None, None, 4), (400000, None, None, None, None, 5), (400001, 1.0, 2, None, None, 6)]
    assert [r[0] for r in limits(spark, rows)] == [1, 3, 90001, 400001]
    assert limits(spark, [(1, 1.0, None, None, None, 0), (1, 2.0, None, None, None, 1)]) == [(1, 2.0, None, None, None)]
    assert limits(spark, []) == [] and limits(spark, [(5, None, None, None, None, 0)]) == [(5, None, None, None, None)]


def test_observed_limits(spark):
    texts = ['{"rate_limits":{"five_hour":{}}}', '{"rate_limits":{}}', "{}", "bad"]
    frame = parse.payloads(spark.createDataFrame([(x,) for x in texts], "json string"))
    assert merge.observed_limits(frame, F.lit(7)).collect() == [(7, None, None, None, None, 0)]
