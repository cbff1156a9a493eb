import datetime

import pytest
from ledger_data import usage_frame
from pyspark.sql import functions as F
from talliq.functions import buckets, formats, pricing, render
from talliq.operators import parse
from talliq.plans import reports, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def utc(text):
    return int(datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.UTC).timestamp())


@pytest.mark.parametrize(
    ("ts", "zone", "period", "label"),
    [
        ("2026-09-05T23:30:00", "Pacific/Auckland", "day", "2026-09-06"), ("2026-09-05T23:30:00", "America/New_York", "day", "2026-09-05"), ("2026-09-06T12:00:00", "UTC", "week", "2026-08-31"), ("2026-09-07T00:00:00", "UTC", "week", "2026-09-07"),
        ("2026-08-31T23:30:00", "Pacific/Auckland", "month", "2026-09"), ("2026-08-31T23:30:00", "UTC", "month", "2026-08"), ("1969-12-31T23:00:00", "UTC", "day", "1969-12-31"), ("2026-09-05T10:30:00", "Pacific/Chatham", "day", "2026-09-05"), ("2026-09-05T11:30:00", "Pacific/Chatham", "day", "2026-09-06"), ("2026-09-05T10:30:00", "Pacific/Pago_Pago", "day", "2026-09-04"),
    ],
)
def test_labels(spark, ts, zone, period, label):
    assert value(spark, buckets.label(F.lit(utc(ts)), zone, period)) == label


@pytest.mark.parametrize(("day", "zone", "hours"), [("2026-03-08", "America/New_York", 23), ("2026-11-01", "America/New_York", 25), ("2026-07-01", "America/New_York", 24)])
def test_days_where_clocks_change(spark, day, zone, hours):
    first = buckets.parse_date(day, zone)
    after = buckets.start_of_day(datetime.date.fromisoformat(day) + datetime.timedelta(days=1), zone)
    assert (after - first) == hours * 3600
    for at in (first, first + 4 * 3600, after - 1):
        assert value(spark, buckets.start(F.lit(at), zone, "day")) == first


def test_missing_midnight(spark):
    first = buckets.parse_date("2026-09-06", "America/Santiago")
    assert first == utc("2026-09-06T04:00:00")
    assert value(spark, buckets.start(F.lit(first + 7200), "America/Santiago", "day")) == first


def test_dates():
    assert buckets.parse_date(" 2026-09-05 ", "UTC") == utc("2026-09-05T00:00:00")
    assert [buckets.parse_date(x, "UTC") for x in ("2026-13-01", "2026-9-5", "x", "", "2026-02-30")] == [None] * 5
    with pytest.raises(ValueError, match="--until"):
        reports.resolve(None, "x", "UTC")


@pytest.mark.parametrize(("text", "ts"), [("2026-09-05T10:00:00Z", 1788602400), ("2026-09-05t10:00:00.123456789z", 1788602400), ("2026-09-05 12:00:00+02:00", 1788602400), ("1969-12-31T23:59:59.500Z", -1), ("2026-09-05", None), ("2026-09-05T10:00:00", None), ("2026-99-05T10:00:00Z", None), (None, None)])
def test_rfc3339(spark, text, ts):
    assert value(spark, buckets.parse_rfc3339(F.lit(text).cast("string"))) == ts


@pytest.mark.parametrize(("left", "text"), [(86400, "1d"), (86399, "23h59m"), (7800, "2h10m"), (600, "10m"), (59, "0m"), (0, None), (-5, None)])
def test_countdown(spark, left, text):
    assert value(spark, buckets.countdown(F.lit(1000 + left), F.lit(1000))) == text


@pytest.mark.parametrize(("n", "text"), [(0, "0.0k"), (2718, "2.7k"), (31416, "31k"), (404000, "404k"), (999600, "1000k"), (1310000, "1.3M"), (47200000, "47M"), (512900000, "513M")])
def test_token_count(spark, n, text):
    assert value(spark, formats.token_count(F.lit(n))) == text


@pytest.mark.parametrize(("x", "want"), [(0.0, "$0.00"), (0.005678, "$0.0057"), (1.005, "$1.00"), (9876.5, "$9876.50")])
def test_usd_values(spark, x, want):
    assert value(spark, formats.usd(F.lit(x))) == want == text.usd(x)


def test_texts(spark):
    v = lambda c: value(spark, c)
    assert v(formats.thousands(F.lit(-7654321))) == "-7 654 321" == text.thousands(-7654321)
    assert [v(formats.bytes_human(F.lit(n).cast("long"))) for n in (0, 1023, 5120, 1 << 20, 77 << 20)] == ["0 kB", "0 kB", "5 kB", "1.0 MB", "77.0 MB"]
    assert [v(formats.csv_field(F.lit(x))) for x in ("a", "a,b", 'a"b', "a\nb")] == ["a", '"a,b"', '"a""b"', "a\nb"]
    assert v(formats.shorten_home(F.lit("/home/user2/x"), "/home/user")) == "~2/x"
    assert [v(formats.middle_cut(F.lit(x), 5)) for x in ("abcde", "abcdef", "äöüßxy")] == ["abcde", "ab…ef", "äö…xy"]
    assert v(formats.middle_cut(F.lit("abcdefgh"), 6)) == "abc…gh"
    assert [v(formats.abbreviated_path(F.lit(x), "/home/u")) for x in ("/home/u/projects/deep/repo", "/home/u", "/var/log", "/home/u/.config/nvim", "plain", "/")] == ["~/p/d/repo", "~", "/v/log", "~/.c/nvim", "plain", "/"]
    assert [v(formats.without_parenthesis(F.lit(x))) for x in ("Opus 5 (1M) x", "Opus 5 ", "(a)", "a\t\u2003(b)")] == ["Opus 5", "Opus 5 ", "", "a"]
    assert [v(formats.window_size(F.lit(n))) for n in (200000, 1000000, 1500000, 2000000, 999)] == ["200k", "1M", "1500k", "2M", "999"]
    assert [v(formats.short_cost(F.lit(x))) for x in (0.001, 0.5, 12.346)] == ["0.001", "0.50", "12.35"]


def priced(spark, **tokens):
    r = pricing.priced(usage_frame(spark, [tokens])).first()
    parts = [r[c] for c in pricing.PARTS]
    return (None if parts[0] is None else float(sum(parts)) / 1e6), r["unpriced"]


def test_prices(spark):
    assert priced(spark, input=20_000, cache_read=60_000, output=8_000) == (0.33, 0)
    assert priced(spark, cache_create=700, cache_1h=160, cache_5m=540) == ((160 * 10 + 540 * 6.25) / 1e6, 0)
    assert priced(spark, cache_create=500) == (0.0, 0)  # writes without a split cost nothing, and are not unpriced
    assert priced(spark, model="unknown", input=60, output=40) == (None, 100)
    assert priced(spark, model="claude-haiku-4-5-20251001", output=1_000_000) == (5.0, 0)
    assert priced(spark, model="claude-haiku-4-5-20250101", output=1)[0] is None


def shown(spark, payload, tokens=5000, cost=0.5, branch=None, now=1000, **options):
    frame = parse.payloads(spark.createDataFrame([(payload,)], "json string"))
    got = frame.select(render.line(F.col("payload"), F.lit(tokens), F.lit(cost), F.lit(branch).cast("string"), F.lit(now), home="/home/u", **options).alias("x")).first()["x"]
    for c in (render.RESET, render.GREY, render.RED, render.GREEN, render.YELLOW, render.CYAN, render.ORANGE, render.BLUE, render.MAGENTA, render.TEAL):
        got = got.replace(c, "")
    for icon, name in ((render.ICON_BRANCH, "B"), (render.ICON_MODEL, "M"), (render.ICON_CONTEXT, "C"), (render.ICON_TOKENS, "T"), (render.ICON_LIMITS, "L")):
        got = got.replace(icon, name)
    return got


FULL = """{"workspace":{"current_dir":"/home/u/src/app"},"model":{"display_name":"Opus 5 (1M)"},"cost":{"total_lines_added":41,"total_lines_removed":7},
"context_window":{"context_window_size":200000,"used_percentage":62.5},"effort":{"level":"high"},
"rate_limits":{"five_hour":{"used_percentage":12.5,"resets_at":8800},"seven_day":{"used_percentage":92.0,"resets_at":500}}}"""


def test_status_line(spark):
    assert shown(spark, FULL, branch="main") == "~/s/app B main(+41 -7) • C ██████░░░░ 63% • L 5h 13% (2h10m) 7d 92% • M Opus 5 · 200k · high • T today 5.0k"
    assert shown(spark, FULL, branch="main", short=True, by_cost=True) == "~/s/app • 63% • T today $0.50"
    assert shown(spark, FULL, tokens=0, short=True) == "~/s/app • 63%"
    assert shown(spark, "{}", tokens=0) == " • T today 0.0k"
    assert shown(spark, "not json") == render.NAME
    assert shown(spark, '{"cwd":"/x","rate_limits":{"seven_day":{"used_percentage":5}}}', tokens=1200) == "/x • L 7d 5% • T today 1.2k"
    assert shown(spark, '{"context_window":{"used_percentage":250}}', branch="b" * 40, tokens=0) == f"B {'b' * 16}…{'b' * 15} • C ██████████ 100% • T today 0.0k"
