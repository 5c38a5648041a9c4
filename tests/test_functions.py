"""Table tests of the scalar rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo, hours, text
from tessera.plans import catalogue
from tessera.operators import equity, metrics, ranking, resolution


def one(spark, column, schema="x string", row=(None,)):
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("raw", "shaped"),
    [("301-555-1234", "(301) 555-1234"), ("1 (301) 555.1234", "(301) 555-1234"), ("555-1234", "555-1234"), (None, None), ("", "")],
)
def test_phone(spark, raw, shaped):
    assert one(spark, text.phone(F.col("x")), row=(raw,)) == shaped


@pytest.mark.parametrize(
    ("metro_m", "bus_m", "mode"),
    [(200, 180, "metro"), (500, 100, "metro"), (800, 100, "bus"), (300, 300, "metro"), (1200, 1500, "metro"), (250, None, "metro"), (1800, 200, "bus"), (1500, 50, "bus"), (None, 150, "bus"), (None, None, None)],
)
def test_transit_mode(spark, metro_m, bus_m, mode):
    walk = [F.round(F.col(c) / geo.NETWORK_M_PER_S / 60, 1) for c in "ab"]
    assert one(spark, geo.transit_mode(*walk), "a int, b int", (metro_m, bus_m)) == mode


def test_haversine(spark):
    there = geo.haversine_m(F.lit(38.9), F.lit(-77.0), F.lit(39.0), F.lit(-77.1))
    back = geo.haversine_m(F.lit(39.0), F.lit(-77.1), F.lit(38.9), F.lit(-77.0))
    a, b = one(spark, there), one(spark, back)
    assert a == pytest.approx(b) and a == pytest.approx(14087, rel=0.01)
    assert one(spark, geo.haversine_m(*[F.lit(x) for x in (38.9, -77.0, 38.9, -77.0)])) == 0


@pytest.mark.parametrize(
    ("raw", "found"),
    [
        ("Mon: 9am-5pm", [("mon", "09:00", "17:00", None)]),
        ("Tue 10:30 a.m. - 12 pm; Thu 1pm-4pm by the side door", [("tue", "10:30", "12:00", None), ("thu", "13:00", "16:00", "by the side door")]),
        ("Mon-Fri 12am to 11pm", [("mon", "00:00", "23:00", None), ("fri", "00:00", "23:00", None)]),
        ("call us", None),
        ("", None),
        (None, None),
        ("Mon 9am", None),
        ("Mon 25 30", None),
    ],
)
def test_parse_hours(spark, raw, found):
    got = one(spark, hours.parse_hours(F.col("x")), row=(raw,))
    assert (got and [tuple(e) for e in got]) == found


@pytest.mark.parametrize(("raw", "found"), [("Mon 9:30-17:30", [("mon", "09:30", "17:30", None)]), ("Mon 10-20, Tue 11-21", [("mon", "10:00", "20:00", None), ("tue", "11:00", "21:00", None)])])
def test_parse_hours_to_the_last_digit(spark, raw, found):
    assert [tuple(e) for e in one(spark, hours.parse_hours(F.col("x")), row=(raw,))] == found


@pytest.mark.parametrize("name", ["facet_filter", "hours_parse", "trending_top4", "weekly_schedule", "access_by_day"])
def test_hours_are_read_once_for_each_text(spark, name):
    """Above the distinct texts, and at few places: a column that is used often or filtered by would be worked out again each time."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    texts = next(k for k, line in enumerate(plan) if "Aggregate" in line and "min(hours" in line)
    assert sum(line.count("regexp_extract_all") for line in plan[: texts + 1]) in range(1, 17)
    assert not any("regexp_extract_all" in line for line in plan[texts + 1 :])


@pytest.mark.parametrize(
    ("raw", "weekday", "minute", "state", "label"),
    [
        ("Mon: 9am-5pm", 0, 540, "open", "Open now - closes 5pm"),
        ("Mon: 9am-5pm", 0, 1020, "opens_this_week", "Monday 9am"),
        ("Mon: 9am-5pm", 0, 500, "opens_today", "Opens today at 9am"),
        ("Mon: 9am-5pm", 6, 500, "opens_this_week", "Tomorrow 9am"),
        ("by appointment", 0, 500, "unknown", "By appointment, call ahead"),
        (None, 0, 500, "unknown", "Call for hours"),
        (", ".join(f"{d} 0:00-23:59" for d in hours.DAYS), 3, 3, "open", "Open 24/7"),
        ("Mon 1pm-2:30pm", 0, 785, "open", "Open now - closes 2:30pm"),
    ],
)
def test_open_status(spark, raw, weekday, minute, state, label):
    got = one(spark, hours.open_status(hours.parse_hours(F.col("x")), F.col("x"), F.lit(weekday), F.lit(minute)), row=(raw,))
    assert tuple(got) == (state, label)


@pytest.mark.parametrize(("zip_code", "state"), [("20001", "DC"), ("20150", "VA"), ("20850", "MD"), ("22201", "VA"), ("90210", None), ("abcde", None), ("200", None), (None, None)])
def test_state(spark, zip_code, state):
    assert one(spark, text.state_of_zip(F.col("x")), row=(zip_code,)) == state


def test_names_and_addresses(spark):
    rows = [("Foo  Bar, Inc.", "foo bar"), ("St. Mary's LLC", "st marys"[:2] + " mary's"), ("A Corp", "a"), (None, None)]
    for raw, clean in rows:
        assert one(spark, text.clean_name(F.col("x")), row=(raw,)) == clean
    assert one(spark, text.slug(F.lit("  Ünï & Co! "))) == "n-co"
    assert one(spark, text.city_of(F.lit("1 Main St, Rockville, MD 20850"))) == "Rockville"
    assert one(spark, text.city_of(F.lit("somewhere"))) is None
    assert one(spark, text.last_zip(F.lit("12345 Oak, MD 20850"))) == "20850"
    assert one(spark, text.url_key(F.lit("HTTP://www.A.org/x//"))) == "https://a.org/x"
    assert one(spark, text.tidy(F.lit("a — b"))) == "a, b"


def test_weather_and_urgency(spark):
    labels = [(0, "Clear sky"), (2, "Partly cloudy"), (45, "Foggy"), (77, "Snow grains"), (76, "Rain showers"), (95, "Thunderstorm"), (90, "Thunderstorm with hail"), (120, "Unknown")]
    for code, label in labels:
        assert one(spark, metrics.weather_label(F.lit(code)))["label"] == label
    for gap, level in [(None, None), (0.01, None), (0.02, "low"), (0.03, "medium"), (0.06, "high")]:
        assert one(spark, equity.urgency(F.col("x")), "x double", (gap,))["level"] == level


def test_common_subsequence():
    assert resolution.common_subsequence("kitten", "sitting") == 4
    assert resolution.common_subsequence("", "x") == 0


def test_token_sort_ratio(spark):
    rows = spark.createDataFrame([("food bank", "bank food"), ("abc", "abd"), ("", ""), (None, "x")], "a string, b string")
    got = [r[0] for r in rows.select(resolution.token_sort_ratio("a", "b")).collect()]
    assert got == pytest.approx([100, 200 * 2 / 6, 100, 0])


def test_merge_order_and_exclusions(spark):
    schema = "ord long, group long, place int, name string, source string, hours string, phone string, requirements array<string>, languages array<string>, accepts_food boolean"
    rows = spark.createDataFrame(
        [
            (1, 1, 2, "b", "cafb", "Mon", "1", ["appointment_required", "photo_id"], ["x"], False),
            (2, 1, 1, "a", "mocofood", "Tue", "", ["walk_in"], ["y", "x"], None),
        ],
        schema,
    )
    got = resolution.merge(rows, ["phone", "hours"], ["languages"], ["accepts_food"]).first()
    assert (got["survivor"], got["name"], got["phone"], got["hours"]) == (2, "a", "1", "Tue")
    assert got["requirements"] == ["walk_in", "photo_id"] and got["languages"] == ["y", "x"]
    assert got["warnings"] == ["hours differ between sources", "walk-in and appointment both reported"] and not got["accepts_food"]


def test_ranking_weights():
    assert all(sum(w) == pytest.approx(1.0) for w in ranking.WEIGHTS.values())


def test_time_labels(spark):
    now = datetime.datetime(2026, 4, 11, 9, 0)
    for start, label in [(datetime.datetime(2026, 4, 11, 17), "Today"), (datetime.datetime(2026, 4, 12, 1), "Tomorrow"), (datetime.datetime(2026, 4, 14, 1), "Tuesday"), (datetime.datetime(2026, 5, 1, 1), "May 1")]:
        assert one(spark, hours.day_label(F.col("a"), F.col("b")), "a timestamp, b timestamp", (start, now)) == label
