"""What keeps work and memory in proportion to the input: plans without rows for pairs, broadcasts of points or repeated shuffles."""

import random
import re
from datetime import date, timedelta

import __spark_entry__ as entry
from fluvia.operators import curves, daily, extremes
from fluvia.plans.bindings import view
from fluvia.plans.catalog import AS_OF, MATCH_PART, hq
from fluvia.plans.catalog_store import lanes_for
from fluvia.session import count_parts, spread, unsorted_parts

SF = "/root/testdata/sf0.001"
CURVE = "station_code string, rating_curve_id string, rating_curve_segment_id string, segment_number int, valid_from date, valid_to date, stage_min_cm double, stage_max_cm double, coefficient_a double, coefficient_h0 double, coefficient_n double"
D0 = date(2000, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ribbons_are_not_broadcast(spark):
    """segments meet their envelopes before they become points, and neither side is broadcast."""
    assert "Broadcast" not in plan(entry.queries()["envelope_ribbons"](spark, SF))


def test_nearest_match_makes_no_pairs(spark):
    """The best pair is chosen within a row; it is the best of all pairs."""
    m, c = view(spark, SF, "measurements"), view(spark, SF, "rating_curves")
    best = curves.nearest_matches(m, c, AS_OF)
    names = sorted(best.columns)
    assert plan(best).count("Exchange hashpartitioning") == 2  # measurements and segments, once each
    want = curves.best_matches(curves.match_measurements(m, c, AS_OF)).select(*names)
    assert sorted(map(str, best.select(*names).collect())) == sorted(map(str, want.collect()))


def test_points_of_one_small_file_are_made_by_many_tasks(spark):
    """a table of one file would be one task of all points."""
    assert curves.curve_points(view(spark, SF, "rating_curves")).rdd.getNumPartitions() >= 4


def random_segments(seed, n):
    r = random.Random(seed)
    day = lambda: None if r.random() < 0.2 else D0 + timedelta(days=r.randrange(60))
    stage = lambda: r.choice([None, float("nan"), float("inf"), *map(float, range(0, 60, 5))])
    return [(str(r.randrange(3)), f"c{r.randrange(4)}", f"s{r.randrange(n)}", r.randrange(3), day(), day(), stage(), stage(), float(r.randrange(1, 4)), 0.1, 1.5) for _ in range(n)]


def test_days_meet_stretches_of_time(spark):
    """F2 to F8: days with stretches of equal validity give what days with every segment give, reversed and open periods too."""
    segments = random_segments(7, 60)
    days = [(s, D0 + timedelta(days=d), 1.0, None if d % 9 == 0 else float(d % 60)) for s in "0123" for d in range(-2, 65)]
    out = curves.match_daily(spark.createDataFrame(days, "station_code string, date date, discharge_m3s double, stage_cm double"), spark.createDataFrame(segments, CURVE))
    assert "collect_set" not in plan(out)
    got = {(r["station_code"], r["date"]): r for r in out.collect()}
    known = lambda x: x is not None and abs(x) < float("inf")
    for s, d, _, h in days:
        valid = [x for x in segments if x[0] == s and (x[4] is None or x[4] <= d) and (x[5] is None or d <= x[5])]
        usable = [x for x in valid if h is not None and known(x[6]) and known(x[7]) and x[6] <= h <= x[7]]
        best = min(usable, key=lambda x: (x[4] is None, -(x[4] or D0).toordinal(), x[1], x[3], x[2]), default=None)
        r = got[s, d]
        assert (r["n_valid_date_curve_segments"], r["n_valid_date_rating_curves"], r["n_applicable_curve_segments"], r["n_applicable_rating_curves"]) == (len({x[2] for x in valid}), len({x[1] for x in valid}), len({x[2] for x in usable}), len({x[1] for x in usable}))
        assert r["rating_curve_segment_id"] == (best and best[2]) and r["selected_curve_valid_from"] == (best and best[4])
        assert r["min_valid_stage_cm"] == min((x[6] for x in valid if known(x[6])), default=None) and r["max_valid_stage_cm"] == max((x[7] for x in valid if known(x[7])), default=None)


def test_records_move_and_are_sorted_once(spark):
    """Merged records need one exchange, days with discharge and stage no other."""
    for name in ("raw_merge", "raw_stage_and_flow"):
        df = entry.queries()[name](spark, SF) if name == "raw_merge" else hq(spark, SF)
        assert plan(df).count("Exchange hashpartitioning") == 1


def test_parts_follow_the_input(spark):
    """a task's memory does not grow with the table."""
    rows = view(spark, SF, "raw_rain")
    assert spread(rows, "station_code", each=1 << 30).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(rows, "station_code", each=1).rdd.getNumPartitions() == 4096


def test_demands_are_not_windows(spark):
    """F16: the demands of a station fold one array of its months; no window sorts a copy of them for each demand."""
    assert not [line for line in plan(entry.queries()["regularization"](spark, SF)).splitlines() if "Window [" in line and "demand_pct_qmlt" in line]


def test_days_and_curves_are_dealt_once(spark):
    """Whatever the session's number of partitions, matched days move no more and are not put together to larger tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for name in ("curve_match", "coverage_metrics", "issue_report"):
            text = plan(entry.queries()[name](spark, SF))
            assert text.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in text
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


DAY_SORT = r"Sort \[station_code#\d+ ASC NULLS FIRST(?:, date#\d+ ASC NULLS FIRST)?\]"


def test_coverage_sorts_records_alone(spark):
    """days were sorted for their join and again for their gaps, while the sorted records were still held."""
    assert len(re.findall(DAY_SORT, plan(entry.queries()["coverage_metrics"](spark, SF)))) == 1


def test_rows_meet_stretches_before_they_are_days(spark):
    """Rows that stand for several days give what their days give, over bounds of curves and for stations without any."""
    r = random.Random(3)
    records = [(s, D0 + timedelta(days=d), r.choice([None, 1.0, 2.0]), r.choice([None, float(d % 60)])) for s in "0123" for d in sorted(r.sample(range(-5, 90), 25))]
    rows = spark.createDataFrame(records, "station_code string, date date, discharge_m3s double, stage_cm double")
    segments = spark.createDataFrame(random_segments(11, 40), CURVE)
    want = curves.match_daily(daily.complete_grid(rows), segments)
    got = curves.match_daily(curves.with_gaps(daily.with_until(rows)), segments, until="until")
    assert got.drop("gap_days").columns == want.columns
    assert sorted(map(str, got.drop("gap_days").collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, curves.coverage(got).collect())) == sorted(map(str, curves.coverage(want).collect()))


def test_parts_stay_unsorted_while_they_are_small(spark):
    """With over 200 parts a task that writes holds its whole split; more come only where parts would pass the greater size."""
    rows = view(spark, SF, "raw_flow")
    size = count_parts(rows, 1)
    assert size == 4096 and unsorted_parts(rows, 1, 1 << 30) == 200 and unsorted_parts(rows, 1, 1) == 4096
    assert unsorted_parts(rows, *MATCH_PART) == spark.sparkContext.defaultParallelism


def test_records_of_six_gigabytes_are_written_unsorted(spark):
    """the records of 6 GB of tables (4.7 GB as Catalyst estimates them) had some 280 parts, for which a task that writes holds its whole split; beyond 6.7 GB parts follow the input."""
    rows = lambda size: spark.range(size // 8)
    assert unsorted_parts(rows(4_700_000_000), *MATCH_PART) == 200
    assert unsorted_parts(rows(64 << 30), *MATCH_PART) == 2048


def test_rain_maxima_read_their_days_once(spark):
    """days, windows and windows at the maximum came from three sorts and windows of all days."""
    assert plan(entry.queries()["rain_annual_maxima"](spark, SF)).count("Generate posexplode") == 1


def test_days_of_maxima_follow_the_input(spark):
    """a task's days were what adaptive execution put together, which grows to 64 MB of compressed days."""
    days = [("1", D0 + timedelta(days=d), float(d % 40)) for d in range(800)]
    text = plan(extremes.annual_maxima(spark.createDataFrame(days, "station_code string, date date, discharge_m3s double")))
    assert "REPARTITION_BY_NUM" in text


def test_lanes_follow_the_log():
    """four lanes of any log held a twentieth of a step's windows in one worker."""
    assert lanes_for(100) == 4 and lanes_for(36_000_000) == 1440
