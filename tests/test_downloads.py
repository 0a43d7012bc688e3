"""Resumable downloads: order, pauses, tokens, and what a killed run asks for again."""

import datetime as dt
import json
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from fluvia.plans import catalog_store
from fluvia.plans.bindings import view
from fluvia.sources.rest import Response
from fluvia.streaming import downloads

DAY = dt.date(2020, 1, 1)


def tasks_of(spark, n, routes=("flow", "rain")):
    return spark.createDataFrame([(f"s{i % 3}", r, DAY + dt.timedelta(days=i), DAY + dt.timedelta(days=i)) for i in range(n) for r in routes], downloads.TASK)


def calls_of(path):
    return [tuple(json.loads(x)) for x in Path(path).read_text().splitlines()] if Path(path).exists() else []


def recorder(path, bad=()):
    def fetch(route, station, start, end, token):
        with open(path, "a") as out:
            out.write(json.dumps([route, station, start.isoformat(), token]) + "\n")
        if (route, start.isoformat()) in bad:
            return Response(500, message="down")
        return Response(200, [{"v": start.day, "w": None}] if start.day % 2 else [])

    return fetch


def test_a_killed_run_repeats_no_finished_window(spark, tmp_path):
    plan, log, check, calls, flag = (str(tmp_path / n) for n in ("plan", "log", "check", "calls", "alive"))
    downloads.plan_downloads(tasks_of(spark, 12), plan, files=6)
    inner = recorder(calls)

    def dies(route, station, start, end, token):
        if Path(calls).exists() and Path(calls).read_text().count("\n") >= 9 and not Path(flag).exists():  # in the third step of four windows each, whichever files come first
            Path(flag).touch()
            raise SystemExit("killed")  # no error that a download handles
        return inner(route, station, start, end, token)

    with pytest.raises(Exception):  # noqa: B017  whatever the stream makes of a worker that goes
        downloads.download_stream(spark, plan, log, check, dies).awaitTermination()
    finished = {(r["route_name"], r["station_code"], r["date_start"].isoformat()) for r in spark.read.parquet(log).collect()}
    before = len(calls_of(calls))
    assert finished and len(finished) < 24
    downloads.download_stream(spark, plan, log, check, dies).awaitTermination()
    again = {c[:3] for c in calls_of(calls)[before:]}
    assert not again & finished
    rows = spark.read.parquet(log).collect()
    assert Counter((r["route_name"], r["station_code"], r["date_start"]) for r in rows).most_common(1)[0][1] == 1 and len(rows) == 24
    assert all(r["status"] == ("success" if r["date_start"].day % 2 else "empty") and r["n_items"] == len(r["items"]) for r in rows)
    assert next(r["items"] for r in rows if r["date_start"].day == 3) == [{"v": "3", "w": None}]
    assert downloads.unfinished(tasks_of(spark, 12), spark.read.parquet(log)).count() == 0


def test_failures_pause_a_route_alone(spark, tmp_path):
    plan, log, check, calls = (str(tmp_path / n) for n in ("plan", "log", "check", "calls"))
    downloads.plan_downloads(tasks_of(spark, 8), plan)
    bad = [("flow", f"2020-01-0{d}") for d in (2, 3, 4)]
    downloads.download_stream(spark, plan, log, check, recorder(calls, bad), stop_after=3).awaitTermination()
    rows = {(r["route_name"], r["date_start"].day): r for r in spark.read.parquet(log).collect()}
    assert [rows["flow", d]["status"] for d in range(1, 9)] == ["success", *["failed_after_3_attempts"] * 3, *["pending"] * 4] and rows["flow", 8]["message"] == "failures"
    assert all(rows["rain", d]["status"] in ("success", "empty") for d in range(1, 9))
    left = downloads.unfinished(tasks_of(spark, 8), spark.read.parquet(log))
    assert sorted(r["date_start"].day for r in left.collect()) == [2, 3, 4, 5, 6, 7, 8]


def test_a_denied_token_is_renewed_once(spark, tmp_path):
    plan, log, check, calls = (str(tmp_path / n) for n in ("plan", "log", "check", "calls"))
    downloads.plan_downloads(tasks_of(spark, 3, ("stage",)), plan)
    count = str(tmp_path / "tokens")

    def new_token():
        with open(count, "a") as out:
            out.write("x")
        return f"t{len(Path(count).read_text())}"

    inner = recorder(calls)

    def fetch(route, station, start, end, token):
        return Response(401, message="token expired") if token == "t1" else inner(route, station, start, end, token)

    downloads.download_stream(spark, plan, log, check, fetch, new_token).awaitTermination()
    assert {c[3] for c in calls_of(calls)} == {"t2"} and len(calls_of(calls)) == 3
    assert "t2" not in "".join(p.read_text(errors="replace") for p in Path(check).rglob("*") if p.is_file())


def test_tokens_last_fifty_minutes():
    downloads._TOKENS.clear()
    made = iter("abc")
    now = [0.0]
    take = lambda: downloads.token_of("r", lambda: next(made), lambda: now[0])
    assert take() == take() == "a"
    now[0] = 50 * 60
    assert take() == "b" and downloads.token_of("r", None) == "none"
    downloads._TOKENS.clear()


def test_query_against_the_windows(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r["route_name"], r["station_code"], r["date_start"]): (r["status"], r["n_attempts"], r["n_items"]) for r in entry.queries()["resumable_downloads"](spark, sf).collect()}
    windows = {(r["route_name"], r["station_code"], r["date_start"]) for r in view(spark, sf, "request_log").select("route_name", "station_code", "date_start").distinct().collect()}
    want = {}
    for route, station, start in windows:
        said = catalog_store.answer(route, station, start, start, "")
        want[route, station, start] = ("failed_after_3_attempts", 3, 0) if not said.ok else ("success" if said.items else "empty", 1, len(said.items))
    assert got == want and {s for s, _, _ in want.values()} == {"success", "empty", "failed_after_3_attempts"}
