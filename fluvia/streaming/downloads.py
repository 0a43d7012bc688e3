"""Resumable downloads as a stateful stream: planned windows in, log rows and records out.

The plan is a folder of Parquet files of tasks, read as a stream; a route (of a lane of stations) is a key with state of
its own: how many windows failed in a row, and why it is paused. The log is the stream's sink. A window is finished once
its micro-batch is committed; a query that is killed goes on from its checkpoint and never asks for a finished window
again. Tokens live in the workers' memory for 50 minutes at most and are in no state, log or checkpoint.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fluvia.sources.rest import TOKEN_MINUTES, Response, Task, attempt

TASK = "station_code string, route_name string, date_start date, date_end date"
LOG = "route_name string, lane int, station_code string, date_start date, date_end date, status string, http_status int, n_attempts int, n_items int, message string, items array<map<string,string>>"
#: (token, since) by route in this worker.
_TOKENS: dict[str, tuple[str, float]] = {}


def token_of(route: str, new_token: Callable[[], str] | None, clock: Callable[[], float] = time.monotonic) -> str:
    """The route's token in this worker, a new one after TOKEN_MINUTES; ``none`` for a service that needs none."""
    if new_token is None:
        return "none"
    token, since = _TOKENS.get(route, ("", -1e18))
    if clock() - since >= TOKEN_MINUTES * 60:
        token = new_token()
        _TOKENS[route] = token, clock()
    return token


def remember(route: str, token: str) -> None:
    """A token that a denied window was given; of an empty or known one nothing is kept."""
    if token and token != _TOKENS.get(route, ("",))[0]:
        _TOKENS[route] = token, time.monotonic()


def worker(fetch: Callable[[str, str, date, date, str], Response], new_token: Callable[[], str] | None, stop_after: int, pause_minutes: float) -> Callable:
    """The stateful function of a route: works through a step's windows by date, steps in the order of the plan's files.

    ``stop_after`` failures in a row, or a denied new token, pause the route; windows of a paused route come out as
    ``pending``. A pause ends after ``pause_minutes``, by the state's timeout.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        route, lane = key
        if state.hasTimedOut:
            state.update((0, None))
            return
        failures, paused = state.get if state.exists else (0, None)
        tasks = pd.concat(list(batches)).sort_values(["date_start", "station_code", "date_end"])
        out = []
        for station, start, end in zip(tasks["station_code"], tasks["date_start"], tasks["date_end"], strict=True):
            if paused is not None:
                out.append((route, lane, station, start, end, "pending", None, 0, 0, paused, []))
                continue
            done = attempt(Task(station, route, start, end), fetch, token_of(route, new_token), new_token)
            if new_token is not None:
                remember(route, done.token)
            failures = 0 if done.status in ("success", "empty") else failures + 1
            if done.status == "paused_auth":
                paused = "unauthorized"
            elif failures >= stop_after:
                paused = "failures"
            items = [{k: None if v is None else str(v) for k, v in item.items()} for item in done.response.items]
            out.append((route, lane, station, start, end, done.status, done.response.status, done.n_attempts, len(items), done.response.message, items))
        state.update((failures, paused))
        if paused is not None:
            state.setTimeoutDuration(max(1, int(pause_minutes * 60_000)))
        found = pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])
        found["http_status"] = found["http_status"].astype("Int32")
        yield found

    return run


def plan_downloads(tasks: DataFrame, folder: str, files: int = 1) -> None:
    """Adds tasks (station_code, route_name, date_start, date_end) to a plan, in ``files`` files: as many steps of the stream."""
    tasks.select("station_code", "route_name", "date_start", "date_end").repartitionByRange(files, "date_start", "station_code").write.mode("append").parquet(folder)


def download_stream(
    spark: SparkSession, plan: str, log: str, checkpoint: str, fetch: Callable[[str, str, date, date, str], Response], new_token: Callable[[], str] | None = None, *, lanes: int = 1, files_per_step: int = 1, stop_after: int = 3, pause_minutes: float = 60.0, endless: bool = False
) -> StreamingQuery:
    """Starts the download of a plan; it ends once the plan is done, or, ``endless``, waits for more of it.

    The routes' windows are dealt over ``lanes`` by station, each with its own failures and pauses. ``fetch`` and
    ``new_token`` run on the executors. A step takes ``files_per_step`` files of the plan: what is fetched again after a
    kill are the windows of one step at most. The log is a Parquet folder (see LOG), exactly once for each window.
    """
    tasks = spark.readStream.schema(TASK).option("maxFilesPerTrigger", files_per_step).parquet(plan)
    keyed = tasks.withColumn("lane", F.pmod(F.xxhash64("station_code"), F.lit(lanes)).cast("int"))
    rows = keyed.groupBy("route_name", "lane").applyInPandasWithState(worker(fetch, new_token, stop_after, pause_minutes), LOG, "failures int, paused string", "append", GroupStateTimeout.ProcessingTimeTimeout)
    writer = rows.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint)
    if endless:
        return writer.trigger(processingTime="5 seconds").start()
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"  # the stream reads it as it starts; with it, timeouts keep a finished plan running
    before = spark.conf.get(idle)
    spark.conf.set(idle, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(idle, before)


def unfinished(plan: DataFrame, log: DataFrame) -> DataFrame:
    """The planned windows that the log has not as success or empty: what the next plan has to hold."""
    keys = ["station_code", "route_name", "date_start", "date_end"]
    done = log.where("status in ('success', 'empty')").select(*keys).distinct()
    return plan.select(*keys).distinct().join(done, keys, "left_anti")
