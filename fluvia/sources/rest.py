"""Download planning and state over a pluggable fetcher, and a Spark data source on top of it.

A fetcher is a function (route, station, start, end, token) -> Response; credentials are never stored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TYPES = {"stage": 1, "rainfall": 2, "discharge": 3}
TOKEN_MINUTES = 50
ATTEMPTS = 3


@dataclass(frozen=True)
class Task:
    station: str
    route: str
    start: date
    end: date


@dataclass
class Response:
    status: int | None
    items: list[dict] = field(default_factory=list)
    message: str = ""

    @property
    def denied(self) -> bool:
        text = self.message.lower()
        return self.status in (401, 403) or any(w in text for w in ("token", "autoriz", "auth", "credencial", "expir"))

    @property
    def ok(self) -> bool:
        return self.status is not None and 200 <= self.status < 300 and not self.denied


def legacy_url(base: str, station: str, variable: str, start: date, end: date, level: str = "2") -> str:
    """The address of a legacy XML series."""
    return f"{base}?codEstacao={quote(station)}&dataInicio={start:%d/%m/%Y}&dataFim={end:%d/%m/%Y}&tipoDados={TYPES[variable]}&nivelConsistencia={quote(level)}"


def yearly_tasks(station: str, routes: Sequence[str], start_year: int, end_year: int, as_of: date) -> list[Task]:
    """Years by routes; the running year ends at ``as_of``, later ones are left out."""
    return [Task(station, r, date(y, 1, 1), min(date(y, 12, 31), as_of)) for y in range(start_year, end_year + 1) if date(y, 1, 1) <= as_of for r in routes]


def windows(station: str, route: str, start: date, end: date, days: int = 366) -> list[Task]:
    out = []
    while start <= end:
        stop = min(start + timedelta(days=days - 1), end)
        out.append(Task(station, route, start, stop))
        start = stop + timedelta(days=1)
    return out


@dataclass
class Run:
    """What a download has done: log rows, items, tasks still to do, and why it paused."""

    log: list[dict] = field(default_factory=list)
    items: list[dict] = field(default_factory=list)
    pending: list[Task] = field(default_factory=list)
    paused: str | None = None


def download(tasks: Sequence[Task], fetch: Callable[[str, str, date, date, str], Response], new_token: Callable[[], str], *, done: set[Task] = frozenset(), stop_after: int = 3, clock: Callable[[], float] = time.monotonic, attempts: int = ATTEMPTS) -> Run:
    """Works through the tasks that are not done: up to three attempts each, a new token after 50 minutes or when denied.

    A task that is denied with a new token, or ``stop_after`` failures in a row, pause the run; what is left is pending.
    """
    run = Run()
    token, since, failed = new_token(), clock(), 0
    todo = [t for t in tasks if t not in done]
    for k, task in enumerate(todo):
        if clock() - since >= TOKEN_MINUTES * 60:
            token, since = new_token(), clock()
        response, refreshed = Response(None), False
        for attempt in range(1, attempts + 1):
            response = fetch(task.route, task.station, task.start, task.end, token)
            run.log.append({"station_code": task.station, "route_name": task.route, "date_start": task.start, "date_end": task.end, "attempt": attempt, "http_status": response.status, "success": response.ok, "n_items": len(response.items), "api_message": response.message})
            if response.ok:
                break
            if response.denied:
                if refreshed:
                    run.pending, run.paused = todo[k:], "unauthorized"
                    return run
                token, since, refreshed = new_token(), clock(), True
        failed = 0 if response.ok else failed + 1
        run.items += response.items
        if failed >= stop_after:
            run.pending, run.paused = todo[k + 1 :], "failures"
            return run
    return run


@dataclass
class Outcome:
    """How one task went: ``status`` is success, empty, paused_auth or failed_after_3_attempts."""

    task: Task
    response: Response
    status: str
    n_attempts: int
    token: str


def attempt(task: Task, fetch: Callable[[str, str, date, date, str], Response], token: str, new_token: Callable[[], str] | None = None, attempts: int = ATTEMPTS) -> Outcome:
    """One task with its retries. A denied one gets one new token, if there is a way to get it; an error of the fetcher is a failed attempt."""
    response, refreshed = Response(None, message="no token"), new_token is None
    if not token and new_token is not None:
        token = new_token()
    if not token:
        return Outcome(task, response, "paused_auth", 0, token)
    n = 0
    while n < attempts:
        n += 1
        try:
            response = fetch(task.route, task.station, task.start, task.end, token)
        except Exception as error:  # a connection that fails is one failed attempt, whatever the fetcher raises
            response = Response(None, message=f"{type(error).__name__}: {error}")
            continue
        if response.ok:
            return Outcome(task, response, "success" if response.items else "empty", n, token)
        if response.denied:
            if refreshed:
                return Outcome(task, response, "paused_auth", n, token)
            token, refreshed, n = new_token(), True, n - 1
    return Outcome(task, response, "failed_after_3_attempts", n, token)


class _Slice(InputPartition):
    def __init__(self, tasks: list[Task]) -> None:
        super().__init__(tasks)


class SeriesSource(DataSource):
    """spark.read.format("fluvia_series"): each station's tasks are a partition. The fetcher comes by class attribute.

    ``new_token`` (a class attribute as well) gives tokens: the first one if the option ``token`` is absent, one more
    after 50 minutes or when a task is denied. A task without items is one row whose item is null; its status tells why,
    so that a plan of the tasks still to do can be made of the rows.
    """

    fetch: Callable[[str, str, date, date, str], Response] | None = None
    new_token: Callable[[], str] | None = None

    @classmethod
    def name(cls) -> str:
        return "fluvia_series"

    def schema(self) -> str:
        return "station_code string, route_name string, date_start date, date_end date, http_status int, status string, n_attempts int, message string, item map<string,string>"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options, type(self).fetch, type(self).new_token)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable | None, new_token: Callable | None) -> None:
        if fetch is None:
            raise ValueError("SeriesSource.fetch is not set")
        self.options, self.fetch, self.new_token = options, fetch, new_token

    def partitions(self) -> list[InputPartition]:
        o = self.options
        return [_Slice([t for r in o["routes"].split(",") for t in windows(s, r, date.fromisoformat(o["start"]), date.fromisoformat(o["end"]))]) for s in o["stations"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        token, since = self.options.get("token", ""), time.monotonic()
        if not token and self.new_token is None:
            token = "none"  # a service that needs no token
        for t in partition.value:
            if self.new_token is not None and time.monotonic() - since >= TOKEN_MINUTES * 60:
                token, since = self.new_token(), time.monotonic()
            done = attempt(t, self.fetch, token, self.new_token)
            if done.token != token:
                token, since = done.token, time.monotonic()
            head = (t.station, t.route, t.start, t.end, done.response.status, done.status, done.n_attempts, done.response.message)
            for item in done.response.items or [None]:
                yield *head, None if item is None else {k: None if v is None else str(v) for k, v in item.items()}


def reports(rows: DataFrame) -> DataFrame:
    """One row for each task of the source: its status, attempts, records and message."""
    keys = ["station_code", "route_name", "date_start", "date_end"]
    return rows.groupBy(*keys).agg(F.max("status").alias("status"), F.max("n_attempts").alias("n_attempts"), F.count("item").alias("n_records"), F.max("message").alias("message"))
