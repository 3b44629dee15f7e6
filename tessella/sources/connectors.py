"""Connectors of literature sources: a registry, one call per source, and markers for those that can't answer."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.records import PAPER

Search = Callable[[str, int], Iterable[dict]]
_PROVIDERS: dict[str, Search] = {}
STATUS = "source string, status string, http_status int, retry_after double, message string, returned int"
#: Answers after which trying later may help.
LATER = (408, 425, 429, 500, 502, 503, 504)


class Unavailable(Exception):
    """A source that could not answer: not the same as one that found nothing."""

    def __init__(self, message: str, http_status: int | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.http_status, self.retry_after = http_status, retry_after


def register(name: str) -> Callable[[Search], Search]:
    """Adds a search function (query, limit) -> rows to the registry (UDF01, UDF04)."""

    def add(f: Search) -> Search:
        _PROVIDERS[name] = f
        return f

    return add


def providers() -> list[str]:
    return sorted(_PROVIDERS)


def with_retries(call: Callable[[], list[dict]], attempts: int = 3, cap: float = 5.0, sleep=time.sleep) -> list[dict]:
    """Tries again after answers that ask for it, as long as they ask but at most `cap` seconds (STR07)."""
    for i in range(attempts):
        try:
            return call()
        except Unavailable as why:
            if i + 1 == attempts or why.http_status not in LATER:
                raise
            sleep(min(cap, why.retry_after if why.retry_after is not None else 2.0**i))
    raise AssertionError


def looser(rungs: list[str], search: Callable[[str], list[dict]]) -> tuple[str | None, list[dict]]:
    """The first query of a ladder that finds something (STR07)."""
    for q in rungs:
        if rows := search(q):
            return q, rows
    return None, []


def federated(spark: SparkSession, query: str, sources: list[str] | None = None, limit: int = 5, budget: float = 150.0) -> tuple[DataFrame, DataFrame]:
    """(papers, status): one call for each source at once; a failure or a source over the time budget is a status row, never a lost result (SRC13, SET01)."""
    names = [n for n in (sources or providers()) if n in _PROVIDERS]
    pool = ThreadPoolExecutor(max_workers=max(1, len(names)))
    calls = {n: pool.submit(lambda n=n: list(_PROVIDERS[n](query, limit))) for n in names}
    wait(calls.values(), timeout=budget)
    pool.shutdown(wait=False, cancel_futures=True)
    papers, status = [], []
    fields = [f.split(" ")[0] for f in PAPER.split(", ")]
    for n, call in calls.items():
        if not call.done():
            status.append((n, "unavailable", None, None, "over the time budget", 0))
        elif (why := call.exception()) is not None:
            status.append((n, "unavailable", getattr(why, "http_status", None), getattr(why, "retry_after", None), str(why), 0))
        else:
            rows = call.result()
            papers += [(n, *(r.get(f) for f in fields)) for r in rows]
            status.append((n, "ok" if rows else "empty", None, None, "", len(rows)))
    return spark.createDataFrame(papers, "source string, " + PAPER), spark.createDataFrame(status, STATUS)
