"""Turns at the run tables: one driver at a time decides which submissions become runs.

Drivers share the store's folder only, and nothing in it is updated in place. So turns are
taken as at a bakery. A driver enters, takes a number above all numbers it sees, and waits
until nobody who wants one of its pipelines has a smaller number or has entered without
having one yet. Each step is a folder of its own; whoever enters later sees the number and
takes a larger one. A driver that died is waited for until its claim is older than
PATIENCE; one that is slower than half of that gives its turn up before it writes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import functions as F

from pactline.functions.timestamps import micros_of
from pactline.sources.store import ControlStore, hour_of

PATIENCE = timedelta(minutes=5)
POLL_SECONDS = 0.2

ENTER, NUMBER, LEAVE = 0, 1, 2
CLAIMS = "pipeline string, number bigint, at bigint, hour bigint, owner string, step int"


class TurnLost(RuntimeError):
    """The driver was too slow: others may take it for dead. Nothing was written."""


def _write(store: ControlStore, owner: str, step: int, pipelines: Sequence[str], number: int) -> None:
    now = store.clock()
    rows = [(p, number, micros_of(now)) for p in pipelines]
    frame = store.spark.createDataFrame(rows, "pipeline string, number bigint, at bigint").coalesce(1)
    frame.write.parquet(f"{store.path('claims')}/hour={hour_of(now)}/owner={owner}/step={step}")


def waiting(store: ControlStore, pipelines: Sequence[str]) -> dict[str, tuple[int, int]]:
    """(step, number) of every owner that has entered for one of the pipelines, not left, and is not taken for dead."""
    now, found = store.clock(), None
    # Claims live for minutes: the folders of this hour and the one before hold all of them.
    for hour in sorted({hour_of(now - timedelta(hours=1)), hour_of(now)}):
        rows = store._read(CLAIMS, f"{store.path('claims')}/hour={hour}")
        found = rows if found is None else found.unionByName(rows) if rows is not None else found
    if found is None:
        return {}
    owners = found.where(F.col("pipeline").isin(*pipelines)).groupBy("owner").agg(
        F.max("step").alias("step"), F.max("number").alias("number"), F.min("at").alias("at")
    )
    alive = owners.where((F.col("step") < LEAVE) & (F.col("at") > micros_of(now - PATIENCE)))
    return {r["owner"]: (r["step"], r["number"]) for r in alive.collect()}


@contextmanager
def turn(store: ControlStore, pipelines: Sequence[str]) -> Iterator[Callable[[], None]]:
    """Hold the pipelines' turn; the value checks that it is still held, to be called before a write."""
    pipelines, owner, began = sorted(set(pipelines)), uuid.uuid4().hex, store.clock()

    def check() -> None:
        if store.clock() - began > PATIENCE / 2:
            raise TurnLost("the turn was held for too long; submit again")

    _write(store, owner, ENTER, pipelines, 0)
    try:
        mine = 1 + max((number for _, number in waiting(store, pipelines).values()), default=0)
        _write(store, owner, NUMBER, pipelines, mine)
        while any(
            step == ENTER or (number, other) < (mine, owner)
            for other, (step, number) in waiting(store, pipelines).items() if other != owner
        ):
            check()
            time.sleep(POLL_SECONDS)
        yield check
    finally:
        _write(store, owner, LEAVE, pipelines, 0)
