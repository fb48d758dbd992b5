"""A circuit breaker for providers over their calls, as a stateful stream and as a batch replay.

Calls are (provider, ts, ok), in the order of (ts, call_id). A provider's breaker opens at the third failure in a row and stays
open for 60 seconds from its last failure; while it is open, calls are refused and their outcome does not count.
The first call after that is let through (half open): one more failure opens it again, a success closes it.

``step`` is the only statement of these rules; the stream runs it with the state that Spark keeps for a provider, the replay with
the rows of a provider streaming by in order, one at a time. The stream holds calls back until the watermark passes
them, so calls that come out of order within the allowed delay are decided in their order; later ones are dropped, as
the watermark defines. State of a provider without calls for ``keep`` is forgotten; it is closed then anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Failures that open a breaker, and microseconds that it stays open.
FAILURES, COOLDOWN = 3, 60_000_000
DECIDED = "provider string, call_id long, ts timestamp, state string, allowed boolean, failures int, open_until timestamp"
State = tuple[int, int]
#: No failures, not open.
CLOSED: State = (0, -1)


def step(state: State, at: int, ok: bool) -> tuple[str, State]:
    """(closed, open or half_open as the call at microsecond ``at`` finds the breaker; the state after it)."""
    failures, until = state
    found = "closed"
    if until >= 0:
        if at < until:
            return "open", state
        found, failures, until = "half_open", FAILURES - 1, -1
    if ok:
        return found, CLOSED
    failures += 1
    return found, (failures, at + COOLDOWN if failures >= FAILURES else -1)


def _decide(provider: str, calls: pd.DataFrame, state: State) -> tuple[pd.DataFrame, State]:
    rows = []
    for call_id, at, ok in zip(calls["call_id"], calls["at"], calls["ok"]):
        found, state = step(state, int(at), bool(ok))
        rows.append((provider, call_id, pd.Timestamp(at, unit="us"), found, found != "open", state[0], None if state[1] < 0 else pd.Timestamp(state[1], unit="us")))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in DECIDED.split(", ")]), state


def _timed(calls: DataFrame) -> DataFrame:
    return calls.select("provider", "call_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "ok")


def replay(calls: DataFrame) -> DataFrame:
    """Each call with the breaker's state: providers are dealt out, sorted by time in their partition, and stream by; no group is held."""
    ordered = _timed(calls).drop("ts").repartition("provider").sortWithinPartitions("provider", "at", "call_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, CLOSED
        for batch in batches:
            for provider, part in batch.groupby("provider", sort=False, dropna=False):
                if provider != now:
                    now, state = provider, CLOSED
                out, state = _decide(provider, part, state)
                yield out

    return ordered.mapInPandas(run, DECIDED)


def stream(calls: DataFrame, delay: str = "30 seconds", keep: int = 600_000) -> DataFrame:
    """The same for a stream of calls, in append mode; ``keep`` is in milliseconds after a provider's last call."""
    state_schema = "failures int, open_until long, waiting array<struct<call_id:long,at:long,ok:boolean>>"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, until, waiting = state.get if state.exists else (0, -1, [])
        held = [(w["call_id"], w["at"], w["ok"]) if isinstance(w, dict) else tuple(w) for w in waiting]
        for batch in batches:
            held += list(zip(batch["call_id"], batch["at"], batch["ok"]))
        passed = state.getCurrentWatermarkMs() * 1000
        ready = sorted((h for h in held if h[1] <= passed), key=lambda h: (h[1], h[0]))
        later = [h for h in held if h[1] > passed]
        out, (failures, until) = _decide(key[0], pd.DataFrame(ready, columns=["call_id", "at", "ok"]), (int(failures), int(until)))
        if state.hasTimedOut and not later:
            state.remove()
        else:
            state.update((int(failures), int(until), [(int(c), int(a), bool(o)) for c, a, o in later]))
            # waiting calls are looked at again once the watermark reaches them
            wake = min(h[1] for h in later) // 1000 + 1 if later else max(passed // 1000, *(h[1] // 1000 for h in held), 0) + keep
            state.setTimeoutTimestamp(int(max(wake, passed // 1000 + 1)))
        yield out

    timed = _timed(calls).withWatermark("ts", delay)
    return timed.groupBy("provider").applyInPandasWithState(run, DECIDED, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def intervals(decided: DataFrame) -> DataFrame:
    """(provider, opened, until): the stretches in which a provider's calls were refused; a failure after half-opening opens a new one."""
    failed = decided.where("open_until is not null and allowed")
    return failed.select("provider", F.col("ts").alias("opened"), F.col("open_until").alias("until"))
