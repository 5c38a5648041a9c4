"""Services outside of Spark behind one hook: a callable for each row, paced, tried again by cause, with an answer of our own
where the service has none, and a status for each row.

The default callables are deterministic and need no network, so every pipeline runs without the services. Results are
kept by ``lookup.answered`` with a cache of versions, so a run that was ended goes on with what is not yet known.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

Answer = Callable[[dict], dict]


class Retry(Exception):
    """What a call raises to be tried again: by any cause."""


class Throttled(Retry):
    """The service asks to be left alone for a while (429)."""


class Unavailable(Retry):
    """The service fails for now (5xx)."""


def failure_of(code: int) -> Exception:
    """What a call raises for the code of an HTTP answer that isn't a success."""
    return Throttled(str(code)) if code == 429 else Unavailable(str(code)) if code >= 500 else ValueError(f"answered {code}")


@dataclass
class Patience:
    """How often a call is tried, and how many seconds lie between by the cause; each further pause of a cause is twice the one before."""

    attempts: int = 3
    pauses: dict[type, float] = field(default_factory=lambda: {Throttled: 30.0, Unavailable: 5.0, Retry: 2.0})

    def pause(self, cause: Exception, earlier: int) -> float:
        kind = next(k for k in type(cause).__mro__ if k in self.pauses)
        return self.pauses[kind] * 2**earlier


class Pace:
    """Calls of one task so far apart that all tasks together make at most ``per_second``: each has its equal part of it."""

    def __init__(self, per_second: float | None, tasks: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap = tasks / per_second if per_second else 0.0
        self.clock, self.sleep, self.next = clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.next is not None and now < self.next:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + self.gap


def with_retries(call: Answer, patience: Patience | None = None, pace: Pace | None = None, own: Answer | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable[[dict], tuple[dict | None, str]]:
    """``call`` with its result and a status: ok, timeout, or the error; ``own`` answers what fails, with the status ``own:`` and the cause."""
    patience = patience or Patience()

    def ask(row: dict) -> tuple[dict | None, str]:
        earlier: dict[type, int] = {}
        for k in range(patience.attempts):
            if pace:
                pace.wait()
            try:
                return call(row), "ok"
            except Retry as cause:
                if k + 1 < patience.attempts:
                    sleep(patience.pause(cause, earlier.get(type(cause), 0)))
                    earlier[type(cause)] = earlier.get(type(cause), 0) + 1
            except TimeoutError:
                return None, "timeout"
            except Exception as e:  # any other failure is the row's status
                return None, f"error:{type(e).__name__}"
        return None, "error:retries"

    def run(row: dict) -> tuple[dict | None, str]:
        found, status = ask(row)
        return (found, status) if status == "ok" or own is None else (own(row), f"own:{status.removeprefix('error:')}")

    return run


def enrich(rows: DataFrame, call: Answer, fields: str, patience: Patience | None = None, own: Answer | None = None, per_second: float | None = None, tasks: int | None = None) -> DataFrame:
    """Rows with the ``fields`` ("name type, ...") of what ``call`` makes of each, null on failure, and ``status``.

    A task works one row at a time, so the number of partitions bounds how many calls run at once. With ``per_second``
    the rows are dealt to ``tasks`` partitions, whose parts of that rate add up to it even if all run at once.
    """
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    kept = rows.columns
    if per_second:
        tasks = tasks or 4
        rows = rows.repartition(tasks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = with_retries(call, patience, Pace(per_second, tasks or 1) if per_second else None, own)
        for frame in frames:
            found = [ask(r) for r in frame.to_dict("records")]
            out = frame.assign(**{n: [(f or {}).get(n) for f, _ in found] for n in names}, status=[s for _, s in found])
            yield out[[*kept, *names, "status"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, {fields}, status string")


def untranslated(row: dict) -> dict:
    """The default translation: the text as it is."""
    return {"translated": row["text"]}


def directions(row: dict) -> dict:
    """The default directions of a record with a metro (``metro``, ``metro_lines``, ``metro_minutes``) or a bus (``bus``, ``bus_minutes``), or neither."""
    told = {}
    if pd.notna(row["metro"]):
        told["metro"] = f"Take the {row['metro_lines']} line to {row['metro']}, then walk {row['metro_minutes']:.0f} minutes."
    if pd.notna(row["bus"]):
        told["bus"] = f"Take bus {row['bus']}, then walk {row['bus_minutes']:.0f} minutes."
    best = "metro" if "metro" in told and ("bus" not in told or row["metro_minutes"] <= row["bus_minutes"]) else "bus" if "bus" in told else None
    return {"directions": " ".join(told.values()) or None, "recommended": best}
