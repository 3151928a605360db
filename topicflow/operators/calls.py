"""Calls to models that may hang, be away for a while, or fail for good.

A scheduler in each task keeps a bounded number of calls in flight, gives each a deadline, tries again after growing
pauses where the kind of error is one that passes, and stops calling once so many calls in a row have failed.
"""

from __future__ import annotations

import heapq
import queue
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from topicflow.operators.models import BatchFunction, ModelFactory

DONE, FAILED, SKIPPED = "done", "failed", "skipped"
#: Inputs that a task holds as Python strings at once.
ROWS_AT_ONCE = 2048
TIMEOUT, CONNECTION, OTHER = "timeout", "connection", "error"


def kind_of_error(error: BaseException) -> str:
    """``timeout``, ``connection`` (the model is away) or ``error`` (this input fails)."""
    if isinstance(error, TimeoutError):
        return TIMEOUT
    return CONNECTION if isinstance(error, ConnectionError) else OTHER


@dataclass(frozen=True)
class CallPolicy:
    """How a task calls its model.

    ``pauses`` has the seconds before the second attempt by kind of error; they double with every further one up to ``longest_pause``. A kind
    that is not named is not tried again. After ``max_failures`` failed calls in a row the task makes no more calls.
    """

    in_flight: int = 1
    deadline: float | None = None
    attempts: int = 3
    pauses: Mapping[str, float] = field(default_factory=lambda: {CONNECTION: 10.0})
    longest_pause: float = 120.0
    max_failures: int | None = 10
    classify: Callable[[BaseException], str] = kind_of_error


@dataclass
class Outcome:
    """What came of one input."""

    result: object = None
    error: str | None = None
    kind: str | None = None
    attempts: int = 0
    status: str = SKIPPED


class Breaker:
    """Counts failed calls in a row; open once there are too many, and from then on."""

    def __init__(self, max_failures: int | None) -> None:
        self.max_failures, self.failures, self.open = max_failures, 0, False

    def record(self, good: bool) -> None:
        self.failures = 0 if good else self.failures + 1
        if self.max_failures is not None and self.failures >= self.max_failures:
            self.open = True

    def room(self, flying: int) -> bool:
        """Whether one more call may start: if all in flight failed, it must not be one too many."""
        return not self.open and (self.max_failures is None or self.failures + flying < self.max_failures)


class Scheduler:
    """Runs one task's calls."""

    def __init__(self, call: BatchFunction, policy: CallPolicy) -> None:
        self.call, self.policy = call, policy
        self.breaker = Breaker(policy.max_failures)
        self.answers: queue.Queue = queue.Queue()
        self.ticket = 0

    def _start(self, text: str) -> int:
        """Call in a thread of its own: one that hangs is left behind and its late answer ignored."""
        self.ticket += 1
        ticket = self.ticket

        def work() -> None:
            try:
                answer = (list(self.call([text]))[0], None)
            except Exception as e:  # any error of the model is an outcome
                answer = (None, e)
            self.answers.put((ticket, *answer))

        threading.Thread(target=work, daemon=True).start()
        return ticket

    def _settle(self, outcome: Outcome, result: object, error: BaseException | None, attempt: int) -> float | None:
        """Note how a call ended; returns the pause before another attempt if there is to be one."""
        self.breaker.record(error is None)
        outcome.attempts = attempt
        if error is None:
            outcome.result, outcome.error, outcome.kind, outcome.status = result, None, None, DONE
            return None
        outcome.kind = self.policy.classify(error)
        outcome.error, outcome.status = f"{type(error).__name__}: {error}", FAILED
        if outcome.kind not in self.policy.pauses or attempt >= self.policy.attempts:
            return None
        return min(self.policy.pauses[outcome.kind] * 2 ** (attempt - 1), self.policy.longest_pause)

    def run(self, texts: Sequence[str]) -> list[Outcome]:
        """Outcomes in the order of the inputs; those not tried once the breaker is open are skipped."""
        outcomes = [Outcome() for _ in texts]
        waiting = [(0.0, i, 1) for i in range(len(texts))]  # ready at, input, attempt
        flying: dict[int, tuple[int, int, float]] = {}  # ticket: input, attempt, deadline
        while waiting or flying:
            now = time.monotonic()
            while waiting and waiting[0][0] <= now and len(flying) < self.policy.in_flight and self.breaker.room(len(flying)):
                _, i, attempt = heapq.heappop(waiting)
                due = now + self.policy.deadline if self.policy.deadline else float("inf")
                flying[self._start(texts[i])] = (i, attempt, due)
            if not flying and self.breaker.open:
                break
            moments = [due for *_, due in flying.values()]
            if waiting and self.breaker.room(len(flying)) and len(flying) < self.policy.in_flight:
                moments.append(waiting[0][0])
            wait = min(moments, default=float("inf")) - now
            ended = []
            try:
                ticket, result, error = self.answers.get(timeout=max(0.0, wait) if wait != float("inf") else None)
                if ticket in flying:
                    ended.append((*flying.pop(ticket)[:2], result, error))
            except queue.Empty:
                now = time.monotonic()
                for ticket in [t for t, (*_, due) in flying.items() if due <= now]:
                    i, attempt, _ = flying.pop(ticket)
                    ended.append((i, attempt, None, TimeoutError(f"no answer within {self.policy.deadline} s")))
            for i, attempt, result, error in ended:
                pause = self._settle(outcomes[i], result, error, attempt)
                if pause is not None:
                    heapq.heappush(waiting, (time.monotonic() + pause, i, attempt + 1))
        return outcomes


def call_model(df: DataFrame, factory: ModelFactory, id_col: str, input_col: str, output: str, policy: CallPolicy, keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row: id, kept columns, output (string), error, kind, attempts, status.

    ``status`` is ``done``, ``failed`` or, where the task had stopped calling before the row's turn, ``skipped``. Every task
    counts its own failures, so a model that always fails gets ``max_failures`` calls from each at most.
    """
    ids = [id_col, *keep]
    columns = [*ids, output, "error", "kind", "attempts", "status"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheduler = Scheduler(factory(), policy)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                outcomes = scheduler.run(batch.column(input_col).to_pylist())
                told = [
                    pa.array([None if o.result is None else str(o.result) for o in outcomes], pa.string()),
                    pa.array([o.error for o in outcomes], pa.string()),
                    pa.array([o.kind for o in outcomes], pa.string()),
                    pa.array([o.attempts for o in outcomes], pa.int32()),
                    pa.array([o.status for o in outcomes], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), *told], columns)

    types = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids]
    return df.select(*ids, input_col).mapInArrow(run, ", ".join([*types, f"`{output}` STRING", "error STRING", "kind STRING", "attempts INT", "status STRING"]))
