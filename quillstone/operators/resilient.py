"""A parallel map whose tasks may fail, take too long or crash: each gets a status of its own."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def _serve(f: Callable[[object], object], there) -> None:
    """The child's loop: values in, (status, result, error) out."""
    while True:
        try:
            value = there.recv()
        except EOFError:
            return
        try:
            r = f(value)
            out = ("success", None if r is None else str(r), None)
        except BaseException as e:  # the child goes on whatever f raises
            out = ("exception", None, f"{type(e).__name__}: {e}")
        there.send(out)


class Isolated:
    """Calls of a function in a child process, which is ended and replaced if a call takes too long or the child dies.

    Nothing that a call does to its process (a loop in C, a crash, changed globals) reaches the caller.
    """

    def __init__(self, f: Callable[[object], object]):
        self.f, self.child, self.here = f, None, None

    def _start(self) -> None:
        fork = multiprocessing.get_context("fork")
        self.here, there = fork.Pipe()
        self.child = fork.Process(target=_serve, args=(self.f, there), daemon=True)
        self.child.start()
        there.close()

    def call(self, value: object, seconds: float = 0.0) -> tuple[str, str | None, str | None]:
        """(status, result as text, error); status success, exception, timeout or crash. seconds 0: no limit."""
        if self.child is None:
            self._start()
        try:
            self.here.send(value)
            if self.here.poll(seconds or None):
                return self.here.recv()
            self.close()
            return "timeout", None, f"longer than {seconds} s"
        except (EOFError, OSError):
            self.child.join()
            code = self.child.exitcode
            self.close()
            return "crash", None, f"the process ended with {code}"

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.here.close()
            self.child = None


def resilient_map(df: DataFrame, key: str, value: str, f: Callable[[object], object], seconds: float = 0.0) -> DataFrame:
    """(key, status, result, error): f of every value as text; status success, exception, timeout or crash.

    One failing row fails no other. A null value is passed on to f. Each task keeps one child process (Isolated). A
    task that Spark repeats runs its rows again.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Isolated(f)
        try:
            for b in batches:
                rows = [worker.call(v, seconds) for v in b.column(1).to_pylist()]
                yield pa.record_batch([b.column(0), *(pa.array([r[i] for r in rows], pa.string()) for i in range(3))], names=[key, "status", "result", "error"])
        finally:
            worker.close()

    return df.select(F.col(key), F.col(value)).mapInArrow(run, f"{key} {kind}, status string, result string, error string")
