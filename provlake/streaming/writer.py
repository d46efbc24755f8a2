"""Continuous writing: a stream's micro-batches, or frames buffered by a thread."""

from __future__ import annotations

import queue
import threading
import time
from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import columns as C
from ..sources.store import Store


def write_stream(store: Store, key: Any, stream: DataFrame, *, checkpoint: str, trigger: dict[str, Any] | None = None, make: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append each micro-batch to the feature's table.

    A batch that is replayed after a failure is appended again; reading keeps one row of an id, so what
    is read stays the same. ``make`` turns a batch into the feature's rows.
    """

    def one(df: DataFrame, batch: int) -> None:
        with store.open("w"):
            store.write(key, make(df) if make else df, run_id=f"batch-{batch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def with_versions(df: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """A root's rows with per-field provenance: a hash of the columns that each field stands for."""
    each = {f: F.substring(F.md5(F.concat_ws("|", *[F.coalesce(C.col(c).cast("string"), F.lit("")) for c in cols])), 1, 8) for f, cols in fields.items()}
    return df.withColumn(C.PROV_BY_FIELD, C.by_field(each))


class BufferedWriter:
    """Collects frames and appends them together, in a thread, after so many rows or seconds, or on demand.

    A failure is raised by the next put, flush or close; the frames that failed aren't tried again.
    """

    def __init__(self, store: Store, *, rows: int = 10_000, seconds: float = 5.0):
        self.store, self.rows, self.seconds = store, rows, seconds
        self.written: dict[str, int] = defaultdict(int)
        self._in: queue.Queue = queue.Queue()
        self._error: BaseException | None = None
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def __enter__(self) -> BufferedWriter:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def put(self, key: Any, df: DataFrame, n: int | None = None) -> None:
        self._raise()
        self._in.put(("rows", str(key), df, df.count() if n is None else n))

    def flush(self, timeout: float | None = None) -> None:
        done = threading.Event()
        self._in.put(("flush", done))
        done.wait(timeout)
        self._raise()

    def close(self) -> None:
        self._in.put(("stop",))
        self._thread.join()
        self._raise()

    def _raise(self) -> None:
        if self._error is not None:
            e, self._error = self._error, None
            raise RuntimeError("buffered rows couldn't be written") from e

    def _run(self) -> None:
        held: dict[str, list[tuple[DataFrame, int]]] = defaultdict(list)
        since = time.monotonic()
        while True:
            try:
                x = self._in.get(timeout=max(0.01, self.seconds - (time.monotonic() - since)))
            except queue.Empty:
                x = ("flush", None)
            if x[0] == "rows":
                if not held:
                    since = time.monotonic()
                held[x[1]].append(x[2:])
                if sum(n for v in held.values() for _, n in v) < self.rows:
                    continue
            try:
                self._write(held)
            except BaseException as e:  # noqa: BLE001
                self._error = e
            held = defaultdict(list)
            since = time.monotonic()
            if x[0] == "flush" and x[1] is not None:
                x[1].set()
            if x[0] == "stop":
                return

    def _write(self, held: dict[str, list[tuple[DataFrame, int]]]) -> None:
        frames = {k: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df for df, _ in v]) for k, v in held.items()}
        if frames:
            with self.store.open("w"):
                self.store.write_many(frames)
            for k, v in held.items():
                self.written[k] += sum(n for _, n in v)
