"""Sinks of batch and streaming results, fan-out, and a progress listener."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener

from ..params import ConfigWatcher

SIGNAL_COLUMNS = ("timestamp_ns", "signal_bias", "signal_volatility", "spread_modifier", "confidence", "latency_us", "strategy_toggle", "strategy_weight")


class Sink(ABC):
    @abstractmethod
    def write(self, df: DataFrame) -> None: ...

    def flush(self) -> None:
        return None


class CsvSink(Sink):
    """CSV files with a header; the first write replaces what is there, later ones append."""

    def __init__(self, path: str):
        self.path, self.mode = path, "overwrite"

    def write(self, df: DataFrame) -> None:
        df.write.mode(self.mode).option("header", True).csv(self.path)
        self.mode = "append"


class NdjsonSink(Sink):
    """One JSON object per line."""

    def __init__(self, path: str):
        self.path, self.mode = path, "overwrite"

    def write(self, df: DataFrame) -> None:
        df.write.mode(self.mode).json(self.path)
        self.mode = "append"


class MemorySink(Sink):
    """Rows in the driver, for tests; ``limit`` bounds what is held."""

    def __init__(self, limit: int = 100_000):
        self.rows, self.limit = [], limit

    def write(self, df: DataFrame) -> None:
        self.rows += df.limit(self.limit - len(self.rows)).collect()

    def clear(self) -> None:
        self.rows = []


class ConsoleSink(Sink):
    def __init__(self, rows: int = 20):
        self.rows = rows

    def write(self, df: DataFrame) -> None:
        df.show(self.rows, truncate=False)


def fan_out(sinks: list[Sink], change: Callable[[DataFrame, object], DataFrame] | None = None, watcher: ConfigWatcher | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: every sink gets every micro-batch, computed once; ``change`` sees the configuration as it is now."""

    def write(df: DataFrame, batch_id: int) -> None:
        if change:
            df = change(df, watcher.current() if watcher else None)
        df = df.persist()
        try:
            for sink in sinks:
                sink.write(df)
                sink.flush()
        finally:
            df.unpersist()

    return write


class ProgressListener(StreamingQueryListener):
    """Rows in, rows a second and the end of each query, told to a callback."""

    def __init__(self, tell: Callable[[str], None], done: Callable[[str | None], None] | None = None):
        self.tell, self.done = tell, done

    def onQueryStarted(self, event):
        self.tell(f"started {event.id}")

    def onQueryProgress(self, event):
        p = event.progress
        self.tell(f"batch {p.batchId}: {p.numInputRows} rows, {p.processedRowsPerSecond:.0f} rows/s")

    def onQueryIdle(self, event):
        return None

    def onQueryTerminated(self, event):
        if self.done:
            self.done(event.exception)
