"""Ordered operators over streams: one machine for each key, its state in the state store, its rows in their order."""

from __future__ import annotations

import json
import pickle
import time
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.fold import unused

#: Rows that wait in one state entry, and rows of a key that are sorted at once before they are cut in such blocks.
BLOCK, RUN = 512, 65_536
#: Groups that packed operators deal their keys in, state entries that a group's keys share, and rows of an output batch.
GROUPS, SLOTS, OUT = 1024, 64, 8192

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """These operators have several states, timers and maps, which only this provider keeps; another one that was set stays."""
    given = spark.conf.get(PROVIDER, "")
    if not given or given.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)


class Machine:
    """What an operator does with the rows of one key. ``state``: the fields that it keeps, as DDL; ``output``: those that it returns."""

    state, output = "", ""

    def open(self, handle) -> None:
        """Ask for more states than the one value."""

    def start(self) -> None:
        """A key that has no state."""
        raise NotImplementedError

    def load(self, values: tuple) -> None:
        raise NotImplementedError

    def dump(self) -> tuple:
        raise NotImplementedError

    def step(self, row: Row) -> Iterable[tuple]:
        raise NotImplementedError

    def late(self, row: Row) -> Iterable[tuple]:
        """A row whose order is not above the last one seen."""
        return ()

    def wake(self, now_ms: int) -> Iterable[tuple]:
        """The watermark has come to ``now_ms``."""
        return ()

    def gone(self) -> bool:
        """Whether nothing is left to keep: the key's state row goes."""
        return False

    def due(self) -> list[int]:
        """Milliseconds at which to be woken; the end of a micro-batch for this key."""
        return []


class Carrying(Machine):
    """Returns rows that came in, their columns ``names``, and more: ``adds``, as DDL. ``inputs``: columns that ``step`` reads besides.

    ``packed`` is set where ``names`` go along outside: then a step returns what it adds, and at most one row for the row it was given.
    """

    names: list[str] = []
    adds, inputs, packed = "", (), False

    def head(self, row) -> tuple:
        return () if self.packed else tuple(row[c] for c in self.names)


def _place(row: tuple) -> tuple:
    """Millisecond and order of a row that waits."""
    return row[0]


def _first(rows: list[tuple], ms: int) -> int:
    """How many of the sorted rows come before this millisecond."""
    return bisect_left(rows, ms, key=lambda r: r[0][0])


class _Waiting(StatefulProcessor):
    """Rows that wait in map state, sorted, in blocks: by the millisecond of the first row; the task's start and a number tell
    blocks apart, in the order of arrival. A row is a tuple that begins with its place."""

    def open_held(self, handle) -> None:
        self.held = handle.getMapState("held", "ms long, task long, n long", "rows binary")
        self.task, self.n = time.time_ns(), 0

    def _wait(self, rows: list[tuple]) -> int:
        """Keep ``rows``, sorted, in blocks; the first millisecond of them."""
        for k in range(0, len(rows), BLOCK):
            block = rows[k : k + BLOCK]
            self.held.updateValue((block[0][0][0], self.task, self.n), (pickle.dumps(block, 5),))
            self.n += 1
        return rows[0][0][0]

    def _runs(self, now: int) -> Iterator[list[tuple]]:
        """The rows that the watermark has passed, in order and in runs; a timer for the first of those that still wait."""
        blocks, rows, least, full = sorted(self.held.keys()), [], None, RUN
        for block in blocks:
            if block[0] > now:
                least = block[0]
                break
            if len(rows) >= full:
                # blocks to come begin here: what is before is complete
                rows.sort(key=_place)
                cut = _first(rows, block[0])
                yield rows[:cut]
                rows = rows[cut:]
                full = max(RUN, 2 * len(rows))
            rows += pickle.loads(self.held.getValue(block)[0])
            self.held.removeKey(block)
        rows.sort(key=_place)
        cut = _first(rows, now + 1)
        yield rows[:cut]
        if cut < len(rows):
            first = self._wait(rows[cut:])
            least = first if least is None else min(first, least)
        if least is not None:
            self.handle.registerTimer(least)

    def close(self) -> None:
        return None


class Ordered(_Waiting):
    """Runs a machine. With ``hold`` rows wait until the watermark has passed them and then come in the order of time and
    ``order``, however they arrived; else the rows of a micro-batch come in ``order``, those not above the last one seen as late.

    Rows wait in blocks, sorted: what a micro-batch brings a key is a state entry for each ``BLOCK`` rows and one timer, and what
    becomes due is read block by block, so a key may have more rows than memory holds.
    """

    def __init__(self, machine: Machine, schema: T.StructType, order: list[str], output: list[str], hold: bool, time: str | None):
        self.machine, self.names, self.order, self.output, self.hold, self.time, self.timed = machine, schema.names, order, output, hold, time, time is not None

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", ("last long, " if not self.hold else "") + self.machine.state)
        if self.hold:
            self.open_held(handle)
        self.machine.open(handle)
        self.make, self.fields = Row(*self.output), Row(*self.names)
        self.width, self.at = len(self.names), [self.names.index(c) for c in self.order]
        self.done: dict[tuple, int] = {}

    def _load(self) -> None:
        self.last = None
        found = self.value.get() if self.value.exists() else None
        if found is None:
            self.machine.start()
        elif self.hold:
            self.machine.load(tuple(found))
        else:
            self.last, *rest = found
            self.machine.load(tuple(rest))

    def _save(self, now_ms: int) -> None:
        due = self.machine.due()
        values = self.machine.dump()
        if self.hold and self.machine.gone():
            self.value.clear()
        else:
            self.value.update(values if self.hold else (self.last, *values))
        if self.timed:
            for ms in due:
                self.handle.registerTimer(max(ms, now_ms + 1))

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentWatermarkInMs() if self.timed else -1
        at, width = self.at, self.width
        if self.hold:
            t, run, firsts = self.names.index(self.time), [], []
            for row in rows:
                row = tuple(row)[:width]
                place = (row[t], *(row[i] for i in at))
                if None not in place:
                    run.append(((-(-place[0] // 1000), *place[1:]), row))
                    if len(run) == RUN:
                        firsts.append(self._wait(sorted(run, key=_place)))
                        run = []
            if run:
                firsts.append(self._wait(sorted(run, key=_place)))
            if firsts:
                self.handle.registerTimer(max(min(firsts), now))
            return
        rows = [r for r in (tuple(row)[:width] for row in rows) if all(r[i] is not None for i in at)]
        self._load()
        for row in sorted(rows, key=lambda r: [r[i] for i in at]):
            order = row[at[0]]
            late = self.last is not None and order <= self.last
            self.last = self.last if late else order
            row = self.fields(*row)
            for out in self.machine.late(row) if late else self.machine.step(row):
                yield self.make(*out)
        self._save(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        if self.done.get(tuple(key)) == now:  # the key's first timer of a micro-batch does it all
            return
        self.done[tuple(key)] = now
        self._load()
        if self.hold:
            for _, row in chain.from_iterable(self._runs(now)):
                for out in self.machine.step(self.fields(*row)):
                    yield self.make(*out)
        for out in self.machine.wake(now):
            yield self.make(*out)
        self._save(now)


class Packed(_Waiting):
    """Runs a machine that carries its rows for a group of keys at once: rows of all of them wait together, so what a micro-batch reads and
    writes, and the batches to and from Python, grow with the rows and not with the keys.

    Rows come as texts: the key, the columns that the machine reads (``fields``, those of its place first) and the ones that only go along.
    Keys share ``SLOTS`` state entries, each with what it keeps of its keys; the group's value says when a slot has to be woken.
    """

    def __init__(self, machine: Carrying, fields: list[str], places: int, time: str, doubles: list[int], adds: list[str]):
        self.machine, self.fields, self.places, self.time, self.doubles, self.adds = machine, fields, places, time, doubles, adds

    def init(self, handle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "slots binary")
        self.value = handle.getMapState("value", "slot int", "keys binary")
        self.open_held(handle)
        self.machine.open(handle)
        self.done: dict[tuple, int] = {}

    def handleInputRows(self, key, rows, timerValues):
        now, t, run, firsts = timerValues.getCurrentWatermarkInMs(), self.fields.index(self.time), [], []
        for frame in rows:
            for name, given, carried in zip(*(frame.iloc[:, k].tolist() for k in (1, 2, 3))):
                values = list(json.loads(given).values())
                place = (values[t], *values[: self.places])
                if None in place:
                    continue
                for k in self.doubles:
                    if type(values[k]) is str:  # not a number, or infinite
                        values[k] = float(values[k])
                run.append(((-(-place[0] // 1000), *place[1:]), name, values, carried))
            if len(run) >= RUN:
                firsts.append(self._wait(sorted(run, key=_place)))
                run = []
        if run:
            firsts.append(self._wait(sorted(run, key=_place)))
        if firsts:
            self.handle.registerTimer(max(min(firsts), now))
        yield from ()

    def _slot(self, slots: dict[int, dict], k: int) -> dict:
        """A slot's keys, each with its state and the millisecond at which to be woken; read once."""
        if k not in slots:
            slots[k] = pickle.loads(self.value.getValue((k,))[0]) if self.value.containsKey((k,)) else {}
        return slots[k]

    def _load(self, found: tuple | None) -> None:
        if found is None:
            self.machine.start()
        else:
            self.machine.load(found[0])

    def _step(self, now: int) -> Iterator[tuple[str, str]]:
        machine, fields, adds = self.machine, self.fields, self.adds
        dues = pickle.loads(self.due.get()[0]) if self.due.exists() else {}
        slots: dict[int, dict] = {}
        touched: dict[int, set] = {}
        for run in self._runs(now):
            of: dict[str, list] = {}
            for row in run:
                of.setdefault(row[1], []).append(row)
            for name, rows in of.items():
                k = zlib.crc32(name.encode()) % SLOTS
                slot = self._slot(slots, k)
                touched.setdefault(k, set()).add(name)
                self._load(slot.get(name))
                for _, _, values, carried in rows:
                    for out in machine.step(dict(zip(fields, values))):
                        yield carried, json.dumps(dict(zip(adds, out)))
                slot[name] = machine.dump(), None
        for k in {*touched, *(k for k, ms in dues.items() if ms <= now)}:
            slot, new = self._slot(slots, k), touched.get(k, ())
            for name, found in list(slot.items()):
                if name not in new and (found[1] is None or found[1] > now):
                    continue
                machine.load(found[0])
                machine.wake(now)
                due = min(machine.due(), default=None)
                if machine.gone():
                    del slot[name]
                else:
                    slot[name] = machine.dump(), due if due is None else max(due, now + 1)
            least = min((ms for _, ms in slot.values() if ms is not None), default=None)
            dues.pop(k, None)
            if least is not None:
                dues[k] = least
            if slot:
                self.value.updateValue((k,), (pickle.dumps(slot, 5),))
            else:
                self.value.removeKey((k,))
        if dues:
            self.due.update((pickle.dumps(dues, 5),))
            self.handle.registerTimer(min(dues.values()))
        else:
            self.due.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        if self.done.get(tuple(key)) == now:  # the group's first timer of a micro-batch does it all
            return
        self.done[tuple(key)] = now
        rows = []
        for row in self._step(now):
            rows.append(row)
            if len(rows) == OUT:
                yield pd.DataFrame(rows, columns=["carried", "added"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["carried", "added"])


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Types whose values are the same after a way through text: of keys, of what a step reads, of what goes along.
KEYS, READ, ALONG = (*_WHOLE, T.StringType, T.BooleanType), (*_WHOLE, T.StringType, T.BooleanType, T.DoubleType), (*_WHOLE, T.StringType, T.BooleanType, T.DoubleType, T.FloatType, T.DecimalType)


def _run_packed(df: DataFrame, machine: Carrying, keys: list[str], fields: list[str], places: int, t_us: str, stamp: str, adds: T.StructType) -> DataFrame:
    text = lambda columns, **how: F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), how)
    key = text(keys, ignoreNullFields="false")
    group = F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")
    rows = df.select(group.alias("group"), key.alias("key"), text(fields, ignoreNullFields="false").alias("given"), text(machine.names).alias("carried"), F.col(f"`{stamp}`"))
    machine.packed = True
    doubles = [k for k, c in enumerate(fields) if isinstance(df.schema[c].dataType, T.DoubleType)]
    processor = Packed(machine, fields, places, t_us, doubles, adds.names)
    with_state = rows.groupBy("group").transformWithStateInPandas(processor, "carried string, added string", "append", "eventTime")
    how = {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)}
    carried = T.StructType([T.StructField(c, df.schema[c].dataType) for c in machine.names])
    return with_state.select(F.from_json("carried", carried, how).alias("c"), F.from_json("added", adds, how).alias("a")).select("c.*", "a.*")


def run_ordered(df: DataFrame, machine: Machine, keys: list[str], order: list[str], t_us: str | None = None, delay: str | None = None, hold: bool = False) -> DataFrame:
    """The rows that ``machine`` returns for the rows of ``df``, a machine for each key.

    ``delay``: how far the watermark is behind the latest ``t_us`` of all keys; rows behind it are dropped, as everywhere in Spark. With
    ``hold`` they wait for it. Without a delay there are no timers. Rows without an order have no place among the others and are left out,
    as are rows that would wait without a time; a null key is a key. Rows that wait for a machine that carries them are packed, a group of keys
    at once, if the types of their columns allow; their times lie in 1678 to 2261, others fail.
    """
    if hold and not delay:
        raise ValueError("rows that wait need a delay after which they have come")
    with_state_store(df.sparkSession)
    kept = df.schema
    if delay:
        stamp = unused(df, "_event_time")
        df = df.withColumn(stamp, F.timestamp_micros(t_us)).withWatermark(stamp, delay)
    if isinstance(machine, Carrying):
        adds = T.StructType.fromDDL(machine.adds)
        fields = list(dict.fromkeys([*order, t_us, *machine.inputs]))
        if hold and all(isinstance(kept[c].dataType, kinds) for names, kinds in ((keys, KEYS), (fields, READ), (machine.names, ALONG)) for c in names):
            return _run_packed(df, machine, keys, fields, len(order), t_us, stamp, adds)
        machine.output = ", ".join([*(f"`{c}` {kept[c].dataType.simpleString()}" for c in machine.names), machine.adds])
    output = T.StructType.fromDDL(machine.output)
    processor = Ordered(machine, kept, order, output.names, hold, t_us if delay else None)
    return df.groupBy(*keys).transformWithState(processor, output, "append", "eventTime" if delay else "none")
