"""Keyed state with event-time timers: rests of providers, results of boards, silent services, memories of posts.

Every processor takes the rows of a key in the order of their time, whatever order they came in: a row waits in the state until the
watermark has passed it, and a timer wakes the key then. So the results do not depend on how a stream is cut into micro-batches,
restarts go on where they were, and rows that come later than the watermark's delay are dropped by Spark and counted in the query's
progress (numRowsDroppedByWatermark). What a key no longer needs is removed by timers as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom.runtime import shared_folder

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000_000  # microseconds


class HeldValue:
    """A value state that is read and written once for all the rows that a key has in a call, not once a row."""

    def __init__(self, state: Any):
        self.state = state
        self.begin()

    def begin(self) -> None:
        self.known, self.changed, self.value = False, False, None

    def get(self) -> tuple | None:
        if not self.known:
            self.known, self.value = True, tuple(self.state.get()) if self.state.exists() else None
        return self.value

    def exists(self) -> bool:
        return self.get() is not None

    def update(self, value: tuple | None) -> None:
        self.known, self.changed, self.value = True, True, value

    def clear(self) -> None:
        self.update(None)

    def end(self) -> None:
        if self.changed:
            if self.value is None:
                self.state.clear()
            else:
                self.state.update(self.value)


class HeldMap:
    """The same for a map state of bounded size: read whole when it is first asked for; what changed is written in the end."""

    def __init__(self, state: Any):
        self.state = state
        self.begin()

    def begin(self) -> None:
        self.map: dict | None = None
        self.there: set = set()
        self.touched: set = set()

    def _all(self) -> dict:
        if self.map is None:
            plain = lambda row: tuple(x.tolist() if hasattr(x, "tolist") else x for x in row)
            self.map = {plain(k): plain(v) for k, v in self.state.iterator()}
            self.there = set(self.map)
        return self.map

    def containsKey(self, key: tuple) -> bool:  # noqa: N802 (the names of Spark's map state)
        return key in self._all()

    def getValue(self, key: tuple) -> tuple | None:  # noqa: N802
        return self._all().get(key)

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        self._all()[key] = value
        self.touched.add(key)

    def removeKey(self, key: tuple) -> None:  # noqa: N802
        self._all().pop(key, None)
        self.touched.add(key)

    def values(self) -> Iterable[tuple]:
        return self._all().values()

    def clear(self) -> None:
        self.touched |= set(self._all())
        self.map = {}

    def end(self) -> None:
        if self.map is None:
            return
        if not self.map and self.there:
            self.state.clear()
            return
        for key in self.touched:
            if key in self.map:
                self.state.updateValue(key, self.map[key])
            elif key in self.there:
                self.state.removeKey(key)


class InOrder(StatefulProcessor):
    """Rows in the order of (t, id). A subclass has row (columns after t and id), out (its result) and the methods below.

    setup(handle) makes its states by value() and held_map(); tick(now) gives what falls due up to a moment; came(row) takes a row, after tick of its time;
    following() is the next moment at which tick must be called without a row, or None.
    """

    row, out = "", ""

    def setup(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def tick(self, now: int) -> list[tuple]:
        raise NotImplementedError

    def came(self, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def following(self) -> int | None:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", f"t long, id long, {self.row}")
        self.held: list[HeldValue | HeldMap] = []
        self.setup(handle)

    def value(self, handle: StatefulProcessorHandle, name: str, schema: str) -> HeldValue:
        self.held.append(HeldValue(handle.getValueState(name, schema)))
        return self.held[-1]

    def held_map(self, handle: StatefulProcessorHandle, name: str, key: str, schema: str) -> HeldMap:
        self.held.append(HeldMap(handle.getMapState(name, key, schema)))
        return self.held[-1]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names, kinds = zip(("t", "long"), ("id", "long"), *(c.split() for c in self.row.split(", ")), strict=True)
        new = [r for pdf in rows for r in _plain(pdf[list(names)], kinds)]
        return self._settled(key, new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        return self._settled(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _settled(self, key: Any, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        for state in self.held:
            state.begin()
        held = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        rows = sorted([*held, *new], key=lambda r: r[:2])
        out: list[tuple] = []
        n = 0
        for r in rows:
            if r[0] > watermark:
                break
            out += self.tick(r[0])
            out += self.came(r)
            n += 1
        out += self.tick(watermark)
        if n or new:
            self.pending.clear()
            if rows[n:]:
                self.pending.put(rows[n:])
        moments = {-(-m // 1000) for m in (rows[n][0] if rows[n:] else None, self.following()) if m is not None}
        for state in self.held:
            state.end()
        known = set(self.handle.listTimers())
        for m in known - moments:
            self.handle.deleteTimer(m)
        for m in moments - known:
            self.handle.registerTimer(m)
        columns = [c.split()[0] for c in self.out.split(", ")]
        if out:
            pdf = pd.DataFrame([(*key, *r) for r in out], columns=[f"_{i}" for i in range(len(key))] + columns)
            pdf["at"] = pd.to_datetime(pdf["at"], unit="us")
            yield pdf

    def close(self) -> None:
        pass


_PLAIN = {"long": int, "boolean": bool, "array<string>": list}


def _plain(pdf: pd.DataFrame, kinds: list[str]) -> Iterable[tuple]:
    """Rows as Python values of the state's types (pandas has longs with missing ones as floats); missing ones are None."""
    missing = lambda x: x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x)
    return zip(*([None if missing(x) else _PLAIN[kind](x) for x in pdf[c]] for c, kind in zip(pdf.columns, kinds, strict=True)), strict=True)


def _run(stream: DataFrame, keys: list[str], at: str, late: str, columns: dict[str, Column], processor: InOrder) -> DataFrame:
    kinds = dict(stream.dtypes)
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != STATE_STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # the only store with timers
    # own names inside, so that the stream's may be any
    own = [f"_{i}" for i in range(len(keys))]
    rows = stream.select(*(F.col(k).alias(n) for k, n in zip(keys, own, strict=True)), F.col(at).cast("timestamp").alias("_at"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), *(c.alias(n) for n, c in columns.items()))
    out = ", ".join([*(f"{n} {kinds[k]}" for k, n in zip(keys, own, strict=True)), processor.out])
    told = rows.withWatermark("_at", late).groupBy(*own).transformWithStateInPandas(processor, outputStructType=out, outputMode="Append", timeMode="EventTime")
    return told.withColumnsRenamed(dict(zip(own, keys, strict=True)))


class Rests(InOrder):
    """A failed answer rests its key until a moment, a success ends the rest. Calls made meanwhile and ends by time are told."""

    row, out = "until long", "id long, at timestamp, kind string"

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.until = self.value(handle, "until", "until long")

    def _until(self) -> int | None:
        return self.until.get()[0] if self.until.exists() else None

    def tick(self, now: int) -> list[tuple]:
        until = self._until()
        if until is None or until > now:
            return []
        self.until.clear()
        return [(None, until, "reopened")]

    def came(self, row: tuple) -> list[tuple]:
        t, name, until = row
        resting = self.until.exists()
        if until is not None and until > t:
            self.until.update((until,))
        elif resting:
            self.until.clear()
        return [(name, t, "refused")] if resting else []

    def following(self) -> int | None:
        return self._until()


def rests_stream(calls: DataFrame, key: str, at: str, id_column: str, until: Column, late: str = "10 minutes") -> DataFrame:
    """A stream of calls to (key, id, at, kind): 'refused' for a call while its key rested, 'reopened' when a rest ended by time.

    until is the moment to which the call's answer rests the key, null for a success, which ends a rest.
    """
    return _run(calls, [key], at, late, {"id": F.col(id_column).cast("long"), "until": F.unix_micros(until.cast("timestamp"))}, Rests())


def rests_table(calls: DataFrame, key: str, at: str, id_column: str, until: Column, upto: Column) -> DataFrame:
    """The batch twin, for the calls and ends up to a moment: what each call left, seen from the next call."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(at, id_column)
    rows = calls.withColumn("_until", until.cast("timestamp")).where(F.col(at) <= upto).withColumn("_left", F.when(F.col("_until") > F.col(at), F.col("_until")))
    rows = rows.withColumn("_before", F.lag("_left").over(w)).withColumn("_next", F.lead(at).over(w))
    refused = rows.where(F.col(at) < F.col("_before")).select(key, F.col(id_column).cast("long").alias("id"), F.col(at).alias("at"), F.lit("refused").alias("kind"))
    ended = rows.where((F.col("_left") <= upto) & (F.col("_next").isNull() | (F.col("_next") >= F.col("_left"))))
    return refused.unionByName(ended.select(key, F.lit(None).cast("long").alias("id"), F.col("_left").alias("at"), F.lit("reopened").alias("kind")))


class Silence(InOrder):
    """A service that has not beaten for longer than its age is told once, by a timer; its next beat is told as well."""

    row, out = "beat boolean", "at timestamp, kind string"

    def __init__(self, age: int):
        self.age = age

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.last = self.value(handle, "last", "t long, told boolean")

    def tick(self, now: int) -> list[tuple]:
        if not self.last.exists():
            return []
        t, told = self.last.get()
        if told or t + self.age >= now:
            return []
        self.last.update((t, True))
        return [(t + self.age, "silent")]

    def came(self, row: tuple) -> list[tuple]:
        told = self.last.exists() and self.last.get()[1]
        self.last.update((row[0], False))
        return [(row[0], "back")] if told else []

    def following(self) -> int | None:
        if not self.last.exists():
            return None
        t, told = self.last.get()
        return None if told else t + self.age + 1000


def silence_stream(beats: DataFrame, key: str, at: str, id_column: str, age_minutes: float = 20, late: str = "10 minutes") -> DataFrame:
    """A stream of beats to (key, at, kind): 'silent' when nothing came for longer than the age, 'back' at the beat that ends it."""
    return _run(beats, [key], at, late, {"id": F.col(id_column).cast("long"), "beat": F.lit(True)}, Silence(int(age_minutes * 60_000_000)))


class Results(InOrder):
    """A board's results: told once, when all its matches are final and it is due, or at the end of waiting with what is final.

    Due: the hour of the first match's day, and so long after the last start as a match takes. A board that was told is remembered
    for a while, so that rows that come later do not tell it again, and then forgotten.
    """

    row, out = "match long, start long, final boolean", "at timestamp, kind string, final int, matches int"

    def __init__(self, hour: int = 21, length: int = 135 * 60_000_000, wait: int = 4 * HOUR, keep: int = 48 * HOUR, offset: int = 0):
        self.hour, self.length, self.wait, self.keep, self.offset = hour, length, wait, keep, offset

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.matches = self.held_map(handle, "matches", "match long", "start long, final boolean")
        self.board = self.value(handle, "board", "first long, last long, open int, n int, changed long")
        self.told = self.value(handle, "told", "forget long")

    def _moments(self, first: int, last: int) -> tuple[int, int]:
        day = (first + self.offset) // (24 * HOUR) * 24 * HOUR - self.offset
        due = max(day + self.hour * HOUR, last + self.length)
        return due, max(due, last + self.wait)

    def tick(self, now: int) -> list[tuple]:
        if self.told.exists():
            if self.told.get()[0] <= now:
                self.told.clear()
            return []
        if not self.board.exists():
            return []
        first, last, still, n, changed = self.board.get()
        due, end = self._moments(first, last)
        at = max(due, changed) if not still else end
        if min(at, end) > now:
            return []
        kind = "complete" if not still and at <= end else "given up"
        self.matches.clear()
        self.board.clear()
        self.told.update((min(at, end) + self.keep,))
        return [(min(at, end), kind, n - still, n)]

    def came(self, row: tuple) -> list[tuple]:
        t, _, match, start, final = row
        if self.told.exists() or match is None:
            return []
        known = self.matches.getValue((match,)) if self.matches.containsKey((match,)) else None
        was_start, was_final = known if known is not None else (None, False)
        if start is None and was_start is None:
            return []  # a result of a match that the board does not have
        start, final = was_start if start is None else start, bool(was_final or final)
        self.matches.updateValue((match,), (start, final))
        if known is None:
            first, last, still, n, _ = self.board.get() if self.board.exists() else (start, start, 0, 0, t)
            self.board.update((min(first, start), max(last, start), still + (not final), n + 1, t))
        elif start == was_start:
            first, last, still, n, _ = self.board.get()
            self.board.update((first, last, still - (final and not was_final), n, t))
        else:  # a match that was moved: the first and last start are sought anew
            starts = [r[0] for r in self.matches.values()]
            _, _, still, n, _ = self.board.get()
            self.board.update((min(starts), max(starts), still - (final and not was_final), n, t))
        return self.tick(t)

    def following(self) -> int | None:
        if self.told.exists():
            return self.told.get()[0]
        if not self.board.exists():
            return None
        first, last, still, _, changed = self.board.get()
        due, end = self._moments(first, last)
        return end if still else min(max(due, changed), end)


def results_stream(rows: DataFrame, board: str, at: str, id_column: str, match: Column, start: Column, final: Column, late: str = "10 minutes", **limits: int) -> DataFrame:
    """A stream of schedule rows (with a start) and result rows (final) to (board, at, kind, final, matches), each board once."""
    columns = {"id": F.col(id_column).cast("long"), "match": match.cast("long"), "start": F.unix_micros(start.cast("timestamp")), "final": F.coalesce(final, F.lit(False))}
    return _run(rows, [board], at, late, columns, Results(**limits))


class Remembered(InOrder):
    """A memory of posts by an inverted index: key to the posts that have it, in map state.

    Rules are (microseconds, least shared keys, least share of the smaller set): a post repeats a remembered one when any rule holds.
    Only posts that repeat nothing and did not fail are remembered, so repeats do not make a memory last longer. Posts leave after
    the longest window and beyond the most recent ones; a memory in which nothing is left has no state.
    """

    row, out = "keys array<string>, ok boolean", "id long, at timestamp, repeated boolean"

    def __init__(self, rules: list[tuple[int, int, float]], most: int):
        self.rules, self.most, self.longest = rules, most, max(r[0] for r in rules)

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.index = self.held_map(handle, "index", "key string", "posts array<long>")
        self.posts = self.held_map(handle, "posts", "post long", "t long, keys array<string>")
        self.edge = self.value(handle, "edge", "first long, next long, newest long")

    def _forget(self, before: int, room: int) -> None:
        """Drops posts older than a moment, and the oldest beyond the most."""
        if not self.edge.exists():
            return
        first, following, newest = self.edge.get()
        kept = first
        while kept < following:
            t, keys = self.posts.getValue((kept,))
            if t >= before and following - kept + room <= self.most:
                break
            for k in keys:
                rest = [p for p in self.index.getValue((k,))[0] if p != kept]
                if rest:
                    self.index.updateValue((k,), (rest,))
                else:
                    self.index.removeKey((k,))
            self.posts.removeKey((kept,))
            kept += 1
        if kept == following:
            self.edge.clear()
        elif kept != first:
            self.edge.update((kept, following, newest))

    def tick(self, now: int) -> list[tuple]:
        if self.edge.exists() and self.edge.get()[2] + self.longest < now:
            self._forget(now - self.longest, 0)
        return []

    def came(self, row: tuple) -> list[tuple]:
        t, name, keys, ok = row
        keys = sorted(set(keys or []) - {None})
        shared: dict[int, int] = {}
        for k in keys:
            if self.index.containsKey((k,)):
                for p in self.index.getValue((k,))[0]:
                    shared[p] = shared.get(p, 0) + 1
        repeated = False
        for p, n in shared.items():
            then, theirs = self.posts.getValue((p,))
            smaller = min(len(keys), len(theirs))
            if any(t - then <= window and n >= least and n >= share * smaller for window, least, share in self.rules):
                repeated = True
                break
        if not repeated and ok is not False and keys:
            self._forget(t - self.longest, 1)
            first, post, _ = self.edge.get() if self.edge.exists() else (0, 0, 0)
            self.posts.updateValue((post,), (t, keys))
            for k in keys:
                self.index.updateValue((k,), ([*(self.index.getValue((k,))[0] if self.index.containsKey((k,)) else []), post],))
            self.edge.update((first, post + 1, t))
        return [(name, t, repeated)]

    def following(self) -> int | None:
        return self.edge.get()[2] + self.longest + 1000 if self.edge.exists() else None


#: The memories: rules (hours, least shared keys, least share) and the most posts.
MEMORIES: dict[str, tuple[list[tuple[float, int, float]], int]] = {
    "stories": ([(36, 4, 0.6)], 150),
    "heads": ([(12, 3, 0.6)], 80),
    "incidents": ([(18, 4, 0.75), (8, 3, 0.5)], 120),
    "speakers": ([(2, 1, 1.0)], 60),
    "judged": ([(24, 1, 1.0)], 300),
}


def memory_stream(posts: DataFrame, channel: str, at: str, id_column: str, keys: Column, ok: Column, memory: str = "stories", late: str = "10 minutes") -> DataFrame:
    """A stream of posts to (channel, id, at, repeated) by one of the MEMORIES of each channel."""
    rules, most = MEMORIES[memory]
    return _run(posts, [channel], at, late, {"id": F.col(id_column).cast("long"), "keys": keys, "ok": ok}, Remembered([(int(h * HOUR), n, s) for h, n, s in rules], most))


def run_available(result: DataFrame, folder: str, mode: str = "append", seconds: int = 900) -> None:
    """Takes what is there of a stream, in as many micro-batches as it needs, into Parquet files at folder/out, and ends; the next
    run goes on from folder/checkpoint."""
    query = result.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream did not end within {seconds} s")


def in_slices(rows: DataFrame, part: Column, parts: int, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream makes of a table that arrives in parts: it is stopped after each part and started again from its checkpoint."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for k in range(parts):
        rows.where(part == k).write.mode("append").parquet(f"{folder}/in")
        result = make(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        run_available(result, folder)
    return read_results(spark, result, folder)


def read_results(spark: SparkSession, result: DataFrame, folder: str) -> DataFrame:
    return spark.read.schema(result.schema).parquet(f"{folder}/out")
