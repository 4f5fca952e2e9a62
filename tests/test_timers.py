"""Keyed state with timers: several micro-batches and restarts equal plain replays."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.plans import catalog, states
from newsloom.streaming import stories, timers

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def streamed(spark, tmp_path, schema, slices, make):
    """The result of a stream that is stopped and started again after each slice."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    for i, rows in enumerate(slices):
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(source)
        result = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1 if i == 0 else 100).parquet(source))
        timers.run_available(result, folder, seconds=120)
    return sorted(map(tuple, timers.read_results(spark, result, folder).collect()), key=repr)


def jittered(rows, rng, parts):
    """Rows (with the time at place 2) in order of arrival: up to 25 minutes late, cut into parts."""
    arrived = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rng.uniform(0, 25)))
    n = -(-len(arrived) // parts)
    return [arrived[i : i + n] for i in range(0, len(arrived), n)]


CALLS = "key string, id long, t timestamp, until timestamp"


def calls(rng, n=90):
    out = []
    for i in range(n):
        t = at(7 * i + rng.choice([0, 0, 3]))
        rest = rng.choice([None, None, 5, 20, 300])
        out.append((f"p{i % 3}", i, t, None if rest is None else t + timedelta(minutes=rest)))
    return out


def plain_rests(rows, upto):
    out, until = [], {}
    for key, name, t, rest in sorted(rows, key=lambda r: (r[2], r[1])):
        if t > upto:
            break
        if key in until and until[key] <= t:
            out.append((key, None, until.pop(key), "reopened"))
        if key in until:
            out.append((key, name, t, "refused"))
        until.pop(key, None)
        if rest is not None and rest > t:
            until[key] = rest
    out += [(key, None, u, "reopened") for key, u in until.items() if u <= upto]
    return sorted(out, key=repr)


def test_rests_over_micro_batches_and_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = calls(rng)
    got = streamed(spark, tmp_path, CALLS, jittered(rows, rng, 3), lambda s: timers.rests_stream(s, "key", "t", "id", F.col("until"), "30 minutes"))
    upto = max(r[2] for r in rows) - timedelta(minutes=30)
    assert got == plain_rests(rows, upto)
    assert {r[3] for r in got} == {"refused", "reopened"}
    table = timers.rests_table(spark.createDataFrame(rows, CALLS), "key", "t", "id", F.col("until"), F.lit(upto))
    assert sorted(map(tuple, table.collect()), key=repr) == got


def test_silence_is_told_once_and_ends(spark, tmp_path):
    rng, beats, n = random.Random(2), [], 0
    for key in "abc":
        t = 0.0
        while t < 900:
            t += rng.choice([5, 9, 20, 20.5, 60])
            beats.append((key, n, at(t), None))
            n += 1
    beats.append(("dead", n, at(3), None))
    got = streamed(spark, tmp_path, CALLS, jittered(beats, rng, 3), lambda s: timers.silence_stream(s, "key", "t", "id", 20, "30 minutes"))
    upto = max(r[2] for r in beats) - timedelta(minutes=30)
    expected = []
    for key in {b[0] for b in beats}:
        times = sorted(b[2] for b in beats if b[0] == key and b[2] <= upto)
        for a, b in zip(times, [*times[1:], None], strict=True):
            end = a + timedelta(minutes=20)
            if (b is None and end < upto) or (b is not None and b > end):
                expected.append((key, end, "silent"))
                expected += [(key, b, "back")] if b is not None else []
    assert got == sorted(expected, key=repr)
    assert ("dead", at(23), "silent") in got and ("dead", at(23), "back") not in got


MATCHES = "board string, id long, t timestamp, match long, start timestamp, final boolean"


def test_boards_are_told_once(spark, tmp_path):
    """early: final before it is due; late: final after; open: never; empty: no matches; again: rows after it was told."""
    d = at(0).replace(hour=0)
    h = lambda x: d + timedelta(hours=x)
    rows, n = [], 0

    def add(board, t, match, start=None, final=False):
        nonlocal n
        rows.append((board, n, h(t), match, None if start is None else h(start), final))
        n += 1

    for board, ends in (("early", (17, 18)), ("late", (17, 21.5)), ("open", (17, None)), ("again", (17, 18)), ("after", (17, 24.5))):
        add(board, 8, 1, 15)
        add(board, 8, 2, {"open": 20, "after": 20, "late": 19}.get(board, 16))
        for match, end in zip((1, 2), ends, strict=True):
            if end:
                add(board, end, match, final=True)
    add("again", 22, 3, 30)
    add("again", 23, 2, final=True)
    add("empty", 9, 7, final=True)
    add("clock", 40, 1, 60)
    rows.sort(key=lambda r: r[2])
    slices = [rows[:9], rows[9:16], rows[16:]]
    got = streamed(spark, tmp_path, MATCHES, slices, lambda s: timers.results_stream(s, "board", "t", "id", F.col("match"), F.col("start"), F.col("final"), "30 minutes"))
    assert got == sorted([("early", h(21), "complete", 2, 2), ("late", h(21.5), "complete", 2, 2), ("open", h(24), "given up", 1, 2), ("again", h(21), "complete", 2, 2), ("after", h(24), "given up", 1, 2)], key=repr)


POSTS = "channel string, id long, t timestamp, keys array<string>, ok boolean"


def plain_memory(rows, rules, most, upto):
    """A list scan: every post against all remembered ones."""
    out, memory = {}, {}
    for channel, name, t, keys, ok in sorted(rows, key=lambda r: (r[2], r[1])):
        if t > upto:
            break
        held, keys = memory.setdefault(channel, []), set(keys or [])
        seen = any(t - then <= timedelta(hours=h) and len(keys & k) >= n and len(keys & k) >= s * min(len(keys), len(k)) for then, k in held for h, n, s in rules)
        out[name] = seen
        if not seen and ok is not False and keys:
            longest = max(r[0] for r in rules)
            memory[channel] = [m for m in held if t - m[0] <= timedelta(hours=longest)][-(most - 1) :] + [(t, keys)]
    return out


@pytest.mark.parametrize("name", ["stories", "incidents"])
def test_memories_equal_a_list_scan(spark, tmp_path, name, monkeypatch):
    rules, most = timers.MEMORIES[name]
    most = 5
    monkeypatch.setitem(timers.MEMORIES, name, (rules, most))
    rng = random.Random(3)
    rows = [(f"c{i % 2}", i, at(95 * i), rng.choice([None, [], *([[f"k{x}" for x in rng.sample(range(7), 5)]] * 8)]), rng.choice([True, True, False, None])) for i in range(100)]
    got = streamed(spark, tmp_path, POSTS, jittered(rows, rng, 2), lambda s: timers.memory_stream(s, "channel", "t", "id", F.col("keys"), F.col("ok"), name, "30 minutes"))
    want = plain_memory(rows, rules, most, max(r[2] for r in rows) - timedelta(minutes=30))
    assert {r[1]: r[3] for r in got} == want and len(got) == len(want)
    assert any(want.values()) and not all(want.values())


class Store:
    """State in memory, to look into."""

    def __init__(self):
        self.map, self.value = {}, None

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    update = lambda self, v: setattr(self, "value", v)
    containsKey = lambda self, k: k in self.map  # noqa: E731, N815
    getValue = lambda self, k: self.map.get(k)  # noqa: E731, N815
    updateValue = lambda self, k, v: self.map.__setitem__(k, v)  # noqa: E731, N815
    removeKey = lambda self, k: self.map.pop(k)  # noqa: E731, N815

    def clear(self):
        self.map, self.value = {}, None


def test_a_memory_is_bounded_and_empties():
    memory = timers.Remembered([(36 * timers.HOUR, 4, 0.6)], 20)
    memory.index, memory.posts, memory.edge = Store(), Store(), Store()
    for i in range(500):
        memory.tick(i * 60_000_000)
        memory.came((i * 60_000_000, i, [f"k{i}", f"m{i % 7}"], True))
        assert len(memory.posts.map) <= 20 and len(memory.index.map) <= 40
    memory.tick(memory.following())
    assert not memory.posts.map and not memory.index.map and memory.following() is None


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("query", "name"), [("memory_streamed", "stories"), ("incidents_streamed", "incidents")])
def test_registered_memories_equal_a_list_scan(spark, query, name):
    rows = [tuple(r) for r in states.posts(spark, SF).select("channel", "event_id", "ts", "keys", "ok").collect()]
    got = catalog.QUERIES[query](spark, SF).collect()
    want = plain_memory(rows, *timers.MEMORIES[name], max(r[2] for r in rows) - timedelta(hours=2))
    assert {r.id: r.repeated for r in got} == want and len(got) == len(want)
    assert 0 < sum(want.values()) < len(want)


def test_remembered_repeats_equal_a_list_scan(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).collect()
    rows = [(str(r.user_id), r.event_id, r.ts, [r.event_type, None if r.k is None else f"k{r.k // 25}"], r.event_type != "error") for r in e]
    want = plain_memory(rows, [(36, 2, 1.0)], 150, datetime.max)
    assert {r.id: r.repeated for r in catalog.QUERIES["remembered_repeats"](spark, SF).collect()} == want


def test_boards_of_a_batch_that_is_tried_again(spark, tmp_path):
    boards = stories.DailyBoards(str(tmp_path / "done"), "UTC", 9, "t").start(spark)
    rows = lambda *r: spark.createDataFrame([(b, at(60 * h)) for b, h in r], "board string, t timestamp")
    first, second = rows(("w", 8), ("w", 10), ("c", 9), ("c", 33)), rows(("w", 11), ("w", 35), ("c", 34))
    boards(first, 0)
    boards(first, 0)
    boards(second, 1)
    written = lambda: sorted((r.board, r.day.day, r.batch) for r in boards.done(spark).collect())
    expected = [("c", 1, 0), ("c", 2, 0), ("w", 1, 0), ("w", 2, 1)]
    assert written() == expected
    boards(second, 1)  # as after a failure between the write and Spark's commit of the micro-batch
    assert written() == expected


def test_rows_too_late_for_a_rescue_are_dropped_and_counted(spark, tmp_path):
    schema = "id long, t timestamp, arrived timestamp, c boolean"
    source, hour = str(tmp_path / "in"), 60
    parts = [[(1, at(0), at(10), False), (2, at(40 * hour), at(40 * hour + 5), False), (3, None, at(5), True), (4, at(90 * hour), at(40 * hour), True)], [(5, at(30 * hour), at(40 * hour), True), (2, at(40 * hour), at(40 * hour + 9), False), (6, at(hour), at(41 * hour), True)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        made = stories.fresh_stream(spark.readStream.schema(schema).parquet(source), "id", "t", "arrived", F.col("c")).select("id", "freshness")
        query = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        dropped = sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])
        assert dropped == 0
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "fresh"), (2, "fresh"), (5, "rescued")]
    late = [(7, at(20 * hour), at(20 * hour + 5), False)]  # arrived in time, but the stream sees it long after
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(source)
    query = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"]) == 1


def test_two_streams_joined_over_an_interval(spark, tmp_path):
    rng, schema = random.Random(6), "id long, t timestamp, k string"
    make = lambda n, shift: [(i + shift, at(13 * i + rng.random() * 10), f"k{rng.randrange(5)}") for i in range(n)]
    new, old = make(60, 0), make(60, 1000)
    new.append((99, at(5), "alone"))
    folders = [str(tmp_path / name) for name in ("new", "old")]
    for part in range(3):
        for folder, rows in zip(folders, (new, old), strict=True):
            late = [r for r in rows if min(2, int(((r[1] - START).total_seconds() / 60 + r[0] % 4 * 10) // 270)) == part]  # up to half an hour late
            spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(folder)
        streams = [spark.readStream.schema(schema).parquet(f) for f in folders]
        result = stories.recent_matches(*streams, "k", "2 HOURS", "1 hour", unmatched=True).select("a", "b")
        timers.run_available(result, str(tmp_path / "run"), seconds=120)
    got = [tuple(r) for r in timers.read_results(spark, result, str(tmp_path / "run")).collect()]
    pairs = {(a, b) for a, t, k in new for b, u, m in old if k == m and t - timedelta(hours=2) <= u < t}
    upto = min(max(r[1] for r in rows) for rows in (new, old)) - timedelta(hours=1)
    alone = {(a, None) for a, t, _ in new if t <= upto and a not in {p[0] for p in pairs}}
    assert len(got) == len(set(got)) and set(got) == pairs | alone and (99, None) in alone
    tables = [spark.createDataFrame(rows, schema) for rows in (new, old)]
    assert {tuple(r) for r in stories.recent_matches(*tables, "k", "2 HOURS").select("a", "b").collect()} == pairs
