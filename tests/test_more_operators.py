"""Logs, batches of a judge, anchored pairs, boards' joins."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import audit, boards, clusters, memory, ranking, similarity, verdicts
from newsloom.operators import components as components_module

T0 = datetime(2024, 1, 31)


def test_anchored_pairs(spark):
    rows = [(1, T0, ["a", "b", "c", "the"], ["457"], None), (2, T0 + timedelta(hours=1), ["a", "b", "x", "the"], ["457"], None), (3, T0 + timedelta(hours=1), ["a", "the"], ["457"], None), (4, T0, ["p", "q", "r"], [], "Minister"), (5, T0 + timedelta(hours=1), ["p", "q", "r"], [], "Minister"), (6, T0 + timedelta(hours=3), ["p", "q", "r"], [], "Minister")]
    df = spark.createDataFrame(rows, "id long, t timestamp, keys array<string>, numbers array<string>, speaker string")
    assert sorted(map(tuple, similarity.anchored(df, ["the"]).collect())) == [(2, 1), (5, 4), (6, 5)]


def test_send_log(spark):
    df = spark.createDataFrame([(T0, "send", "c", "x" * 5000, '{"ok": true, "result": {"message_id": 7}}'), (T0, "send", "c", "y", '{"ok": false, "description": "no"}'), (T0, "send", "c", None, "broken")], "t timestamp, method string, chat string, text string, response string")
    assert [(r.len, r.ok, r.message_id, r.error, r.trimmed_from) for r in memory.send_log(df).collect()] == [(5000, True, 7, None, 5000), (1, False, None, "no", None), (None, None, None, None, None)]


def test_raw_texts_are_held(spark):
    df = spark.createDataFrame([("a", "raw"), ("b", "done"), ("c", None)], "title string, status string")
    out, blocks = memory.without_raw(df, ["raw"], F.lit(T0))
    assert [r.title for r in out.collect()] == ["b", "c"] and [(r.title, r.until) for r in blocks.collect()] == [("a", T0 + timedelta(minutes=20))]


def test_run_metrics(spark):
    attempts = spark.createDataFrame([("published", None), ("failed", "x"), ("blocked", "x")], "result string, reason string")
    feeds = spark.createDataFrame([(0,), (3,)], "candidates int")
    row = audit.run_metrics(attempts, feeds, "r1", F.lit(T0)).first()
    assert (row.attempts, row.published, row.feeds, row.empty_feeds, row.rejections) == (3, 1, 2, 1, {"x": 2})


@pytest.mark.parametrize("size", [1, 3, 8])
def test_judge_in_batches(spark, size):
    seen = lambda titles: [{"score": len(t), "happened": True, "scope": "national"} if t != "none" else None for t in titles]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["abc", "none", "x", "yy"])], "id long, title string").coalesce(1)
    got = verdicts.judged_in_batches(df, seen, size).orderBy("id").collect()
    assert [(r.score, r.happened) for r in got] == [(3, True), (None, None), (1, True), (2, True)]
    assert all(r.score is None for r in verdicts.judged_in_batches(df, lambda t: [], size).collect())


def test_prices_must_be_complete(spark):
    cell = lambda s, v: f"<tr><td>1</td><td>{s}</td><td>{v}</td></tr>"
    page = spark.createDataFrame([(1, cell("USD", "5") + cell("EUR", "6"))], "page_id long, html string")
    rows = boards.price_rows(page, ["USD", "EUR", "GBP"])
    assert boards.complete_prices(rows, ["USD"], 2).count() == 2
    with pytest.raises(Exception, match="missing: GBP"):
        boards.complete_prices(rows, ["USD", "GBP"], 2).collect()


def test_results_of_a_board(spark):
    goals = "struct<host: int, guest: int>"
    board = spark.createDataFrame([(1, 1, "A", "B"), (2, 3, "C", "D"), (3, 1, "E", "F"), (4, 1, "G", "H")], "id long, sport int, hostName string, guestName string")
    results = spark.createDataFrame([(1, 7, (2, 2), None, (4, 5)), (2, 7, (0, 0), (3, 1), (0, 0)), (3, 6, (1, 0), None, None), (4, 7, None, None, None)], f"id long, status int, goals {goals}, points {goals}, penalties {goals}")
    got = boards.final_results(board, results).orderBy("id").collect()
    assert [(r.id, r.host, r.guest, r.penalties and tuple(r.penalties)) for r in got] == [(1, 2, 2, (4, 5)), (2, 3, 1, None)]
    shown = spark.createDataFrame([("A", "B", "t")], "hostName string, guestName string, scheduledStartOn string")
    assert boards.shown_matches(shown.union(spark.createDataFrame([("A", "B", "u")], shown.schema)), shown).count() == 1


def test_caption_items(spark):
    df = spark.createDataFrame([("d", i < 6, i, i) for i in range(20)], "day string, own boolean, score int, start int")
    got = boards.caption_items(df, "day", "own", "score", "start").groupBy("own").agg(F.count("*").alias("n"), F.max("more").alias("more")).collect()
    assert {r.own: (r.n, r.more) for r in got} == {True: (4, 2), False: (6, 8)}


def test_components_of_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(components_module, "HUB", 5)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200), (7, 300), (300, 301), (7, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {i: 0 for i in [*range(60), 300, 301]} | {100 + i: 100 for i in range(31)}
    assert {r.node: r.label for r in components_module.components(df).collect()} == want
    monkeypatch.setattr(components_module, "MOST_NODES", 0)
    assert {r.node: r.label for r in components_module.components(df).collect()} == want
    monkeypatch.setattr(components_module, "MOST_HUBS", 0)
    assert {r.node: r.label for r in components_module.components(df).collect()} == want


def plain_greedy(n, pairs, heads_only):
    """One greedy pass in the order of ids."""
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    of: dict[int, int] = {}
    for i in range(n):
        found = [of[j] for j in near[i] if j in of and (of[j] == j or not heads_only)]
        of[i] = min(found) if found else i
    return of


@pytest.mark.parametrize("heads_only", [False, True])
@pytest.mark.parametrize("largest", [1, 4, 1000])
def test_greedy_clusters_in_tasks_and_in_rounds(spark, heads_only, largest):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(70 + i, 71 + i) for i in range(6)]
    pairs = [(a, b) for a, b in pairs if a != b]
    rows = spark.createDataFrame([(i, i) for i in range(80)], "id long, seq long")
    got = clusters.greedy_clusters(rows, spark.createDataFrame(pairs, "a long, b long"), heads_only, largest).collect()
    assert {r.id: r.cluster_id for r in got} == plain_greedy(80, pairs, heads_only) and len(got) == 80


def test_story_pairs_by_rule(spark):
    """Each rule's pair is found, whatever its length: signature, short titles, part of a longer title, number."""
    titles = ["quake of 5 in iran kills", "iran shaken by quake, 5 dead say rescue teams", "ab cd", "ab cd news", "ab", "one two three four five six", "one two three four five six seven eight nine ten", "alpha beta gamma delta 77", "alpha beta gamma omega sigma 77"]
    from newsloom.functions import tokens as K

    df = spark.createDataFrame(list(enumerate(titles)), "id long, norm string")
    norm, numbers = F.col("norm"), K.numbers_in(F.col("norm"))
    rows = df.select("id", "norm", K.title_tokens(norm).alias("tokens"), K.story_tokens(norm).alias("story"), numbers.alias("numbers"), similarity.signatures(norm, numbers, [[["rescue"], ["shaken"], ["x"]]], ["quake"], ["iran"]).alias("signature"))
    got = {tuple(r) for r in similarity.story_pairs(rows, similarity.same_story()).collect()}
    every = rows.crossJoin(rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])).where("id < b_id")
    for c in rows.columns:
        every = every.withColumnRenamed(c, f"a_{c}")
    plain = {(r.a_id, r.b_id) for r in every.where(similarity.same_story() | (F.size(F.array_intersect("a_signature", "b_signature")) > 0)).collect()}
    assert got == plain >= {(0, 1), (5, 6), (7, 8)}


def test_bounded_boards(spark):
    """Line by line against the fold, with lines that fit later, long ones, and groups that span batches."""
    rng = random.Random(5)
    rows = [(rng.randrange(4), k, "x" * rng.choice([1, 5, 30, 90])) for k in range(400)] + [(9, 1, "y" * 500), (None, 2, "z"), (3, None, None)]
    df = spark.createDataFrame(rows, "g int, k int, line string")
    got = {r.g: (r.text, r.taken, r.skipped) for r in ranking.fit_boards(df, "g", "k", "line", 200).collect()}
    want = {}
    for g in {r[0] for r in rows if r[0] is not None}:
        text, taken, skipped = "", 0, 0
        for _, line in sorted((k, line) for h, k, line in rows if h == g and line):
            longer = f"{text}\n{line}" if text else line
            text, taken, skipped = (longer, taken + 1, skipped) if len(longer) <= 200 else (text, taken, skipped + 1)
        want[g] = text, taken, skipped
    assert got == want


def test_history_keys(spark):
    from newsloom.functions import urls

    rows = [("One  story", "http://a.com/x?utm_source=1"), ("one story ", "http://a.com/x"), ("One story", "http://a.com/y"), ("Other story", "http://a.com/x")]
    df = spark.createDataFrame(rows, "title string, link string")
    a, b, c, d = (r.k for r in df.select(urls.history_key(F.col("title"), F.col("link")).alias("k")).collect())
    assert a == b and len({a, c, d}) == 3
