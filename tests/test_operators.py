"""Operators against fixtures and plain replays."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, text, tokens, urls
from newsloom.operators import boards, clusters, memory, ranking, scores, similarity, verdicts
from newsloom.operators.components import components
from newsloom.operators.rules import Rule, all_reasons, first_reason, has
from newsloom.sources import landed
from newsloom.streaming import stories


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw, want", [("a‌ b  c", "a b c"), ("", ""), (None, None), (" x\n\ty ", "x y")])
def test_normal_space(spark, raw, want):
    assert one(spark, raw, text.normal_space) == want


def test_half_spaces_and_digits(spark):
    assert one(spark, "او می رود", text.half_spaced) == "او می‌رود"
    assert one(spark, "کتاب ها", text.half_spaced) == "کتاب‌ها"
    assert one(spark, "۱۴۰۵ و ٢٣", text.western_digits) == "1405 و 23"
    assert one(spark, "يك", lambda c: text.folded(c)) == "یک"


@pytest.mark.parametrize("title, want", [("Business leaders said", False), ("US strikes port", True), ("OpenAI launches us tool", True)])
def test_word_edges(spark, title, want):
    assert one(spark, title, lambda c: has(F.lower(c), ["us"])) is want


@pytest.mark.parametrize("raw, want", [("They met and", True), ("They met the band", False), ("Wait…", True), ("", True), (None, True), ("Done.", False)])
def test_incomplete(spark, raw, want):
    assert one(spark, raw, text.is_incomplete) is want


def test_captions(spark):
    assert one(spark, "Line one https://x.y/z\nSource: agency\nLine two", text.sanitised_caption) == "Line one\n\nLine two"
    got = spark.createDataFrame([("T", "lead.", ["d1", "d2", "d3"])], "t string, l string, d array<string>").select(text.build_caption(F.lit("H"), F.col("t"), F.col("l"), F.col("d"), F.lit("F")).alias("c")).select("c", text.parse_caption(F.col("c")).alias("p")).first()
    assert got.p.lead == "lead." and got.p.details == ["d1", "d2", "d3"]


def test_json_object_and_redaction(spark):
    assert one(spark, '```json\n{"a": 1}\n```', text.json_object) == '{"a": 1}'
    assert one(spark, 'so: {"a": 1} ok', text.json_object) == '{"a": 1}'
    assert one(spark, "[1, 2]", text.json_object) is None and one(spark, "3", text.json_object) is None
    assert "[REDACTED]" in one(spark, "key sk-abcdefghijklmnopqrst end", text.redacted)


def test_numbers(spark):
    assert one(spark, "12,000 and ۴۵", lambda c: F.array_sort(tokens.scaled_numbers(c))) == [12, 45, 12000]
    assert one(spark, "2024 and 1234 and 500", tokens.distinctive_numbers) == ["1234"]
    assert one(spark, "at least twelve? 7 people killed, five injured", tokens.toll) == 7
    assert one(spark, "M 5.6 - near", tokens.magnitude) == 5.6
    assert one(spark, "Minister: we agree", tokens.speaker) == "Minister"


@pytest.mark.parametrize("raw, want", [("HTTP://WWW.Ex.com:80/a/?utm_source=x&b=2&a=1#f", "http://ex.com/a?a=1&b=2"), ("ex.com", "https://ex.com/"), ("https://ex.com/?ref=1", "https://ex.com/"), ("https://ex.com/a?Referrer=q&output=x&igshid=3&utm_id=4", "https://ex.com/a?igshid=3")])
def test_canonical(spark, raw, want):
    assert one(spark, raw, urls.canonical) == want


@pytest.mark.parametrize("raw, flag", [("https://google.com/x", "aggregator"), ("https://lh3.googleusercontent.com/i", "aggregator"), ("https://t1.gstatic.com/i", "aggregator"), ("https://www.fb.com/x", "social"), ("https://youtu.be/x", "social"), ("https://pbs.twimg.com/x", "social"), ("https://flipboard.com/x", None), ("https://linkedin.com/x", None)])
def test_kinds_of_hosts(spark, raw, flag):
    assert [k for k in ("aggregator", "social") if one(spark, raw, urls.kinds)[k]] == ([flag] if flag else [])


def test_absolute_links(spark):
    base = F.lit("https://h.com/a/b.html")
    assert [one(spark, x, lambda c: urls.absolute(c, base)) for x in ("c", "/d", "//e.com/f", "../g", "https://i.com")] == ["https://h.com/a/c", "https://h.com/d", "https://e.com/f", "https://h.com/g", "https://i.com"]


def test_jalali(spark):
    rows = spark.createDataFrame([(date(2024, 3, 20),), (date(2025, 3, 21),), (date(2024, 3, 19),)], "d date").select(dates.jalali(F.col("d")).alias("j")).collect()
    assert [tuple(r.j) for r in rows] == [(1403, 1, 1), (1404, 1, 1), (1402, 12, 29)]
    assert one(spark, "۱ فروردین ۱۴۰۳", lambda c: dates.says_today(c, F.lit("2024-03-20").cast("date")))


def test_reasons(spark):
    df = spark.createDataFrame([(1,), (5,)], "x int")
    rules = [Rule("small", F.col("x") < 3), Rule("odd", F.col("x") % 2 == 1)]
    assert [tuple(r) for r in df.select(first_reason(rules), all_reasons(rules)).collect()] == [("small", ["small", "odd"]), ("odd", ["odd"])]


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or any(x in f and f[0] != f[1] for f in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def greedy(n, pairs, heads_only):
    near = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    groups: list[list[int]] = []
    for i in range(n):
        for g in groups:
            if any((i, m) in near for m in (g[:1] if heads_only else g)):
                g.append(i)
                break
        else:
            groups.append([i])
    return {i: g[0] for g in groups for i in g}


@pytest.mark.parametrize("heads_only", [False, True])
def test_clusters_equal_a_global_greedy_pass(spark, heads_only):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)})
    rows = spark.createDataFrame([(i, i) for i in range(40)], "id long, seq long")
    got = dict(clusters.greedy_clusters(rows, spark.createDataFrame(pairs, "a long, b long"), heads_only).collect())
    assert got == greedy(40, pairs, heads_only)


def test_candidate_pairs_lose_no_pair(spark):
    rng = random.Random(9)
    sets = {i: [f"k{rng.randrange(25)}" for _ in range(rng.randint(0, 9))] for i in range(60)}
    rows = spark.createDataFrame(list(sets.items()), "id long, keys array<string>")
    test = tokens.shared(F.col("a_keys"), F.col("b_keys")) >= 4
    got = {(r.a, r.b) for r in similarity.self_pairs(rows, "keys", 4, test).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 4}


def test_diverse_order_is_the_greedy_walk(spark):
    rng = random.Random(7)
    rows = [(i, f"f{rng.randrange(4)}", rng.randrange(40)) for i in range(60)]
    left, picked, count = list(rows), [], {}
    while left:
        best = max(left, key=lambda r: (r[2] - ranking.PENALTIES[min(count.get(r[1], 0), 3)], -r[0]))
        left.remove(best)
        count[best[1]] = count.get(best[1], 0) + 1
        picked.append(best[0])
    df = ranking.diverse_order(spark.createDataFrame(rows, "id long, family string, score int"), "family", "score", "id")
    assert [r.id for r in ranking.top(df, 60, F.desc("adjusted"), F.col("id")).orderBy("place").collect()] == picked


def test_fit_lines(spark):
    got = spark.createDataFrame([(["aaaa", "b" * 50, "cc"],)], "l array<string>").select(ranking.fit_lines(F.col("l"), 10).alias("b")).first().b
    assert tuple(got) == ("aaaa\ncc", 2, 1)


def test_history(spark, tmp_path):
    lines = [f"{i:032x}" for i in range(6000)] + [f"TITLE|{1_706_600_000}|A title", "TITLE|bad|other", "rubbish"]
    (tmp_path / "h.txt").write_text("\n".join(lines))
    titles, keys = landed.mixed_history(spark, str(tmp_path / "h.txt"))
    kept, newest = memory.compact_history(titles, keys, F.lit("2024-01-31").cast("timestamp"))
    assert [r.title for r in kept.collect()] == ["A title"]
    assert newest.count() == 5000 and newest.agg(F.max("key")).first()[0] == f"{5999:032x}"


def test_state_documents(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"a": 1}\n{broken\n')
    good, bad = landed.state_documents(spark, str(tmp_path / "s.json"), "a int")
    assert [r.a for r in good.collect()] == [1] and [r.value for r in bad.collect()] == ["{broken"]


def test_feed_items(spark, tmp_path):
    items = "".join(f"<item><title>T{i}</title><link>https://h/{i}</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item>" for i in range(25))
    (tmp_path / "f.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    rows = landed.feed_items(spark, str(tmp_path / "f.xml")).collect()
    assert len(rows) == 20 and rows[0].published_at == datetime(2024, 1, 1, 10)
    assert landed.catalogue(spark, [("a", "u")], [("a", "u"), ("b", "u")]).count() == 2


@pytest.mark.parametrize("label, want", [("Published", "published"), ("sent", "published"), ("what", "unknown"), (None, "unknown")])
def test_statuses_fail_closed(spark, label, want):
    assert one(spark, label, verdicts.canonical_status) == want


@pytest.mark.parametrize("ok, want", [(True, "published"), (False, "failed"), (None, "ambiguous")])
def test_outcomes(spark, ok, want):
    assert one(spark, ok, verdicts.outcome, "boolean") == want


@pytest.mark.parametrize("score, scope, want", [(11, "national", False), (8, "galactic", False), (8, "national", True), (8, "local", False), (6, "national", False)])
def test_verdict_range(spark, score, scope, want):
    no = F.lit(False)
    df = spark.createDataFrame([(score, scope)], "s int, c string").select(verdicts.acceptance(F.col("s"), F.lit(True), F.col("c"), no, no, no, no).alias("y"))
    assert df.first().y is want


def test_output_problems(spark):
    df = spark.createDataFrame([("Five of 12.", "Here is 13 of them.")], "a string, b string").select(verdicts.output_problems(F.col("a"), F.col("b")).alias("p"))
    assert df.first().p == ["new_number", "meta_phrase"]


def test_registry(spark):
    rows = spark.createDataFrame([("https://h/a?x=1", "t"), ("https://h/b", "Known"), ("https://h/c", "new")], "link string, title string")
    registry = spark.createDataFrame([("https://h/a/", ["known"])], "source_url string, titles array<string>")
    assert [r.status for r in memory.registered(rows, registry, ["link"], F.col("title")).orderBy("link").collect()] == ["skipped_duplicate", "skipped_duplicate", "new"]


def test_price_tables(spark):
    html = "<table><tr><td>1</td><td>USD</td><td>۱۰,۰۰۰</td><td>+2</td></tr><tr><td>2</td><td>usd</td><td>-</td><td></td></tr><tr><td>x</td></tr></table>"
    page = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = boards.price_rows(page, ["USD", "EUR"]).collect()
    assert [(r.symbol, r.value) for r in rows] == [("USD", "-")]
    assert page.select(boards.is_price(F.array(F.lit(""), F.lit(""), F.lit("۱۰,۰۰۰")))).first()[0] is True


def test_weather_must_align(spark):
    cities = spark.createDataFrame([(0, "A"), (1, "B")], "place int, city string")
    one_city = '[{"current": {"temperature_2m": 3.4, "weather_code": 1}, "daily": {"temperature_2m_max": [9.0], "temperature_2m_min": [1.0], "precipitation_probability_max": [60]}}]'
    with pytest.raises(Exception, match="differ in number"):
        boards.weather_rows(spark.createDataFrame([(one_city,)], "value string"), cities).collect()
    rows = boards.weather_rows(spark.createDataFrame([(one_city,)], "value string"), cities.where("place = 0")).collect()
    assert [(r.city, r.code, r.tmax) for r in rows] == [("A", 1, 9.0)]


def test_scores(spark):
    assert [one(spark, h, scores.recency_score, "double") for h in (0.5, 2.0, 36.0, 40.0, None)] == [12, 10, 1, 0, 0]


def test_freshness(spark):
    now = datetime(2024, 1, 31)
    rows = [(now - timedelta(minutes=5), False), (now - timedelta(hours=3), True), (now - timedelta(hours=3), False), (now + timedelta(minutes=10), False), (None, True)]
    df = spark.createDataFrame(rows, "t timestamp, c boolean").select(stories.freshness(F.col("t"), F.lit(now), F.col("c")).alias("f"))
    assert [r.f for r in df.collect()] == ["fresh", "rescued", "late", "future", "undated"]


def test_stream_dedup_and_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i % 4, start + timedelta(minutes=i), 1.0) for i in range(40)], "key long, ts timestamp, value double")
    source = str(tmp_path / "in")
    df.coalesce(1).write.parquet(source)
    q = stories.unique_stream(spark.readStream.schema(df.schema).parquet(source), "key", "ts").writeStream.format("memory").queryName("uniq").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("uniq").count() == 4
    assert stories.windowed(df, "ts", ["key"], "20 minutes").agg(F.sum("n")).first()[0] == 40
