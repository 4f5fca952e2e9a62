"""Column functions and small operators that no query of the catalogue shows on its own."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, text, urls
from newsloom.operators import boards, clusters, gates, scores, verdicts
from newsloom.sources import landed
from newsloom.streaming import stories

T0 = datetime(2024, 1, 31)


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_titles_and_contents(spark):
    assert one(spark, "<b>Big   news</b> - agency.com", text.clean_title) == "Big news"
    assert one(spark, "<p>Text https://a.b/c here</p> subscribe now #tag #two", lambda c: text.clean_content(c, ["subscribe now"])) == "Text here"
    body = "He spoke. The video shows him. He left."
    assert one(spark, body, lambda c: text.media_consistent(c, F.lit(False))) == "He spoke. He left." and one(spark, body, lambda c: text.media_consistent(c, F.lit(True))) == body
    assert one(spark, "The port of Rome is closed", lambda c: text.rewritten(c, [("port", "harbour"), ("port of Rome", "Roman port")])) == "The Roman harbour is closed"
    assert one(spark, "word " * 30, lambda c: F.length(text.cut_at_word(c, 50))) <= 50
    assert one(spark, "Trade talks on oil", lambda c: text.hashtags(c, [("oil", "#oil"), ("trade", "#trade"), ("talk", "#talk")])) == ["#oil", "#trade"]


def test_utf16(spark):
    assert one(spark, "a😀bc", lambda c: text.utf16_span(c, F.lit("bc"))).asDict() == {"offset": 3, "length": 2}
    assert one(spark, "a", lambda c: text.utf16_span(c, F.lit("zz"))) is None


def test_ids_and_links(spark):
    df = spark.createDataFrame([(None, "", "https://h/n/abc.html"), ("7", "x", "https://h/")], "id string, slug string, link string")
    assert [r[0] for r in df.select(urls.candidate_id([F.col("id"), F.col("slug")], [F.col("link")])).collect()] == ["abc", "7"]
    page = '<link rel="canonical" href="https://news.google.com/x"><a href="https://t.me/y">t</a><a href="/own/story">s</a>'
    assert one(spark, page, lambda c: urls.publisher_link(c, F.lit("https://site.org/a/b"))) == "https://site.org/own/story"
    assert one(spark, '<img src="a.png"><img src="b.png" width="640">', urls.image_link) == "b.png"
    assert one(spark, '<source src="x.webm">', urls.video_link) == "x.webm"


def test_local_clock(spark):
    assert one(spark, datetime(2024, 1, 31, 22, 0), dates.local_time, "timestamp") == "01:30"
    assert one(spark, "2024-01-31T10:00:00Z", dates.parsed_time) == datetime(2024, 1, 31, 10)


def test_scores_and_levels(spark):
    terms = {"mass": ["dozens killed"], "breaking": ["urgent"], "decision": ["approved"], "countries": ["france"], "routine": ["visited"]}
    bonus = lambda t, b: spark.createDataFrame([(t, b)], "t string, b string").select(scores.quality_bonus(F.col("t"), F.col("b"), terms)).first()[0]
    assert [bonus("urgent", "france 12"), bonus("x", "dozens killed"), bonus("visited", ""), bonus("visited and approved", "")] == [9, 9, -5, 4]
    level = lambda tier, score, age: spark.range(1).select(scores.post_level(breaking=F.lit(True), age_minutes=F.lit(age), tier=F.lit(tier), calm=F.lit(False), score=F.lit(score))).first()[0]
    assert [level(3, 1, 60), level(3, 1, 100), level(4, 12, 100), level(1, 16, 100)] == [5, 3, 4, 4]
    assert one(spark, "a vote in parliament", lambda c: scores.first_label(c, [("war", ["attack"]), ("politics", ["vote"])], "other")) == "politics"
    assert one(spark, "iran", lambda c: scores.mapped(c, {"iran": "home"})) == "home"


def test_sports(spark):
    rate = lambda h, g, l: spark.createDataFrame([(h, g, l)], "h string, g string, l string").select(boards.match_importance(F.col("h"), F.col("g"), F.col("l"), ["Iran"], ["Ajax"], ["final"], ["league one"], ["youth"])).first()[0]
    assert [rate("Iran", "X", "a"), rate("Iran", "X", "women cup"), rate("Ajax", "X", None), rate("A", "B", "youth final"), rate("A", "B", "final"), rate("A", "B", "League One"), rate("A", "B", "z")] == [5, 0, 4, 0, 3, 2, 0]
    level = lambda t: one(spark, t, lambda c: gates.major_sports(c, ["football"], ["final"], ["won", "beat"], ["derby"]))
    assert [level("football final won"), level("football won"), level("football soon"), level("won the vote")] == [3, 2, 0, 0]
    assert spark.range(1).select(boards.result_text(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), boards.result_text(F.lit(1), F.lit(2), F.lit(0), F.lit(0)), boards.result_text(F.lit(None).cast("int"), F.lit(2), F.lit(0), F.lit(0))).first()[:] == ("(4 - 3) 2 - 1", "2 - 1", None)


def test_scope_gates(spark):
    local = lambda t: one(spark, t, lambda c: gates.foreign_local(c, ["France", "Spain"], ["city council"], security=F.lit(False), approved=F.lit(False)))
    assert [local("The city council of Lyon, France"), local("city council, France and Spain"), local("France")] == [True, False, False]
    blocked = lambda h: one(spark, h, lambda c: gates.blocked_publisher(c, ["bad.com"], ["ok.zz"], ".zz"), "array<string>")
    assert [blocked(["a.bad.com"]), blocked(["ok.zz"]), blocked(["x.zz"]), blocked([])] == [True, False, True, False]
    assert one(spark, 5, lambda c: gates.rescued(F.lit("no_event"), c, critical=F.lit(True), global_critical=F.lit(False)), "int").asDict() == {"reason": None, "score": 13}
    tier = lambda reason, hard, sport: one(spark, reason, lambda c: gates.editor_tier(c, ["no_event"], hard=F.lit(hard), war_zone=F.lit(False), strong=F.lit(True), sport=F.lit(sport)))
    assert [tier("no_event", True, False), tier("no_event", False, False), tier("advert", True, False), tier("no_event", True, True), tier(None, True, False)] == [4, 3, 0, 0, 0]


def test_second_opinion(spark):
    rows = [(i, "A strike in the northern port", "no_event: x", "r") for i in range(7)] + [(8, "short", "no_event", "r"), (9, "A strike in the northern port", "advert", "r")]
    df = spark.createDataFrame(rows, "id long, title string, reason string, run string")
    out = gates.second_opinion(df, ["no_event"], ["strike"], "run", 5, F.col("id"))
    assert sorted(r.id for r in out.where("eligible").collect()) == [0, 1, 2, 3, 4]


def test_site_exports(spark):
    items = spark.createDataFrame([(i, f"t{i}", T0 + timedelta(minutes=i)) for i in range(80)], "id long, title string, t timestamp")
    out = landed.site_exports(items, spark.createDataFrame([(79,)], "id long"), most=70)
    assert {k: v.count() for k, v in out.items()} == {"index": 60, "feed": 50, "sitemap": 70}
    assert out["feed"].agg(F.max("id")).first()[0] == 78


def test_heads(spark):
    rows = [("c", 1, T0, ["a", "b"]), ("c", 2, T0 + timedelta(hours=1), ["a", "b", "x"]), ("c", 3, T0 + timedelta(hours=2), ["q"]), ("d", 4, T0, ["a"])]
    df = spark.createDataFrame(rows, "channel string, id long, t timestamp, keys array<string>")
    assert sorted(r.id for r in clusters.merge_heads(df).collect()) == [2, 3, 4]


def test_boards_run_once_a_day(spark):
    batch = spark.createDataFrame([("w", datetime(2024, 1, 31, 20)), ("w", datetime(2024, 1, 31, 3)), ("m", datetime(2024, 1, 31, 20))], "board string, t timestamp")
    done = spark.createDataFrame([("m", T0.date())], "board string, day date")
    assert [r.board for r in stories.once_a_day(batch, done, "UTC", 18).collect()] == ["w"]


def test_retries(spark):
    rows = [("a", T0, "failed"), ("b", T0, "ambiguous"), ("c", T0, "failed"), ("c", T0 + timedelta(seconds=2), "failed"), ("d", T0, "failed"), ("d", T0 + timedelta(seconds=2), "published")]
    assert [tuple(r) for r in stories.retry_queue(spark.createDataFrame(rows, "key string, t timestamp, outcome string")).collect()] == [("a", 1)]


@pytest.mark.parametrize("raw, problems", [("", ["empty"]), ("A. B. C. D.", ["too_many_sentences"]), ("x" * 800, ["too_long"]), ("```x```", ["artefact"]), ("Fine words.", [])])
def test_output_checks(spark, raw, problems):
    assert one(spark, raw, lambda c: verdicts.output_problems(F.lit("source"), c)) == problems
