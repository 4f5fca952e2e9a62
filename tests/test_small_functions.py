"""Page headers, teasers, widgets, boards, files and audit columns on fixtures."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from newsloom.functions import editing, text
from newsloom.functions.dates import local_day
from newsloom.operators import boards, editorial, gates
from newsloom.sources import landed


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def strings(*values):
    return F.array(*[F.lit(v) for v in values])


BODY = "The council of the town met on Monday and decided to build a new bridge over the river."


def test_page_headers(spark):
    head = "Home > News Published: 2024/01/30 12:30 News code: 4471 Council decides "
    strip = lambda t, title: value(spark, editing.without_header(F.lit(t), F.lit(title)))
    assert strip(head + BODY, "Council decides") == BODY
    assert strip(BODY, "Council decides") == BODY  # no marker, no header
    assert strip("Published: 12:30 Council decides Too little is left", "Council decides") == "Published: 12:30 Council decides Too little is left"
    far = "x " * 300 + "Published: 1 " + BODY
    assert strip(far, "Council decides") == far and strip(None, "x") is None


def test_teasers_and_widgets(spark):
    tease = lambda *s: value(spark, editing.without_teasers(strings(*s)))
    assert tease("12:30 - " + BODY, "Read more about the bridge.", "See also: roads") == [BODY]
    assert tease("12:30 Short.", "Related stories") == ["12:30 Short.", "Related stories"]  # too little would remain
    cut = lambda *s: value(spark, editing.without_widgets(strings(*s)))
    assert cut(f"{BODY} Share: 12", "Views 300 Comments 4", "Print this page") == [BODY] and cut("Shares fell by a third today.") == ["Shares fell by a third today."]


def test_search_texts(spark):
    assert value(spark, text.search_text(F.lit("a"), F.lit(None), F.lit("bcd"), limit=4)) == "a bc"


def test_lines_of_boards(spark):
    line = lambda *x: value(spark, boards.board_line(F.lit("Town"), *[F.lit(v).cast(t) for v, t in zip(x, ("double", "double", "double", "int"), strict=True)]))
    assert line(3.6, -1.2, 7.5, 40) == "Town 4° -1°/8° 40%" and line(None, None, 2.0, None) == "Town — —/2° —"
    change = lambda x: value(spark, boards.format_change(F.lit(x).cast("double")))
    assert [change(x) for x in (1234.5, -2.0, 0.0, None)] == ["▲ 1,234.50", "▼ 2.00", "–", "–"]


def test_models_and_dates_of_pages(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    page = "<table>" + row("Alpha", "1402", "100", "—", "5") + row("Beta", "1401", "", "90", "") + row("Alpha", "1403", "110", "95", "-") + row("", "1400", "1", "2") + row("Gamma", "", "1", "2") + row("Delta", "1", "2") + "</table>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    assert sorted(map(tuple, boards.model_rows(df).collect())) == [(1, "Alpha", "1403", "110", "95", None), (1, "Beta", "1401", None, "90", None)]
    date = lambda t: value(spark, boards.update_date(F.lit(t), "update date"))
    assert date("x update date: 10 Mehr 1403 | y") == "10 Mehr 1403" and date("update date: 1 | y") is None and date("none") is None


def test_matches_and_their_leagues(spark):
    json = '{"matches":[{"id":1,"leagueId":7,"sport":1,"hostName":"A","guestName":"B","status":2},{"id":2,"leagueId":9}],"leagues":[{"id":7,"title":"Top"},{"id":7,"title":"Top"}]}'
    df = spark.createDataFrame([(json,), ("broken",), (None,)], "value string")
    assert sorted((r.id, r.league, r.hostName) for r in boards.match_rows(df).collect()) == [(1, "Top", "A"), (2, None, None)]


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>né</p>", encoding="utf-8")
    (tmp_path / "b.txt").write_text("no", encoding="utf-8")
    row = landed.page_files(spark, str(tmp_path)).collect()
    assert [(r.html, r.bytes, len(r.sha256)) for r in row] == [("<p>né</p>", 10, 64)]
    out, df = str(tmp_path / "out"), spark.range(3).withColumn("k", F.col("id") % 2)
    first = landed.publish_version(df, out, "1", ["k"])
    landed.publish_version(df.where("id = 0"), out, "2")
    landed.publish_version(df.where("id < 2"), out, "2")  # tried again, it replaces its own version and no other
    assert spark.read.parquet(first).count() == 3 and sorted(r.id for r in spark.read.parquet(f"{out}/version=2").collect()) == [0, 1]
    assert value(spark, landed.search_feed("http://x/?q=", F.lit("a b&c"))) == "http://x/?q=a+b%26c"


def test_security_records_and_days(spark):
    kind = lambda t: value(spark, gates.security_kind(F.lit(t)))
    assert [kind(t) for t in ("12 killed in fire", "dozens hurt", "drone attack on refinery", "9 killed", "refinery opens", None)] == ["mass-casualty", "mass-casualty", "energy-attack", None, None, None]
    df = spark.createDataFrame([(1, "t", "s", None, 3, "late", True)], "id long, title string, source string, published_at timestamp, score int, reason string, critical boolean")
    r = df.select(*gates.rejection_record("gate", "critical")).first()
    assert (r.id, r.reason, r.stage, r.overrides.critical) == (1, "late", "gate", True) and df.select(*gates.rejection_record("gate")).first().overrides is None
    assert value(spark, local_day(F.lit("2024-01-30 20:31:00").cast("timestamp"))) == datetime.date(2024, 1, 31)


def test_guides_have_room_for_five_sentences(spark):
    problems = lambda out, source="In 1999 it began.": value(spark, editorial.guide_problems(F.lit(out), F.lit(source)))
    five = "One line here. " * 4 + "It began in 1999."
    assert problems(five) == [] and problems("One line here. " * 5 + "End.") == ["too_many_sentences"]
    assert problems("x" * 901) == ["too_long"] and problems("It began in 2001.") == ["new_number"]


def test_ends_and_first_words_are_told_without_the_whole_text(spark):
    """The gates' word counts and ends equal those over whole texts, and a small event's numbers are looked for in few texts."""
    from newsloom.functions import text as T
    from newsloom.operators import gates as G
    from newsloom.operators import rules

    texts = ["", " ", "a", "a b", " a  b ", "one\tand", "x and\n", "x and", "so on...\r\n", "so on…", "a,\n", "a,\n\n", "x of \n", "and", "a b c d e f g h i j k l", " a b c d e f g h i j k", " a b", "a:", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    trimmed = F.trim(F.coalesce(t, F.lit("")))
    dangling = F.lower(F.element_at(F.split(trimmed, r"\s+"), -1)).isin("and", "or", "of", "the", "with", "to", "و", "که", "از", "با", "به", "در")
    whole = (trimmed == "") | trimmed.rlike(r"(…|\.\.\.|[,،:؛])$") | dangling
    rows = df.select(T.is_incomplete(t).alias("a"), whole.alias("b"), *[(T.fewer_words(t, n) == (T.word_count(t) < n)).alias(f"w{n}") for n in (1, 2, 4, 6, 12)]).collect()
    for text, r in zip(texts, rows, strict=True):
        assert r.a == r.b and (text is None or all(r[2:])), text
    said = spark.createDataFrame([("a quake of 4.1",), ("quakes",), (None,), ("QUAKE",), ("re.d",), ("red",)], "t string")
    assert [r[0] for r in said.select(rules.has(t, ["quake", "earthquake"])).collect()] == [True, False, None, False, False, False]
    assert [r[0] for r in said.select(rules.has(t, ["re.d", "r.d"])).collect()] == [False, False, None, False, True, True]
    events = [("M 4.1 earthquake", "", "small_quake"), ("Magnitude 5 quake", "", None), ("Quake", "houses damaged", None), ("Bus crash", "2 killed on a road", "small_crash"), ("Bus crash", "12 killed", None), ("Crash", "of prices", None), (None, None, None)]
    df = spark.createDataFrame([e[:2] for e in events], "t string, b string")
    assert [r[0] for r in df.select(G.small_event(t, F.col("b"))).collect()] == [e[2] for e in events]
