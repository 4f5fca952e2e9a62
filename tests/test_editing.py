"""Line editing and gates against plain replays and fixtures."""

from __future__ import annotations

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.functions import editing as E
from newsloom.operators import gates as G
from newsloom.plans.edited import redundant_lines


def cases(seed=4, n=60):
    rng = random.Random(seed)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "12", "345"]
    return [(i, " ".join(rng.choices(words, k=5)), [" ".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(rng.randint(0, 7))]) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(cases(), "id long, title string, s array<string>")


def keys(text):
    return list(dict.fromkeys(w[:4] for w in re.findall(r"[^\W\d_]{4,}", text.lower())))


def common(a, b):
    return len(set(a) & set(b))


def result(table, column):
    return {r.id: r.y for r in table.select("id", column.alias("y")).collect()}


def test_on_topic(table):
    def plain(title, s):
        t = keys(title)
        if len(t) < 3:
            return s
        lead = next((i for i, x in enumerate(s) if common(keys(x), t) >= 2), None)
        if lead is None:
            return []
        k = keys(s[lead])
        return [s[lead], *(x for x in s[lead + 1 :] if common(keys(x), t) or common(keys(x), k))]

    assert result(table, E.on_topic(F.col("title"), F.col("s"))) == {i: plain(t, s) for i, t, s in cases()}


def test_near_copies(table):
    def plain(s):
        kept = []
        for x in s:
            w = set(x.lower().split())
            if w and not any(len(w & set(k.lower().split())) >= 0.8 * len(w) for k in kept):
                kept.append(x)
        return kept

    assert result(table, E.without_near_copies(F.col("s"))) == {i: plain(s) for i, _, s in cases()}


def test_redundant(table):
    def plain(title, s):
        kept = []
        for x in s:
            said = " ".join([title, " ".join(kept)])
            news = set(re.findall("[0-9]+", x)) - set(re.findall("[0-9]+", said)) or len(set(keys(x)) - set(keys(said))) > 1
            if not kept or news:
                kept.append(x)
        return kept

    assert result(table, E.without_redundant(F.col("title"), F.col("s"))) == {i: plain(t, s) for i, t, s in cases()}


def test_redundant_lines_of_long_texts(spark, tmp_path):
    """The query counts sentences to a text's end; a copy far behind its original is found."""
    news = [f"Story{'abcdefgh'[i % 8] * (1 + i // 8)} {i} names item{i} and place{i}." for i in range(60)]
    spark.createDataFrame([(0, "Headline.\n" + " ".join(news + news[50:])), (1, "Headline.\n" + " ".join(news[:3] * 30 + news[3:])), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.news, r.unlike) for r in redundant_lines(spark, str(tmp_path)).collect()}
    assert (got[0], got[1], got[3]) == ((61, 61), (61, 61), (0, 0))


def test_best_lead(table):
    def plain(title, s):
        n = [common(keys(x), keys(title)) for x in s[:4]]
        if len(n) > 1:
            best = max(range(1, len(n)), key=lambda i: (n[i], -i))
            if n[best] >= 3 and n[best] >= n[0] + 2:
                return [s[best], *s[:best], *s[best + 1 :]]
        return s

    assert result(table, E.best_lead(F.col("title"), F.col("s"))) == {i: plain(t, s) for i, t, s in cases()}


def test_summary(table):
    def plain(s):
        if not s:
            return ""
        text, taken = s[0], 0
        for x in sorted(s[1:], key=lambda x: -x.count("echo")):
            if taken < 2 and len(text) + 1 + len(x) <= 60:
                text, taken = f"{text} {x}", taken + 1
        return text

    score = lambda x: F.length(x) - F.length(F.replace(x, F.lit("echo"), F.lit("ech")))
    assert result(table, E.summary(F.col("s"), score, limit=60)) == {i: plain(s) for i, _, s in cases()}


def apply(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_quotes(spark):
    assert apply(spark, ["He said «a.", "b» and left", "«open"], E.joined_quotes, "array<string>") == ["He said «a. b» and left"]
    assert apply(spark, ["«a"], E.joined_quotes, "array<string>") == ["«a»"]


def test_headlines(spark):
    body = F.lit("The harbour was closed and ships waited")
    assert apply(spark, "Harbour closed؛ Unrelated promise kept", lambda c: E.supported_parts(c, body)) == "Harbour closed"
    assert apply(spark, "x" * 60 + " / " + "y" * 60, E.first_part) == "x" * 60
    assert apply(spark, "He left early", lambda c: E.named_lead(F.lit("Foreign minister: no talks"), c)) == "Foreign minister left early"


def test_attribution(spark):
    got = apply(spark, ["According to Daily News, the bridge fell", "Daily News added more", "It was old, as reported by Daily News."], lambda c: E.without_attribution(c, ["Daily News"]), "array<string>")
    assert got == ["the bridge fell", "It was old."]


def test_repair(spark):
    problem = lambda c: F.when(F.length(c) > 5, "long")
    assert apply(spark, "too long text", lambda c: E.repaired(problem, c, F.substring(c, 1, 4))) == "too "
    assert apply(spark, "fine", lambda c: E.repaired(problem, c, F.lit("never"))) == "fine"


@pytest.mark.parametrize(
    "title, body, reason",
    [("Buy a phone today", "", "purchase_title"), ("Weather", "sponsored content below", "explicit_marker"), ("Where to buy shoes", "", "reseller"), ("News", "call us or sign up for a car", "call_to_action"), ("Coupon day", "", "commerce_title"), ("", "sponsored", None), ("Parliament votes", "The price rose", None), ("Ministers meet in capital", "", None)],
)
def test_adverts(spark, title, body, reason):
    df = spark.createDataFrame([(title, body)], "t string, b string")
    assert df.select(G.advert(F.col("t"), F.col("b"))).first()[0] == reason


@pytest.mark.parametrize("title, keeps", [("Earthquake of magnitude 6.1 far away", True), ("M 5.2 earthquake in Peru", False), ("M 5.2 earthquake in Iraq", True), ("Markets rise", True)])
def test_quakes(spark, title, keeps):
    assert apply(spark, title, lambda c: G.keeps_quake(c, ["iraq"])) is keeps


def test_old_and_listed(spark):
    year = F.lit(2024)
    assert apply(spark, "The 2015 accord", lambda c: G.old_event(c, F.lit("It was signed in 2015."), year)) is True
    assert apply(spark, "The 2015 accord", lambda c: G.old_event(c, F.lit("In 2024 it ended."), year)) is False
    assert apply(spark, "1. a\n2. b\n3) c", G.is_list_post) is True and apply(spark, "1. a\nb", G.is_list_post) is False


def test_incidents(spark):
    places = {"North Port": "north", "Port": "south"}
    sign = lambda t: G.incident_signature(t, [("blast", "explosion|blast")], places, F.array().cast("array<string>"))
    df = spark.createDataFrame([("Explosion in North Port, 4 killed", "Blast at North Port"), ("Explosion in Port", "Blast at North Port"), ("Ceremony for explosion in Port", "x")], "a string, b string")
    rows = df.select(sign(F.col("a")).alias("a"), sign(F.col("b")).alias("b")).select("a", G.match_strength(F.col("a"), F.col("b")).alias("m")).collect()
    assert rows[0].a.places == ["north port"] and rows[0].a.regions == ["north"] and rows[0].a.toll == 4
    assert rows[0].m == 1 and rows[1].m == 0 and rows[2].a is None
    assert spark.range(1).select(G.toll_update(F.lit(9), F.lit(5)), G.toll_update(F.lit(6), F.lit(5))).first()[:] == (True, False)


def test_post_problem(spark):
    df = spark.createDataFrame([("Short one", ["a b c"]), ("A title of five words", ["Too short."]), ("A title of five words", ["The first sentence has more than six words in it.", "And the second one says where and when it all happened."])], "t string, s array<string>")
    assert [r[0] for r in df.select(G.post_problem(F.col("t"), F.col("s"))).collect()] == ["title_short", "body_short", None]


def test_on_topic_of_long_texts(spark):
    """Thousands of sentences under a title of thousands of keys: the lead is looked for once, in time that grows with the text."""
    word = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:04d}")
    title = " ".join(word(i) for i in range(4000))
    s = ["Nothing said here."] * 3000 + [f"{word(i)} met {word(i + 1)} by {word(9000 + i % 900)}." for i in range(3000)] + ["Nothing said here.", f"Only {word(9001)} now."] + [f"It was {word(9800)}."] * 2
    rows = [(0, title, s), (1, None, s[:2]), (2, title, None), (3, "Two keys", s[:2]), (4, "Two keys", None), (5, title, []), (6, title, [None, s[3000], None, s[3001]])]
    df = spark.createDataFrame(rows, "id long, title string, s array<string>")
    started = time.monotonic()
    got = result(df, E.on_topic(F.col("title"), F.col("s")))
    assert time.monotonic() - started < 30
    assert got == {0: s[3000:6000], 1: [], 2: [], 3: s[:2], 4: None, 5: [], 6: [s[3000], s[3001]]}


def drawn(seed, n):
    """Long texts of few words, in which many sentences say again in part what dropped ones said."""
    rng = random.Random(seed)
    words = ["Alpha", "bravo", "Charlie", "delta", "échos", "fox", "golfing", "hotel", "India", "juliet", "kilo", "lima", "mike", "12", "345", "6"] + [f"word{a}{b}" for a in "abcde" for b in "abcde"] + [f"{a}{b}ten" for a in "abcdef" for b in "abcdef"]
    gaps = [" ", " ", " ", "  ", " ", "\t", " ", "　", "\x85", "\x1f", "​"]
    say = lambda: rng.choice(["", "", "", "", "More details "]) + "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 5, 9))))
    return [(i, rng.choice([None, say()]), rng.choice([None] + [[rng.choice([None] + [say()] * 30) for _ in range(rng.choice((0, 1, 30, 200)))]] * 9)) for i in range(n)]


def test_redundant_and_near_copies_of_long_texts(spark):
    """More rows than one slice, against plain replays by row and sentence."""
    white = r"[\t-\r \x85\xa0  -     　]+"

    def unlike(s):
        kept = []
        for x in s:
            w = set(re.split(white, (x or "").lower())) - {""}
            if w and not any(len(w & k) >= 0.8 * len(w) for k, _ in kept):
                kept.append((w, x))
        return [x for _, x in kept]

    def news(title, s):
        kept, k, n = [], set(keys(title or "")), set(re.findall("[0-9]+", title or ""))
        for x in s:
            new_k, new_n = set(keys(x or "")) - k, set(re.findall("[0-9]+", x or "")) - n
            if not kept and x is s[0] or (new_n or len(new_k) > 1) and not (x or "").startswith("More details"):
                kept.append(x)
                k, n = k | new_k, n | new_n
        return kept

    rows = drawn(11, 600)
    df = spark.createDataFrame(rows, "id long, title string, s array<string>").coalesce(1)
    got = {r.id: r for r in df.select("id", E.without_near_copies(F.col("s")).alias("u"), E.without_redundant(F.col("title"), F.col("s")).alias("n")).collect()}
    for i, title, s in rows:
        assert got[i].u == (None if s is None else unlike(s)), i
        assert got[i].n == (None if s is None else news(title, s)), i


def test_sentences_are_coded_in_slices():
    """The folds hold a slice of a batch's rows at a time, numbered, not every word of it as Python strings."""
    seen = []
    column = pa.array([["a"]] * 600, pa.list_(pa.string()))
    E._by_slices(lambda c: (seen.append(len(c)), pa.array([[True]] * len(c)))[1], column)
    assert sum(seen) == 600 and max(seen) <= E.SLICE
    assert E._by_slices(lambda c: E._unlike(c, 0.8), column.slice(0, 0)).to_pylist() == []
