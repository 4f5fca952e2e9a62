"""What a reviewer found at larger sizes, on small inputs that show it."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import blocks, clusters, gates, ranking, similarity
from newsloom.plans import catalog


def written(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


def test_no_pick_when_every_item_is_done(spark, tmp_path):
    """as its SQL, no row when nothing is left; the operator still begins again where that is asked for."""
    written(spark.createDataFrame([(0, "a"), (1, "b")], "n_nationkey long, n_name string"), tmp_path, "nation")
    written(spark.createDataFrame([(40, 0), (80, 1), (41, 1)], "c_custkey long, c_nationkey long"), tmp_path, "customer")
    assert catalog.QUERIES["rotation_pick"](spark, str(tmp_path)).isEmpty()
    bank = spark.read.parquet(f"{tmp_path}/nation.parquet")
    assert ranking.next_lesson(bank, bank, "n_nationkey", "n_nationkey").first().n_nationkey == 0
    assert ranking.next_lesson(bank, bank.where("n_nationkey = 0"), "n_nationkey", "n_nationkey", again=False).first().n_nationkey == 1


def test_strict_bar_of_a_host_is_not_its_subdomains(spark, tmp_path):
    """the query's bar is for the listed hosts alone, as in its SQL; the operator can hold subdomains to it as well."""
    pages = [(150, "http://example.org/"), (151, "http://m.therin.example.org/"), (152, "http://m.ththth.example.net/"), (1, "http://example.org/a")]
    written(spark.createDataFrame([(i, u, f"<title>x{i}</title>") for i, u in pages], "page_id long, url string, html string"), tmp_path, "pages")
    got = {r.page_id: (r.importance < 30, r.strict) for r in catalog.QUERIES["page_importance"](spark, str(tmp_path)).collect()}
    assert got == {150: (True, True), 151: (True, False), 152: (True, True), 1: (False, False)}
    both = spark.createDataFrame([("m.example.org",)], "h string").select(gates.strict_source(F.col("h"), F.lit(5), ["example.org"]), gates.strict_source(F.col("h"), F.lit(5), ["example.org"], subdomains=False))
    assert tuple(both.first()) == (True, False)


T0 = datetime(2024, 1, 1)


def key_rows(n, seed, keys=14):
    r = random.Random(seed)
    return [(i, T0 + timedelta(minutes=r.choice([0, 720, 2160, r.randrange(6000)])), r.sample([f"k{k}" for k in range(keys)], r.randrange(11))) for i in range(n)]


def joined(df):
    """The joins and repeats on which rows would meet by a key before a pair is decided."""
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "key" in x]


@pytest.mark.parametrize("fewest", [2_000, 7])
def test_pairs_of_blocks_equal_brute_force(spark, monkeypatch, fewest):
    """pairs are decided where blocks of rows meet, and no pair of a common key is written before."""
    monkeypatch.setattr(blocks, "FEWEST", fewest)
    rows = [(i, keys) for i, _, keys in key_rows(110, 4)] + [(900, None), (901, ["k1", None])]
    df = spark.createDataFrame(rows, "id long, keys array<string>")
    sets = {i: set(k or []) - {None} for i, k in rows}
    shared = lambda a, b: len(sets[a] & sets[b])

    def overlap(a, b):
        n, least = shared(a, b), min(len(sets[a]), len(sets[b]))
        return n >= 6 and n / least >= 0.4 or n >= 4 and n / least >= 0.6

    inside = lambda a, b: len(sets[a]) >= 5 and sets[a] <= sets[b] and len(sets[b]) - len(sets[a]) <= 2
    half = lambda a, b: shared(a, b) >= 4 and 2 * shared(a, b) >= min(len(sets[a]), len(sets[b]))
    for found, test, ordered in ((similarity.overlap_pairs(df), overlap, True), (similarity.containment_pairs(df), inside, False), (similarity.headline_pairs(df), lambda a, b: inside(a, b) or half(a, b), False)):
        want = sorted((a, b, shared(a, b)) for a in sets for b in sets if a != b and (a < b or not ordered) and test(a, b))
        assert want and sorted(map(tuple, found.collect())) == want and not joined(found)


def test_rare_keys_alone_bring_rows_together(spark):
    """pairs by rare keys, over all rows and in the hours before the later one, also with common keys and equal times."""
    r = random.Random(8)
    rows = [(i, t, keys + ["hot"] + [f"r{r.randrange(40)}" for _ in range(6)]) for i, t, keys in key_rows(130, 9, 11)]
    rows = [(i, t, list(dict.fromkeys(k))) for i, t, k in rows] + [(500, T0, [f"x{k}" for k in range(7)]), (501, T0, [f"x{k}" for k in range(7)])]
    df = spark.createDataFrame(rows, "id long, t timestamp, keys array<string>")
    sets, at = {i: set(k) for i, _, k in rows}, {i: t for i, t, _ in rows}
    count = {k: sum(k in x for x in sets.values()) for x in sets.values() for k in x}
    want = sorted((a, b, len(sets[a] & sets[b]), n) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 4 and (n := sum(count[k] <= 9 for k in sets[a] & sets[b])) >= 1)
    assert len(want) > 5 and sorted(map(tuple, similarity.rare_follow_up(df, 9, 4, 1).collect())) == want
    hours = timedelta(hours=12)
    held = {(i, k): sum(k in sets[j] and at[i] - hours <= at[j] <= at[i] for j in sets) for i in sets for k in sets[i]}
    assert {(x.id, x.key): x.df for x in similarity.windowed_frequency(df, 12).collect()} == held
    want = []
    for a in sets:
        for b in sets:
            later = max(a, b, key=lambda i: (at[i], i))
            both = sets[a] & sets[b]
            n = sum(held[later, k] <= 4 for k in both)
            if a < b and abs(at[a] - at[b]) <= hours and len(both) >= 5 and n >= 2:
                want.append((a, b, later, len(both), n))
    assert len(want) > 5 and sorted(map(tuple, similarity.rare_in_window(df, 12, 4, 5, 2).collect())) == sorted(want)


def test_windowed_frequency_has_no_sliding_frame(spark):
    """a frame with a moving begin is counted anew for each row."""
    df = spark.createDataFrame(key_rows(20, 1), "id long, t timestamp, keys array<string>")
    plan = similarity.windowed_frequency(df, 36)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan.lower() and "-129600000000" not in plan.split("Window", 1)[1].split("]", 1)[0]


@pytest.mark.parametrize("fewest", [2_000, 6])
@pytest.mark.parametrize("kind", ["story", "event"])
def test_stories_of_blocks_equal_the_rule_on_all_pairs(spark, monkeypatch, fewest, kind):
    """a pair is decided in the task that counts its tokens, as the rule on columns decides it."""
    monkeypatch.setattr(blocks, "FEWEST", fewest)
    r = random.Random(3)
    words = [f"w{k}" for k in range(12)] + ["g1", "g2", "g3"]
    rows = []
    for i in range(90):
        w = r.sample(words, r.randrange(10))
        rows.append((i, f"{i}", w, [x for x in w if x[0] == "w"], r.choice([[], [], ["457"], ["457", "8"]]), r.choice([[]] * 9 + [["event 0"]])))
    df = spark.createDataFrame(rows, "id long, norm string, tokens array<string>, story array<string>, numbers array<string>, signature array<string>")
    found = similarity.story_pairs(df, kind)
    a, b = (df.select(*[F.col(c).alias(n if c == "id" else f"{n}_{c}") for c in df.columns]) for n in "ab")
    test = similarity.same_story() if kind == "story" else similarity.same_event()
    want = {(x.a, x.b) for x in a.crossJoin(b).where("a < b").where(test).select("a", "b").collect()}
    stars = [i for i, *_, s in rows if s]
    want |= {(stars[0], i) for i in stars[1:]}
    assert len(want) > 20 and sorted(map(tuple, found.collect())) == sorted(want) and not joined(found)


@pytest.mark.parametrize("heads_only", [False, True])
def test_clusters_of_many_pairs_are_found_in_rounds(spark, monkeypatch, heads_only):
    """More pairs than the bound are not searched for components; the result is that of the replay."""
    r = random.Random(6)
    pairs = spark.createDataFrame([tuple(r.sample(range(60), 2)) for _ in range(60)] + [(70 + i, 71 + i) for i in range(5)], "a long, b long")
    rows = spark.createDataFrame([(i, -i // 3) for i in range(80)], "id long, seq long")
    want = sorted(map(tuple, clusters.greedy_clusters(rows, pairs, heads_only).collect()))
    monkeypatch.setattr(clusters, "components", None)
    assert sorted(map(tuple, clusters.greedy_clusters(rows, pairs, heads_only, most_pairs=10).collect())) == want and len(want) == 80


def test_newest_matches_equal_all_pairs_without_pairing(spark):
    """a hot region or place is passed once in the order of time; rows do not meet before the match is known."""
    from newsloom.operators import editorial
    from newsloom.operators.gates import match_strength, toll_update

    r = random.Random(12)
    some = lambda names: r.sample(names, r.randrange(len(names)))
    rows = [(i, T0 + timedelta(minutes=r.choice([0, 480, 1080, r.randrange(4000)])), r.choice(["fire", "quake"]), some("abcd"), some(["x", "y", "z"]), some(["r", "s"]), r.choice([None, 2, 5, 9])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, t timestamp, kind string, anchors array<string>, places array<string>, regions array<string>, toll int")
    a, b = (df.select(F.struct(*df.columns).alias(n)) for n in "ab")
    age = F.unix_timestamp("a.t") - F.unix_timestamp("b.t")
    both = a.crossJoin(b).where("b.t < a.t").withColumn("s", match_strength(F.col("a"), F.col("b"))).where(((F.col("s") == 2) & (age <= 64800)) | ((F.col("s") == 1) & (age <= 28800)))
    best = both.groupBy("a.id").agg(F.max_by(F.struct("b.id", "s", toll_update(F.col("a.toll"), F.col("b.toll"))), F.struct("b.t", "b.id")).alias("x"))
    got = editorial.incident_matches(df)
    want = sorted((x.id, *x.x) for x in best.collect())
    assert len(want) > 50 and {x[2] for x in want} == {1, 2} and sorted(map(tuple, got.select("id", "match_id", "strength", "released").collect())) == want


def test_a_board_reads_and_writes_its_state_once_a_call():
    """the state is asked once for all rows of a call; a row of a board does not list its matches again."""
    from newsloom.streaming import timers

    class State:
        def __init__(self):
            self.value, self.map, self.calls = None, {}, 0

        def exists(self):
            self.calls += 1
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

        def iterator(self):
            self.calls += 1
            return iter(self.map.items())

        def updateValue(self, k, v):  # noqa: N802
            self.map[k] = v

        def clear(self):
            self.value, self.map = None, {}

    states = {}
    handle = type("Handle", (), {"getValueState": lambda _, n, s: states.setdefault(n, State()), "getMapState": lambda _, n, k, s: states.setdefault(n, State())})()
    board, minute = timers.Results(), 60_000_000
    board.held = []
    board.setup(handle)
    rows = [(k, k, k % 50, (600 - k % 50) * minute if k < 50 else None, k >= 50 and k % 3 == 0) for k in range(100)] + [(100, 100, 7, 900 * minute, False)]
    for state in board.held:
        state.begin()
    assert not [x for r in rows for x in board.came(r)]
    for state in board.held:
        state.end()
    final = len({k % 50 for k in range(50, 100) if k % 3 == 0})
    assert states["board"].value == (551 * minute, 900 * minute, 50 - final, 50, 100) and len(states["matches"].map) == 50
    assert sum(s.calls for s in states.values()) <= 10


@pytest.mark.parametrize("words", [1, 4])
def test_smaller_rows_meet_larger_ones_by_their_rarer_keys(spark, monkeypatch, words):
    """r04 F4, F6: the kernel of stories meets fewer rows by their keys than share one, and finds the same pairs, also among keys of one frequency."""
    import numpy as np

    monkeypatch.setattr(blocks, "WORDS", words)
    r = random.Random(14)
    names = list(range(150))
    sets = [set(r.sample(names, r.randrange(30))) | set(r.sample(range(20), r.randrange(20))) for _ in range(240)]
    block = lambda rows: {"id": np.array(rows), "size": np.array([len(sets[i]) for i in rows]), "keys": (np.array([k for i in rows for k in sorted(sets[i])]), np.array([len(sets[i]) for i in rows]))}
    a, b = block(list(range(130))), block(list(range(130, 240)))
    rule = similarity._overlaps
    fewest = lambda size: next((n for n in range(4, size + 1) if rule(np.array([n]), size, size)[0]), 0)
    need = lambda rows: np.array([fewest(int(size)) for size in rows["size"]])
    for x, y in ((a, b), (a, a)):
        want = {(i, j, len(sets[i] & sets[j])) for i in x["id"].tolist() for j in y["id"].tolist() if (x is not y or i < j) and sets[i] and sets[j] and rule(np.array([len(sets[i] & sets[j])]), len(sets[i]), len(sets[j]))[0]}
        got = []
        for i, hit, n, swapped in blocks._sharing(x, y, "keys", "size", need):
            one, others = (y["id"][i], x["id"][hit]) if swapped else (x["id"][i], y["id"][hit])
            got += [(min(int(one), j), max(int(one), j), k) for j, k in zip(others.tolist(), n.tolist(), strict=True) if rule(np.array([k]), len(sets[int(one)]), len(sets[j]))[0]]
        assert len(want) > 20 and sorted(got) == sorted(want)
        found = [(int(i), int(j), int(k)) for p, q, n, _ in blocks.KeyPairs(rule, 4).pairs(x, y) for i, j, k in zip(x["id"][p], y["id"][q], n, strict=True)]
        assert sorted((min(i, j), max(i, j), k) for i, j, k in found) == sorted(want)
    index = blocks.Index(a["keys"], a["size"])
    asked = []
    monkeypatch.setattr(blocks, "_often", lambda posts, *more, f=blocks._often: asked.append(len(posts)) or f(posts, *more))
    list(index.meet(a["keys"], a["size"], need(a), np.full(130, 130)))
    assert sum(asked) < 0.7 * sum(len(sets[i] & sets[j]) for i in range(130) for j in range(130))


@pytest.mark.parametrize("fewest", [2_000, 9])
def test_anchored_posts_meet_by_number_or_speaker(spark, monkeypatch, fewest):
    """r04 F5: keys are counted for rows that share a number or a speaker in time, and no list of Python numbers is held for each key."""
    monkeypatch.setattr(blocks, "FEWEST", fewest)
    r = random.Random(15)
    rows = [(i, t, keys + r.choice([[], ["tn"]]), r.choice([None, [], ["457"], ["457", "888"], ["999"]]), r.choice([None, "x", "y"])) for i, t, keys in key_rows(150, 16, 12)]
    df = spark.createDataFrame(rows, "id long, t timestamp, keys array<string>, numbers array<string>, speaker string")
    want = []
    for i, t, keys, numbers, speaker in rows:
        for j, u, others, theirs, other in rows:
            n, apart = len(set(keys) & set(others) - {"tn"}), t - u
            if (t, i) > (u, j) and (set(numbers or []) & set(theirs or []) and n >= 2 and apart <= timedelta(hours=36) or speaker and speaker == other and n >= 3 and apart <= timedelta(hours=2)):
                want.append((i, j))
    assert len(want) > 50 and sorted(map(tuple, similarity.anchored(df, ["tn"]).collect())) == sorted(want)
    assert not hasattr(blocks, "Shared")
