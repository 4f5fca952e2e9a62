"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from newsloom.operators import boards
from newsloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    cursor = duck.execute(catalog.ORACLES[name])
    there = [d[0] for d in cursor.description]
    assert sorted(there) == columns
    want = sorted((tuple(plain(r[there.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


#: Queries without SQL, and the tests that replay them as registered.
REPLAYED = {
    "output_numbers": "test_output_numbers_replayed", "bounded_board": "test_bounded_board_replayed", "remembered_repeats": "tests/test_timers.py", "memory_streamed": "tests/test_timers.py",
    "incidents_streamed": "tests/test_timers.py", "html_main_text": "tests/test_html_text.py", "dictionary_rewritten": "tests/test_dictionary.py",
}
#: Those of which only the functions are held, by fixtures.
BY_FIXTURES = ["lead_reselect", "on_topic_lines", "post_problems", "publisher_links", "redundant_lines", "scored_summary"]


def test_every_query_without_sql_is_named():
    assert sorted([*REPLAYED, *BY_FIXTURES]) == sorted(set(catalog.QUERIES) - set(catalog.ORACLES))


@pytest.mark.parametrize("name", BY_FIXTURES)
def test_query_without_sql_is_the_same_on_other_partitions(spark, name):
    runs = []
    for n in ("4", "3"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(sorted((tuple(map(plain, r)) for r in catalog.QUERIES[name](spark, SF).collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] and runs[0] == runs[1]


def test_output_numbers_replayed(spark, duck):
    rows = duck.execute("SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn), role FROM conversations").fetchall()

    def numbers(text):
        found = {int(n) for n in re.findall("[0-9]+", re.sub("(?<=[0-9])[,٬،](?=[0-9]{3})", "", text or "")) if len(n) <= 18}
        return {n // s for n in found for s in (1, 10**3, 10**6, 10**9) if s == 1 or (n >= s and n % s == 0)}

    want = {(c, t): bool(numbers(out) - numbers(src)) for c, t, out, src, role in rows if role == "assistant" and src is not None}
    assert {(r.conv_id, r.turn): r.new_number for r in catalog.QUERIES["output_numbers"](spark, SF).collect()} == want


def test_bounded_board_replayed(spark):
    lines = spark.read.parquet(f"{SF}/customer.parquet").select("c_nationkey", "c_custkey", F.concat_ws(": ", "c_name", boards.format_price(F.col("c_acctbal") * 1000)).alias("line")).collect()
    want: dict[int, list] = {}
    for r in sorted(lines, key=lambda r: r.c_custkey):
        b = want.setdefault(r.c_nationkey, ["", 0, 0])
        longer = f"{b[0]}\n{r.line}" if b[0] else r.line
        b[:] = [longer, b[1] + 1, b[2]] if len(longer) <= 3900 else [b[0], b[1], b[2] + 1]
    assert {r.c_nationkey: [r.text, r.taken, r.skipped] for r in catalog.QUERIES["bounded_board"](spark, SF).collect()} == want
