"""Daily boards: price tables from pages, weather and match documents, and the lines made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import normal_space, western_digits
from newsloom.runtime import broadcast_if_small


def html_cells(html: Column) -> Column:
    """array<array<string>>: the text of the cells of each table row."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: normal_space(F.regexp_replace(c, "<[^>]*>", " ")))
    return F.transform(rows, cells)


def price_rows(pages: DataFrame, symbols: Sequence[str], html: str = "html", id_column: str = "page_id", least_cells: int = 3) -> DataFrame:
    """(id, symbol, cells): the last row of a page that names the symbol; value and change are the third and fourth cells."""
    rows = pages.select(id_column, F.posexplode(html_cells(F.col(html))).alias("place", "cells")).where(F.size("cells") >= least_cells)
    alternation = "|".join("\\Q" + s + "\\E" for s in sorted(symbols, key=len, reverse=True))
    rows = rows.withColumn("symbol", F.upper(F.regexp_extract(F.concat_ws(" ", "cells"), f"(?i)({alternation})", 1))).where("symbol <> ''")
    best = rows.groupBy(id_column, "symbol").agg(F.max_by("cells", "place").alias("cells"))
    return best.withColumn("value", F.get("cells", 2)).withColumn("change", F.get("cells", 3))


def model_rows(pages: DataFrame, html: str = "html", id_column: str = "page_id") -> DataFrame:
    """(id, model, year, market, factory, change): the last row of each model; a dash or nothing is null."""
    rows = pages.select(id_column, F.posexplode(html_cells(F.col(html))).alias("place", "c")).where((F.size("c") >= 4) & (F.get("c", 0) != "") & (F.get("c", 1) != ""))
    price = lambda k: F.when(~F.coalesce(F.get("c", k), F.lit("")).isin("", "-", "—"), F.get("c", k))
    return rows.groupBy(id_column, F.get("c", 0).alias("model")).agg(F.max_by(F.struct(F.get("c", 1).alias("year"), price(2).alias("market"), price(3).alias("factory"), price(4).alias("change")), "place").alias("x")).select(id_column, "model", "x.*")


def update_date(text: Column, label: str) -> Column:
    """The three to sixty characters after the label, up to a bar or tag; null without them."""
    return F.nullif(F.regexp_extract(text, rf"\Q{label}\E\s*[:：]?\s*([^|<\s:：][^|<]{{1,58}}[^|<\s])", 1), F.lit(""))


def is_price(cells: Column, place: int = 2) -> Column:
    return F.coalesce(western_digits(F.get(cells, place)).rlike(r"^[+-]?[0-9][0-9,٬.]*$"), F.lit(False))


def format_price(amount: Column) -> Column:
    """Compact from a million on, else with grouping."""
    return F.when(amount.isNull(), "—").when(amount >= 1_000_000, F.concat(F.regexp_replace(F.format_number(amount / 1_000_000, 2), r"\.?0+$", ""), F.lit(" M"))).otherwise(F.format_number(amount, 0))


def format_change(change: Column) -> Column:
    return F.when(change > 0, F.concat(F.lit("▲ "), F.format_number(change, 2))).when(change < 0, F.concat(F.lit("▼ "), F.format_number(-change, 2))).otherwise("–")


WEATHER_SCHEMA = "array<struct<current: struct<temperature_2m: double, weather_code: int, wind_speed_10m: double>, daily: struct<weather_code: array<int>, temperature_2m_max: array<double>, temperature_2m_min: array<double>, precipitation_probability_max: array<int>>>>"


def weather_rows(answers: DataFrame, cities: DataFrame, json: str = "value") -> DataFrame:
    """Answers aligned by place with the cities (place, city); a different number of them is an error."""
    n = cities.agg(F.count("*").alias("n"))
    parsed = answers.select(F.from_json(json, WEATHER_SCHEMA).alias("all")).crossJoin(F.broadcast(n))  # one row
    parsed = parsed.where(F.assert_true(F.size("all") == F.col("n"), F.lit("answers and cities differ in number")).isNull())
    rows = parsed.select(F.posexplode("all").alias("place", "x"))
    first = lambda c: F.get(F.col(f"x.daily.{c}"), 0)
    return rows.join(broadcast_if_small(cities), "place").select("city", F.col("x.current.temperature_2m").alias("now"), first("temperature_2m_max").alias("tmax"), first("temperature_2m_min").alias("tmin"), first("precipitation_probability_max").alias("rain"), F.coalesce(first("weather_code"), F.col("x.current.weather_code")).alias("code"))


def extremes(rows: DataFrame, group: str, name: str, high: str, low: str, order: str) -> DataFrame:
    """Per group the name with the greatest high and that with the least low (the earlier of equals), of rows with both."""
    both = rows.where(F.col(high).isNotNull() & F.col(low).isNotNull())
    return both.groupBy(group).agg(F.max_by(name, F.struct(F.col(high), -F.col(order))).alias("highest"), F.min_by(name, F.struct(F.col(low), F.col(order))).alias("lowest"))


def board_line(city: Column, now: Column, tmin: Column, tmax: Column, rain: Column) -> Column:
    """What is not known is a dash; a format of nothing would be text."""
    shown = lambda how, c: F.when(c.isNull(), "—").otherwise(F.format_string(how, c))
    degrees = lambda c: shown("%.0f°", c)
    return F.concat_ws(" ", city, degrees(now), F.concat(degrees(tmin), F.lit("/"), degrees(tmax)), shown("%d%%", rain))


MATCH_SCHEMA = "struct<matches: array<struct<id: long, leagueId: long, sport: int, hostName: string, guestName: string, scheduledStartOn: string, status: int>>, leagues: array<struct<id: long, title: string>>>"


def match_rows(answers: DataFrame, json: str = "value") -> DataFrame:
    """Matches with their league's title, null for an unknown league."""
    parsed = answers.select(F.from_json(json, MATCH_SCHEMA).alias("d"))
    matches = parsed.select(F.inline("d.matches"))
    leagues = parsed.select(F.inline("d.leagues")).select(F.col("id").alias("leagueId"), F.col("title").alias("league"))
    return matches.join(leagues.dropDuplicates(["leagueId"]), "leagueId", "left")


def match_importance(host: Column, guest: Column, league: Column, own: Sequence[str], clubs: Sequence[str], stages: Sequence[str], top_leagues: Sequence[str], excluded: Sequence[str]) -> Column:
    """5 the own team, 4 a big club, 3 a deciding stage, 2 a top league, 0 others and excluded leagues."""
    low, names = F.lower(F.coalesce(league, F.lit(""))), F.lower(F.concat_ws(" ", host, guest))
    some = lambda text, terms: F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(text, t))
    return F.when(some(names, own) & ~low.contains("women"), 5).when(some(names, clubs), 4).when(some(low, excluded), 0).when(some(low, stages), 3).when(some(low, top_leagues), 2).otherwise(0)


def best_window(rows: DataFrame, score: str, start: str, tie: str, asof: Column, before: str, after: str, k: int) -> DataFrame:
    """The k best by score of those that start around asof, then in the order of their start."""
    inside = rows.where(F.col(start).between(asof - F.expr(before), asof + F.expr(after)))
    return inside.orderBy(F.desc(score), start, tie).limit(k).orderBy(start, tie)


def result_text(host: Column, guest: Column, host_pens: Column, guest_pens: Column) -> Column:
    pens = F.when((host_pens.isNotNull()) & (guest_pens.isNotNull()) & ((host_pens > 0) | (guest_pens > 0)), F.concat(F.lit("("), guest_pens, F.lit(" - "), host_pens, F.lit(") ")))
    return F.when(host.isNotNull() & guest.isNotNull(), F.concat(F.coalesce(pens, F.lit("")), guest, F.lit(" - "), host))


def due_boards(matches: DataFrame, day: str, start: str, finished: str, at_hour: int = 21) -> DataFrame:
    """Per day: when its results are due (the hour, or 2 h 15 min after the last start) and when waiting ends (4 h after it)."""
    g = matches.groupBy(day).agg(F.max(start).alias("last_start"), F.bool_and(finished).alias("all_finished"), F.count("*").alias("matches"))
    due = F.greatest(F.to_timestamp(day) + F.make_dt_interval(hours=F.lit(at_hour)), F.col("last_start") + F.expr("INTERVAL '2:15' HOUR TO MINUTE"))
    return g.withColumn("due_at", due).withColumn("given_up_at", F.col("last_start") + F.expr("INTERVAL 4 HOURS"))


def longest_alias(rows: DataFrame, aliases: DataFrame, name: str, id_column: str) -> DataFrame:
    """Each row's target by the longest alias (alias, target) that its lower-cased name holds.

    Names give their parts of the lengths that aliases have, and parts and aliases meet by equality: no alias is tried on a name
    that lacks it.
    """
    sizes = [r.n for r in aliases.select(F.length("alias").alias("n")).where("n > 0").distinct().collect()]  # lengths of names: few
    low = F.lower(name)

    def parts_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))

    parts = [parts_of(n) for n in sizes]
    cut = rows.withColumn("alias", F.explode(F.array_distinct(F.flatten(F.array(*parts).cast("array<array<string>>")))))
    met = cut.join(broadcast_if_small(aliases.dropDuplicates(["alias"])), "alias")
    met = met.select(*rows.columns, *aliases.columns)
    return met.withColumn("_n", F.row_number().over(Window.partitionBy(id_column).orderBy(F.desc(F.length("alias")), "alias"))).where("_n = 1").drop("_n")


def complete_prices(rows: DataFrame, required: Sequence[str], least: int = 5, id_column: str = "page_id") -> DataFrame:
    """rows of pages whose table has every required symbol and enough prices; a page that lacks some is an error that names it."""
    have = rows.groupBy(id_column).agg(F.collect_set("symbol").alias("have"), F.count_if(is_price(F.col("cells"))).alias("prices"))
    lacking = F.array_except(F.array(*[F.lit(s) for s in required]).cast("array<string>"), F.col("have"))
    bad = (F.size(lacking) > 0) | (F.col("prices") < least)
    checked = have.where(F.when(bad, F.raise_error(F.concat(F.lit("incomplete price table; missing: "), F.array_join(lacking, ",")))).isNull())
    return rows.join(checked.select(id_column), id_column, "left_semi")


def shown_matches(matches: DataFrame, shown: DataFrame) -> DataFrame:
    """Matches that a board showed: the same sides and start."""
    return matches.join(shown.select("hostName", "guestName", "scheduledStartOn").distinct(), ["hostName", "guestName", "scheduledStartOn"], "left_semi")


def final_results(board: DataFrame, results: DataFrame, finished: int = 7) -> DataFrame:
    """Board rows with their result, when it is final and both scores are known; sport 3 counts points, others goals."""
    score = lambda side: F.when(F.col("sport") == 3, F.col(f"points.{side}")).otherwise(F.col(f"goals.{side}"))
    pens = (F.coalesce("penalties.host", F.lit(0)) > 0) | (F.coalesce("penalties.guest", F.lit(0)) > 0)
    both = F.col("penalties.host").isNotNull() & F.col("penalties.guest").isNotNull() & pens
    r = results.where(F.col("status") == finished).select("id", "goals", "points", "penalties")
    rows = board.join(r, "id").select("id", "hostName", "guestName", score("host").alias("host"), score("guest").alias("guest"), F.when(both, F.col("penalties")).alias("penalties"))
    return rows.where("host is not null and guest is not null")


def caption_items(rows: DataFrame, group: str, own: str, score: str, start: str, first_own: int = 4, first_other: int = 6) -> DataFrame:
    """The rows that a caption names (some of the own side's, some others) with how many more there are."""
    w = Window.partitionBy(group, own)
    rows = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc(score), start))).withColumn("all", F.count("*").over(w))
    limit = F.when(F.col(own), first_own).otherwise(first_other)
    return rows.withColumn("more", F.greatest(F.col("all") - limit, F.lit(0))).where(F.col("place") <= limit).drop("all")
