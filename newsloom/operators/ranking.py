"""Ranking with diversity, caps, tiers and bounded walks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a family's second, third, fourth and later picks cost.
PENALTIES = (0, 4, 10, 18)


def diverse_order(rows: DataFrame, family: str, score: str, seq: str, penalties: Sequence[int] = PENALTIES) -> DataFrame:
    """adjusted: the score less the penalty of the row's place in its family; ordering by it is what a greedy walk picks."""
    place = F.row_number().over(Window.partitionBy(family).orderBy(F.desc(score), seq))
    cost = F.element_at(F.array(*[F.lit(p) for p in penalties]), F.least(place, F.lit(len(penalties))))
    return rows.withColumn("family_place", place).withColumn("adjusted", F.col(score) - cost)


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k by the order, with their place; sorted and cut in each task before rows meet."""
    best = rows.orderBy(*order).limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def family_cap(rows: DataFrame, family: str, score: str, seq: str, most: int = 2, exempt: int = 12) -> DataFrame:
    """Rows beyond the family's first most are dropped unless their score is exempt."""
    place = F.row_number().over(Window.partitionBy(family).orderBy(F.desc(score), seq))
    return rows.withColumn("family_place", place).where((F.col("family_place") <= most) | (F.col(score) >= exempt))


def eligible_tiers(rows: DataFrame, tier: str = "tier") -> DataFrame:
    """Tier 4 alone when there are two such rows (with tiers 2 and 3 when there is one); without any, tiers 2 and up."""
    totals = rows.agg(F.max(tier).alias("top"), F.count_if(F.col(tier) >= 4).alias("fours"))
    least = F.when((F.col("top") >= 4) & (F.col("fours") >= 2), 4).otherwise(2)
    return rows.crossJoin(F.broadcast(totals.select(least.alias("least")))).where(F.col(tier) >= F.col("least")).drop("least")  # one row


def walk(rows: DataFrame, group: str, ok: str, target: int, *order: Column) -> DataFrame:
    """judged: whether a walk in the given order that stops after target accepted rows still looks at the row."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("judged", F.coalesce(F.sum(F.col(ok).cast("int")).over(w), F.lit(0)) < target)


def keep_last_days(rows: DataFrame, group: str, day: str, k: int) -> DataFrame:
    return rows.withColumn("_d", F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc(day)))).where(F.col("_d") <= k).drop("_d")


def next_lesson(bank: DataFrame, done: DataFrame, key: str, place: str, again: bool = True) -> DataFrame:
    """The first item not yet done; when every item is, the first of all, or with again=False none."""
    left = bank.join(done.select(key).distinct(), key, "left_anti").withColumn("_again", F.lit(0))
    if not again:
        return left.orderBy(place).limit(1).drop("_again")
    return left.union(bank.withColumn("_again", F.lit(1))).orderBy("_again", place).limit(1).drop("_again")


def fit_lines(lines: Column, limit: int) -> Column:
    """struct<text, taken, skipped>: lines appended in order while they fit; one that does not is skipped and takes no room."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("taken"), F.lit(0).alias("skipped"))

    def step(acc: Column, line: Column) -> Column:
        longer = F.concat(acc.text, F.when(acc.text == "", "").otherwise("\n"), line)
        fits = F.length(longer) <= limit
        return F.struct(F.when(fits, longer).otherwise(acc.text).alias("text"), (acc.taken + fits.cast("int")).alias("taken"), (acc.skipped + (~fits).cast("int")).alias("skipped"))

    return F.aggregate(lines, start, step)


def fit_boards(rows: DataFrame, group: str, order: str, line: str, limit: int) -> DataFrame:
    """(group, text, taken, skipped): fit_lines() for each group's lines in their order, whatever the number of lines.

    Groups are sorted by Spark and pass a task line by line; it holds one text of at most `limit` characters.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list = []  # group, text, taken, skipped
        for pdf in batches:
            done = []
            for key, new in pdf[[group, line]].itertuples(index=False):
                if not now or now[0] != key:
                    done += [now] if now else []
                    now = [key, "", 0, 0]
                longer = f"{now[1]}\n{new}" if now[1] else new
                if len(longer) <= limit:
                    now[1:3] = longer, now[2] + 1
                else:
                    now[3] += 1
            if done:
                yield pd.DataFrame(done, columns=[group, "text", "taken", "skipped"])
        if now:
            yield pd.DataFrame([now], columns=[group, "text", "taken", "skipped"])

    lines = rows.where(F.col(group).isNotNull() & F.col(line).isNotNull()).select(group, order, line)
    ordered = lines.repartition(group).sortWithinPartitions(group, order, line)
    return ordered.mapInPandas(run, f"{group} {dict(rows.dtypes)[group]}, text string, taken int, skipped int")
