"""Verdicts of judges over stories: acceptance, alignment, consensus, provider order and output checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.tokens import scaled_numbers
from newsloom.operators.rules import Rule, all_reasons
from newsloom.runtime import broadcast_if_small

SCOPES = ["international", "national", "regional", "local"]


def acceptance(score: Column, happened: Column, scope: Column, hard: Column, war_zone: Column, security: Column, fallback: Column) -> Column:
    """Whether a verdict lets a story pass; out-of-range scores and unknown scopes count as a refusal, no verdict as the rule."""
    usable = score.between(0, 10) & scope.isin(*SCOPES)
    own = happened & (scope != "local") & (score >= F.when(war_zone, 5).when(hard, 6).otherwise(7))
    return F.when(score.isNull(), fallback).when(security & happened & (score >= 2), True).otherwise(F.coalesce(usable & own, F.lit(False)))


def aligned(verdicts: DataFrame, stories: DataFrame) -> DataFrame:
    """Verdicts (batch, n, echo, ...) kept when their echo shows that they speak of story n of the batch.

    Of the first three echoed words at least two (or all there are) must be among the title's first eight.
    """
    words = lambda c, k: F.slice(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), 1, k)
    joined = verdicts.join(stories, ["batch", "n"])
    echo = words(F.col("echo"), 3)
    return joined.where((F.size(echo) > 0) & (F.size(F.array_intersect(echo, words(F.col("title"), 8))) >= F.least(F.lit(2), F.size(F.array_distinct(echo)))))


def consensus(verdicts: DataFrame, item: str, model: str, flag: str) -> DataFrame:
    """A flag on an item counts when a second model raises it too."""
    votes = verdicts.groupBy(item).agg(F.count_distinct(F.when(F.col(flag), F.col(model))).alias("flags"), F.count_distinct(model).alias("models"))
    return votes.withColumn("confirmed", F.col("flags") >= 2)


def first_usable(verdicts: DataFrame, providers: DataFrame, cooling: DataFrame, item: str, *tie: str) -> DataFrame:
    """The verdict of each item's first provider by priority that parsed, rests not and, if weak, approves something concrete.

    Of several verdicts of that provider the first by the tie columns counts.
    """
    rows = verdicts.join(broadcast_if_small(providers), "provider").join(broadcast_if_small(cooling.select("provider").distinct()), "provider", "left_anti")
    usable = F.col("ok").isNotNull() & (~F.col("weak") | (F.col("ok") & F.col("concrete")))
    rows = rows.where(usable)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(item).orderBy("priority", "provider", *tie))).where("_n = 1").drop("_n")


def output_problems(source: Column, output: Column, most_sentences: int = 3, most_chars: int = 750, meta: str = r"(as an ai|here is|summary:)") -> Column:
    """array<string> of what is wrong with a rewritten text, judged against its source."""
    new_numbers = F.size(F.array_except(scaled_numbers(output), scaled_numbers(source))) > 0
    sentences = F.size(F.filter(F.split(F.regexp_replace(output, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != ""))
    return all_reasons([
        Rule("empty", F.trim(F.coalesce(output, F.lit(""))) == ""),
        Rule("new_number", new_numbers),
        Rule("too_many_sentences", sentences > most_sentences),
        Rule("too_long", F.length(output) > most_chars),
        Rule("meta_phrase", F.lower(output).rlike(meta)),
        Rule("artefact", output.rlike(r"(```|\{\{|\}\}|<[a-z]+>)")),
    ])


# Canonical statuses and the labels that older runs used.
STATUSES = ["published", "failed", "ambiguous", "blocked", "skipped_duplicate", "editorial_blocked", "selected"]
STATUS_ALIASES = {"success": "published", "sent": "published", "ok": "published", "error": "failed", "unknown_result": "ambiguous", "duplicate": "skipped_duplicate", "rejected": "blocked"}


def canonical_status(label: Column) -> Column:
    """Known labels and aliases; everything else, and null, is 'unknown'."""
    low = F.lower(F.trim(label))
    aliases = F.create_map(*[x for k, v in STATUS_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.when(low.isin(*STATUSES), low), F.element_at(aliases, low), F.lit("unknown"))


def outcome(ok: Column) -> Column:
    """true: published; false: failed (may be tried again); null: ambiguous (never tried again)."""
    return F.when(ok.isNull(), "ambiguous").when(ok, "published").otherwise("failed")


def judged_in_batches(stories: DataFrame, judge: Callable[[list[str]], list[dict | None]], size: int = 8) -> DataFrame:
    """(id, score, happened, scope) from a judge that sees so many titles at a time; a story it gives nothing for has nulls.

    The judge runs in the tasks that hold the stories; one that answers with another number of verdicts gets none accepted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), size):
                part = pdf.iloc[k : k + size]
                given = judge(part["title"].tolist())
                given = given if len(given) == len(part) else [None] * len(part)
                rows = [v or {} for v in given]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "score": pd.array([r.get("score") for r in rows], "Int32"), "happened": pd.array([r.get("happened") for r in rows], "boolean"), "scope": [r.get("scope") for r in rows]})

    return stories.select("id", "title").mapInPandas(run, f"id {dict(stories.dtypes)['id']}, score int, happened boolean, scope string")
