"""Rule tables as columns: term counts, flags, and gates that name the first reason for a rejection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(terms: Sequence[str], whole_words: bool = True) -> str:
    """One alternation for a list of terms, in the syntax that Java and RE2 share."""
    body = "|".join(sorted((t.lower() for t in terms), key=lambda t: (-len(t), t)))
    return rf"(^|[^a-z0-9])({body})([^a-z0-9]|$)" if whole_words else f"({body})"


# Signs of expressions, which terms may be, and how many terms are looked for as plain text first.
SIGNS, MOST_LOOKED_FOR = set("\\.^$*+?{}[]|()"), 16


def has(text: Column, terms: Sequence[str], whole_words: bool = True) -> Column:
    found = text.rlike(any_of(terms, whole_words))
    if not terms or len(terms) > MOST_LOOKED_FOR or any(SIGNS & set(t) for t in terms):
        return found
    return reduce(or_, [F.contains(text, F.lit(t.lower())) for t in terms]) & found  # most texts hold none, which is seen faster so


def count_terms(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur as substrings; one array and one lambda, however many terms."""
    return F.size(F.filter(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(text, t)))


@dataclass(frozen=True)
class Rule:
    reason: str
    when: Column


def first_reason(rules: Sequence[Rule]) -> Column:
    """The reason of the first rule that holds; null if none does. Later rules are not looked at for rows decided before."""
    return F.coalesce(*[F.when(r.when, F.lit(r.reason)) for r in rules])


def all_reasons(rules: Sequence[Rule]) -> Column:
    return F.filter(F.array(*[F.when(r.when, F.lit(r.reason)) for r in rules]), lambda x: x.isNotNull())


def gate(rules: Sequence[Rule], rescue: Column | None = None, never_rescued: Sequence[str] = ()) -> tuple[Column, Column]:
    """(accepted, reason): rejected by the first rule that holds, unless a rescue applies to that reason."""
    reason = first_reason(rules)
    if rescue is not None:
        reason = F.when(rescue & ~F.coalesce(reason.isin(*never_rescued), F.lit(False)) if never_rescued else rescue, F.lit(None)).otherwise(reason)
    return reason.isNull(), reason
