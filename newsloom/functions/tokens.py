"""Token sets, fingerprints and numbers of short texts, as column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import western_digits

# Words that carry no story.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]
GENERIC_WORDS = ["news", "report", "latest", "live", "update", "today"]
SUFFIXES = ["ations", "ation", "ings", "ing", "ers", "er", "ed", "es", "s"]
VOWELS = "[aeiouáéíóúäöüàèêîâçıویاء]"


def _listed(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def title_tokens(title: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct words of two or more characters: digits folded, lower case, punctuation out, stop words out."""
    words = F.split(F.regexp_replace(F.lower(western_digits(title)), r"(?U)[^\p{L}\p{N}]+", " "), " ")
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2)), _listed(stop))


def story_tokens(title: Column) -> Column:
    return F.array_except(title_tokens(title), _listed(GENERIC_WORDS))


def stem(word: Column, suffixes: Sequence[str] = SUFFIXES, least: int = 3) -> Column:
    return F.regexp_replace(word, rf"^(.{{{least},}}?)({'|'.join(suffixes)})$", "$1")


def fingerprint(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Keys of the words of three or more letters: light stem, then the first letter and the rest without vowels."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]{3,}"), F.lit(0)), lambda w: ~F.array_contains(_listed(stop), w))
    keys = F.transform(words, lambda w: F.concat(F.substring(stem(w), 1, 1), F.regexp_replace(F.substring(stem(w), 2, 1 << 30), VOWELS, "")))
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) >= 2))


def numbers_in(text: Column) -> Column:
    """Distinct runs of digits, of any script, as western digits."""
    return F.array_distinct(F.regexp_extract_all(western_digits(text), F.lit(r"[0-9]+"), F.lit(0)))


def distinctive_numbers(text: Column) -> Column:
    """Three or more digits, no year of the two calendars, no round hundreds."""
    return F.filter(numbers_in(text), lambda n: (F.length(n) >= 3) & ~n.rlike("^(13|14|19|20)[0-9]{2}$") & ~n.endswith("00"))


def scaled_numbers(text: Column) -> Column:
    """Numbers without thousand separators; multiples of 10^3, 10^6 and 10^9 also yield the quotient."""
    plain = F.regexp_replace(western_digits(text), r"(?<=[0-9])[,٬،](?=[0-9]{3})", "")
    values = F.transform(F.filter(F.regexp_extract_all(plain, F.lit(r"[0-9]+"), F.lit(0)), lambda n: F.length(n) <= 18), lambda n: n.cast("long"))
    scales = F.array(*[F.lit(s).cast("long") for s in (1, 10**3, 10**6, 10**9)])
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.transform(F.filter(scales, lambda s: (s == 1) | ((v >= s) & (v % s == 0))), lambda s: (v / s).cast("long")))))


# Number words.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "dozens": 24, "hundreds": 200, "یک": 1, "دو": 2, "سه": 3, "چهار": 4, "پنج": 5, "شش": 6, "هفت": 7, "هشت": 8, "نه": 9, "ده": 10}


def toll(text: Column, verbs: str = "killed|dead|died|injured|wounded|کشته|زخمی|مجروح") -> Column:
    """The largest count that stands before (or after 'killed:') a casualty word, in digits or words; null without one."""
    low = F.lower(western_digits(text))
    words = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
    raw = F.array_union(
        F.regexp_extract_all(low, F.lit(rf"(?<![0-9])([0-9]{{1,7}}|{words})(?: [\p{{L}}]+){{0,2}} (?:{verbs})"), F.lit(1)),
        F.regexp_extract_all(low, F.lit(rf"(?:{verbs})(?: at least|:)? ([0-9]{{1,7}}|{words})\b"), F.lit(1)),
    )
    table = F.create_map(*[x for k, v in NUMBER_WORDS.items() for x in (F.lit(k), F.lit(v))])
    return F.array_max(F.transform(raw, lambda x: F.coalesce(x.try_cast("int"), F.element_at(table, x))))


def magnitude(text: Column) -> Column:
    low = F.lower(western_digits(text))
    first = F.regexp_extract(low, r"\bm ?([0-9](?:\.[0-9])?)\b", 1)
    second = F.regexp_extract(low, r"([0-9](?:\.[0-9])?)[- ]?(?:magnitude|on the richter|ریشتر)", 1)
    third = F.regexp_extract(low, r"(?:magnitude|بزرگی)(?: of)? ([0-9](?:\.[0-9])?)", 1)
    return F.coalesce(*[F.nullif(x, F.lit("")).try_cast("double") for x in (first, second, third)])


def speaker(text: Column) -> Column:
    """One to three words of at most 30 characters before a colon."""
    found = F.trim(F.regexp_extract(F.regexp_replace(text, "<[^>]*>", ""), r"^[^\p{L}]*([^:：\n«»<>]{2,30}?)\s*[:：]", 1))
    return F.when((found != "") & (F.size(F.split(found, r"\s+")) <= 3), found)


def adjacent_repeat(text: Column, least: int = 6) -> Column:
    """Whether two neighbouring words of at least so many letters are the same."""
    w = F.split(F.lower(text), r"(?U)\s+")
    return F.exists(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.coalesce((a == b) & (F.length(a) >= least), F.lit(False))), lambda x: x)


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    both = shared(a, b)
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 0.0).otherwise(both / every)


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(shared(a, b) / least)
