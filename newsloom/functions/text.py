"""Text cleaning as column functions. Patterns carry (?U) where letters or digits of any script are meant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that the normalisers fold.
INVISIBLE = "‌‏‎ "
EASTERN_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
MARKS = "[\\u064B-\\u065F\\u0670]"
FOLDS = {
    "letters": ("يك", "یک"),
    "dedup": ("يكةأإؤۀآ", "یکهااوها"),
    "polish": ("يكأإۀ", "یکااه"),
}
SENTENCE_END = r"(?<=[.!؟?؛])\s+"


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normal_space(text: Column) -> Column:
    """Zero-width and no-break characters count as spaces."""
    return collapsed(F.translate(text, INVISIBLE, " " * len(INVISIBLE)))


def half_spaced(text: Column, prefixes: Sequence[str] = ("می", "نمی"), suffixes: Sequence[str] = ("ها", "های", "هایی", "تر", "ترین")) -> Column:
    """Keeps the half space: folds letters, drops direction marks, and ties verb prefixes and word suffixes by a half space."""
    text = F.translate(text, "يك‏‎", "یک")
    text = collapsed(F.regexp_replace(text, r" *‌ *", "‌"))
    text = F.regexp_replace(text, rf"(^|\s)({'|'.join(prefixes)}) (?=\S)", "$1$2‌")
    return F.regexp_replace(text, rf"(\S) ({'|'.join(sorted(suffixes, key=len, reverse=True))})(?=\s|$)", "$1‌$2")


def western_digits(text: Column) -> Column:
    return F.translate(text, EASTERN_DIGITS, "0123456789" * 2)


def persian_digits(text: Column) -> Column:
    return F.translate(text, "0123456789-.", PERSIAN_DIGITS + "−٫")


def folded(text: Column, profile: str = "letters", lower: bool = True) -> Column:
    """One of the named letter folds; dedup and polish also drop vowel marks."""
    text = F.translate(text, *FOLDS[profile])
    if profile != "letters":
        text = F.regexp_replace(text, MARKS, "")
    text = normal_space(text)
    return F.lower(text) if lower else text


def search_text(*columns: Column, limit: int = 4000) -> Column:
    """Columns joined by spaces (nulls left out) and cut, to be computed once and scanned by many rules."""
    return F.substring(F.concat_ws(" ", *columns), 1, limit)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def rest_lines(text: Column) -> Column:
    at = F.instr(text, "\n")
    return F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise("")


def sentences(text: Column, least: int = 1) -> Column:
    """array<string>: split after an end mark and white space; shorter ones than least are dropped."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text))


def fewer_words(text: Column, n: int) -> Column:
    """word_count(text) < n, by no more of a text than its first words."""
    return F.size(F.filter(F.split(text, r"(?U)\s+", n + 2), lambda w: w != "")) < n


def is_incomplete(text: Column, dangling: Sequence[str] = ("and", "or", "of", "the", "with", "to", "و", "که", "از", "با", "به", "در")) -> Column:
    """Empty, cut off, or ending in a connector as a whole last word."""
    text = F.trim(F.coalesce(text, F.lit("")))
    last = F.element_at(F.split(F.substring_index(text, " ", -1), r"\s+"), -1)
    tail = F.substring(text, -5, 5)  # three signs and the line's end, before which $ stands too
    return (text == "") | tail.rlike(r"(…|\.\.\.|[,،:؛])$") | F.lower(last).isin(*dangling)


def cut_at_word(text: Column, limit: int, least: int = 40) -> Column:
    """Whole when it fits; else up to the last segment mark at or after least characters, else up to the last word."""
    head = F.substring(text, 1, limit)
    segment = F.regexp_extract(head, rf"(?s)^(.{{{least},}})[.!؟?؛،,:](?=[^.!؟?؛،,:]*$)", 1)
    word = F.regexp_extract(F.substring(text, 1, limit + 1), r"(?s)^(.*\S)\s", 1)
    return F.when(F.length(text) <= limit, text).when(segment != "", segment).when(word != "", word).otherwise(head)


def rewritten(text: Column, rules: Sequence[tuple[str, str]], whole_words: bool = True) -> Column:
    """Phrases replaced in the order of the rules, longest first among the given ones when whole words are meant."""
    for old, new in sorted(rules, key=lambda r: -len(r[0])) if whole_words else rules:
        quoted = "\\Q" + old + "\\E"
        text = F.regexp_replace(text, rf"(?iU)(?<![\w]){quoted}(?![\w])" if whole_words else quoted, new.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def stripped(text: Column, patterns: Sequence[str], least_words: int = 0) -> Column:
    """Patterns removed one after another; the text stays as it was if fewer than least_words words remain."""
    out = text
    for p in patterns:
        out = F.regexp_replace(out, p, " ")
    out = collapsed(out)
    return F.when(word_count(out) >= least_words, out).otherwise(text)


# What captions and titles carry besides their wording.
URL_PATTERN = r"(?i)\bhttps?://\S+|\bwww\.\S+|\bt\.me/\S+"
SOURCE_LINE = r"(?im)^\s*(source|منبع)\s*[:：].*$"
SUFFIX_PATTERNS = [r"(?i)\s*[-|–]\s*(x|twitter|telegram|instagram|facebook|youtube)\s*$", r"(?i)\s*[-|–]\s*[a-z0-9-]+(\.[a-z0-9-]+)+\s*$", r"\s*\+\s*(فیلم|عکس|ویدئو)\s*$"]
MEDIA_WORDS = r"(?i)\b(video|film|footage)\b|فیلم|ویدئو|ویدیو"
SECRET_PATTERNS = [r"\b\d{8,10}:[A-Za-z0-9_-]{30,}", r"\bsk-[A-Za-z0-9_-]{16,}", r"\bAIza[A-Za-z0-9_-]{20,}", r"\bgh[pousr]_[A-Za-z0-9]{20,}", r"(?i)\bbearer\s+[A-Za-z0-9._-]{12,}"]


def clean_title(title: Column, limit: int = 180) -> Column:
    out = normal_space(F.regexp_replace(title, "<[^>]*>", " "))
    for p in SUFFIX_PATTERNS:
        out = F.regexp_replace(out, p, "")
    return F.substring(F.trim(out), 1, limit)


def clean_content(text: Column, phrases: Sequence[str] = (), limit: int = 6000) -> Column:
    """Markup, links, source lines, listed boilerplate phrases and trailing hashtags removed, then cut."""
    out = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), URL_PATTERN, " ")
    out = F.regexp_replace(out, SOURCE_LINE, " ")
    if phrases:
        out = F.regexp_replace(out, "(?i)" + "|".join("\\Q" + p + "\\E" for p in sorted(phrases, key=len, reverse=True)), " ")
    out = F.regexp_replace(normal_space(out), r"(\s*#[^\s#]+)+$", "")
    return F.substring(out, 1, limit)


def sanitised_caption(text: Column) -> Column:
    """Links and source lines removed, line breaks kept."""
    out = F.regexp_replace(F.regexp_replace(text, SOURCE_LINE, ""), URL_PATTERN, "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def redacted(text: Column, known: Sequence[str] = (), limit: int = 500) -> Column:
    for value in known:
        text = F.replace(text, F.lit(value), F.lit("[REDACTED]"))
    for p in SECRET_PATTERNS:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return F.substring(text, 1, limit)


def media_consistent(text: Column, has_video: Column) -> Column:
    """Without a video, sentences that speak of one are dropped."""
    kept = F.filter(sentences(text), lambda s: ~s.rlike(MEDIA_WORDS))
    return F.when(has_video, text).otherwise(F.concat_ws(" ", kept))


def script_ratio(text: Column, inside: str, letters: str) -> Column:
    """Share of the letters that belong to a script (both are character classes); 1 without letters."""
    n = F.regexp_count(text, F.lit(letters))
    return F.when(n == 0, 1.0).otherwise(F.regexp_count(text, F.lit(inside)) / n)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def utf16_span(text: Column, part: Column) -> Column:
    """struct<offset, length> of part in text in UTF-16 units; null when it does not occur."""
    at = F.position(part, text)
    return F.when(at > 0, F.struct(utf16_length(F.substring(text, F.lit(1), at - 1)).alias("offset"), utf16_length(part).alias("length")))


def hashtags(text: Column, rules: Sequence[tuple[str, str]], limit: int = 2) -> Column:
    """The first distinct tags whose word occurs as a whole word, in the order of the rules."""
    low = F.lower(text)
    hits = F.array(*[F.when(low.rlike(rf"(?U)(?<!\w)\Q{word.lower()}\E(?!\w)"), F.lit(tag)) for word, tag in rules])
    return F.slice(F.array_distinct(F.filter(hits, lambda t: t.isNotNull())), 1, limit)


def json_object(raw: Column) -> Column:
    """The object in a model's answer as text: fences stripped, else the outermost braces; null unless it parses as an object."""
    bare = F.trim(F.regexp_replace(raw, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    is_object = lambda c: c.startswith("{") & F.try_parse_json(c).isNotNull()
    return F.when(is_object(bare), bare).when(is_object(inner), inner)


def caption_lines(caption: Column) -> Column:
    """The lines of a post that are story text: no tags, rules, links or short headers."""
    return F.filter(
        F.transform(F.split(caption, "\n"), lambda x: F.trim(x)),
        lambda x: (x != "") & ~x.startswith("#") & ~x.rlike(r"^[━─—-]{3,}$") & ~x.rlike(URL_PATTERN) & ~(x.contains("·") & (F.length(x) < 40)) & ~(x.rlike(r"^[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]") & (F.length(x) < 30)),
    )


def story_head(caption: Column) -> Column:
    return F.concat_ws(" ", F.slice(caption_lines(caption), 1, 2))


def build_caption(header: Column, title: Column, lead: Column, details: Column, footer: Column, limit: int = 980) -> Column:
    """header, title, lead, details and footer as blocks; details are dropped from the end until the caption fits."""
    blocks = lambda k: F.concat_ws("\n\n", header, title, F.concat(F.lit("⚡ "), lead), *( [F.concat_ws("\n", F.transform(F.slice(details, 1, k), lambda d: F.concat(F.lit("▫ "), d)))] if k else []), footer)
    fits = [F.when((F.size(details) >= k) & (F.length(blocks(k)) <= limit), blocks(k)) for k in (3, 2, 1)]
    return F.coalesce(*fits, blocks(0))


def parse_caption(caption: Column) -> Column:
    """struct<lead, details> of a built caption."""
    lines = F.split(caption, "\n")
    after = lambda mark: F.transform(F.filter(lines, lambda x: x.startswith(mark)), lambda x: F.trim(F.substring(x, F.lit(len(mark) + 1), F.length(x))))
    return F.struct(F.get(after("⚡"), 0).alias("lead"), after("▫").alias("details"))
