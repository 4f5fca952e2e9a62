"""Sentence-level editing of stories as array functions: what to keep, what to drop, what to put first."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import collapsed, word_count, words_of


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for all its uses inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keys_of(text: Column, letters: int = 4) -> Column:
    """Distinct stems: the first letters of the words of so many letters or more."""
    return F.array_distinct(_stems(text, letters))


def _stems(text: Column, letters: int = 4) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(\p{{L}}{{{letters}}})\p{{L}}*"), F.lit(1))


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def sentence_score(sentence: Column, very: Sequence[str], plain: Sequence[str], speech: Sequence[str]) -> Column:
    low = F.lower(sentence)
    n = lambda terms: F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t)))
    return 4 * n(very) + 2 * n(plain) + F.when(n(speech) > 0, 1).otherwise(0)


def summary(sentences: Column, score: Callable[[Column], Column], more: int = 2, limit: int = 600) -> Column:
    """The first sentence and up to two more by score (earlier first among equals) while they fit, in score order."""
    rest = F.transform(F.slice(sentences, F.lit(2), F.greatest(F.size(sentences) - 1, F.lit(0))), lambda s, i: F.struct((-score(s)).alias("rank"), i.alias("place"), s.alias("text")))
    start = F.struct(F.get(sentences, 0).alias("text"), F.lit(0).alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        longer = F.concat_ws(" ", acc.text, x.text)
        fits = (acc.taken < more) & (F.length(longer) <= limit)
        return F.struct(F.when(fits, longer).otherwise(acc.text).alias("text"), (acc.taken + fits.cast("int")).alias("taken"))

    return F.when(F.size(sentences) > 0, F.aggregate(F.array_sort(rest), start, step).text).otherwise("")


def supported_parts(title: Column, body: Column, sign: str = "؛", share: float = 0.5) -> Column:
    """Parts of a headline between signs are kept when half of their words, or the words' stems, are in the body."""
    low = F.lower(body)

    def support(part: Column) -> Column:
        w = words_of(F.lower(part))
        return F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.filter(w, lambda x: low.contains(F.substring(x, 1, 4)))) / F.size(w))

    parts = F.split(title, rf"\s*\Q{sign}\E\s*")
    kept = F.filter(parts, lambda p: support(p) >= share)
    return F.when(F.size(parts) < 2, title).when(F.size(kept) == 0, title).otherwise(F.array_join(kept, f"{sign} "))


def first_part(title: Column, limit: int = 100, least: int = 25) -> Column:
    """The part before ' / ' of a title that is too long."""
    part = F.substring_index(title, " / ", 1)
    return F.when((F.length(title) > limit) & (F.length(part) >= least) & (part != title), part).otherwise(title)


# How a source is named before, inside and after a sentence.
ATTRIBUTIONS = [r"(?i)^(?:according to|as reported by) [^,.]{2,40}, *", r"(?i),? (?:according to|as reported by) [^,.]{2,40}(?=[.]?$)", r"(?i),? [^,.]{2,40} (?:reported|said in a report)(?=[.]?$)", r"^به گزارش [^،.]{2,40}، *", r"،? به نقل از [^،.]{2,40}(?=[.]?$)"]


def without_attribution(sentences: Column, outlets: Sequence[str] = ()) -> Column:
    """Attributions stripped; a later sentence whose subject is an outlet is dropped, the lead is kept."""

    def strip(s: Column) -> Column:
        for p in ATTRIBUTIONS:
            s = F.regexp_replace(s, p, "")
        return F.trim(s)

    cleaned = F.filter(F.transform(sentences, strip), lambda s: s != "")
    if not outlets:
        return cleaned
    names = "|".join("\\Q" + o.lower() + "\\E" for o in outlets)
    return F.filter(cleaned, lambda s, i: (i == 0) | ~F.lower(s).rlike(rf"^(the )?({names})\b"))


def without_header(text: Column, title: Column, markers: str = r"(?i)news code|published|کد خبر|تاریخ انتشار", least_words: int = 12) -> Column:
    """Where the first 400 characters carry a page's header: its markers and the repeated headline go, if enough words remain."""
    head = F.substring(text, 1, 400)
    bare = F.regexp_replace(text, rf"(?i)(?:{markers.removeprefix('(?i)')})\s*[:：]?\s*[0-9۰-۹/:\- ]*", " ")
    at = F.position(title, bare)
    cut = collapsed(F.when((F.length(title) > 0) & (at > 0) & (at < 400), F.substring(bare, at + F.length(title), F.length(bare))).otherwise(bare))
    return F.when(head.rlike(markers) & (word_count(cut) >= least_words), cut).otherwise(text)


def without_teasers(sentences: Column, least_words: int = 8) -> Column:
    """Ticker stamps before sentences and sentences that only point to other stories are removed; kept as it was if little remains."""
    stamped = F.transform(sentences, lambda s: F.regexp_replace(s, r"^\s*[0-9]{1,2}:[0-9]{2}\s*[-|–]?\s*", ""))
    kept = F.filter(stamped, lambda s: ~F.lower(s).rlike(r"^(read more|see also|related|more on this|بیشتر بخوانید|مطالب مرتبط)"))
    return F.when(word_count(F.array_join(kept, " ")) >= least_words, kept).otherwise(sentences)


def without_widgets(sentences: Column, least_words: int = 4) -> Column:
    """Button and counter texts are cut from sentences; scraps of few words are dropped."""
    cut = F.transform(sentences, lambda s: collapsed(F.regexp_replace(s, r"(?i)\b(share|like|comments?|views?|print|copy link|subscribe)\b\s*[:：]?\s*[0-9]*", " ")))
    return F.filter(cut, lambda s: word_count(s) >= least_words)


def on_topic(title: Column, sentences: Column, lead_keys: int = 2, least_title_keys: int = 3) -> Column:
    """The first sentence that shares two keys with the title leads; later ones must share a key with the title or the lead.

    Titles of few keys decide nothing, then all sentences stay; without a lead nothing does.
    """

    @F.arrow_udf("array<boolean>")
    def kept(head: pa.Array, column: pa.Array) -> pa.Array:
        return _by_slices(lambda t, s: _topical(t, s, lead_keys, least_title_keys), head, column)

    topical = _chosen(sentences, kept(keys_of(title), F.transform(sentences, lambda s: _stems(s))))
    few = F.coalesce(F.size(keys_of(title)) < least_title_keys, F.lit(False))
    return F.when(sentences.isNull() & ~few, F.array().cast("array<string>")).otherwise(topical)


#: Rows of a batch that are worked on together: bounds the memory of a worker.
SLICE = 256


def _by_slices(work: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    parts = [work(*[c.slice(i, SLICE) for c in columns]) for i in range(0, len(columns[0]), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.bool_()))


def _listed(values: np.ndarray, like: pa.Array) -> pa.Array:
    """values as lists of the lengths of like's, null where like is."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(like), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, pa.bool_()), mask=like.is_null())


def _parents(lists: pa.Array) -> np.ndarray:
    return pc.list_parent_indices(lists).to_numpy().astype(np.int64)


def _coded(*strings: pa.Array) -> tuple[list[np.ndarray], int]:
    """Numbers that are equal where strings are, and how many there are."""
    some = [s for s in strings if len(s)]  # an empty part of Spark's may have no buffer to be joined
    found = (pa.concat_arrays(some) if some else pa.array([], pa.string())).dictionary_encode()
    codes = found.indices.to_numpy().astype(np.int64)
    return np.split(codes, np.cumsum([len(s) for s in strings])[:-1]), max(1, len(found.dictionary))


def _distinct(line: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of every line once each."""
    return np.divmod(np.unique(line * size + codes), size)


def _topical(title: pa.Array, column: pa.Array, lead_keys: int, least_title_keys: int) -> pa.Array:
    lines = column.flatten()
    row, line = _parents(column), _parents(lines)
    (head, keys), size = _coded(title.flatten(), lines.flatten())
    line, keys = _distinct(line, keys, size)
    pairs = row[line] * size + keys
    titled = np.bincount(line[np.isin(pairs, _parents(title) * size + head)], minlength=len(lines))
    leads = np.full(len(column), len(lines))
    fit = np.flatnonzero(titled >= lead_keys)
    np.minimum.at(leads, row[fit], fit)
    lead = leads[row]
    led = np.bincount(line[np.isin(pairs, pairs[line == lead[line]])], minlength=len(lines))
    few = pc.fill_null(pc.less(pc.list_value_length(title), least_title_keys), False).to_numpy(zero_copy_only=False)
    at = np.arange(len(lines))
    return _listed(few[row] | (at == lead) | (at > lead) & ((titled > 0) | (led > 0)), column)


def _chosen(sentences: Column, kept: Column) -> Column:
    pairs = F.zip_with(sentences, kept, lambda s, k: F.struct(s.alias("s"), k.alias("k")))
    return F.transform(F.filter(pairs, lambda x: x.k), lambda x: x.s)


def without_near_copies(sentences: Column, share: float = 0.8) -> Column:
    """A sentence is dropped when so much (above 0) of its words is in one kept before it."""

    @F.arrow_udf("array<boolean>")
    def kept(column: pa.Array) -> pa.Array:
        return _by_slices(lambda s: _unlike(s, share), column)

    return _chosen(sentences, kept(F.transform(sentences, lambda s: F.lower(s))))


#: The characters of Java's (?U)\\s, in the syntax of Arrow's expressions.
_WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _words(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(line, word) of the distinct words of lines, words as numbers below the last of the three."""
    if pc.any(pc.match_substring_regex(lines, _WHITE.replace(" ", ""))).as_py():
        lines = pc.replace_substring_regex(lines, _WHITE, " ")
    parts = pc.split_pattern(lines, " ")
    words = parts.flatten()
    filled = pc.not_equal(words, "")
    (codes,), size = _coded(words.filter(filled))
    return *_distinct(_parents(parts)[filled.to_numpy(zero_copy_only=False)], codes, size), size


def _unlike(column: pa.Array, share: float) -> pa.Array:
    """Sentences of which too little was said before, in whatever sentences, stay; the others are looked up among those kept."""
    lines = column.flatten()
    line, words, size = _words(lines)
    counts = np.bincount(line, minlength=len(lines))
    heads = _firsts(_parents(column)[line] * size + words)
    again = counts - np.bincount(line[heads], minlength=len(lines))
    doubtful = again >= share * counts
    kept = (counts > 0) & ~doubtful
    ends = np.concatenate(([0], np.cumsum(counts))).tolist()
    line_ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))).tolist()
    for first, end in zip(line_ends, line_ends[1:], strict=False):
        unsure = np.flatnonzero(doubtful[first:end] & (counts[first:end] > 0))
        if len(unsure):
            start, stop = first + int(unsure[0]), first + int(unsure[-1]) + 1
            text = words[ends[first] : ends[stop]].tolist()
            said = [text[ends[i] - ends[first] : ends[i + 1] - ends[first]] for i in range(first, stop)]
            kept[start:stop] = _look_up(said, doubtful[first:stop].tolist(), share)[start - first :]
    return _listed(kept, column)


def _look_up(sentences: list[list[int]], doubtful: list[bool], share: float) -> list[bool]:
    """Of n words c must be shared, so a copy's original holds one of any n - c + 1 of them: those in the fewest kept sentences."""
    kept = [False] * len(sentences)
    holders: dict[int, list[int]] = {}
    sets: list[set[int]] = []
    none: list[int] = []
    for i, words in enumerate(sentences):
        own = set(words)
        sets.append(own)
        if not words:
            continue
        if doubtful[i]:
            least = share * len(words)
            probes = sorted([holders.get(w, none) for w in words], key=len)[: max(0, len(words) - math.ceil(least) + 1)]
            if any(len(own & sets[k]) >= least for k in set().union(*probes)):
                continue
        kept[i] = True
        for w in words:
            holders.setdefault(w, []).append(i)
    return kept


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where a value stands for the first time."""
    return np.unique(values, return_index=True)[1]


def without_redundant(title: Column, sentences: Column, fillers: Sequence[str] = (r"(?i)^(more details|further details|this story is)",)) -> Column:
    """After the lead, fillers go, and details that add no number and at most one key to what was said."""
    numbers = lambda s: F.regexp_extract_all(s, F.lit(r"[0-9]+"), F.lit(0))
    head = F.coalesce(title, F.lit(""))

    @F.arrow_udf("array<boolean>")
    def kept(*columns: pa.Array) -> pa.Array:
        return _by_slices(_news, *columns)

    each = lambda f: F.transform(sentences, f)
    return _chosen(sentences, kept(keys_of(head), numbers(head), each(lambda s: _stems(s)), each(numbers), each(lambda s: s.rlike("|".join(fillers)))))


def _news(head_keys: pa.Array, head_numbers: pa.Array, keys: pa.Array, numbers: pa.Array, filler: pa.Array) -> pa.Array:
    """Sentences whose news are said there for the first time stay; what is new only if sentences before were dropped is replayed."""
    row = _parents(keys)
    first = np.zeros(len(row), bool)
    first[_firsts(row)] = True
    may = first | ~pc.fill_null(filler.flatten(), False).to_numpy(zero_copy_only=False)

    def new(head: pa.Array, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, line, opens) of what the title does not say: row and value, sentence, whether it is the first such."""
        lines = column.flatten()
        line = _parents(lines)
        (told, said), size = _coded(head.flatten(), lines.flatten())
        line, said = _distinct(line, said, size)
        pairs = row[line] * size + said
        open_ = ~np.isin(pairs, _parents(head) * size + told)
        pairs, line = pairs[open_], line[open_]
        opens = np.zeros(len(pairs), bool)
        opens[_firsts(pairs)] = True
        return pairs, line, opens

    both = [new(head_keys, keys), new(head_numbers, numbers)]
    count = lambda line, which: np.bincount(line[which], minlength=len(row))
    enough = lambda k, n: (k > 1) | (n > 0)
    kept = first | may & enough(*[count(line, opens) for _, line, opens in both])
    left = []  # what no sentence that stays has said before
    for pairs, line, _ in both:
        stays = np.flatnonzero(kept[line])
        known, at = np.unique(pairs[stays], return_index=True)
        where = np.searchsorted(known, pairs)
        said_at = np.where(np.isin(pairs, known), line[stays[at]][np.minimum(where, len(known) - 1)] if len(known) else 0, len(row))
        left.append((said_at > line) & may[line] & ~kept[line])
    unsure = np.flatnonzero(may & ~kept & enough(*[count(line, which) for (_, line, _), which in zip(both, left, strict=True)]))
    said: tuple[set[int], set[int]] = (set(), set())
    for i in unsure.tolist():
        fresh = [set(pairs[a:b][which[a:b]].tolist()) - done for (pairs, line, _), which, done in zip(both, left, said, strict=True) for a, b in [np.searchsorted(line, (i, i + 1))]]
        kept[i] = enough(*map(len, fresh))
        if kept[i]:
            for done, more in zip(said, fresh, strict=True):
                done |= more
    return _listed(kept, keys)


def best_lead(title: Column, sentences: Column, first: int = 3) -> Column:
    """One of the first details comes to the front when it shares three title keys and two more than the lead does."""
    t = keys_of(title)
    scored = F.transform(F.slice(sentences, F.lit(1), F.lit(first + 1)), lambda s, i: F.struct(common(keys_of(s), t).alias("n"), (-i).alias("place")))

    def order(x: Column) -> Column:
        best = F.array_max(F.slice(x, F.lit(2), F.lit(first)))
        moves = (F.size(x) > 1) & (best.n >= 3) & (best.n >= F.get(x, 0).n + 2)
        moved = F.concat(F.array(F.get(sentences, -best.place)), F.filter(sentences, lambda _, i: i != -best.place))
        return F.when(moves, moved).otherwise(sentences)

    return let(scored, order)


def joined_quotes(sentences: Column, opening: str = "«", closing: str = "»") -> Column:
    """Sentences are joined while more quotation marks are open than closed; unbalanced rests are dropped, a lead is closed."""
    count = lambda s, mark: F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit("")))
    is_open = lambda s: count(s, opening) > count(s, closing)

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        return F.when((F.size(acc) > 0) & is_open(last), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", last, s)))).otherwise(F.concat(acc, F.array(s)))

    joined = F.aggregate(sentences, F.array().cast("array<string>"), step)
    closed = F.transform(joined, lambda s, i: F.when((i == 0) & is_open(s), F.concat(s, F.lit(closing))).otherwise(s))
    return F.filter(closed, lambda s: count(s, opening) == count(s, closing))


def named_lead(title: Column, body: Column, pronouns: Sequence[str] = ("He", "She", "وی", "او")) -> Column:
    """A lead that begins with a pronoun gets the headline's speaker: one to five words before a colon, without digits."""
    who = F.trim(F.regexp_extract(title, r"^([^:：0-9]{2,60})[:：]", 1))
    fits = (who != "") & (word_count(who) <= 5)
    begins = rf"^({'|'.join(pronouns)})(?=\s)"
    return F.when(fits & body.rlike(begins), F.concat(who, F.regexp_replace(body, begins, ""))).otherwise(body)


def repaired(problem: Callable[[Column], Column], *variants: Column) -> Column:
    """The first variant without a problem (problem gives a reason or null); the first of all when every one has some."""
    return F.coalesce(*[F.when(problem(v).isNull(), v) for v in variants], variants[0])
