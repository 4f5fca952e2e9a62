"""Winnowing fingerprints, with DataFrame functions only.

The k-grams are of words, the positions are word numbers. A k-gram's hash is a cyclic polynomial of its words' hashes, a rolling
hash: each word's 64 bits are turned once more for every word that follows, and all are combined by exclusive or. It is rolled by
doubling: that of 2 m words is that of the first m, turned m times, with that of the next m. Of every window of consecutive
hashes the smallest is chosen, the rightmost one among equals, and kept with its position. Two texts that share a run of at least
GRAM + WINDOW - 1 words have a chosen hash in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.runtime import id_ranges

#: Words in a k-gram; k-gram hashes in a window (both powers of two).
GRAM, WINDOW = 4, 8
#: Bits by which a word's hash is turned for each word after it.
TURN = 13
#: Characters of a word before it is cut, so that a text without white space has words too.
WORD_CHARS = 32


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument is not computed again for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _turned(x: Column, bits: int) -> Column:
    bits %= 64
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def gram_hashes(text: Column, gram: int = GRAM) -> Column:
    """array<bigint>: the hash of every gram consecutive words. A text of fewer words is one k-gram, no words are none."""

    def rolled(h: Column, width: int) -> Column:
        """h holds the hashes of width words from every word on; past the last word there is nothing to combine."""
        if width == gram:
            return F.slice(h, F.lit(1), F.greatest(F.size(h) - (gram - 1), F.lit(1)))
        both = F.transform(h, lambda x, i: _turned(x, TURN * width).bitwiseXOR(F.coalesce(F.get(h, i + width), F.lit(0).cast("bigint"))))
        return _let(both, lambda y: rolled(y, 2 * width))

    words = F.regexp_extract_all(text, F.lit(r"\S{1,%d}" % WORD_CHARS), F.lit(0))
    hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: rolled(h, 1))
    return _let(hashes, lambda h: F.filter(h, lambda x: x.isNotNull()))


def selected(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array<struct<hash bigint, position int>> of the chosen k-grams in the order of their positions.

    A text of fewer than window k-grams is one window; one without words gives an empty array.
    """

    def lesser(a: Column, b: Column) -> Column:
        """The smaller hash, of equal ones that on the right (b)."""
        return F.when(b.hash <= a.hash, b).otherwise(a)

    def minima(x: Column, width: int) -> Column:
        """x holds the minima of width neighbours; doubled until they are of a window. Those past the last window go."""
        if width == window:
            return F.slice(x, F.lit(1), F.greatest(F.size(x) - (window - 1), F.lit(1)))
        return _let(F.transform(x, lambda v, i: lesser(v, F.get(x, i + width))), lambda y: minima(y, 2 * width))

    def once(x: Column) -> Column:
        """Windows choose from left to right, so a choice that is made again follows itself."""
        return F.filter(x, lambda v, i: F.coalesce(F.get(x, i - 1).position != v.position, F.lit(True)))

    placed = F.transform(gram_hashes(text, gram), lambda h, i: F.struct(h.alias("hash"), i.alias("position")))
    return _let(placed, lambda g: _let(minima(g, 1), once))


def hashes_of(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: x.hash))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def as_text(chosen: Column) -> Column:
    """'hash:position hash:position ...', hashes in hexadecimal."""
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.lower(F.hex(x.hash)), F.lit(":"), x.position.cast("string"))), " ")


def fingerprints(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with a column fingerprint: array of struct<hash bigint, position int>. A null text counts as empty and has no entries."""
    return docs.withColumn("fingerprint", selected(F.coalesce(F.col(text_column), F.lit(""))))


def with_next(docs: DataFrame, columns: list[str], ranges: int) -> DataFrame:
    """docs (id and columns) with a struct next: the columns of the next row by descending id, after the last row the first.

    Rows are dealt to ranges of ids whose upper ends are quantiles of the ids, and so ids themselves. The row that ends a range
    also goes to the range above it, where it follows that range's last row; the largest id also goes below all others. So one
    shuffle suffices and no task holds more than a range. Rows of one id are ordered by their columns. A row with a null id has
    no place in the order and a null next.
    """
    number, ends, top = id_ranges(docs, ranges)
    last_below = F.array(*[F.lit(e) for e in ends]).cast("array<bigint>")
    own = F.struct(number.alias("range"), F.lit(False).alias("guest"), F.lit(False).alias("wrapped"))
    above = F.when(F.array_contains(last_below, F.col("id")), F.struct((number + 1).alias("range"), F.lit(True).alias("guest"), F.lit(False).alias("wrapped")))
    below = F.when(F.col("id") == F.lit(top), F.struct(F.lit(0).alias("range"), F.lit(True).alias("guest"), F.lit(True).alias("wrapped")))
    placed = docs.withColumn("at", F.explode(F.filter(F.array(own, above, below), lambda x: x.isNotNull())))
    spread = F.when(F.col("id").isNull(), -1 - F.pmod(F.xxhash64(columns[0]), F.lit(ranges)).cast("int")).otherwise(F.col("at.range"))
    order = Window.partitionBy(spread).orderBy("at.wrapped", F.desc("id"), *columns)
    following = F.when(F.col("id").isNotNull(), F.lead(F.struct(*columns)).over(order))
    return placed.withColumn("next", following).where("not at.guest").drop("at")


def half_edited(docs: DataFrame, ranges: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text with its later half overwritten, and their likenesses; one row per row of docs.

    Returns the id, n_chars, edited_sha256, fingerprint and edited_fingerprint ('hash:position ...'), near_edited and near_next.
    The last floor(n_chars / 2) characters give way to the first as many (or all) of the next text in descending order of id,
    after the last that of the first. Null texts count as empty; two texts without words are alike (1), one without words and
    one with words are not (0). A row with a null id has no next text (empty). Empty table: no rows. Other columns are not read.
    """
    text = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # the shuffle carries texts alone; the next text is fingerprinted anew, which moves less than its fingerprint would
    rows = with_next(text, ["text"], ranges)
    rows = rows.withColumn("n", F.char_length("text").cast("long")).withColumn("following", F.coalesce("next.text", F.lit("")))
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n") - F.floor(F.col("n") / 2)).cast("int"))
    taken = F.substring(F.col("following"), F.lit(1), F.floor(F.col("n") / 2).cast("int"))
    rows = rows.select("id", "n", selected(F.col("text")).alias("chosen"), selected(F.col("following")).alias("next_chosen"), F.concat(kept, taken).alias("edited"))
    rows = rows.select("id", "n", "chosen", "next_chosen", F.sha2("edited", 256).alias("edited_sha256"), selected(F.col("edited")).alias("edited_chosen"))
    own, edited, following = (hashes_of(F.col(c)) for c in ("chosen", "edited_chosen", "next_chosen"))
    return rows.select(
        F.col("id").alias(id_column), F.col("n").alias("n_chars"), "edited_sha256", as_text(F.col("chosen")).alias("fingerprint"), as_text(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"),
    )
