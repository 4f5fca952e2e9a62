"""A small table with the awkward cases: nulls, empty and long texts, ties, repeated rows, columns of clashing names."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, id string, label int, n long, key string, shard int, chunk string, part int"
NASTY = [None, "", " \n\t ", "one", "One TWO three four", "é É ß ǆ 漢字 😀", "a" * 400, "x " * 300, "License: CC BY, cc-by; all rights reserved.", "J̌ Σ ΑΣ\x0b\x1c\x85 end", "(c)!!??", "tab\tand\r\nnew\x0cline"]


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows(seed: int = 11, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"{rng.choice(['Al', 'be', 'ça', 'DO', 'el'])}{rng.choice(['ra', 'né', 'st', 'üm'])}{i % 37}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 160))) + rng.choice(["", ".", "\nEnd."]) for _ in range(n)]
    for i in range(0, 40, 2):  # near and exact copies, and copies in another case
        w = texts[i].split(" ")
        if i % 4:
            w[rng.randrange(len(w))] = "edited"
        texts[i + 1] = " ".join(w).upper() if i % 8 == 2 else " ".join(w)
    texts += NASTY + NASTY[:4]
    texts += [" ".join(rng.choices(words, k=6000))]
    out = [(3 * i + 1, t, "en", "x", 0, 1, "k", 2, "c", 3) for i, t in enumerate(texts)]
    return [*out, out[5], out[5]]


def frame(spark, data: list[tuple] | None = None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def no_rows(spark):
    return frame(spark, []).coalesce(1)
