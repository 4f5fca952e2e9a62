"""The pipeline against a plain version, stage by stage."""

from __future__ import annotations

import random

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from newsloom.llm import quality_crf
from tests.llm.fixtures import low
from tests.llm.test_dedup import classes

WORDS = Tokenizer.from_file(P.path("word_bpe_49k.json"))


def write(spark, folder) -> list[tuple]:
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("al", "be", "ça", "do", "el", "fi") for b in ("ra", "né", "st", "üm", "ko")]
    good = lambda: " ".join(rng.choices(words, k=rng.randint(6, 90))).capitalize() + "."
    bad = lambda: rng.choice([" | ".join(rng.choices(words, k=30)), "!! ".join(w.upper() for w in rng.choices(words, k=30)) + "!!", " ".join([rng.choice(words)] * 40)])
    texts = [good() if i % 5 else bad() for i in range(200)]
    for i in range(0, 60, 6):
        texts[i + 1] = texts[i + 2]  # exact copies
        w = texts[i + 3].split(" ")
        w[0] = "edited"
        texts[i + 4] = " ".join(w) if i % 12 else texts[i + 3].upper()
    texts += [None, "", " ".join(rng.choices(words, k=5000)).capitalize() + "."]
    data = [(7 * i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(7 * i, int(i % 5 > 0), 0) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return data


def test_pipeline(spark, tmp_path):
    data = write(spark, tmp_path)
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "exact", "near", "packed"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    from newsloom.llm import registry

    labels = registry.table(spark, str(tmp_path), "labels").where(registry.fold("doc_id", 4) != 2)
    scores = {r.doc_id: r.score for r in quality_crf.score(docs, quality_crf.train(docs, labels)).collect()}
    kept = [d for d in data if scores[d[0]] >= corpus_pipeline.KEEP_SCORE]
    assert 120 < len(kept) < 180
    first = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert first.columns == docs.columns and sorted(r.doc_id for r in first.collect()) == [d[0] for d in kept]
    last: dict[str, tuple] = {}
    for d in kept:
        last[low(d[1])] = max(last.get(low(d[1]), d), d)
    second = sorted(last.values())
    assert len(second) < len(kept)
    assert sorted(tuple(r) for r in corpus_pipeline.exact(spark, first, "").collect()) == second
    _, label = classes(second)
    third = [d for d in second if label[d[0]] == d[0]]
    assert len(third) < len(second)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {d[0]: len(WORDS.encode(d[1], add_special_tokens=False).ids) + 1 for d in third}
    got: dict[int, int] = {}
    filled: dict[int, int] = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert got == sizes and max(filled.values()) <= 2048
    assert len(filled) <= -(-sum(sizes.values()) // 2048) + 1


def test_pipeline_without_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_nulls_repeats_and_clashing_names(spark, tmp_path):
    good, other = "The quick brown fox jumps over the lazy dog near the river bank today.", "A second plain text stands here with words of its own and ends well."
    rows = [(1, good, "a", 5, "x"), (1, good, "a", 5, "x"), (2, good, "a", 5, "x"), (None, other, "b", 6, "y"), (3, None, None, None, None), (4, "", "c", 7, "z"), (5, other + " " + " ".join(f"w{i}." for i in range(5000)), "d", 8, "w")]
    spark.createDataFrame(rows, "doc_id long, text string, id string, n long, key string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (None, 0), (9, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {1, 2, 4, 3, 5, None} and {2, None, 5} <= {r.doc_id for r in got} and 1 not in {r.doc_id for r in got}
