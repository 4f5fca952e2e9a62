"""Document quality by a linear-chain conditional random field over lines.

Every line with a visible character is labelled good or bad from features of its own, its predecessor and its successor, and
from the labels beside it. Forward-backward marginals, weighted by line length, give the document's share of good text; a
logistic link fitted on the same training documents turns it into a score.

Labels are known of documents only, so every line of a training document carries its document's label: the chain learns how
strongly neighbouring lines agree ("stay" against "change"), not where good text turns bad.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.runtime import checkpointed, give_back, lean, workers_import
from newsloom.llm.textbytes import SPACE_WORDS, split_words, string_buffers

#: Bounds of the training sample: documents of each label (those of the smallest hashes), and visible lines of them all. Documents
#: are taken whole; those that would bring the lines of their label over half of the bound are left out of the sample.
TRAIN_DOCUMENTS, TRAIN_LINES = 1500, 400_000
ROUNDS, STEP, RIDGE = 120, 0.15, 1e-3
RUN_BYTES = 1 << 21
#: The score of a document without a line that has a visible character.
BLANK_SCORE = 0.0

_CLASSES = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "lower": np.isin(np.arange(256), np.arange(97, 123)),
    "wide": np.arange(256) >= 0xC0,
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "space": ~SPACE_WORDS,
    "stop": np.isin(np.arange(256), list(b".,;:'\"?-()")),
    "shout": np.arange(256) == ord("!"),
    "bar": np.arange(256) == ord("|"),
}
OWN = ["bias", "size", *_CLASSES, "odd", "word_length", "repeated_word", "stopped", "same_as_before"]
FEATURES = 3 * len(OWN) + 2


def line_features(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, first) of the visible lines of documents data[cut[d]:cut[d + 1]]; document d owns first[d]:first[d + 1]."""
    n = len(data)
    edges = np.unique(np.concatenate([cut, np.flatnonzero(data == 10) + 1]))
    start, end = edges[:-1], edges[1:]
    start, end = start[start < n], end[start < n]
    if not len(start):
        return np.zeros((0, FEATURES), np.float32), np.zeros(0), np.zeros(len(cut), int)
    counts = {k: np.add.reduceat(table[data].view(np.uint8), start, dtype=np.int32) for k, table in _CLASSES.items()}
    size = end - start
    seen = counts["space"] < size
    start, end, size = start[seen], end[seen], size[seen]
    counts = {k: v[seen] for k, v in counts.items()}
    first = np.searchsorted(start, cut)
    doc = np.repeat(np.arange(len(cut) - 1), np.diff(first))
    visible = size - counts["space"]
    words = split_words(data, cut, SPACE_WORDS, slice(0, len(cut) - 1))
    hashes = words.hashes()
    line = np.searchsorted(start, words.start, "right") - 1
    n_words = np.bincount(line, minlength=len(start))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    begin = np.searchsorted(line, np.arange(len(start)))
    whole = np.add.reduceat(hashes, begin)
    same = np.zeros(len(start), bool)
    same[1:] = (whole[1:] == whole[:-1]) & (doc[1:] == doc[:-1])
    last = words.end[np.minimum(begin + n_words, len(hashes)) - 1] - 1
    share = lambda x: x / visible
    letters = counts["upper"] + counts["lower"] + counts["wide"]
    multi = visible - letters - counts["digit"] - counts["stop"] - counts["shout"] - counts["bar"]  # also the later bytes of wide characters
    odd = np.maximum(0, multi - counts["wide"])
    own = np.stack(
        [np.ones(len(start)), np.log1p(size) / 8, *(share(counts[k]) for k in _CLASSES), share(odd), visible / np.maximum(n_words, 1) / 16, np.bincount(line, again, len(start)) / np.maximum(n_words, 1), _CLASSES["stop"][data[last]], same], 1
    ).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    before[inner], after[inner - 1] = own[inner - 1], own[inner]
    ends = np.ones((2, len(start)), np.float32)
    ends[0, inner] = ends[1, inner - 1] = 0
    return np.concatenate([own, before, after, ends.T], 1), size.astype(float), first


def _marginals(emission: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) of each line, expected moves (2, 2), log of the normaliser) of all chains; emission is the gain of 'good'."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    at, live = first[:-1][order], length[order]
    score = np.zeros((len(emission), 2))
    score[:, 1] = emission
    forward, backward = np.empty_like(score), np.zeros_like(score)
    forward[at] = score[at]
    longest = int(live[0]) if len(live) else 0
    alive = [int(np.searchsorted(-live, -t, "left")) for t in range(longest + 1)]  # chains longer than t
    for t in range(1, longest):
        i = at[: alive[t]] + t
        x = forward[i - 1][:, :, None] + moves
        forward[i] = np.logaddexp(x[:, 0], x[:, 1]) + score[i]
    for t in range(longest - 2, -1, -1):
        i = at[: alive[t + 1]] + t
        x = moves + (score[i + 1] + backward[i + 1])[:, None, :]
        backward[i] = np.logaddexp(x[:, :, 0], x[:, :, 1])
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(len(emission), bool)
    inner[at] = False
    i = np.flatnonzero(inner)
    pair = forward[i - 1][:, :, None] + moves + (score[i] + backward[i])[:, None, :] - total[i][:, None, None]
    return good, np.exp(pair).sum(0), float(total[at].sum())


def fit(features: np.ndarray, first: np.ndarray, label: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """Weights by gradient steps with momentum (Adam) on the chains' likelihood; each line carries its document's label."""
    length = np.diff(first)
    y = np.repeat(label, length).astype(float)
    mean, spread = features.mean(0), features.std(0) + 1e-3
    mean[0], spread[0] = 0, 1
    x = ((features - mean) / spread).astype(np.float64)
    n = max(1, len(x))
    kept = np.array([[((length - 1)[(label == a) & (length > 0)]).sum() if a == b else 0.0 for b in (0, 1)] for a in (0, 1)])
    p = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, ROUNDS + 1):
        good, moved, _ = _marginals(x @ p[:-4], first, p[-4:].reshape(2, 2))
        g = np.concatenate([x.T @ (good - y), (moved - kept).ravel()]) / n + RIDGE * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = {"weights": p[:-4], "moves": p[-4:].reshape(2, 2), "mean": mean, "spread": spread, "link": np.array([1.0, 0.0])}
    share = document_share(model, features, first, size)
    seen = length > 0
    model["link"] = _link(_logit(share[seen]), label[seen])
    return model


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset of a logistic regression, by Newton steps with a little ridge."""
    w = np.array([1.0, 0.0])
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        hessian = z.T @ (z * (p * (1 - p))[:, None]) + np.eye(2)
        w -= np.linalg.solve(hessian, z.T @ (p - y) + w - np.array([1.0, 0.0]))
    return w


def document_share(model: dict[str, np.ndarray], features: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' P(good); nan without lines."""
    x = (features - model["mean"]) / model["spread"]
    good, _, _ = _marginals(x @ model["weights"], first, model["moves"])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(doc, good * size, len(first) - 1) / np.bincount(doc, size, len(first) - 1)


def _runs(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    data, offsets = string_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN_BYTES, "right")) - 1))
        yield slice(i, j), data[int(offsets[i]) : int(offsets[j])], offsets[i : j + 1] - offsets[i]
        i = j


def _training_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, cut in _runs(batch.column(2)):
            features, size, first = line_features(data, cut)
            for k in range(rows.stop - rows.start):
                a, b = int(first[k]), int(first[k + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start + k, 1), batch.column(1).slice(rows.start + k, 1), pa.array([features[a:b].astype(np.float32).tobytes()]), pa.array([size[a:b].tobytes()])], names=["id", "label", "features", "size"])


def _line_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, cut in _runs(batch.column(1)):
            n = np.diff(line_features(data, cut)[2])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, len(n)), pa.array(n)], names=["id", "lines"])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> dict[str, np.ndarray]:
    """A model from a bounded sample of labelled rows: at most TRAIN_DOCUMENTS of each label, with all their lines.

    The sample is that of the smallest hashes of the id, so it does not depend on the order of rows. A document labelled twice
    takes the smaller label, an id with several texts the smallest; labels without a document, null labels and null ids are passed over. Without any usable label the
    model is neutral.
    """
    workers_import(docs.sparkSession)
    named = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.min(label_column).cast("int").alias("label"))
    chosen = None
    for value in (0, 1):
        part = named.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCUMENTS)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "id")
    texts = checkpointed(texts.groupBy(F.col("id").cast("long").alias("id"), "label").agg(F.min("text").alias("text")))
    counts = texts.select("id", "text").mapInArrow(lean(_line_counts), "id long, lines long").join(texts.select("id", "label"), "id")
    order = Window.partitionBy("label").orderBy("lines", "id").rowsBetween(Window.unboundedPreceding, 0)  # the sample's rows
    within = counts.withColumn("all", F.sum("lines").over(order)).where(F.col("all") <= TRAIN_LINES // 2).select("id")
    rows = texts.join(F.broadcast(within), "id").select("id", "label", "text")
    got = sorted(rows.mapInArrow(lean(_training_lines), "id long, label int, features binary, size binary").collect(), key=lambda r: r.id)
    features = [np.frombuffer(r.features, np.float32).reshape(-1, FEATURES) for r in got]
    first = np.concatenate([[0], np.cumsum([len(f) for f in features])]).astype(int)
    if not got or not first[-1]:
        return {"weights": np.zeros(FEATURES), "moves": np.zeros((2, 2)), "mean": np.zeros(FEATURES), "spread": np.ones(FEATURES), "link": np.array([1.0, 0.0])}
    label, size = np.array([r.label for r in got]), np.concatenate([np.frombuffer(r.size) for r in got])
    sample = np.concatenate(features)
    del features, got
    model = fit(sample, first, label, size)
    del sample
    give_back()
    return model


def score(docs: DataFrame, model: dict[str, np.ndarray], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, score (0 to 1, higher: better), n_lines, good_share.

    Only the text decides. A text without a visible character (null, empty, blank) has no lines, score 0 and a null share. Texts
    of any length are scored whole. Repeated rows are scored each; an empty table gives no rows.
    """
    workers_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, cut in _runs(batch.column(1)):
                features, size, first = line_features(data, cut)
                share = document_share(model, features, first, size)
                blank = np.isnan(share)
                value = 1 / (1 + np.exp(-(_logit(np.where(blank, 0.5, share)) * model["link"][0] + model["link"][1])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, len(share)), pa.array(np.where(blank, BLANK_SCORE, value)), pa.array(np.diff(first)), pa.array(share, mask=blank)], names=["id", "score", "n_lines", "good_share"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, score double, n_lines long, good_share double").withColumnRenamed("id", id_column)


def cross_validated(docs: DataFrame, labels: DataFrame, thresholds: Sequence[float], folds: int = 3, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """(threshold, bad_kept, good_lost, n): what each threshold does to labelled documents that the model has not seen.

    labels are those that may be learnt from; they are dealt into folds by a hash of their id, and each fold is scored by a model of
    the others. A document labelled twice takes the smaller label, as in train; labels without a document are passed over.
    """
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col(id_column).cast("string")), F.lit(folds))
    named = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min(label_column).cast("int").alias("_label")).withColumn("_fold", fold)
    scored = None
    for k in range(folds):
        model = train(docs, named.where(F.col("_fold") != k).withColumnRenamed("_label", label_column), id_column, text_column, label_column)
        asked = named.where(F.col("_fold") == k).select(id_column, "_label")
        part = score(docs.select(id_column, text_column).join(asked, id_column, "left_semi"), model, id_column, text_column).join(asked, id_column).select("score", "_label")
        scored = part if scored is None else scored.unionByName(part)
    cut = scored.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    kept = F.col("score") >= F.col("threshold")
    return cut.groupBy("threshold").agg(F.count_if(kept & (F.col("_label") == 0)).alias("bad_kept"), F.count_if(~kept & (F.col("_label") == 1)).alias("good_lost"), F.count("*").alias("n")).orderBy("threshold")
