"""Quality classifier: naive Bayes support vectors on n-grams of words and of word shapes.

Features are indicators of three kinds: a word, or a pair of neighbouring words, occurs (lower-cased, without the marks
behind it); a one-, two- or three-gram of word shapes occurs, or makes up at least a given share of the text. A word's
shape is its letter case, length class, what it ends in, and whether it repeats the word before it or any earlier word
of the document. Each indicator is scaled by its class log-count ratio, and a linear hinge-loss
model is fitted to the scaled indicators by dual coordinate descent; its margin is calibrated on rows that
the descent does not see. Words are looked at once for every distinct one of an Arrow batch; nothing is kept beyond it.

The fit uses at most ``MAX_LABELLED`` labelled documents outside the held-out fold, chosen by a hash of the id (of rows
that share an id, the one with the least hash of its text); their indicator numbers, not their texts, come to the driver.

Edge cases: a null or empty text has no indicator and gets the score of the constant alone; a null ``doc_id`` is never
held out; repeated rows are scored each; no labels, or only one class, give every document score 0.5 or that class;
labels with null fields are left out; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sliced
from .near_dedup import SPACE, mixed
from .toxicity import logistic

MAX_LABELLED, BUCKETS, WORD_BUCKETS = 12_000, 1 << 16, 1 << 18
SHARES = (0.0, 0.03, 0.12, 0.4)
FOLDS, FOLD, LIMIT = 4, 2, 0.7
C, EPOCHS, ALPHA = 0.1, 12, 1.0


def shapes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of each word: case, length class and ending as one small number; and the word without what it ends in."""
    core = pc.replace_substring_regex(words, r"[^\pL\pN_]+$", "")
    tail = pc.replace_substring_regex(words, r"(?s)^.*[\pL\pN_]", "")
    is_, at = lambda a: a.to_numpy(zero_copy_only=False), lambda p: pc.match_substring_regex(tail, p).to_numpy(zero_copy_only=False)
    n = is_(pc.utf8_length(core))
    first = is_(pc.utf8_is_upper(pc.utf8_slice_codeunits(core, 0, 1)))
    case = np.select([n == 0, is_(pc.utf8_is_lower(core)), is_(pc.utf8_is_upper(core)) & (n > 1), first, is_(pc.utf8_is_digit(core))], [0, 1, 2, 3, 4], 5)
    size = sum((n > x).astype(np.int64) for x in (1, 3, 6, 10, 20))
    end = is_(pc.utf8_length(tail))
    ending = np.select([end == 0, at("^[,;:]$"), at("^[.?!]$"), at("^[.,]+$"), at("!"), end > 1], [0, 1, 2, 3, 4, 5], 6)
    return (case * 6 + size) * 7 + ending, core


SHAPES = 6 * 6 * 7
#: Indicators: shares of shape n-grams, then words and pairs of words.
INDICATORS = BUCKETS * len(SHARES) + WORD_BUCKETS


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The indicator numbers of all texts in a row, and where each text's begin."""
    import xxhash

    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), SPACE)
    at = lists.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    coded = lists.flatten().dictionary_encode()
    words, n = coded.dictionary, len(texts)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    index = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(at))
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[index]
    index, doc = index[full], doc[full]
    sizes = np.bincount(doc, minlength=n)
    again = np.ones(len(index), bool)
    again[np.unique(doc * len(words) + index, return_index=True)[1]] = False
    inside = doc[1:] == doc[:-1]
    same = np.concatenate([np.zeros(min(1, len(index)), bool), (index[1:] == index[:-1]) & inside])
    shape, core = shapes(words)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in pc.utf8_lower(core).to_pylist()), np.uint64, len(words))[index]
    with np.errstate(over="ignore"):
        pair = mixed(own[:-1] * np.uint64(3) + own[1:])[inside]
    word_key = np.concatenate([doc * WORD_BUCKETS + (own >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS, doc[1:][inside] * WORD_BUCKETS + (pair >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS])
    word_key = np.unique(word_key)
    gram = (shape[index] + SHAPES * (again + same)).astype(np.uint64)
    keys, base = [], np.uint64(3 * SHAPES + 1)
    s = gram
    for k in range(1, 4):
        h = (mixed(gram + np.uint64(k << 60)) >> np.uint64(40)).astype(np.int64) % BUCKETS
        keys.append(doc[: len(h)] * BUCKETS + h)
        if len(gram) < 2:
            break
        # One word longer, within a document.
        gram = np.where(doc[k:] == doc[: len(doc) - k], gram[:-1] * base + s[k:], np.uint64(0))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    owner = key // BUCKETS
    share = count / np.maximum(1, sizes[owner])
    level = sum((share >= x).astype(np.int64) for x in SHARES)
    step = np.arange(int(level.sum())) - np.repeat(np.cumsum(level) - level, level)
    out = np.concatenate([np.repeat((key % BUCKETS) * len(SHARES), level) + step, BUCKETS * len(SHARES) + word_key % WORD_BUCKETS])
    owner = np.concatenate([np.repeat(owner, level), word_key // WORD_BUCKETS])
    return out[np.argsort(owner, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = C, epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """Dual coordinate descent for the hinge loss: weights over scaled indicators, the constant last."""
    w, alpha = np.zeros(len(scale) + 1), np.zeros(len(rows))
    x = [scale[r] for r in rows]
    norm = np.array([float(v @ v) + 1 for v in x])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v, t = rows[i], x[i], y[i]
            g = t * (float(w[r] @ v) + w[-1]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            d = (new - alpha[i]) * t
            if d:
                alpha[i] = new
                w[r] += d * v  # an indicator occurs once in a row
                w[-1] += d
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w


class Quality:
    """Weights of indicators, and the line that turns a margin into a probability."""

    def __init__(self, weights: np.ndarray, constant: float, line: np.ndarray):
        self.weights, self.constant, self.line = weights.astype(np.float32), constant, line

    def scores(self, texts: pa.Array) -> np.ndarray:
        ids, at = indicators(texts)
        total = np.concatenate([[0.0], np.cumsum(self.weights[ids].astype(float))])
        z = self.line[0] * (total[at[1:]] - total[at[:-1]] + self.constant) + self.line[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, folds: int | None = FOLDS, fold: int = FOLD, max_labelled: int = MAX_LABELLED) -> Quality:
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    if folds:
        known = known.filter(~held_out("doc_id", folds, fold))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, at = indicators(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], ["doc_id", "ids", "y"])

    training = docs.select(F.col("doc_id").cast("long"), F.struct(F.xxhash64("text").alias("h"), "text").alias("t")).join(F.broadcast(known), "doc_id")
    training = training.groupBy("doc_id", "y").agg(F.min("t").alias("t")).select("doc_id", "t.text", "y")
    found = training.mapInArrow(measure, "doc_id long, ids array<int>, y int").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    lists, y = found.column("ids").combine_chunks(), found.column("y").to_numpy()[order].astype(float)
    off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    rows = [flat[off[i] : off[i + 1]] for i in order]
    size = INDICATORS
    if len(set(y)) < 2:
        return Quality(np.zeros(size), 0.0, np.array([0.0, 0.0 if not len(y) else 30.0 * (2 * y[0] - 1)]))
    # Every fifth row is kept for the calibration.
    back = np.arange(len(rows)) % 5 == 4 if len(rows) >= 100 else np.zeros(len(rows), bool)
    pos, neg = np.full(size, ALPHA), np.full(size, ALPHA)
    for r, t in zip((r for r, b in zip(rows, back) if not b), y[~back]):
        (pos if t else neg)[r] += 1
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    ratio[(pos + neg) <= 2 * ALPHA + 1] = 0  # seen once: no evidence
    w = descend([r for r, b in zip(rows, back) if not b], 2 * y[~back] - 1, ratio)
    weights, constant = w[:-1] * ratio, float(w[-1])
    margin = np.array([weights[r].sum() + constant for r in rows])
    use = back if back.any() and len(set(y[back])) == 2 else ~back
    return Quality(weights, constant, logistic(margin[use, None], y[use]))


def score(docs: DataFrame, model: Quality, folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, over its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(model.scores(batch.column(1)))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out("doc_id", folds, fold).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
