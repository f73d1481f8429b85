"""Document quality: counts for plain rules, then a calibrated logistic regression.

The model is linear in the frequencies of hashed word and character n-grams.
It is fitted on a bounded sample of labelled documents, `SAMPLE_PER_CLASS` of
either class at most, those with the smallest hash of their id. A quarter of
them is held back from the weights and fits the calibration, weighted to the
shares that the classes have among all labelled documents. Every document is
then scored whole, in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.llm import tokens
from brightwater.llm.common import map_arrow

#: Labelled documents of each class that the model is fitted on.
SAMPLE_PER_CLASS = 800
#: Least calibrated probability of good quality of a document that is kept.
THRESHOLD = 0.5
MIN_WORDS = 50
#: Largest share of words in repeated three-word windows, in percent.
MAX_REPEAT_PERCENT = 50

#: Bytes of text that are worked on at once; each n-gram takes some numbers of 8 bytes.
_SLICE_BYTES = 1 << 20
_BUCKETS = 1 << 15
_WORD_GRAMS = (1, 2)
_CHAR_GRAMS = (3, 4)
_SCALE = 20.0
_RIDGE = 1e-4
_STEPS = 120

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys in order of position: whether an equal one of the same owner comes earlier; anywhere."""
    order = np.lexsort((keys, owner))
    same = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    earlier, anywhere = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:]] = same
    anywhere[order[1:]] |= same
    anywhere[order[:-1]] |= same
    return earlier, anywhere


def _count(part: pa.Array, words: tokens.Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    data, docs = words.data, len(part)
    offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + docs + 1]
    offsets = offsets - offsets[0]
    first_of_byte = (data & 0xC0) != 0x80
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    doc = np.repeat(np.arange(docs), np.diff(np.searchsorted(breaks, offsets)) + 1)
    ends = np.minimum(np.append(starts[1:], len(data)), offsets[doc + 1])
    ends = np.where(np.isin(ends - 1, breaks) & (ends > starts), ends - 1, ends)
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, doc = starts[has_word], ends[has_word], doc[has_word]
    lines = tokens.Words(data, starts, ends, np.searchsorted(doc, np.arange(docs + 1)))
    dup_lines, _ = _repeated(tokens.word_hashes(lines), doc)

    at = tokens.whole_windows(words.first, 3)
    owner = words.doc_of_word()
    _, repeated = _repeated(tokens.rolling(hashes, 3)[at], owner[at])
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[at[repeated] + i] = True
    return {
        "n_words": words.counts(),
        "word_chars": tokens.sums(first_of_byte & tokens.IS_WORD[data], offsets),
        "n_symbols": tokens.sums(_SYMBOL[data], offsets),
        "n_dup_lines": tokens.sums(dup_lines, lines.first),
        "n_repeat_words": tokens.sums(covered, words.first),
    }


def _grams(words: tokens.Words, part: pa.Array, hashes: np.ndarray):
    """For each kind of n-gram: bucket of each occurrence, and where each document's begin."""
    docs = len(part)
    for block, n in enumerate(_WORD_GRAMS):
        at = tokens.whole_windows(words.first, n)
        bucket = tokens.mix(tokens.rolling(hashes, n)[at]) >> np.uint64(49)
        yield block, bucket.astype(np.int64), np.searchsorted(at, words.first)
    offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + docs + 1]
    offsets = offsets - offsets[0]
    chars = np.frombuffer(bytes(words.data).decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    heads = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum((words.data & 0xC0) != 0x80, out=heads[1:])
    first = heads[offsets]
    for block, n in enumerate(_CHAR_GRAMS, len(_WORD_GRAMS)):
        at = tokens.whole_windows(first, n)
        bucket = (tokens.rolling(chars, n)[at] * tokens.BASE) >> np.uint64(49)
        yield block, bucket.astype(np.int64), np.searchsorted(at, first)


_BLOCKS = len(_WORD_GRAMS) + len(_CHAR_GRAMS)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.intercept, -500, 500)))


def _features(batches):
    """Frequencies of a document's n-grams as a sparse vector."""
    for batch in batches:
        rows = {"index": [], "value": []}
        for _, part in tokens.slices(batch.column("text"), _SLICE_BYTES):
            words = tokens.split(part)
            hashes = tokens.word_hashes(words)
            index, value = [[] for _ in range(len(part))], [[] for _ in range(len(part))]
            for block, bucket, first in _grams(words, part, hashes):
                for d in range(len(part)):
                    found, times = np.unique(bucket[first[d] : first[d + 1]], return_counts=True)
                    index[d].append(found + block * _BUCKETS)
                    value[d].append(_SCALE * times / max(1, first[d + 1] - first[d]))
            rows["index"] += [np.concatenate(x) for x in index]
            rows["value"] += [np.concatenate(x) for x in value]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array(rows["index"], pa.list_(pa.int32())), pa.array(rows["value"], pa.list_(pa.float32()))],
            ["doc_id", "quality", "index", "value"],
        )


class _Rows:
    def __init__(self, index, value):
        lengths = np.array([len(x) for x in index])
        self.index, self.value = np.concatenate(index), np.concatenate(value)
        self.row = np.repeat(np.arange(len(index), dtype=np.int32), lengths)
        self.n = len(index)

    def times(self, weights):
        return np.bincount(self.row, self.value * weights.astype(np.float32)[self.index], self.n)

    def transposed_times(self, errors):
        return np.bincount(self.index, self.value * errors.astype(np.float32)[self.row], _BLOCKS * _BUCKETS)


def _fit(rows: _Rows, target: np.ndarray) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by Nesterov's accelerated gradient."""
    norms = np.bincount(rows.row, rows.value**2, rows.n) + 1
    step = 1 / (0.25 * norms.max() + _RIDGE)
    w, b = np.zeros(_BLOCKS * _BUCKETS), 0.0
    ahead_w, ahead_b, momentum = w, b, 1.0
    for _ in range(_STEPS):
        error = (1 / (1 + np.exp(-np.clip(rows.times(ahead_w) + ahead_b, -500, 500))) - target) / rows.n
        new_w = ahead_w - step * (rows.transposed_times(error) + _RIDGE * ahead_w)
        new_b = ahead_b - step * error.sum()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / following
        ahead_w, ahead_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b, momentum = new_w, new_b, following
    return w, b


def _calibrate(score: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the weighted logistic regression on the score, by Newton's method.

    Targets are pulled slightly inwards, so that classes that the score parts cleanly have a solution.
    """
    x = np.stack([score, np.ones_like(score)], 1)
    target = np.where(target > 0, 1 - 1 / (target.sum() + 2), 1 / ((1 - target).sum() + 2))
    found = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -500, 500)))
        gradient = x.T @ (weight * (p - target)) + 1e-6 * found
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-6 * np.eye(2)
        change = np.linalg.solve(hessian, gradient)
        change *= min(1.0, 5 / max(1e-12, np.abs(change).max()))
        found = found - change
        if np.abs(change).max() < 1e-9:
            break
    return float(found[0]), float(found[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """The model, or None unless both classes have at least four labelled documents.

    Only labels 0 and 1 count. Of documents that share an id, the smallest text is taken.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(
        "doc_id IS NOT NULL AND quality IN (0, 1)"
    )
    known = known.distinct()
    share = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    zero, one = (known.where(F.col("quality") == c).orderBy(*by_hash).limit(per_class) for c in (0, 1))
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(zero.union(one)), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(
        sample.select("doc_id", "quality", "text"), _features, f"doc_id {kind}, quality int, index array<int>, value array<float>"
    ).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("quality", "ascending")]).combine_chunks()
    target = rows["quality"].to_numpy().astype(float)
    if min((target == 0).sum(), (target == 1).sum()) < 4:
        return None
    sizes = np.diff(rows["index"].chunk(0).offsets.to_numpy())
    index = np.split(rows["index"].chunk(0).values.to_numpy(), np.cumsum(sizes)[:-1])
    value = np.split(rows["value"].chunk(0).values.to_numpy(), np.cumsum(sizes)[:-1])
    # every fourth row of each class is held back
    held = np.zeros(len(target), bool)
    for c in (0, 1):
        held[np.flatnonzero(target == c)[::4]] = True
    fitted, calibrated = (_Rows([index[i] for i in at], [value[i] for i in at]) for at in (np.flatnonzero(~held), np.flatnonzero(held)))
    del rows, index, value
    weights, bias = _fit(fitted, target[~held])
    score = calibrated.times(weights) + bias
    of_class = {c: share[c] / (target[held] == c).sum() for c in (0, 1)}
    slope, intercept = _calibrate(score, target[held], np.where(target[held] == 1, of_class[1], of_class[0]) * held.sum() / sum(share.values()))
    return Model(weights.astype(np.float32), bias, slope, intercept)


def _judged(model: Model | None, threshold: float, keep: str):
    def per_batch(batches):
        for batch in batches:
            out = {name: [] for name in COUNTS}
            probability = []
            for _, part in tokens.slices(batch.column("text"), _SLICE_BYTES):
                words = tokens.split(part)
                hashes = tokens.word_hashes(words)
                for name, values in _count(part, words, hashes).items():
                    out[name].append(values)
                if model is not None:
                    score = np.full(len(part), model.bias)
                    for block, bucket, first in _grams(words, part, hashes):
                        weights = model.weights[block * _BUCKETS : (block + 1) * _BUCKETS]
                        score += _SCALE * tokens.sums(weights[bucket].astype(float), first) / np.maximum(1, np.diff(first))
                    probability.append(model.probability(score))
            counts = {name: np.concatenate(x) if x else np.zeros(0, np.int64) for name, x in out.items()}
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
            if model is None:
                good = pa.nulls(batch.num_rows, pa.float64())
                kept = ~failed
            else:
                good = np.concatenate(probability) if probability else np.zeros(0)
                kept = ~failed & (good >= threshold)
            if keep == "rows":
                yield batch.filter(pa.array(kept))
            else:
                columns = [batch.column("doc_id"), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)]
                columns += [pa.array(failed), pa.array(good), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "p_good", "kept"])

    return per_batch


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """Columns `doc_id`, the counts of the whole text, `base_failed`, `p_good` and `kept`; one row per row of `docs`.

    Null and empty texts have no words and so fail. Without labels of both
    classes `p_good` is null and the plain rules decide. Repeated rows give
    repeated rows, null ids stay, an empty table gives none. Other columns of
    `docs` and `labels` are not read.
    """
    model = train(docs, labels, per_class)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, p_good double, kept boolean"
    return map_arrow(rows, _judged(model, threshold, "counts"), schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The rows of `docs`, all columns, that `judge` keeps."""
    model = train(docs, labels, per_class)
    return map_arrow(docs, _judged(model, threshold, "rows"), docs.schema)
