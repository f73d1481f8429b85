"""Removal of word windows that also start in a document with a smaller id.

Every window of thirteen words gets a Rabin-Karp hash. Windows are dealt out by
a minimizer, the smallest hash of a four-word run inside them: equal windows
have equal minimizers, and neighbours mostly share theirs, so a run of windows
travels as one row. The rows of a minimizer arrive sorted by doc_id, hence the
first document with a window is the smallest, and a task remembers only the
distinct windows of the minimizer it is at.

Before they travel, windows are compared within each slice of a map task. One
that a smaller document of the slice holds is settled there; so a passage that
a third of all documents share sends a row per slice, not per document.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.llm import tokens
from brightwater.llm.common import map_arrow

WIDTH = 13
#: Words in the runs that choose a window's minimizer.
MINIMIZER = 4
#: Bytes of a window's hash that travel, beside four of its minimizer's.
HASH_BYTES = 7

# A row that travels is one binary value, which sorts by minimizer, then
# document: these four numbers, big-endian, followed by the hashes of the run's
# windows. Where the windows are settled, their number follows instead, in four
# bytes, which is no multiple of HASH_BYTES.
_HEAD = np.dtype([("mini", ">u4"), ("doc_id", ">u8"), ("mark", ">i4"), ("start", ">i4")])
_SIGN = np.uint64(1 << 63)


def _packed(mini, doc_id, mark, start, bounds, tail: np.ndarray) -> pa.Array:
    """Row `r` gets the rows of `tail` (bytes) from `bounds[r]` up to `bounds[r + 1]`."""
    rows, width = len(mini), tail.shape[1]
    head = np.empty(rows, _HEAD)
    head["mini"], head["mark"], head["start"] = mini, mark, start
    head["doc_id"] = doc_id.view(np.uint64) ^ _SIGN
    offsets = np.arange(rows + 1) * _HEAD.itemsize + bounds * width
    out = np.empty(offsets[-1], np.uint8)
    is_head = np.zeros(offsets[-1], bool)
    is_head[(offsets[:-1, None] + np.arange(_HEAD.itemsize)).ravel()] = True
    out[is_head] = head.view(np.uint8)
    out[~is_head] = tail.ravel()
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def _unpacked(column: pa.Array):
    """Heads, number of windows, whether they are settled, and the hashes of all that are not."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.diff(offsets) - _HEAD.itemsize
    settled = size % HASH_BYTES != 0
    is_head = np.zeros(len(data), bool)
    is_head[(offsets[:-1, None] + np.arange(_HEAD.itemsize)).ravel()] = True
    is_count = np.zeros(len(data), bool)
    is_count[(offsets[1:][settled, None] - np.arange(4, 0, -1)).ravel()] = True
    head = data[is_head].view(_HEAD)
    n = size // HASH_BYTES
    n[settled] = data[is_count].view(">i4")
    tail = data[~is_head & ~is_count].reshape(-1, HASH_BYTES)
    hashes = np.zeros((len(tail), 8), np.uint8)
    hashes[:, :HASH_BYTES] = tail
    return head, n, settled, hashes.view(np.uint64).ravel()


def _run(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First window in the high 32 bits, number of windows in the low ones."""
    return (start.astype(np.int64) << 32) | n.astype(np.int64)


def _least_of_each(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every `width` consecutive values, by doubling."""
    reach, least = 1, values
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return least


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column, and the end."""
    n = len(columns[0])
    new = np.ones(n + 1, bool)
    if n > 1:
        new[1:n] = False
        for column in columns:
            new[1:n] |= column[1:] != column[:-1]
    return np.flatnonzero(new) if n else np.zeros(1, np.int64)


def _settled(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a smaller document among these holds the same window."""
    order = np.lexsort((docs, hashes))
    sorted_hashes = hashes[order]
    begins = _runs(sorted_hashes)
    least = np.repeat(docs[order][begins[:-1]], np.diff(begins))
    out = np.empty(len(hashes), bool)
    out[order] = docs[order] > least
    return out


def _rows_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _emit(width: int, minimizer: int):
    def per_batch(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            marks = batch.column("mark").to_numpy(zero_copy_only=False)
            for begin, part in tokens.slices(batch.column("text")):
                words = tokens.split(part)
                at = tokens.whole_windows(words.first, width)
                if not len(at):
                    continue
                each = tokens.word_hashes(words)
                hashes = tokens.rolling(each, width)[at]
                mini = _least_of_each(tokens.mix(tokens.rolling(each, minimizer)), width - minimizer + 1)[at]
                doc = words.doc_of_word()[at]
                start = (at - words.first[doc]).astype(np.int32)
                settled = _settled(hashes, ids[begin + doc])

                for chosen in (np.flatnonzero(~settled), np.flatnonzero(settled)):
                    travels = not len(chosen) or not settled[chosen[0]]
                    # neighbours in one document and, if they travel, with one minimizer
                    near = chosen - np.arange(len(chosen))
                    bounds = _runs(near, doc[chosen], mini[chosen]) if travels else _runs(near, doc[chosen])
                    first = chosen[bounds[:-1]]
                    if not len(first):
                        continue
                    if travels:
                        tail = hashes[chosen].view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
                    else:
                        tail = np.diff(bounds).astype(">i4").view(np.uint8).reshape(-1, 4)
                        bounds = np.arange(len(bounds))
                    row = begin + doc[first]
                    packed = _packed((mini[first] >> np.uint64(32)).astype(np.uint32), ids[row], marks[row], start[first], bounds, tail)
                    yield pa.RecordBatch.from_arrays([packed], ["packed"])

    return per_batch


_FOUND = pa.schema([("doc_id", pa.int64()), ("mark", pa.int32()), ("run", pa.int64())])


def _find(batches):
    """Runs of removable windows, from rows sorted by minimizer and doc_id."""
    open_mini = None
    known = known_docs = None  # windows of the open minimizer and the first document of each
    for batch in batches:
        if not batch.num_rows:
            continue
        head, n, done, hashes = _unpacked(batch.column("packed"))
        mini, marks, start = (head[name].astype(np.int64) for name in ("mini", "mark", "start"))
        ids = (head["doc_id"].astype(np.uint64) ^ _SIGN).view(np.int64)
        runs = [(ids[done], marks[done], start[done], n[done])]
        rest = np.flatnonzero(~done)
        if len(rest):
            row = np.repeat(rest, n[rest])
            offset = np.arange(len(row)) - np.repeat(np.cumsum(n[rest]) - n[rest], n[rest])
            docs = ids[row]
            order = np.lexsort((docs, hashes))
            bounds = _runs(hashes[order])
            distinct, least = hashes[order][bounds[:-1]], docs[order][bounds[:-1]].copy()
            if open_mini is not None and mini[rest[0]] == open_mini:
                place = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
                seen = known[place] == distinct
                least[seen] = np.minimum(least[seen], known_docs[place[seen]])
            removable = np.empty(len(hashes), bool)
            removable[order] = docs[order] > np.repeat(least, np.diff(bounds))

            last = mini[rest[-1]]
            of_last = np.zeros(len(distinct), bool)
            group = np.repeat(np.arange(len(distinct)), np.diff(bounds))
            of_last[group[mini[row[order]] == last]] = True
            distinct, least = distinct[of_last], least[of_last]
            if open_mini == last:
                older = ~np.isin(known, distinct)
                distinct, least = np.concatenate([known[older], distinct]), np.concatenate([known_docs[older], least])
                by = np.argsort(distinct)
                distinct, least = distinct[by], least[by]
            open_mini, known, known_docs = last, distinct, least

            chosen = np.flatnonzero(removable)
            if len(chosen):
                bounds = _runs(chosen - np.arange(len(chosen)), row[chosen])
                first = chosen[bounds[:-1]]
                of = row[first]
                runs.append((ids[of], marks[of], start[of] + offset[first], np.diff(bounds)))
        ids, marks, start, n = (np.concatenate(x) for x in zip(*runs))
        if len(ids):
            yield _rows_of(_FOUND, doc_id=ids, mark=marks, run=_run(start, n))


def removable_windows(docs: DataFrame, width: int = WIDTH, minimizer: int = MINIMIZER) -> DataFrame:
    """Columns `doc_id`, `mark`, `run`: first window (high 32 bits) and number of windows (low) of each run.

    `docs` has `doc_id` bigint, `mark` int (of the text) and `text`.
    """
    sent = map_arrow(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), _emit(width, minimizer), "packed binary")
    # settled rows go where the hash of their minimizer sends them, and are passed on
    met = sent.repartition(F.substring("packed", 1, 4)).sortWithinPartitions("packed")
    return map_arrow(met, _find, "doc_id bigint, mark int, run bigint")


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())]
)


def _remove(width: int, with_text: bool):
    schema = _RESULT if with_text else pa.schema([f for f in _RESULT if f.name != "kept_text"])

    def per_batch(batches):
        for batch in batches:
            runs = batch.column("runs")
            bounds = np.asarray(runs.offsets)
            packed = np.asarray(runs.values)
            empty = runs.is_null().to_numpy(zero_copy_only=False)
            out = {f.name: [] for f in schema if f.name != "doc_id"}
            for d, text in enumerate(batch.column("text").cast(pa.binary())):
                words = (text.as_py() or b"").split()
                removed = 0
                kept = words
                if not empty[d]:
                    change = np.zeros(len(words) + 1, np.int64)
                    mine = packed[bounds[d] : bounds[d + 1]]
                    np.add.at(change, mine >> 32, 1)
                    np.add.at(change, (mine >> 32) + (mine & 0xFFFFFFFF) + width - 1, -1)
                    keep = np.cumsum(change[:-1]) == 0
                    kept = list(compress(words, keep.tolist()))
                    removed = len(words) - len(kept)
                joined = b" ".join(kept)
                out["n_words"].append(len(words))
                out["n_removed"].append(removed)
                out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    out["kept_text"].append(joined.decode())
            yield _rows_of(schema, doc_id=batch.column("doc_id"), **out)

    return per_batch


def remove_repeated_windows(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    minimizer: int = MINIMIZER,
    with_text: bool = True,
) -> DataFrame:
    """Columns `doc_id`, `n_words`, `n_removed`, `kept_text` (if asked for) and `kept_sha256`; one row per row of `docs`.

    A word is removed if a window of `width` words covers it whose word
    sequence also starts in a document with a smaller id. Kept words are joined
    by single spaces. Null texts have no words. A null id is neither smaller
    nor larger than another, so such rows are kept whole and remove nothing.
    Rows with the same id do not remove each other's words. An empty table
    gives no rows. Other columns of `docs` are not read.
    """
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.hash(text).alias("mark"), F.col(text).alias("text")
    )
    runs = removable_windows(rows, width, minimizer).groupBy("doc_id", "mark").agg(F.collect_list("run").alias("runs"))
    found = runs.select(F.col("doc_id").alias("id"), F.col("mark").alias("its_mark"), "runs")
    joined = rows.join(found, (F.col("doc_id") == F.col("id")) & (F.col("mark") == F.col("its_mark")), "left")
    schema = "doc_id bigint, n_words bigint, n_removed bigint" + ", kept_text string" * with_text + ", kept_sha256 string"
    return map_arrow(joined.select("doc_id", "text", "runs"), _remove(width, with_text), schema)
