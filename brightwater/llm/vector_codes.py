"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

Nearest entries are found by slicing and intersecting. For every dimension of
a part the entries' coordinates are sorted, and each place in that order keeps
a mask of the entries before it, a bit for each in 64-bit words. The entries
within a radius of a value in one dimension are a range of that order, so their
mask is the difference of two kept ones; the masks of all dimensions, ANDed,
give the entries that are within the radius in every dimension. Those within
the radius in all are among them. A first radius, half the typical distance of
neighbouring entries, settles most parts in crowded places; another one, the
distance of an entry already known, settles the rest, so results are exact.

All is done in whole numbers. Rounds are Spark aggregations: each task sends
one sum for each entry that it uses, and the codebooks, 256 entries a part,
travel to the driver and back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.llm.common import map_arrow, write_shared
from brightwater.llm.group_joins import join_groups

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Scaled components are held within this bound either way, so that sums of squares fit 64 bits.
BOUND = 1 << 27
#: Vectors whose candidates are expanded at once.
SLICE = 512
#: Below this, products of doubles are exact whole numbers, up to 1024 dimensions.
_EXACT = 1 << 20


class Codebook:
    """The entries of one part, whole numbers in rows, with their prefix masks by dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, dims = entries.shape
        words = -(-k // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        own = np.zeros((k, words), np.uint64)
        own[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k, dtype=np.uint64) % np.uint64(64))
        self.prefix = np.zeros((dims, k + 1, words), np.uint64)
        for d in range(dims):
            np.bitwise_or.accumulate(own[order[:, d]], axis=0, out=self.prefix[d, 1:])
        self.every = np.bitwise_or.reduce(own, axis=0)
        self.small = dims <= 1024 and np.abs(entries).max(initial=0) < _EXACT
        self.norms = (entries**2).sum(axis=1)
        self.radius = self._first_radius()
        #: the dimension in which entries differ most, for a first guess
        self.widest = int(np.argmax(np.ptp(entries, axis=0))) if dims else None
        self.order = order

    def _first_radius(self) -> int:
        if len(self.entries) < 2:
            return 0
        nearest = []
        for i, entry in enumerate(self.entries):
            far = ((self.entries - entry) ** 2).sum(axis=1)
            nearest.append(np.delete(far, i).min())
        return int(np.sqrt(float(np.median(nearest)))) // 2

    def within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that are within each row's radius in every dimension."""
        mask = np.broadcast_to(self.every, (len(x), len(self.every))).copy()
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            mask &= self.prefix[d][high] ^ self.prefix[d][low]
        return mask

    def best_of(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest of the masked entries, the least index of equal ones, and its squared distance; -1 where there is none.

        Where many are masked the distances of a slice come from one product of matrices.
        """
        index, far = np.full(len(x), -1), np.full(len(x), -1, np.int64)
        for begin in range(0, len(x), SLICE):
            bits = np.unpackbits(mask[begin : begin + SLICE].view(np.uint8), axis=1, bitorder="little")
            part = x[begin : begin + SLICE]
            if self.small and np.abs(part).max(initial=0) < _EXACT and 16 * np.count_nonzero(bits) > bits.size:
                squared = (part**2).sum(axis=1)[:, None] - 2 * (part.astype(float) @ self.entries.T.astype(float)) + self.norms
                squared[bits[:, : len(self.entries)] == 0] = np.inf
                nearest = squared.argmin(axis=1)
                least = squared[np.arange(len(part)), nearest]
                some = np.isfinite(least)
                index[begin : begin + SLICE][some] = nearest[some]
                far[begin : begin + SLICE][some] = least[some].astype(np.int64)
                continue
            row, entry = np.nonzero(bits)
            if not len(row):
                continue
            squared = ((x[begin + row] - self.entries[entry]) ** 2).sum(axis=1, dtype=np.int64)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat(squared, first)
            hits = np.flatnonzero(squared == np.repeat(least, np.diff(np.r_[first, len(row)])))
            hits = hits[np.r_[True, row[hits][1:] != row[hits][:-1]]]
            index[begin + row[hits]] = entry[hits]
            far[begin + row[hits]] = least
        return index, far

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row, the least index of equally near ones."""
        index, far = self.best_of(x, self.within(x, np.full(len(x), self.radius)))
        open_ = np.flatnonzero((far < 0) | (far > self.radius**2))
        if len(open_):
            rest = x[open_]
            known = far[open_]
            guess = np.zeros(len(rest), np.int64)
            if self.widest is not None:
                place = np.searchsorted(self.sorted[:, self.widest], rest[:, self.widest])
                guess = self.order[np.minimum(place, len(self.entries) - 1), self.widest]
            guessed = ((rest - self.entries[guess]) ** 2).sum(axis=1, dtype=np.int64)
            known = np.where(known < 0, guessed, np.minimum(known, guessed))
            radius = np.ceil(np.sqrt(known.astype(float))).astype(np.int64) + 1
            index[open_], far[open_] = self.best_of(rest, self.within(rest, radius))
        return index, far


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Columns `vec_id`, `label` and `x`, the vectors in whole numbers, of the rows that are kept; see `compress`."""
    value = F.col("v")
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where(value.isNotNull()).where(F.coalesce(finite, F.lit(False)) & (F.size("v") % PARTS == 0))
    held = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), c * SCALE))).cast("int"))
    return write_shared(rows.select("vec_id", "label", held.alias("x")), "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _cut(x: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(part) for part in np.split(x, PARTS, axis=1)]


def _next_codebooks(rows: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    sent = rows.sparkSession.sparkContext.broadcast(codebooks)
    k, width = codebooks[0].shape

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(entries) for entries in sent.value]
        sums, counts = np.zeros((PARTS * k, width), np.int64), np.zeros(PARTS * k, np.int64)
        for batch in batches:
            for p, part in enumerate(_cut(_matrix(batch.column("x")))):
                index, _ = books[p].assign(part)
                counts[p * k : (p + 1) * k] += np.bincount(index, minlength=k)
                np.add.at(sums, p * k + index, part)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["entry", "n", "total"]
        )

    partial = map_arrow(rows.select("x"), per_task, "entry int, n bigint, total array<bigint>")
    totals = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)]
    out = [entries.copy() for entries in codebooks]
    # at most PARTS * ENTRIES rows
    for row in partial.groupBy("entry").agg(F.sum("n").alias("n"), *totals).collect():
        out[row["entry"] // k][row["entry"] % k] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return out


def train(rows: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray] | None:
    """The codebooks of rows from `whole_numbers` of one width, one per part; None if there are no rows.

    They start as the parts of the `ENTRIES` rows with the smallest ids, nulls
    last, equal ids by their vectors; fewer rows give fewer entries.
    """
    first = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    if not first:
        return None
    codebooks = _cut(np.array([row["x"] for row in first], np.int64).reshape(len(first), -1))
    for _ in range(rounds):
        codebooks = _next_codebooks(rows, codebooks)
    return codebooks


def encode(rows: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """Columns `vec_id`, `label`, `code` (two hex digits a part) and `error` of rows from `whole_numbers`."""
    sent = rows.sparkSession.sparkContext.broadcast(codebooks)
    types = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(entries) for entries in sent.value]
        for batch in batches:
            parts = _cut(_matrix(batch.column("x")))
            found = [book.assign(part) for book, part in zip(books, parts)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            error = np.sum([far for _, far in found], axis=0, dtype=np.int64)
            columns = [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return map_arrow(rows, per_task, f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint")


def decode(codes: list[str], codebooks: list[np.ndarray]) -> np.ndarray:
    """The vectors that codes stand for, in the input's scale."""
    index = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(len(codes), PARTS)
    return np.concatenate([book[index[:, p]] for p, book in enumerate(codebooks)], axis=1) / SCALE


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in codebooks for v in book.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Columns `vec_id`, `code`, `error`, `label_error` and `codebooks_sha256`, one row per kept row of `vectors`.

    Dropped are rows whose vector is null or holds a null or non-finite
    component, and rows that cannot be cut alike: those whose length is not a
    multiple of four or not that of the kept vector with the smallest id.
    Scaled components beyond 2**27 either way count as that bound. Null ids
    come after all others, equal ids are ordered by their vectors, and repeated
    rows count again. Of equally near entries the lower index is taken. Fewer
    than 256 kept rows give fewer entries. Null labels are one label.
    Other columns are not read. An empty table gives no rows.
    """
    rows = whole_numbers(vectors, vec_id, embedding, label)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).collect()
    rows = rows.where(F.size("x") == (len(first[0]["x"]) if first else 0))
    codebooks = train(rows)
    if codebooks is None:
        return rows.select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    coded = write_shared(encode(rows, codebooks), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("label_rows"))
    coded = join_groups(coded, write_shared(by_label, "labels"), ["label"], "label_rows")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
