"""Language of texts by cross-parsing entropy.

For each language a suffix automaton holds every substring of a sample of its
labelled text. A text is parsed greedily: a phrase goes on as long as the
automaton knows it, that is, for the longest match, then the next one begins. A
phrase is a pointer into the sample, so a text of n letters costs phrases *
log2(sample length) / n bits per letter; the language with the least wins.

The sample is bounded: `DOCS` documents a language with the smallest hash of
their id, and of those `PIECES` pieces of `PIECE` characters, or fewer where the
languages together would exceed `CHARACTERS`. An automaton has fewer than three
edges a character. They are sent to the executors as rows that overlap, 10 to 17
bytes an edge, whatever the number of letters; a model over `MODEL_BYTES` is
refused. Every text is parsed whole, in stretches of equal length side by side,
each beginning a new phrase.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightwater.llm import tokens
from brightwater.llm.common import map_arrow, write_shared

DOCS = 60
PIECES = 60
PIECE = 500
#: Characters of the samples of all languages together.
CHARACTERS = 2_000_000
#: Bytes of a model that is sent to the executors: three edges a character, of 24
#: bytes each at most, and the classes of all code points.
MODEL_BYTES = 72 * CHARACTERS + (8 << 20)
HELD_OUT = 2
UNKNOWN = "und"
_STRETCH = 256
#: Stretches that are parsed side by side.
_AT_ONCE = 8192
#: Bytes of text that are worked on at once.
_SLICE_BYTES = 1 << 20
#: Places that are tried at once for a row of edges.
_WINDOW = 4096
_SPACE, _OTHER = 0, 1  # no letter; a letter that no sample has


def _automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence (Blumer et al., 1985)."""
    following, link, length = [{}], [-1], [0]
    last = 0
    for code in codes:
        state = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and code not in following[p]:
            following[p][code] = state
            p = link[p]
        if p >= 0:
            q = following[p][code]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and following[p].get(code) == q:
                    following[p][code] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return following


def _row_starts(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Where each row of codes begins, so that no two begin at one place and none share an edge's place.

    First fit, longest rows first. Rows of one code fill what is left, all rows of
    the same code at once. Windows that are nearly full are not searched again.
    """
    starts = np.zeros(len(rows), np.int64)
    free, unused = np.ones((2, sum(map(len, rows)) + width + 2 * _WINDOW), bool)
    singles: dict[int, list[int]] = {}
    low = 0
    for r in sorted(range(len(rows)), key=lambda r: len(rows[r]), reverse=True):
        codes = rows[r].tolist()
        if len(codes) == 1:
            singles.setdefault(codes[0], []).append(r)
            continue
        at = low
        while True:
            if at + width + _WINDOW > len(free):
                free, unused = np.pad([free, unused], ((0, 0), (0, len(free))), constant_values=True)
            fits = unused[at : at + _WINDOW].copy()
            for code in codes:
                fits &= free[at + code : at + code + _WINDOW]
            if fits.any():
                break
            at += _WINDOW
        starts[r] = at + fits.argmax()
        unused[starts[r]] = free[starts[r] + rows[r]] = False
        if np.count_nonzero(free[low : low + _WINDOW]) < _WINDOW // 20:
            low += _WINDOW
    # Each of them takes two places at most from each of the others.
    room = width + 2 * sum(map(len, singles.values()))
    free, unused = np.pad([free, unused], ((0, 0), (0, room)), constant_values=True)
    for code, members in singles.items():
        places = np.flatnonzero(unused[: len(unused) - code] & free[code:])[: len(members)]
        starts[members] = places
        unused[places] = free[places + code] = False
    return starts


@dataclass
class Edges:
    """Edges of an automaton, in rows that overlap (a double array; Aoe, 1989).

    The row of a state begins at `start[state]`, and its edge by `code` is at
    that place plus `code` if `owner` there is the row's begin. The last row and
    the last place are empty, for states without edges."""

    width: int
    start: np.ndarray
    owner: np.ndarray
    to: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, to: np.ndarray, width: int = 256) -> Edges:
        """The edge from `state` by `code` has the key `state * width + code`; each key once."""
        states, codes = np.divmod(keys, width)
        order = np.argsort(states, kind="stable")
        used, first = np.unique(states[order], return_index=True)
        starts = _row_starts(np.split(codes[order], first[1:]) if len(keys) else [], width)
        places = np.repeat(starts, np.diff(first, append=len(keys))) + codes[order]
        size = int(places.max(initial=-1)) + 2
        if size + width >= 1 << 31:
            raise ValueError(f"{len(keys)} edges are too many for one language")
        start = np.full(used.max(initial=-1) + 2, size - 1, np.int32)
        start[used] = starts
        table = Edges(width, start, np.full(size, -1, np.int32), np.zeros(size, np.int32))
        table.owner[places], table.to[places] = places - codes[order], to[order]
        return table

    def linked(self) -> Edges:
        """The same with the begin of the next state's row in `to`, as `follow` takes it."""
        return Edges(self.width, self.start, self.owner, self.start.take(self.to, mode="clip"))

    def follow(self, rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the edge by each code leads to, and the indexes of those that are not there."""
        places = rows + codes
        missing = np.flatnonzero(self.owner.take(places, mode="clip") != rows)
        return self.to.take(places, mode="clip"), missing

    def find(self, keys: np.ndarray) -> np.ndarray:
        """What each edge leads to, -1 where there is none."""
        states, codes = np.divmod(keys, self.width)
        found, missing = self.follow(self.start.take(states, mode="clip"), codes)
        found[missing] = -1
        return found

    def bytes(self) -> int:
        return self.start.nbytes + self.owner.nbytes + self.to.nbytes


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray
    width: int
    edges: list[Edges]
    bits: np.ndarray

    def bytes(self) -> int:
        return self.classes.nbytes + sum(e.bytes() for e in self.edges)


def _collapsed(codes: np.ndarray) -> np.ndarray:
    """Whether a code is kept when neighbouring spaces become one."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
    return keep


def fit(pieces: dict[str, list[str]]) -> Model:
    """The model of samples by language."""
    letters = sorted({c for texts in pieces.values() for t in texts for c in t.lower() if c.isalpha()})
    is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    classes = np.where(is_letter, _OTHER, _SPACE).astype(np.int32)
    for k, letter in enumerate(letters):
        for form in {letter, letter.upper(), letter.title()}:
            if len(form) == 1:
                classes[ord(form)] = k + 2
    width = len(letters) + 2
    edges, bits = [], []
    for language in sorted(pieces):
        codes = classes[np.frombuffer(" ".join(pieces[language]).encode("utf-32-le", "replace"), np.uint32)]
        codes = codes[_collapsed(codes)].tolist()
        following = _automaton(codes)
        n = sum(map(len, following))
        keys = np.fromiter((state * width + code for state, out in enumerate(following) for code in out), np.int64, n)
        to = np.fromiter((to for out in following for to in out.values()), np.int32, n)
        edges.append(Edges.of(keys, to, width).linked())
        bits.append(math.log2(max(2, len(codes))))
    return Model(sorted(pieces), classes, width, edges, np.array(bits))


def phrases(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text (without nulls) in each language, and whether it has a letter."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    first = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy())])
    codes = model.classes.take(np.frombuffer(bytes(data).decode("utf-8", "replace").encode("utf-32-le"), np.uint32))
    keep = _collapsed(codes)
    keep[first[:-1][first[:-1] < len(codes)]] = True
    kept = np.flatnonzero(keep)
    first, codes = np.searchsorted(kept, first), codes.take(kept)
    has_letter = np.diff(np.searchsorted(np.flatnonzero(codes != _SPACE), first)) > 0

    lengths = np.diff(first)
    stretches = -(-lengths // _STRETCH)
    owner = np.repeat(np.arange(len(texts)), stretches)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    begin = first[owner] + number * _STRETCH
    size = np.minimum(lengths[owner] - number * _STRETCH, _STRETCH)
    longest = np.argsort(-size, kind="stable")
    owner, begin, size = owner[longest], begin[longest], size[longest]
    counts = np.zeros((len(texts), len(model.languages)), np.int64)
    for low in range(0, len(owner), _AT_ONCE):
        part = slice(low, low + _AT_ONCE)
        # Of a column, only the stretches that reach it: the first ones, as the longest come first.
        reach = np.searchsorted(-size[part], -np.arange(size[low]))
        columns = [codes.take(begin[low : low + n] + k) for k, n in enumerate(reach)]
        for k, edges in enumerate(model.edges):
            root = edges.start[0]
            begins = edges.find(np.arange(model.width))
            begins[begins < 0] = root
            row = np.full(len(size[part]), root)
            found = np.ones(len(row), np.int64)
            for column in columns:
                row, ends = edges.follow(row[: len(column)], column)
                found[ends] += 1
                row[ends] = begins.take(column.take(ends))
            np.add.at(counts[:, k], owner[part], found)
    return counts, has_letter


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; see `identify`."""
    names, scores = [], []
    for _, part in tokens.slices(texts, _SLICE_BYTES):
        counts, has_letter = phrases(model, part)
        name, score = np.full(len(part), UNKNOWN, object), np.zeros(len(part))
        if model.languages:
            cost = (counts * model.bits)[has_letter]
            order = np.argsort(cost, axis=1, kind="stable")
            name[has_letter] = np.array(model.languages, object)[order[:, 0]]
            least = np.take_along_axis(cost, order[:, :2], axis=1)
            score[has_letter] = 1 - least[:, 0] / least[:, 1] if len(model.languages) > 1 else 1
        names.extend(name)
        scores.append(score)
    return names, np.concatenate([np.zeros(0), *scores])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, characters: int = CHARACTERS) -> dict[str, list[str]]:
    """Pieces of labelled text by language, from documents that are not held out and have an id.

    All languages get the same share of `characters`, up to `PIECES` pieces.
    """
    known = docs.select("doc_id", "text", "lang").where(
        "doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL"
    )
    known = known.where(~held_out(F.col("doc_id"))).withColumn("order", F.xxhash64("doc_id"))
    first = known.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("order", "doc_id", "text"))).where(
        F.col("n") <= DOCS
    )
    # Every language is among them, so that the texts are read once.
    first = write_shared(first, "language_sample")
    share = max(1, characters // max(1, first.select("lang").distinct().count()))
    length, most = min(PIECE, share), max(1, min(PIECES, share // PIECE))
    places = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / length).cast("int"))
    pieces = first.where("text != ''").select("lang", "order", "text", F.explode(places).alias("at")).select(
        "lang", F.xxhash64("order", "at").alias("order"), F.substring(F.col("text"), F.col("at") * length + 1, F.lit(length)).alias("piece")
    )
    chosen = pieces.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("order", "piece"))).where(
        F.col("n") <= most
    )
    found: dict[str, list[str]] = {}
    for row in sorted(chosen.select("lang", "n", "piece").collect()):
        found.setdefault(row["lang"], []).append(row["piece"])
    return {lang: texts for lang, texts in found.items() if any(c.isalpha() for t in texts for c in t)}


def identify(docs: DataFrame) -> DataFrame:
    """Columns `doc_id`, `held_out`, `lang_pred` and `score`; one row per row of `docs`.

    `score` is how much more the next best language costs, from 0 (as much) to
    1 (no bound, or there is no other). A null text or one without a letter is
    `und` with score 0, as is any text where no labelled text is given.
    Languages that cost the same go by name. Rows with a null id or language
    are predicted but not learned from. Repeated rows give repeated rows, an
    empty table none. A very long text is parsed whole, as any other; of its
    pieces the sample may hold some. Other columns are not read.
    """
    fitted = fit(sample(docs))
    if fitted.bytes() > MODEL_BYTES:
        raise ValueError(f"the model of {len(fitted.languages)} languages takes {fitted.bytes()} bytes")
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def per_batch(batches):
        for batch in batches:
            names, scores = predict(model.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, per_batch, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
