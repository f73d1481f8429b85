"""Spelling variants: words one edit apart, found with an index of variable-length grams.

The dictionary holds the grams that more than `often` words contain; a rarer
gram is never made longer, so the tree of grams is pruned by frequency. A word,
with a mark at each end, is decomposed into one gram for each position: the
shortest that is not in the dictionary, or the longest allowed. Which gram
begins at a position is told by its own characters alone, so an edit elsewhere
leaves it as it is.

An edit affects a gram if it falls inside, so a word knows for each place which
of its grams an edit there affects. Of two grams that do not overlap an edit
affects one at most. A word therefore asks for two lists only, those of the two
such grams that the fewest words contain: words one edit away hold the left one
at the same distance from their beginning, or else the right one at the same
distance from their end. Lists are kept by that distance and by word length.
What they propose is verified by the edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.llm.common import map_arrow, write_shared

#: A word is at least so long and occurs at least so often.
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Lengths of grams.
SHORTEST, LONGEST = 2, 6
#: Words that may contain a gram before it is made longer.
OFTEN = 64
#: Grams of one length in the dictionary, at most; larger vocabularies raise the bound `OFTEN` instead.
DICTIONARY = 100_000
#: Words that ask for one list in one task.
ASKING = 256
#: Every so manieth run, by its hash, loses a character.
TYPO_EVERY = 97

#: Distinct words that a task counts before it passes them on.
COUNTED = 400_000

#: A run of A-Z, a-z and U+00C0 to U+00FF in UTF-8, A-Z lower-cased before.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
_BEGIN, _END = "<", ">"


def typo(run: bytes, crc: int) -> bytes:
    """`run` without its code point at `crc` modulo its length."""
    points = run.decode()
    k = crc % len(points)
    return (points[:k] + points[k + 1 :]).encode()


def words_of(doc_id: str, text: bytes) -> Iterator[tuple[bytes, int]]:
    """The runs of a text with their numbers; those whose CRC-32 of `<doc_id>:<run>` 97 divides have a typo."""
    begin = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text.lower())).items():
        crc = zlib.crc32(run, begin)
        yield (run if crc % TYPO_EVERY else typo(run, crc)), n


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns `word` and `n`: the words of all texts, after `typo`, that are long and frequent enough."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def counted():
            columns = [pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for of, value in zip(batch.column("doc_id").to_pylist(), texts):
                for word, n in words_of(of, value.as_py()):
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > COUNTED:
                    yield counted()
                    counts.clear()
        yield counted()

    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(text).alias("text"))
    counted = map_arrow(rows, per_task, "word string, n bigint").where(F.char_length("word") >= LEAST_LENGTH)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def gram_dictionary(words: DataFrame) -> tuple[dict[str, int], int]:
    """The grams that more than `often` words contain with their numbers of words, and `often`.

    `often` is `OFTEN` or, if greater, the characters of all words over
    `DICTIONARY`. A length then has fewer than `DICTIONARY` frequent grams,
    since a word has no more grams of a length than characters. So what the
    driver collects has a bound of a few times `DICTIONARY`.
    """
    characters = words.agg(F.sum(F.char_length("word") + 2)).first()[0] or 0
    often = max(OFTEN, -(-characters // DICTIONARY))
    marked = words.select(F.concat(F.lit(_BEGIN), "word", F.lit(_END)).alias("w"))

    def of_length(q: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.char_length("w") - (q - 1)), lambda p: F.substring("w", p, F.lit(q)))

    grams = marked.select(F.explode(F.array_distinct(F.concat(*[of_length(q) for q in range(SHORTEST, LONGEST)]))).alias("gram"))
    frequent = grams.groupBy("gram").count().where(F.col("count") > often)
    return {r["gram"]: r["count"] for r in frequent.collect()}, often


def longest(length: int) -> int:
    """The longest gram in words that are compared with words of `length` and one more.

    Two of them fit side by side, so there always is a pair that does not overlap.
    """
    return min(LONGEST, (length + 3) // 2)


def decompose(marked: str, dictionary: dict[str, int], most: int) -> list[tuple[int, int]]:
    """Beginning and end of the gram at each position of a word with its marks."""
    out, n = [], len(marked)
    for begin in range(n - SHORTEST + 1):
        end = begin + SHORTEST
        while end < n and end - begin < most and marked[begin:end] in dictionary:
            end += 1
        out.append((begin, end))
    return out


def cheapest_pair(marked: str, grams: list[tuple[int, int]], dictionary: dict[str, int], often: int):
    """The two grams, the first wholly before the second, that the fewest words contain together."""
    rated = [(dictionary.get(marked[b:e], often), b - e, b, e) for b, e in grams]
    n = len(marked)
    left, right = [None] * (n + 1), [None] * (n + 1)
    for gram in rated:
        _, _, b, e = gram
        left[e] = gram if left[e] is None else min(left[e], gram)
        right[b] = gram
    for k in range(1, n + 1):
        left[k] = min((g for g in (left[k - 1], left[k]) if g), default=None)
    for k in range(n - 1, -1, -1):
        right[k] = min((g for g in (right[k + 1], right[k]) if g), default=None)
    pairs = [(a[0] + b[0], a[1] + b[1], a[2:], b[2:]) for a, b in zip(left, right) if a and b]
    return min(pairs)[2:]


def _index(words: DataFrame, sent) -> DataFrame:
    """The lists: a row `key`, `b`, `n_b` for each gram of each word and each end of the word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = sent.value
        for batch in batches:
            lists = []
            for word in batch.column("word").to_pylist():
                marked, n, keys = f"{_BEGIN}{word}{_END}", len(word), []
                for most in {longest(n), longest(max(n - 1, LEAST_LENGTH))}:
                    for b, e in decompose(marked, known, most):
                        gram = marked[b:e]
                        keys += (f"{most},{n},{b},{gram}", f"{most},{n},{e - n - 3},{gram}")
                lists.append(keys)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string())), batch.column("word"), batch.column("n")], ["keys", "b", "n_b"])

    lists = map_arrow(words, rows, "keys array<string>, b string, n_b bigint")
    return lists.select(F.explode("keys").alias("key"), "b", "n_b").select(F.xxhash64("key").alias("key"), "b", "n_b")


def _asked(words: DataFrame, sent) -> DataFrame:
    """The lists that each word asks for: `key`, `a`, `n_a`, and for those of its right gram the left one, `other`, at `at`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = sent.value
        for batch in batches:
            asked = []
            for word in batch.column("word").to_pylist():
                marked, n = f"{_BEGIN}{word}{_END}", len(word)
                most = longest(n)
                (b, e), (c, f) = cheapest_pair(marked, decompose(marked, known, most), known, often)
                left, right = marked[b:e], marked[c:f]
                asked.append([
                    ask for m in (n, n + 1)
                    for ask in ((f"{most},{m},{b},{left}", None, None), (f"{most},{m},{f - n - 3},{right}", b + 1, left))
                ])
            lists = pa.array([[{"key": k, "at": p, "other": o} for k, p, o in row] for row in asked], _ASKS)
            yield pa.RecordBatch.from_arrays([lists, batch.column("word"), batch.column("n")], ["asked", "a", "n_a"])

    asked = map_arrow(words, rows, "asked array<struct<key: string, at: int, other: string>>, a string, n_a bigint")
    asked = asked.select(F.explode("asked").alias("ask"), "a", "n_a")
    return asked.select(F.xxhash64("ask.key").alias("key"), "a", "n_a", F.col("ask.at").alias("at"), F.col("ask.other").alias("other"))


_ASKS = pa.list_(pa.struct([("key", pa.string()), ("at", pa.int32()), ("other", pa.string())]))


def near_words(words: DataFrame) -> DataFrame:
    """Each pair of words that one inserted, deleted or replaced code point tells apart, once: `a`, `n_a`, `b`, `n_b`.

    `words` has distinct words of at least `LEAST_LENGTH` code points, without
    the marks `<` and `>`, and numbers `n`. A list that more than `ASKING`
    words ask for is copied for each further `ASKING` of them.
    """
    sent = words.sparkSession.sparkContext.broadcast(gram_dictionary(words))
    index = write_shared(_index(words, sent), "lists")
    asked = write_shared(_asked(words, sent), "asked")
    deals = asked.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("deals")).where("deals > 1")
    deals = write_shared(deals, "deals")
    if not deals.isEmpty():
        index = index.join(deals, "key", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)))
        asked = asked.join(deals, "key", "left").withColumn("deal", F.pmod(F.xxhash64("a"), F.coalesce("deals", F.lit(1))).cast("int"))
        index, asked = index.drop("deals"), asked.drop("deals")
        keys = ["key", "deal"]
    else:
        keys = ["key"]
    marked = F.concat(F.lit(_BEGIN), "b", F.lit(_END))
    # what the left gram finds is not taken from the right one again
    once = F.col("other").isNull() | (F.substring(marked, F.col("at"), F.char_length("other")) != F.col("other"))
    ordered = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    pairs = asked.join(index, keys).where(ordered & once & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "n_a", "b", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """`word` and `root` of the words that have a form, by doubling the way followed in each round."""
    state = write_shared(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = state.join(onward, "root", "left")
        ahead = write_shared(ahead.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        state = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return state


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns `word`, `form`, `root`, `n`, `n_near` and `form_n`, one row per distinct word.

    Words are the runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z
    lower-cased, after `typo`, of at least five code points that occur at least
    three times. `form` is the near word of largest `n`, if that is at least
    twice the word's own, else null; of equal ones the first in code-point
    order. `root` follows forms to the last and is the word itself without one;
    numbers at least double on the way, so it ends. Null texts have no words, a
    null id counts as empty. Repeated rows count again. Very long texts are
    taken whole, and a long word is a word. Other columns are not read. An
    empty table gives no rows.
    """
    words = write_shared(count_words(docs, doc_id, text), "words")
    pairs = write_shared(near_words(words), "near")
    near = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("word")).alias("other"))
    near = near.union(pairs.select("b", F.struct(-F.col("n_a"), "a")))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    has_form = -F.col("best.n") >= 2 * F.col("n")
    rows = words.join(best, "word", "left").select(
        "word", F.when(has_form, F.col("best.word")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(has_form, -F.col("best.n")).alias("form_n"),
    )
    rows = write_shared(rows, "variants")
    roots = _roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
