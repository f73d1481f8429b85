"""Secrets in texts: fixed patterns, and strings of high entropy in sliding windows.

Only built-in expressions are used, so a text never leaves the JVM and no row
is shuffled. A regular expression gives the matches and, split at it, the texts
between them; their lengths give the positions. Positions are code points.
Sums and maxima along the matches of a text are made in blocks, so the time is
in proportion to the matches.

An entropy candidate is a longest run of token characters with a letter and a
digit. A window of `WINDOW` characters slides over it with the counts of its
characters, five bits each: a step changes two counts and the sum of
c * log2(c), from which the entropy follows. Windows above the bound of the
candidate's class join into spans. A class is an alphabet, and its bound lies
`SPREAD` standard deviations below the mean entropy of windows drawn evenly
from it. A candidate that the allow-list knows to be harmless adds none, nor
does a span that overlaps one of a pattern.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.llm.common import let

# The patterns, and the least length of the match or its second group.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Access and hex matches are longest runs to the right, so asking for the least
# length in the pattern finds the same ones as dropping the short ones after.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
PATTERNS = [("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32)]
KINDS = ["assign", "access", "hex", "entropy"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
SPREAD = 2.5
#: Pattern and number of letters of each class of candidates; the first that fits holds, the last fits all.
CLASSES = [("^[0-9A-Fa-f]+$", 16), ("^[0-9a-z]+$", 36), ("^[0-9A-Z]+$", 36), ("", 64)]

# Strings that look random and are no secrets. In this order:
# UUIDs, integrity digests of lock files, placeholders, alphabets in order,
# paths of words and numbers, dates and version chains.
ALLOWED = [
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)^sha(1|224|256|384|512)[-_=]",
    r"(?i)example|placeholder|changeme|your[-_]?(key|token|secret)|xxxx",
    r"(?i)abcdefgh|0123456789|9876543210",
    r"^/?([A-Za-z]+|[0-9]{1,8})([/_=-]+([A-Za-z]+|[0-9]{1,8}))+/?$",
]

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SPAN = "array<struct<start:int,kind:int,end:int>>"
MASK = "[SECRET]"
#: Elements that a running sum goes through at a time.
_BLOCK = 64
_COUNT_BITS, _COUNTS_A_LONG = 5, 12


def least_bits(letters: int) -> float:
    """Bits a character above which a window counts as random, for candidates of an alphabet of so many letters."""
    n, p = WINDOW, 1 / letters
    weight = [c * math.log2(c) if c else 0.0 for c in range(n + 1)]
    chance = [math.comb(n, c) * p**c * (1 - p) ** (n - c) for c in range(n + 1)]
    both = sum(
        math.comb(n, a) * math.comb(n - a, b) * p ** (a + b) * (1 - 2 * p) ** (n - a - b) * weight[a] * weight[b]
        for a in range(n + 1)
        for b in range(n + 1 - a)
    )
    mean = letters * sum(q * w for q, w in zip(chance, weight))
    square = letters * sum(q * w * w for q, w in zip(chance, weight)) + letters * (letters - 1) * both
    return math.log2(n) - (mean + SPREAD * math.sqrt(square - mean**2)) / n


def _no_spans() -> Column:
    return F.array().cast(_SPAN)


def _running(values: Column, join) -> Column:
    """`join`, of two integers, of each element with all before it; 0 leaves the other as it is."""

    def scan(items: Column, before: Column) -> Column:
        return F.aggregate(items, F.array(before), lambda done, x: F.concat(done, F.array(join(F.element_at(done, -1), x))))

    def in_blocks(items: Column) -> Column:
        last = F.floor((F.size(items) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * _BLOCK + 1, _BLOCK))

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), join))
        return let(
            scan(totals, F.lit(0)),
            lambda before: F.flatten(F.transform(blocks, lambda b, k: F.slice(scan(b, before[k]), 2, _BLOCK))),
        )

    return let(
        values,
        lambda items: F.when(F.size(items) > 0, let(in_blocks(items), joined)).otherwise(F.array().cast("array<int>")),
    )


def _located(text: Column, pattern: str) -> Column:
    """All matches as an array of (start, match), empty where there is none."""
    kind = "array<struct<start:int,match:string>>"

    def placed(matches: Column) -> Column:
        # before each match lies one of the texts that the pattern splits off
        lengths = let(
            F.transform(F.split(text, pattern, -1), F.length),
            lambda between: F.transform(matches, lambda m, i: F.length(m) + between[i]),
        )
        return let(
            _running(lengths, lambda a, b: a + b),
            lambda ends: F.transform(matches, lambda m, i: F.struct((ends[i] - F.length(m)).alias("start"), m.alias("match"))),
        ).cast(kind)

    located = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(text.rlike(pattern), located).otherwise(F.array().cast(kind))


def _pattern_spans(text: Column, kind: int) -> Column:
    _, pattern, group, least = PATTERNS[kind]
    long_enough = F.filter(
        _located(text, pattern), lambda m: F.length(F.regexp_extract(m["match"], pattern, group) if group else m["match"]) >= least
    )
    return F.transform(long_enough, lambda m: _span(m["start"], kind, m["start"] + F.length(m["match"])))


def _span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


def _weight(count: Column) -> Column:
    """c * log2(c) of a count within a window."""
    return F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])[count]


def _random_runs(token: Column) -> Column:
    """Runs (start, end) of random windows in a candidate, from 0."""
    codes = F.transform(F.split(token, "", -1), lambda ch: F.instr(F.lit(_ALPHABET), ch) - 1)
    # the sum of c * log2(c) below which a window is random
    limits = [(pattern, WINDOW * (math.log2(WINDOW) - least_bits(letters))) for pattern, letters in CLASSES]
    most = F.lit(limits[-1][1])
    for pattern, limit in reversed(limits[:-1]):
        most = F.when(token.rlike(pattern), F.lit(limit)).otherwise(most)
    return let(codes, lambda found: let(most, lambda limit: _runs_of_codes(token, found, limit)))


def _runs_of_codes(token: Column, codes: Column, most: Column) -> Column:
    kind = "array<struct<start:int,end:int>>"
    longs = -(-len(_ALPHABET) // _COUNTS_A_LONG)

    def shift(code: Column) -> Column:
        return (code % _COUNTS_A_LONG) * _COUNT_BITS

    def count_of(counts: Column, code: Column) -> Column:
        packed = counts[F.floor(code / _COUNTS_A_LONG).cast("int")]
        return F.call_function("shiftright", packed, shift(code)).bitwiseAND((1 << _COUNT_BITS) - 1).cast("int")

    def one_at(code: Column, k: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift(code))
        return F.when(F.floor(code / _COUNTS_A_LONG) == k, one).otherwise(F.lit(0).cast("bigint"))

    def add(state: Column, code: Column) -> Column:
        before = count_of(state["counts"], code)
        return F.struct(
            F.transform(state["counts"], lambda c, k: c + one_at(code, k)).alias("counts"),
            (state["total"] - _weight(before) + _weight(before + 1)).alias("total"),
        )

    empty = F.struct(F.array_repeat(F.lit(0).cast("bigint"), longs).alias("counts"), F.lit(0.0).alias("total"))
    run = F.array(F.struct(F.lit(0).alias("start"), F.lit(WINDOW).alias("end")))
    begin = let(
        F.aggregate(F.slice(codes, 1, WINDOW), empty, add),
        lambda first: F.struct(
            first["counts"].alias("counts"), first["total"].alias("total"),
            F.when(first["total"] < most, run).otherwise(F.array()).cast(kind).alias("runs"),
        ),
    )

    def step(state: Column, move: Column) -> Column:
        gone, new, end = move["gone"], move["new"], move["end"]
        fewer, more = count_of(state["counts"], gone), count_of(state["counts"], new)
        total = F.when(gone == new, state["total"]).otherwise(
            state["total"] - _weight(fewer) + _weight(fewer - 1) - _weight(more) + _weight(more + 1)
        )
        counts = F.when(gone == new, state["counts"]).otherwise(
            F.transform(state["counts"], lambda c, k: c - one_at(gone, k) + one_at(new, k))
        )
        runs, last = state["runs"], F.element_at(state["runs"], -1)
        joins = (F.size(runs) > 0) & (last["end"] >= end - WINDOW)
        longer = F.concat(
            F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), end.alias("end"))),
        )
        further = F.concat(runs, F.array(F.struct((end - WINDOW).alias("start"), end.alias("end"))))
        return F.struct(
            counts.alias("counts"), total.alias("total"),
            F.when(total >= most, runs).when(joins, longer).otherwise(further).cast(kind).alias("runs"),
        )

    n = F.length(token)
    ends = F.when(n > WINDOW, F.sequence(F.lit(WINDOW + 1), n)).otherwise(F.array().cast("array<int>"))
    moves = F.transform(
        ends, lambda e: F.struct(codes[e - 1 - WINDOW].alias("gone"), codes[e - 1].alias("new"), e.alias("end"))
    )
    return F.aggregate(moves, begin, step, lambda s: s["runs"])


def _entropy_spans(text: Column, known: Column) -> Column:
    allowed = "|".join(f"(?:{p})" for p in ALLOWED)
    candidates = F.filter(
        _located(text, CANDIDATE),
        lambda c: c["match"].rlike("[0-9]")
        & c["match"].rlike("[A-Za-z]")
        & ~c["match"].rlike(allowed),
    )
    spans = F.flatten(
        F.transform(
            candidates,
            lambda c: F.transform(
                _random_runs(c["match"]), lambda r: _span(c["start"] + r["start"], len(PATTERNS), c["start"] + r["end"])
            ),
        )
    )
    return let(
        F.coalesce(spans, _no_spans()),
        lambda found: F.when((F.size(found) == 0) | (F.size(known) == 0), found).otherwise(_apart_from(found, known)),
    )


def _apart_from(found: Column, known: Column) -> Column:
    """Spans of `found`, sorted and apart from each other, that overlap none of `known`."""
    # the farthest end of the known spans that start before each found one ends
    starts = F.transform(known, lambda k: F.struct(k["start"].alias("at"), F.lit(1).alias("known"), k["end"].alias("reach")))
    asked = F.transform(found, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("known"), F.lit(0).alias("reach")))

    def met(events: Column) -> Column:
        reach = _running(F.transform(events, lambda e: e["reach"]), lambda a, b: F.greatest(a, b))
        both = F.zip_with(events, reach, lambda e, r: F.struct(e["known"].alias("known"), r.alias("reach")))
        return F.filter(both, lambda e: e["known"] == 0)

    return let(
        let(F.sort_array(F.concat(starts, asked)), met),
        lambda reached: F.filter(found, lambda s, i: reached[i]["reach"] <= s["start"]),
    )


def with_spans(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`: all spans as (start, kind, end), sorted, kinds as numbers in `KINDS`."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(
        name, F.sort_array(F.concat(*[_pattern_spans(content, k) for k in range(len(PATTERNS))]))
    ).withColumn(
        name, F.sort_array(F.concat(F.col(name), F.coalesce(_entropy_spans(content, F.col(name)), _no_spans())))
    )


def _joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s["kind"]], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns `doc_id`, `n_assign`, `n_access`, `n_hex`, `base_sha256` and `spans`; one row per row of `docs`.

    `spans` lists kind:start:end of all spans by start, then kind; the end is
    exclusive. `base_sha256` is the digest of the same list without entropy
    spans. Null texts count as empty, very long ones are searched whole, in time
    in proportion to their length and matches. Null ids and repeated rows stay
    as they are, spans that begin together are listed by kind, an empty table
    gives no rows, other columns of `docs` are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = with_spans(rows, "text", "found")

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("found", lambda s: s["kind"] < len(PATTERNS))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(len(PATTERNS))],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def _united(spans: Column) -> Column:
    """Sorted spans as (start, end), overlapping ones as one."""

    def united(reach: Column) -> Column:
        last = F.size(spans) - 1
        starts = F.filter(spans, lambda s, i: (i == 0) | (s["start"] >= reach[F.greatest(i - 1, F.lit(0))]))
        ends = F.filter(reach, lambda r, i: (i == last) | (spans[F.least(i + 1, last)]["start"] >= r))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s["start"].alias("start"), e.alias("end")))

    return let(_running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), united)


def mask_secrets(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", mask: str = MASK) -> DataFrame:
    """`docs` with each span in `text` replaced by `mask`, overlapping ones by one.

    Where a text changes, `n_chars` becomes its new length if there is such a
    column. Other rows and columns stay as they are, nulls included.
    """
    name = "_spans"
    while name in docs.columns:
        name += "_"
    found = with_spans(docs, text, name)
    found = found.withColumn(name, let(F.col(name), _united))
    spans = F.col(name)
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(spans[k - 1]["end"])
    end = lambda k: F.when(k < F.size(spans), spans[k]["start"]).otherwise(F.length(text))
    rest = F.transform(
        F.sequence(F.lit(0), F.size(spans)), lambda k: F.substring(F.col(text), begin(k) + 1, end(k) - begin(k))
    )
    changed = F.size(spans) > 0
    found = found.withColumn(text, F.when(changed, F.array_join(rest, mask)).otherwise(F.col(text)))
    if n_chars in docs.columns:
        kind_of = docs.schema[n_chars].dataType
        found = found.withColumn(n_chars, F.when(changed, F.length(text).cast(kind_of)).otherwise(F.col(n_chars)))
    return found.select(*docs.columns)
