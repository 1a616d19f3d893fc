"""Secret scan in DataFrame functions only.

Three base kinds are regular expressions. The method adds a fourth: over candidate strings of key-like characters a
window of WINDOW characters slides one character at a time; the counts of the characters in it (a string with a place
for each character, so that an update copies 80 bytes) are updated by the one that enters and the one that leaves, and with them the sum of c * log2(c) (in millionths, so that it stays exact), from
which the window's Shannon entropy follows: log2(WINDOW) - sum / WINDOW. A candidate's character class sets the least
entropy of a secret. The span reaches from the first such window to the end of the last. Candidates that an allow-list
pattern matches, or that touch a base span, add none. Letters of one case are told from words by entropy alone, so that
only a part of such keys is found.

Null counts as empty; texts without a match have empty span lists; extra columns are kept, but base and spans replaced.
All steps are linear in a text's length, or n^1.5 in its number of matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill.llm._common import fresh

#: Base kinds in their order: pattern, and what a match needs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings (their characters are ASCII from 43, a plus, to 122, a z) and the window.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Character classes, the first that fits holds: pattern and least entropy in bits (of at most log2(20) = 4.32).
#: Digits only are of the kind hex already. Without a digit, upper and lower case that change faster than in names are
#: judged as keys; the rest may be words, slugs or paths and needs more.
CLASSES = ((r"^[0-9A-Fa-f]+$", 3.0), (r"^[A-Za-z]*[0-9][A-Za-z0-9]*$", 3.7), (r"[0-9]", 3.6), (r"[a-z][A-Z]{2}[a-z]|[a-z][A-Z][a-z][A-Z]", 3.6), (r"", 4.1))
#: Candidates that match one of these as a whole are known not to be secrets: placeholders, alphabets, UUIDs. No group
#: may repeat without a bound: java.util.regex recurses for each turn.
ALLOWED = (
    r"(?i)^(?:(?:your|my|the|example|sample|placeholder|changeme|insert|api|access|secret|private|client|auth|key|token|password|value|id|goes|here)[_/=+-]?){1,24}$",
    r"(?i)^(?:(?:abcdefghij(?:klmnopqrstuvwxyz)?|0123456789|1234567890)[+/_=-]{0,2}){1,9}$",
    r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
)


def _scaled(count: int) -> int:
    return round(count * math.log2(count) * 1e6) if count > 1 else 0


#: Matches that one step of a running sum or maximum handles.
_STEP = 512
_INTS = "cast(array() as array<int>)"


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """function of value, which is computed once."""
    return F.transform(F.array(value), function)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums, or maxima, of an array of positive ints: of each part first, as appending to one long array copies it each time."""

    def part(p: Column) -> Column:
        step = lambda s, v: F.struct(join(s["at"], v).alias("at"), F.array_append(s["out"], join(s["at"], v)).alias("out"))
        return F.aggregate(p, F.struct(F.lit(0).alias("at"), F.expr(_INTS).alias("out")), step)

    def all_(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _STEP).cast("int")), lambda i: part(F.slice(v, i * _STEP + 1, F.lit(_STEP))))
        step = lambda s, p: F.struct(join(s["at"], p["at"]).alias("at"), F.array_append(s["out"], F.transform(p["out"], lambda x: join(s["at"], x))).alias("out"))
        return F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("out")), step, lambda s: s["out"]))

    return F.when(F.size(values) > 0, bound(values, all_)).otherwise(F.expr(_INTS))


def sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def maxima(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b))


def _positions(text: Column, pattern: str, matches: Column) -> Column:
    """Code point at which each match starts."""
    both = F.slice(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match")), F.lit(1), F.size(matches))
    ends = sums(F.transform(both, lambda b: F.length(b["gap"]) + F.length(b["match"])))
    starts = F.transform(F.arrays_zip(ends.alias("end"), matches.alias("match")), lambda e: e["end"] - F.length(e["match"]))
    return F.when(F.size(matches) > 0, starts).otherwise(F.expr(_INTS))


def high_entropy(candidate: Column) -> Column:
    """First and last start of windows whose entropy reaches what the candidate's class asks; null ones if there are none."""
    codes, pad = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - 42), F.array_repeat(F.lit(None).cast("int"), WINDOW)
    # each character with the one that leaves; split and limit are outside of the step, which would take them anew each time
    moves = bound(codes, lambda c: F.slice(F.arrays_zip(c.alias("enters"), F.concat(pad, c).alias("leaves")), F.lit(1), F.length(candidate)))
    grows = F.array(*(F.lit(_scaled(c) - _scaled(c - 1)) for c in range(WINDOW + 1)))
    most = F.lit(-1)
    for pattern, least in reversed(CLASSES):
        most = F.when(candidate.rlike(pattern), F.lit(round(WINDOW * (math.log2(WINDOW) - least) * 1e6))).otherwise(most)
    count = lambda counts, place: F.ascii(F.substring(counts, place, F.lit(1))) - 65

    def seen(s: Column) -> list[Column]:
        """first and last, with the window that the state is at."""
        at, high = s["i"] - WINDOW, (s["i"] >= WINDOW) & (s["sum"] <= s["most"])
        return [F.coalesce(s["first"], F.when(high, at)).alias("first"), F.when(high, at).otherwise(s["last"]).alias("last")]

    def step(s: Column, move: Column) -> Column:
        enters, leaves = move["enters"], move["leaves"]
        gone = count(s["counts"], leaves)
        come = count(s["counts"], enters) - F.coalesce((enters == leaves).cast("int"), F.lit(0))
        less = F.when(leaves.isNull(), s["counts"]).otherwise(F.overlay(s["counts"], F.chr(64 + gone), leaves, F.lit(1)))
        return F.struct(
            (s["i"] + 1).alias("i"),
            s["most"].alias("most"),
            F.overlay(less, F.chr(66 + come), enters, F.lit(1)).alias("counts"),
            (s["sum"] - F.coalesce(F.get(grows, gone), F.lit(0)) + F.get(grows, come + 1)).alias("sum"),
            *seen(s),
        )

    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("i"), most.alias("most"), F.lit("A" * 80).alias("counts"), F.lit(0).alias("sum"), none.alias("first"), none.alias("last"))
    return F.aggregate(moves, start, step, lambda s: F.struct(*seen(s)))


def _apart(new: Column, base: Column) -> Column:
    """Those of new spans that no base span overlaps; both are sorted."""
    row = lambda s, is_new: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(is_new).alias("new"))
    both = F.sort_array(F.concat(F.transform(base, lambda s: row(s, False)), F.transform(new, lambda s: row(s, True))))
    far = 1 << 30

    def kept(rows: Column) -> Column:
        reach = maxima(F.transform(rows, lambda r: F.when(r["new"], 0).otherwise(r["end"])))
        ahead = F.reverse(maxima(F.reverse(F.transform(rows, lambda r: F.when(r["new"], 0).otherwise(far - r["start"])))))
        good = F.filter(F.arrays_zip(rows.alias("r"), reach.alias("reach"), ahead.alias("ahead")), lambda z: z["r"]["new"] & (z["reach"] <= z["r"]["start"]) & (far - z["ahead"] >= z["r"]["end"]))
        return F.transform(good, lambda z: F.struct(z["r"]["start"].alias("start"), z["r"]["kind"].alias("kind"), z["r"]["end"].alias("end")))

    return F.when((F.size(new) > 0) & (F.size(base) > 0), bound(both, kept)).otherwise(new)


def find_secrets(documents: DataFrame) -> DataFrame:
    """documents with base and spans: arrays of (start, kind number, end) in code points, sorted."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = fresh(documents, "text_", "assign", "value", "access", "hex", "cand", "assign_at", "access_at", "hex_at", "cand_at", "high")
    text_, assign, value, access, hex_, cand, *places, high = names
    with_matches = documents.withColumns({
        text_: text,
        assign: F.regexp_extract_all(text, F.lit(ASSIGN), 0),
        value: F.regexp_extract_all(text, F.lit(ASSIGN), 2),
        access: F.regexp_extract_all(text, F.lit(ACCESS), 0),
        hex_: F.regexp_extract_all(text, F.lit(HEX), 0),
        cand: F.regexp_extract_all(text, F.lit(CANDIDATE), 0),
    })
    placed = with_matches.withColumns({at: _positions(F.col(text_), p, F.col(c)) for at, c, p in zip(places, (assign, access, hex_, cand), (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True)})
    spans = lambda m, at, kind, keep: F.transform(F.filter(F.arrays_zip(F.col(m).alias("m"), F.col(at).alias("at"), F.col(value).alias("v")), keep), lambda z: F.struct(z["at"].alias("start"), F.lit(kind).alias("kind"), (z["at"] + F.length(z["m"])).alias("end")))
    base = F.concat(
        spans(assign, places[0], 0, lambda z: F.length(z["v"]) >= ASSIGN_LEAST),
        spans(access, places[1], 1, lambda z: F.length(z["m"]) >= ACCESS_LEAST),
        spans(hex_, places[2], 2, lambda z: z["m"].isNotNull()),
    )
    allowed = lambda m: F.exists(F.array(*map(F.lit, ALLOWED)), lambda p: F.regexp_like(m, p))
    found = F.transform(
        F.filter(F.arrays_zip(F.col(cand).alias("text"), F.col(places[3]).alias("at")), lambda c: ~allowed(c["text"])),
        lambda c: bound(high_entropy(c["text"]), lambda h: F.struct((c["at"] + h["first"]).alias("start"), F.lit(3).alias("kind"), (c["at"] + h["last"] + WINDOW).alias("end"))),
    )
    based = placed.withColumns({"base": F.sort_array(base), high: F.filter(found, lambda s: s["start"].isNotNull())})
    return based.withColumn("spans", F.sort_array(F.concat("base", _apart(F.col(high), F.col("base"))))).drop(*names)


def as_text(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """find_secrets' rows with every span of the text replaced by mark; spans that overlap or touch are replaced as one."""

    def cut(reach: Column) -> Column:
        rows = F.transform("spans", lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(reach, i - 1), F.lit(-1)).alias("before")))
        # a span that starts beyond what came before it ends one hole and begins another
        holes = F.filter(rows, lambda r: r["start"] > r["before"])
        starts = F.concat(F.transform(holes, lambda r: r["start"]), F.array(F.length("text")))
        stops = F.concat(F.array(F.lit(0)), F.filter(F.transform(holes, lambda r: r["before"]), lambda x: x >= 0), F.array(F.element_at(reach, -1)))
        return bound(F.split("text", ""), lambda chars: F.array_join(F.transform(F.arrays_zip(stops.alias("a"), starts.alias("b")), lambda z: F.array_join(F.slice(chars, z["a"] + 1, z["b"] - z["a"]), "")), mark))

    cleaned = bound(maxima(F.transform("spans", lambda s: s["end"])), cut)
    return found.withColumn("text", F.when(F.size("spans") > 0, cleaned).otherwise(F.col("text")))
