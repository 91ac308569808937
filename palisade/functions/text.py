"""Column functions that the scanners share: spans, hashes, checksums, rewriting.

Positions are counted in code points inside expressions and given out in UTF-16
units (``utf16``). ``let`` binds a value once, so that an expression that uses it
several times doesn't compute it several times.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

FINDING = "struct<type:string,start:int,end:int,match:string,confidence:double>"
TOKEN = "struct<token:string,original:string>"
RESULT = f"struct<scanner:string,passed:boolean,score:double,text:string,findings:array<{FINDING}>,reason:string,redaction:array<{TOKEN}>>"
#: Spans sort by start, then the longer first, then catalogue order.
SPAN = "struct<start:int,neg:int,ord:int,type:string,end:int,match:string,confidence:double>"
_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def texts(values) -> Column:
    """A constant array of texts. One literal: building plans costs driver time for every call."""
    values = list(values)
    if not values:
        return empty("string")
    apart = next(c for c in map(chr, range(0xE000, 0xF8FF)) if not any(c in v for v in values))
    return F.split(F.lit(apart.join(values)), apart, -1)


def spans(t: Column, regex: Column, type_: Column, confidence: Column, order: Column, match: bool = True) -> Column:
    """All matches of a Java pattern, as ``array<SPAN>``, in text order.

    The pieces between the matches give the positions; texts without a match are
    gone over once.
    """

    def build(m: Column) -> Column:
        return F.when(F.size(m) > 0, let(F.split(t, regex, -1), lambda p: placed(p, m))).otherwise(empty(SPAN))

    def placed(p: Column, all_: Column) -> Column:
        def add(acc: Column, m: Column) -> Column:
            start = acc["pos"] + F.length(F.get(p, acc["i"]))
            end = start + F.length(m)
            hit = F.struct(
                start.alias("start"), (-F.length(m)).alias("neg"), order.alias("ord"), type_.alias("type"), end.alias("end"),
                (m if match else F.lit(None).cast("string")).alias("match"), confidence.alias("confidence"),
            )
            return F.struct(end.alias("pos"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(hit)).alias("out"))

        zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("i"), empty(SPAN).alias("out"))
        return F.aggregate(all_, zero, add, lambda acc: acc["out"])

    return F.coalesce(let(F.regexp_extract_all(t, regex, 0), build), empty(SPAN))


class Pattern(NamedTuple):
    """A Java pattern and what its spans bear."""

    regex: str
    type: str
    confidence: float = 1.0


def spans_of(t: Column, patterns: list[Pattern], fired: Column | None = None, match: bool = True) -> Column:
    """The spans of several patterns, pattern by pattern; ``fired``: the numbers of
    those to try. The patterns are data, so the plan doesn't grow with them."""
    regex, types = texts(p.regex for p in patterns), texts(p.type for p in patterns)
    weights = {p.confidence for p in patterns}
    one = F.lit(float(weights.pop())) if len(weights) == 1 else None
    confidence = F.from_json(F.lit(json.dumps([float(p.confidence) for p in patterns])), "array<double>")

    def found(k: Column) -> Column:
        return let(F.get(regex, k), lambda r: spans(t, r, F.get(types, k), F.get(confidence, k) if one is None else one, k, match))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(patterns) - 1)) if fired is None else fired, found))


def fired(gates: list[Column | None]) -> Column:
    """The numbers of the gates that are open; None: always."""
    return F.array_compact(F.array(*[F.lit(k) if g is None else F.when(g, F.lit(k)) for k, g in enumerate(gates)]))


def literals_fired(low: Column, gates: list[tuple[tuple[str, ...], ...]]) -> Column:
    """The numbers of the gates whose literals a (lower-case) text has: one of each group."""
    data = F.from_json(F.lit(json.dumps(gates)), "array<array<array<string>>>")
    has = lambda k: F.forall(F.get(data, k), lambda group: F.exists(group, lambda x: F.contains(low, x)))
    return F.filter(F.sequence(F.lit(0), F.lit(len(gates) - 1)), lambda k: F.coalesce(has(k), F.lit(False)))


def replaced(t: Column, regex: Column, token: Callable[[Column], Column]) -> Column:
    """``t`` with each match of a Java pattern replaced by ``token(match)``."""

    def build(x: Column) -> Column:
        pieces = F.transform(x["p"], lambda p, i: F.concat(p, F.when(i < F.size(x["m"]), token(F.get(x["m"], i))).otherwise(F.lit(""))))
        return F.array_join(pieces, "")

    found = F.struct(F.split(t, regex, -1).alias("p"), F.regexp_extract_all(t, regex, 0).alias("m"))
    return F.when(F.rlike(t, regex), let(found, build)).otherwise(t)


def rewritten(t: Column, patterns: Column, token: str | Callable[[Column], Column]) -> Column:
    """One pattern of an array after the other, each over what the one before has
    made; a fold, so that the plan doesn't grow with the number of patterns."""
    if isinstance(token, str):
        return F.aggregate(patterns, t, lambda acc, p: F.regexp_replace(acc, p, F.lit(token)))
    return F.aggregate(patterns, t, lambda acc, p: replaced(acc, p, token))


def fnv1a32(t: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as bigint."""
    units = F.hex(F.encode(t, "UTF-16BE"))

    def unit(h: Column, i: Column) -> Column:
        return F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")

    def hashed(h: Column) -> Column:
        # sequence() counts down from 0 to -1, so the empty text is set apart
        us = F.transform(F.sequence(F.lit(0), (F.length(h) / 4).cast("int") - 1), lambda i: unit(h, i))
        return F.when(h == "", F.lit(2166136261).cast("bigint")).otherwise(F.aggregate(us, F.lit(2166136261).cast("bigint"), lambda a, u: a.bitwiseXOR(u) * F.lit(16777619).cast("bigint") % F.lit(4294967296).cast("bigint")))

    return let(units, hashed)


def hash_digits(t: Column) -> Column:
    """The low 24 bits as six hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fnv1a32(t) % F.lit(16777216).cast("bigint"))), 6, "0")


def digit_skeleton(t: Column) -> Column:
    """The runs of digits of a text, with an x for each run of anything else:
    short for prose, so that what a pattern needs of digits is tested on little."""
    return F.regexp_replace(t, "[^0-9]+", "x")


def luhn_ok(match: Column, least: Column) -> Column:
    def valid(d: Column) -> Column:
        def worth(c: Column, i: Column) -> Column:
            n = c.cast("int")
            twice = n * 2
            return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(n)

        total = F.aggregate(F.transform(F.split(F.reverse(d), ""), worth), F.lit(0), lambda a, n: a + n)
        return (F.length(d) >= least) & (total % 10 == 0)

    return let(F.regexp_replace(match, "[^0-9]", ""), valid)


def resolved(found: Column) -> Column:
    """Greedy: in order of start, then length; a span stays if it begins where no
    span that stayed reaches."""

    def keep(acc: Column, s: Column) -> Column:
        ok = s["start"] >= acc["to"]
        return F.struct(F.when(ok, s["end"]).otherwise(acc["to"]).alias("to"), F.when(ok, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("to"), empty(SPAN).alias("out"))
    return let(found, lambda a: F.when(F.size(a) < 2, a).otherwise(F.aggregate(F.array_sort(a), zero, keep, lambda acc: acc["out"])))


def spliced(t: Column, found: Column, tokens: Column) -> Column:
    """``t`` with each (disjoint, sorted) span replaced by its token."""

    def add(acc: Column, i: Column) -> Column:
        s = F.get(found, i)
        return F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.substring(t, acc["pos"] + 1, s["start"] - acc["pos"]), F.get(tokens, i)).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    whole = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, add, lambda acc: F.concat(acc["out"], F.substring(t, acc["pos"] + 1, F.length(t))))
    return F.when(F.size(found) == 0, t).otherwise(whole)


def utf16(t: Column, found: Column) -> Column:
    """Findings with positions in UTF-16 units, from spans in code points."""

    def units(at: Column) -> Column:
        return at + F.regexp_count(F.substring(t, F.lit(1), at), F.lit(_ASTRAL))

    def plain(s: Column, start: Column, end: Column) -> Column:
        return F.struct(s["type"].alias("type"), start.alias("start"), end.alias("end"), s["match"].alias("match"), s["confidence"].alias("confidence"))

    astral = F.transform(found, lambda s: plain(s, units(s["start"]), units(s["end"])))
    return F.when(F.rlike(t, F.lit(_ASTRAL)), astral).otherwise(F.transform(found, lambda s: plain(s, s["start"], s["end"])))


def rehydrated(t: Column, redaction: Column) -> Column:
    """Tokens back to what they stand for: one literal replacement after another."""
    return F.aggregate(F.coalesce(redaction, empty(TOKEN)), t, lambda acc, r: F.replace(acc, r["token"], r["original"]))


def merged(first: Column, second: Column) -> Column:
    """Two redaction lists as one map in insertion order: a later value of a
    token counts, at the place of the first."""

    def once(all_: Column) -> Column:
        names = F.array_distinct(F.transform(all_, lambda r: r["token"]))
        return F.transform(names, lambda n: F.struct(n.alias("token"), F.element_at(F.filter(all_, lambda r: r["token"] == n), -1)["original"].alias("original")))

    return let(F.concat(first, second), once)


def result(scanner: str, passed, score, text: Column, findings: Column, reason, redaction: Column | None = None) -> Column:
    def col(x, kind):
        return x.cast(kind) if isinstance(x, Column) else F.lit(x).cast(kind)

    return F.struct(
        F.lit(scanner).alias("scanner"),
        col(passed, "boolean").alias("passed"),
        col(score, "double").alias("score"),
        text.alias("text"),
        findings.cast(f"array<{FINDING}>").alias("findings"),
        col(reason, "string").alias("reason"),
        (empty(TOKEN) if redaction is None else redaction.cast(f"array<{TOKEN}>")).alias("redaction"),
    ).cast(RESULT)


def clean(scanner: str, text: Column) -> Column:
    return result(scanner, True, 0.0, text, empty(FINDING), None)
