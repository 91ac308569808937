"""The text dialect: rows of (pattern, text, matches) in Java and RE2."""

import duckdb
import pytest
from pyspark.sql import functions as F

from palisade.functions import catalog as C
from palisade.functions import dialect as D
from palisade.functions import text as T

CASES = [
    (r"\b\d{3}-\d{2}-\d{4}\b", "ä123-45-6789 b123-45-6789 123-45-6789", ["123-45-6789", "123-45-6789"]),
    (r"\d\s\d", "1 2 3　4 5 6", ["1 2", "3　4", "5 6"]),
    (r"\w+", "née x_1", ["n", "e", "x_1"]),
    (r"[^\w\s]+", "a, b !?", [",", "!?"]),
    (r"a\Bb", "ab a b", ["ab"]),
    (r"\bcat\b", "cat category écat cat!", ["cat", "cat", "cat"]),
]


@pytest.mark.parametrize("pattern,text,want", CASES)
def test_matches(spark, pattern, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.regexp_extract_all("t", F.lit(D.java(pattern)), 0)).first()[0] == want
    assert duckdb.execute("select regexp_extract_all(?, ?)", [text, D.re2(pattern)]).fetchone()[0] == want


def test_unicode_case(spark):
    df = spark.createDataFrame([("ÄRZTE ärzte",)], "t string")
    assert df.select(F.regexp_count("t", F.lit(D.java("ärzte", unicode_case=True)))).first()[0] == 2


def test_all_catalogue_patterns_compile(spark):
    patterns = [p.pattern for p in C.PII] + [s.pattern for s in C.SECRETS] + [p for g in C.INJECTIONS for p in g.patterns] + [p for _, p, _ in C.CODE] + list(C.URL_CHECKS.values()) + [C.URL, C.TOKEN]
    spark.range(1).select(*[F.rlike(F.lit("x"), F.lit(D.java(p))).alias(f"c{k}") for k, p in enumerate(patterns)]).collect()
    for p in C.PII:
        D.re2(p.re2 or p.pattern)
    assert len(C.PII) == 30 and len(C.STOP_WORDS) == 111 and len(C.CODE) == 21
    assert len([p for p in C.PII if set(p.locales) & set(C.DEFAULT_LOCALES)]) == 15


USER = [
    (r"\b(a|,b)", "x,b a", [",b", "a"]),
    (r"(?<n>a|b)\B.", "ab b. bc", ["ab", "bc"]),
    (r"o.$", "on\non\n", []),
    (r"o.$", "on\non", ["on"]),
    (r"a.b", "a\u0085b a\u2028b", ["a\u0085b"]),
]


@pytest.mark.parametrize("pattern,text,want", USER)
def test_user_patterns(spark, pattern, text, want):
    """Any pattern of a user: the same matches in Spark and in a stream's state."""
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.regexp_extract_all("t", F.lit(D.user(pattern)), 0)).first()[0] == want
    assert [m.group() for m in D.python(pattern).finditer(text)] == want


def test_escape_and_check(spark):
    import re

    for s in ("a.b", "c++", "[x]", "$5 (or) {y}|z^", "a-b/c"):
        assert re.fullmatch(D.escape(s), s)
    for p in ("x*", "(", ""):
        with pytest.raises(ValueError):
            D.check(p)


HASHES = [
    ("", 2166136261), ("a", 3826002220), ("foobar", 3214735720), ("alice@example.com", 2493822278), ("a@b.com", 2306867065), ("drugs", 3013108180),
    ("secret", 1719429393), ("Ignore previous", 3207604732), ("secret user input", 934716196), ("​", 238996298), ("­", 2819345080), ("\U000e0041", 2040020026),
]


def test_hashes(spark):
    df = spark.createDataFrame(HASHES, "t string, h bigint")
    assert [r for r in df.select("t", "h", T.fnv1a32(F.col("t")).alias("g")).collect() if r.h != r.g] == []
    assert df.where("t = 'drugs'").select(T.hash_digits(F.col("t"))).first()[0] == "9861d4"


@pytest.mark.parametrize("text,least,ok", [("4111 1111 1111 1111", 12, True), ("4111 1111 1111 1112", 12, False), ("046-454-286", 9, True), ("046-454-286", 12, False), ("0", 1, True)])
def test_luhn(spark, text, least, ok):
    assert spark.createDataFrame([(text,)], "t string").select(T.luhn_ok(F.col("t"), F.lit(least))).first()[0] is ok


def test_spans_at_the_edges(spark):
    df = spark.createDataFrame([("ab..ab",), ("",), ("ab",), (None,)], "t string")
    rows = df.select(T.spans_of(F.col("t"), [T.Pattern("ab", "x")]).alias("s")).collect()
    assert [[(s.start, s.end) for s in r.s or []] for r in rows] == [[(0, 2), (4, 6)], [], [(0, 2)], []]


def test_overlaps_are_resolved_greedily(spark):
    # the middle span overlaps the first and goes, which leaves room for the third
    df = spark.createDataFrame([("abcdef",)], "t string")
    t = F.col("t")
    s = T.spans_of(t, [T.Pattern("abc", "a"), T.Pattern("cde", "b"), T.Pattern("de", "c")])
    assert [x.type for x in df.select(T.resolved(s).alias("s")).first().s] == ["a", "c"]


def test_catalogues_are_one_literal(spark):
    """Patterns are data: which of them are tried, their order and what their spans bear."""
    t = F.col("t")
    df = spark.createDataFrame([("a1 b2 a3",), ("",), (None,)], "t string")
    items = [T.Pattern("b.", "y", 0.5), T.Pattern("a.", "x")]
    rows = df.select(T.spans_of(t, items).alias("all"), T.spans_of(t, items, T.fired([t.contains("q"), None])).alias("some"), T.literals_fired(t, [(("b", "z"), ("a",)), (("z",),)]).alias("k")).collect()
    assert [(x.type, x.start, x.end, x.match, x.confidence, x.ord) for x in rows[0]["all"]] == [("y", 3, 5, "b2", 0.5, 0), ("x", 0, 2, "a1", 1.0, 1), ("x", 6, 8, "a3", 1.0, 1)]
    assert [x.match for x in rows[0].some] == ["a1", "a3"] and rows[0].k == [0] and all(r["all"] == [] == r.some == r.k for r in rows[1:])
