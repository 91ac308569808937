"""Line dedup: winnowing over line hashes, DataFrame functions only.

A text's lines are the pieces between line feeds, and each is hashed. A line is
deleted if it lies in a run of lines with ``MIN_WORDS`` words or more that stands
somewhere earlier too (smaller document id, then row, then line). Such a run can
be shortened from both ends, as long as it holds the line and has the words, to
the shortest run from its first line on or the shortest one up to its last line:
these are the windows.

Winnowing: of each window the smallest line hash is its fingerprint, so any two
copies of a run have the fingerprints of all windows in it in common, and
neighbouring windows mostly share theirs. Positions are joined by fingerprint: a
window whose fingerprint stands at one place only can't be repeated and goes. A
fingerprint alone doesn't tell which of its places are copies of each other (a
frequent short line is the smallest of many windows), so matches are extended both
ways to the whole window: its key is the hash of all its lines; for a blank line at
an edge, the hash of the run next to it and the distance. Of each key's places the
first stays and all others are deleted; windows that overlap or touch make up the
maximal runs. What is deleted stands somewhere earlier, so one copy of every line
always stays.

Work and shuffles grow with the number of lines: a run has at most ``MIN_WORDS``
lines that aren't blank, and a key with n places is joined to its first one n - 1
times, never place with place. The aggregations that find fingerprints with two
places and the first place of a key are combined in the map tasks, and joins on hot
keys are sort-merge joins that adaptive execution splits. Runs are told apart by 64
bits of hashes of lines, lines by 60.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import shared_dir, written

MIN_WORDS = 50
_BLANK = " \\t\\u000b\\u000c\\r"

#: Of line l: 60 bits of its hash, 0 for a blank line; and its words.
_HASH = f"if(trim(BOTH '{_BLANK}' FROM l) = '', 0L, cast(conv(substr(md5(l), 1, 15), 16, 10) as bigint))"
_WORDS = f"size(array_remove(split(translate(l, '{_BLANK[1:]}', '     '), ' '), ''))"


def _lines(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("r", "id", f"transform(split(t, '\\n'), l -> struct({_HASH} as h, {_WORDS} as n)) as a")


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """k, id, r, a, b, m: the keys of row r, each with the lines a to b it stands
    for, and the window's smallest line hash."""
    each = lines.selectExpr("r", "id", "size(a) as size", "posexplode(a) as (p, x)").selectExpr("r", "id", "size", "p", "x.h as h", "x.n as n").where("n > 0")
    by = Window.partitionBy("r").orderBy("p")
    each = each.select(
        "r", "id", "p", "h", "n",
        (F.col("p") - F.coalesce(F.lag("p").over(by), F.lit(-1)) - 1).alias("before"),
        (F.coalesce(F.lead("p").over(by), F.col("size")) - F.col("p") - 1).alias("after"),
        F.sum("n").over(by).alias("e"),
        F.sum("n").over(Window.partitionBy("r")).alias("total"),
    ).withColumn("c", F.col("e") - F.col("n"))
    line = F.struct("p", "h", "n")
    ahead = F.collect_list(line).over(Window.partitionBy("r").orderBy("c").rangeBetween(Window.currentRow, min_words - 1))
    behind = F.collect_list(line).over(Window.partitionBy("r").orderBy("e").rangeBetween(1 - min_words, Window.currentRow))
    each = each.where(f"total >= {min_words}").withColumn("f", ahead).withColumn("g", behind)
    key = "xxhash64(transform({0}, x -> struct(x.p - {0}[0].p as p, x.h as h)))"
    each = each.withColumn("kf", F.expr(f"if(total - c >= {min_words}, {key.format('f')}, null)")).withColumn("kg", F.expr(f"if(e >= {min_words}, {key.format('g')}, null)"))
    # a shortest run up to a line is mostly the shortest one from its first line as well, and then has its key already
    new = f"aggregate(g, 0, (s, x) -> s + x.n) - n >= {min_words}"
    low = "array_min(transform({0}, x -> x.h))"
    each = each.withColumn("mf", F.expr(low.format("f"))).withColumn("mg", F.expr(low.format("g")))
    found = f"""concat(
        if(kf is null, array(), array(struct(kf as k, p as a, f[size(f) - 1].p as b, mf as m))),
        if(kg is null or not {new}, array(), array(struct(kg as k, g[0].p as a, p as b, mg as m))),
        if(kf is null or before = 0, array(), transform(sequence(1, before), i -> struct(xxhash64(kf, -i) as k, p - i as a, p - i as b, mf as m))),
        if(kg is null or after = 0, array(), transform(sequence(1, after), i -> struct(xxhash64(kg, i) as k, p + i as a, p + i as b, mg as m))))"""
    return each.selectExpr("r", "id", f"inline({found})").select("k", "id", "r", "a", "b", "m")


def repeated_runs(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """r, runs (array of first and last line to delete) of the rows that have any."""
    places = written(windows(_lines(rows), min_words), shared_dir(rows.sparkSession, "line-windows"))
    # fingerprints with windows that differ in their place
    place = F.struct("r", "a", "b")
    prints = places.groupBy("m").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("m")
    places = places.join(prints.hint("merge"), "m", "left_semi").select("k", "id", "r", "a", "b")
    first = places.groupBy("k").agg(F.min(F.struct("id", "r", "a")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", F.col("f.r").alias("r0"), F.col("f.a").alias("a0"))
    later = places.select("k", "r", "a", "b").join(first, "k").where("r <> r0 or a <> a0").select("r", "a", "b")
    # runs that overlap or touch become one
    by = Window.partitionBy("r").orderBy("a")
    last = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    begins = later.withColumn("new", F.when(F.col("a") <= last + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = begins.groupBy("r", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", bare_scan: bool = False) -> DataFrame:
    """``row`` (the input row), ``n_lines``, ``n_removed`` and ``kept_text``.

    A null text stays null and has no lines; an empty text has one blank line.
    Blank lines bear no words; they are deleted only inside a run. Rows with a
    null id come first, rows with equal ids follow each other in the order they
    are stored. A text all of whose lines go becomes empty; its row stays. Very
    long texts, of many lines or of one, take work in proportion to their length.
    Other columns are passed on; an empty table gives no rows.

    Rows are numbered as they are read, so the input must be read alike each
    time: a plan other than a plain file scan (``bare_scan``) is written first.
    """
    if not bare_scan:
        docs = written(docs, shared_dir(docs.sparkSession, "lines"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("t")).withColumn("r", F.monotonically_increasing_id())
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).withColumn("r", F.monotonically_increasing_id()).where("t is not null")
    out = whole.join(repeated_runs(rows, min_words), "r", "left")
    keep = "filter(split(t, '\\n'), (l, i) -> not exists(runs, y -> i between y.a and y.b))"
    return out.select(
        "row",
        F.expr("if(t is null, 0, size(split(t, '\\n')))").cast("bigint").alias("n_lines"),
        F.expr(f"if(runs is null, t, array_join({keep}, '\\n'))").alias("kept_text"),
        F.expr(f"if(runs is null, 0, size(split(t, '\\n')) - size({keep}))").cast("bigint").alias("n_removed"),
    )
