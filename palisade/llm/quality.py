"""Quality rules: hashed n-gram log-likelihood ratio, DataFrame functions only.

Words and word pairs are hashed to buckets. Two multinomials are estimated: one
over trusted documents, one over the whole corpus. A document's score is the mean
over its n-grams of ``ln p_trusted - ln p_corpus``; it is kept if that is at least
``THRESHOLD``. The trusted counts are smoothed by ``PRIOR`` n-grams a bucket in the
corpus's own proportion, so a bucket that has hardly been seen says little. An
n-gram of the document itself is left out of both counts (else documents of the
trusted sample would always do better): there is a weight for documents in the
sample and one for all others. Weights are integers (1/1024 nat), so sums don't
depend on their order and each verdict is the same in every run.

The number of buckets grows with the corpus, as its vocabulary does: the power of
two above ``BUCKET_ROOT`` times the square root of the text's bytes (2^16 for 25 MB,
2^21 for 30 GB, 2^27 for 100 TB). The corpus counts cover every document; they are
combined in the map tasks, so the shuffle has one row per bucket and task, and are
written to the shared folder. The weights (4 bytes a bucket) come back into the plan
as the value of a scalar subquery, never to Python. The trusted sample is bounded:
``TRUSTED_ROWS`` label rows, those with the smallest hash of their id.

Windows of three words are compared by a 64-bit hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import shared_dir, written

#: Buckets per square root of the corpus's bytes.
BUCKET_ROOT = 8
#: Buckets whose weights one task puts together.
CHUNK = 4096
#: Trusted label rows that are used at most.
TRUSTED_ROWS = 20_000
#: Nats per n-gram below which a document goes.
THRESHOLD = -0.11
#: N-grams a bucket that the trusted counts are smoothed by.
PRIOR = 6
#: Steps of a weight in one nat.
SCALE = 1024

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]


def _replaced(text, chars: str, by: str):
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The whole row, its id and its words; null text has none."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    return d.withColumn("w", F.array_remove(F.split(_replaced(F.col("t"), SPACES, " "), " "), ""))


def buckets_for(n_bytes: int) -> int:
    return 1 << max(12, math.ceil(math.log2(BUCKET_ROOT * math.sqrt(n_bytes + 1))))


def of_word(buckets: int) -> tuple[str, str]:
    """SQL for word i, x, of w: its bucket, and that of the pair it begins (or null)."""
    return f"cast(pmod(xxhash64(x, 1), {buckets}) as int)", f"if(i + 1 < size(w), cast(pmod(xxhash64(x, get(w, i + 1), 2), {buckets}) as int), null)"


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """At most ``rows`` ids of labelled good, non-toxic documents."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _flagged(d: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """With ``good``: 1 for documents of the trusted sample, else null."""
    return d.join(F.broadcast(trusted_ids(labels, rows).select(F.col("doc_id").alias("id"), F.lit(1).alias("good"))), "id", "left")


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRUSTED_ROWS) -> tuple[Column, int]:
    """A scalar struct<other, own> of the weights of all buckets, for documents
    outside the trusted sample and for those in it (zeros where no trusted document
    is found), and the number of buckets."""
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    buckets = buckets_for(plain.agg(F.sum(F.octet_length("t").cast("bigint"))).first()[0] or 0)
    uni, pair = of_word(buckets)
    grams = _flagged(_rows(plain, "id", "t").select("id", "w"), labels, rows).selectExpr("good", f"inline_outer(transform(w, (x, i) -> struct({uni} as u, {pair} as p)))").selectExpr("good", "explode(array(u, p)) as b")
    counts = written(grams.where("b is not null").groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("good")), shared_dir(spark, "ngram-counts"))
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    share = (total.good or 0) / (total.raw or 1)

    def weight(good: str, raw: str) -> str:
        # the prior in corpus n-grams is PRIOR / share
        return f"cast(round({SCALE} * ln((greatest({good}, 0) + {PRIOR}D) / ({share!r}D * {raw} + {PRIOR}D))) as smallint)" if share else "cast(0 as smallint)"

    every = spark.range(buckets).selectExpr("cast(id as int) as b").join(counts, "b", "left")
    every = every.selectExpr(f"b div {CHUNK} as c", "b", f"coalesce({weight('good', '(raw - 1)')}, cast(0 as smallint)) as o", f"coalesce({weight('(good - 1)', '(raw - 1)')}, cast(0 as smallint)) as w")
    chunk = every.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("b", "o", "w"))).alias("a")).selectExpr("c", "transform(a, x -> x.o) as o", "transform(a, x -> x.w) as w")
    whole = chunk.agg(F.array_sort(F.collect_list(F.struct("c", "o", "w"))).alias("a")).selectExpr("struct(flatten(transform(a, x -> x.o)) as other, flatten(transform(a, x -> x.w)) as own) as v")
    return written(whole, shared_dir(spark, "ngram-weights")).select("v").scalar(), buckets


def score(docs: DataFrame, labels: DataFrame, weight: tuple[Column, int], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", rows: int = TRUSTED_ROWS) -> DataFrame:
    """``row`` (the whole input row), ``id`` and the columns in ``FEATURES``.

    Null and empty texts have no words and fail the base rules; very long texts
    are judged whole, in one row. Rows are judged one by one: equal rows get equal
    verdicts, and other columns play no part. An empty table gives no rows.
    """
    d = _flagged(_rows(docs, id_col, text_col), labels, rows)
    lines = f"filter(split(t, '\\n'), l -> trim(BOTH ' {SPACES}' FROM l) <> '')"
    d = d.select(
        "row",
        "id",
        "good",
        "w",
        F.size("w").cast("bigint").alias("n_words"),
        (F.char_length("t") - F.octet_length("t") + F.octet_length(_replaced(F.col("t"), " " + SPACES, ""))).cast("bigint").alias("word_chars"),
        (F.octet_length("t") - F.octet_length(_replaced(F.col("t"), SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.expr(lines).alias("l"),
        F.expr("transform(w, (x, i) -> if(i + 2 < size(w), xxhash64(x, get(w, i + 1), get(w, i + 2)), null))").alias("h"),
    )
    found, buckets = weight
    uni, pair = of_word(buckets)
    sums = f"aggregate(transform(w, (x, i) -> get(v, {uni}) + coalesce(get(v, {pair}), 0)), 0L, (a, b) -> a + b)"
    d = d.withColumn("v", F.when(F.col("good").isNull(), found["other"]).otherwise(found["own"]))
    d = d.select(
        "row", "id", "n_words", "word_chars", "n_symbols",
        F.expr("cast(size(l) - size(array_distinct(l)) as bigint)").alias("n_dup_lines"),
        F.expr(sums).alias("sum"),
        # only texts in which a window comes back are sorted
        F.expr("if(size(array_distinct(h)) < size(h) - least(size(h), 2) + least(size(h), 1), array_sort(filter(transform(h, (x, i) -> struct(x, i)), s -> s.x is not null)), null)").alias("s"),
    )
    again = "transform(filter(transform(s, (v, j) -> if(get(s, j - 1).x = v.x or get(s, j + 1).x = v.x, v.i, null)), p -> p is not null), p -> array(p, p + 1, p + 2))"
    d = d.withColumn("n_repeat_words", F.expr(f"cast(coalesce(size(array_distinct(flatten({again}))), 0) as bigint)"))
    d = d.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    limit = round(threshold * SCALE * 1000)
    d = d.withColumn("kept", F.expr(f"not base_failed and 1000 * sum >= {limit} * (2 * n_words - 1)"))
    return d.withColumn("score", F.expr(f"if(n_words = 0, 0D, sum / cast({SCALE} * (2 * n_words - 1) as double))")).select("row", "id", *FEATURES)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Weights from all of ``docs``, then ``score`` of all of ``docs``."""
    return score(docs, labels, weights(docs, labels, id_col, text_col), threshold, id_col, text_col)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``.

    The row number keeps the filter above the verdict: pushed below it, it would
    have every feature computed again inside one expression."""
    return judge(docs, labels, threshold).withColumn("at", F.monotonically_increasing_id()).where("kept and at >= 0").select("row.*")
