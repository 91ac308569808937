import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 7919}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from the big house near the old river bank "
    rows = [
        (1, base * 4),
        (2, base * 4),
        (2, base * 4),
        (3, None),
        (None, base * 4 + "end"),
        (None, None),
        (4, ""),
        (5, " \n\t\n "),
        (6, LONG),
        (7, "x"),
        (8, "a b c d e f g h i j k l\n\n" + base * 3 + "\n" + base * 3 + "\na b"),
        (9, "<|endoftext|> é 日本 🙂 \x1c b"),
        (10, "nosp" * 30_000),
    ]
    df = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("row", "r", "t", "k", "id", "key", "kept", "n_words", "shard", "slot", "cell", "g", "b", "w", "h", "s", "a", "good", "score", "first", "runs", "at", "n_removed", "kept_text", "_at"):
        df = df.withColumn(c, F.lit("other"))
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    df.coalesce(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(odd_docs, tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    odd_docs.where("false").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (8, 1, 0), (6, 0, 0), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, "quick brown fox jumps over the lazy dog and runs far"), (2, None), (3, ""), (4, "the lazy"), (4, "the lazy"), (None, "old river bank")], "item_id bigint, text string"
    )
