"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark
decontamination, and encoding of what is left.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``, so
``n_chars`` is that of the text as it then is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.bpe import encode_decode
from palisade.llm.common import removed, shared_dir, table, written
from palisade.llm.decontaminate import decontaminated
from palisade.llm.jaccard_join import first_of_each
from palisade.llm.line_dedup import dedup_lines
from palisade.llm.quality import keep
from palisade.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the n-gram log-likelihood ratio reject go."""
    return keep(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go; documents of which nothing is left go too."""
    out = dedup_lines(docs, bare_scan=True).withColumn("at", F.monotonically_increasing_id()).where("(n_removed = 0 or trim(kept_text) <> '') and at >= 0")
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("row.n_chars"))}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).cast(t).alias(c) for c, t in docs.dtypes])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return first_of_each(docs, bare_scan=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as ids, and decoded again."""
    return encode_decode(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: Hashing to buckets, chosen paths and BPE are not for SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = shared_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k + 1 == len(STAGES) else written(out, f"{root}/{k}")
        if 0 < k < len(STAGES) - 1:
            removed(spark, f"{root}/{k - 1}")  # the stage has read it
    return docs
