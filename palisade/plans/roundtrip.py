"""The guarded round-trip: scan the prompt, get a response, scan it, rehydrate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.plans.policy import Policy


def round_trip(df: DataFrame, policy: Policy, prompt: str, response: str | Callable[[Column], Column], out: str = "outcome") -> DataFrame:
    """``df`` with ``out``: struct<blocked, blocked_stage, block_reason, input,
    output, raw_output, pii, input_results, output_results>.

    ``response`` is a column of responses (already joined to their prompts), or a
    function of the sanitised prompt's column (an expression or a pandas UDF). A
    prompt that is blocked gets no response. Tokens in the response turn back
    into what they stand for by the prompt's redactions only.
    """
    df = policy.scan_input(df, prompt, "__in")
    stop = F.col("__in.blocker").isNotNull()
    answer = response(F.col("__in.text")) if callable(response) else F.col(response)
    df = df.withColumn("__answer", F.when(~stop, answer))
    df = policy.scan_output(df, "__answer", "__out")
    cut = ~stop & F.col("__out.blocker").isNotNull()
    blocker = F.when(stop, F.col("__in.blocker")).when(cut, F.col("__out.blocker"))
    whole = F.struct(
        (stop | cut).alias("blocked"),
        F.when(stop, F.lit("input")).when(cut, F.lit("output")).alias("blocked_stage"),
        blocker["reason"].alias("block_reason"),
        F.when(~stop, F.col("__in.text")).alias("input"),
        F.when(~stop & ~cut, T.rehydrated(F.col("__out.text"), F.col("__in.redaction"))).alias("output"),
        F.when(~stop & ~cut, F.col("__out.text")).alias("raw_output"),
        F.col("__in.redaction").alias("pii"),
        F.col("__in.results").alias("input_results"),
        F.when(stop, T.empty(T.RESULT)).otherwise(F.col("__out.results")).alias("output_results"),
    )
    return df.withColumn(out, whole).withColumn("__raw", F.col("__answer")).drop("__in", "__out", "__answer").withColumnRenamed("__raw", f"{out}_response")


def all_findings(outcome: Column) -> Column:
    return F.flatten(F.transform(F.concat(outcome["input_results"], outcome["output_results"]), lambda r: r["findings"]))
