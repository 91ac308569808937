"""Audit records and metrics from outcomes. Texts are never stored, only hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from palisade.functions import text as T


def _entries(results: Column, stage: str) -> Column:
    def entry(r: Column) -> Column:
        kinds = F.array_sort(F.array_distinct(F.transform(r["findings"], lambda f: f["type"])))
        return F.struct(
            r["scanner"].alias("name"),
            F.lit(stage).alias("stage"),
            r["passed"].alias("passed"),
            r["score"].alias("score"),
            F.size(r["findings"]).alias("finding_count"),
            F.when(F.size(kinds) > 0, kinds).alias("finding_types"),
        )

    return F.transform(results, entry)


def audit(df: DataFrame, prompt: str, outcome: str = "outcome", timestamp: Column | None = None, out: str = "audit") -> DataFrame:
    """``df`` with ``out``, the audit record, and ``<out>_json``, in which keys
    without a value are left out.

    input_hash is that of the prompt as it came; output_hash is 0 if the prompt
    was blocked, that of the raw response if the response was, else that of the
    text that is given back.
    """
    o = F.col(outcome)
    entries = F.concat(_entries(o["input_results"], "input"), _entries(o["output_results"], "output"))
    answer = F.when(o["blocked_stage"] == "output", F.col(f"{outcome}_response")).otherwise(o["output"])
    record = F.struct(
        (F.unix_micros(F.current_timestamp()) if timestamp is None else timestamp).alias("timestamp_us"),
        o["blocked"].alias("blocked"),
        o["blocked_stage"].alias("blocked_stage"),
        o["block_reason"].alias("block_reason"),
        T.fnv1a32(F.col(prompt)).alias("input_hash"),
        F.when(F.coalesce(o["blocked_stage"] == "input", F.lit(False)), F.lit(0).cast("bigint")).otherwise(T.fnv1a32(answer)).alias("output_hash"),
        entries.alias("scanners"),
        F.aggregate(entries, F.lit(0), lambda a, e: a + e["finding_count"]).alias("total_findings"),
    )
    return df.withColumn(out, record).withColumn(f"{out}_json", F.to_json(F.col(out)))


def observed(df: DataFrame, name: str | Observation, outcome: str = "outcome") -> DataFrame:
    """``df`` with metrics that are gathered while it runs (``Observation``, or a
    streaming listener's ``observedMetrics`` under a name)."""
    o = F.col(outcome)
    n = F.aggregate(F.concat(o["input_results"], o["output_results"]), F.lit(0), lambda a, r: a + F.size(r["findings"]))
    return df.observe(name, F.count(F.lit(1)).alias("runs"), F.sum(o["blocked"].cast("long")).alias("blocked"), F.sum(n).alias("findings"))


def by_scanner(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """stage, scanner, runs, blocked, findings."""
    o = F.col(outcome)
    rows = df.select(F.explode(F.concat(_entries(o["input_results"], "input"), _entries(o["output_results"], "output"))).alias("e"))
    return rows.groupBy("e.stage", F.col("e.name").alias("scanner")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum((~F.col("e.passed")).cast("long")).alias("blocked"), F.sum("e.finding_count").alias("findings")
    )


def rollup(results: DataFrame, column: str) -> DataFrame:
    """scanner, type, findings: counts with subtotals (null stands for all)."""
    rows = results.select(F.explode(column).alias("r")).select("r.scanner", F.explode("r.findings").alias("f")).select("scanner", F.col("f.type").alias("type"))
    return rows.rollup("scanner", "type").agg(F.count(F.lit(1)).alias("findings"))
