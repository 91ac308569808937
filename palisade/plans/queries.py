"""The engine's queries over the driver's tables, as ``__spark_entry__.py`` registers
them. The tables have few violations, so a fragment chosen by the row's id is
added to each text, by the same rule here and in the SQL of ``oracles``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions import catalog as C
from palisade.functions import text as T
from palisade.operators import scanners as S
from palisade.plans import policy as P
from palisade.plans import report, roundtrip
from palisade.plans.oracles import ALTERNATIVES, CONFIG, FRAGMENTS, ORACLES, PATTERNS, SENTENCE, TOPICS
from palisade.sources.tables import chunk_stream, scratch, table
from palisade.streaming import segments as G

__all__ = ["ORACLES", "QUERIES"]


def _with_fragment(df: DataFrame, id_col: str, text: str, kind: str) -> DataFrame:
    frags = F.array(*map(F.lit, FRAGMENTS[kind]))
    return df.select(F.col(id_col).alias("id"), F.concat(F.col(text), F.lit(" "), F.get(frags, (F.col(id_col) % len(FRAGMENTS[kind])).cast("int"))).alias("t"))


def _docs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _with_fragment(table(spark, sf_dir, "documents"), "doc_id", "text", kind)


def _talk(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("n"), "text")
    return _with_fragment(t, "n", "text", kind)


def digest(df: DataFrame, r: str = "r") -> DataFrame:
    x = F.col(r)
    one = lambda f: F.concat_ws(":", F.concat(f["type"], F.lit("@"), f["start"]), f["end"], F.round(f["confidence"] * 10000).cast("int"), F.coalesce(f["match"], F.lit("")))
    pairs = F.array_join(F.transform(x["redaction"], lambda r: F.concat(r["token"], F.lit("="), r["original"])), "|")
    return df.select(
        "id", x["passed"].alias("passed"), F.round(x["score"], 6).alias("score"), x["text"].alias("text"), F.size(x["findings"]).alias("n_findings"),
        F.array_join(F.transform(x["findings"], one), "|").alias("findings"), x["reason"].alias("reason"), pairs.alias("redaction"),
    )


def _scan(source, kind: str, make):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return digest(source(spark, sf_dir, kind).withColumn("r", make(F.col("t"))))

    return query


def url_pages(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _with_fragment(table(spark, sf_dir, "pages"), "page_id", "url", kind)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant's turn with the user's turn before it."""
    t = table(spark, sf_dir, "conversations")
    a = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    u = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    return a.join(u, ["conv_id", "turn"]).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))


def grounding(action: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return digest(_pairs(spark, sf_dir).withColumn("r", S.scan_grounding(F.col("response"), F.col("prompt"), 0.5, action)))

    return query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    t = F.when(k == 1, F.concat("props", F.lit(" x"))).when(k == 2, F.replace("props", F.lit('"k"'), F.lit('"q"'))).when(k == 3, F.lit('{"k": "s"}')).when(k == 4, F.lit("[1]")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), t.alias("t"))


def schema(action: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = {"type": "object", "required": ["k"], "properties": {"k": {"type": "number"}}}
        return digest(_events(spark, sf_dir).withColumn("r", S.scan_schema(F.col("t"), rules, action)))

    return query


def _staged(df: DataFrame) -> DataFrame:
    s = F.col("s")
    names = F.array_join(F.transform(s["results"], lambda r: r["scanner"]), ",")
    return df.select("id", s["text"].alias("text"), names.alias("scanners"), s["blocker"]["scanner"].alias("blocker"))


def chain_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = [P.invisible_text(), P.banned_pattern(PATTERNS, action="redact"), P.banned_topic(TOPICS), P.token_limit(max_tokens=600)]
    return _staged(P.Policy(chain).scan_input(_docs(spark, sf_dir, "topic"), "t", "s"))


def policy_from_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(P.Policy.from_config(CONFIG).scan_input(_docs(spark, sf_dir, "topic"), "t", "s"))


def chain_stage_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanners of the input stage in an output chain are not run."""
    chain = [P.token_limit(max_tokens=1), P.invisible_text(), P.banned_topic(TOPICS)]
    return _staged(P.Policy([], chain).scan_output(_docs(spark, sf_dir, "topic"), "t", "s"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pairs(spark, sf_dir)
    frags = F.array(*map(F.lit, FRAGMENTS["mail"]))
    df = df.select(
        "id",
        F.concat("prompt", F.lit(" "), F.get(frags, (F.col("id") % len(FRAGMENTS["mail"])).cast("int"))).alias("prompt"),
        F.concat(F.lit("Wrote to [EMAIL_1]. "), F.col("response")).alias("response"),
    )
    rules = P.Policy([P.pii(types=["email"], locales=["us"]), P.banned_topic(["drugs"])], [P.banned_topic(TOPICS)])
    return roundtrip.round_trip(df, rules, "prompt", "response")


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("outcome")

    def results(r: Column) -> Column:
        return F.array_join(F.transform(r, lambda x: F.format_string("%s:%s:%.1f:%d", x["scanner"], x["passed"], x["score"], F.size(x["findings"]))), ",")

    pairs = F.array_join(F.transform(o["pii"], lambda r: F.concat(r["token"], F.lit("="), r["original"])), "|")
    return _outcomes(spark, sf_dir).select(
        "id", *[o[c].alias(c) for c in ("blocked", "blocked_stage", "block_reason", "input", "output", "raw_output")], pairs.alias("pii"),
        results(o["input_results"]).alias("input_results"), results(o["output_results"]).alias("output_results"),
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("audit")
    rows = report.audit(_outcomes(spark, sf_dir), "prompt", timestamp=F.lit(0).cast("bigint"))
    return rows.select("id", *[a[c].alias(c) for c in ("blocked", "input_hash", "output_hash", "total_findings")], "audit_json")


def metrics_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics that are gathered while a job runs."""
    seen = Observation("guard")
    report.observed(_outcomes(spark, sf_dir), seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([seen.get], "runs bigint, blocked bigint, findings bigint")


def metrics_by_scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_scanner(_outcomes(spark, sf_dir))


def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # bound once: a generator above would put the text's expression in for every use
    scans = T.let(F.col("t"), lambda t: F.array(S.scan_pii(t, "warn", ["email", "ip", "ssn"], ["us"]), S.scan_topic(t, TOPICS, "warn")))
    return report.rollup(_docs(spark, sf_dir, "pii").select(scans.alias("r")), "r")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").cast("int").alias("chunk_seq"), F.col("text").alias("chunk"))


def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.segments(_chunks(spark, sf_dir))


def stream_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.guarded(G.segments(_chunks(spark, sf_dir)), [P.banned_topic(TOPICS)])
    return out.select("stream_id", "seg_seq", "text", "blocked", F.size("findings").alias("n_findings"))


def stream_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same segments from a stream of chunk files with one state per stream."""
    root = scratch(spark, "stream")
    last = F.lead("chunk_seq").over(Window.partitionBy("stream_id").orderBy("chunk_seq")).isNull()
    _chunks(spark, sf_dir).withColumn("is_last", last).repartition(4).write.parquet(f"{root}/chunks")
    parts = G.stream_segments(chunk_stream(spark, f"{root}/chunks"), timeout_ms=None)
    query = parts.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(parts.schema).parquet(f"{root}/out")


def _guarded_talk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, P.Policy]:
    """Prompts (stream_id, prompt) and chunks of conversations, and the policy of ``_outcomes``."""
    talk = table(spark, sf_dir, "conversations").withColumn("stream_id", F.col("conv_id").cast("string"))
    frags = F.array(*map(F.lit, FRAGMENTS["mail"]))
    first = talk.where("role = 'user'").groupBy("stream_id", "conv_id").agg(F.min_by("text", "turn").alias("text"))
    prompts = first.select("stream_id", F.concat("text", F.lit(" "), F.get(frags, (F.col("conv_id") % len(FRAGMENTS["mail"])).cast("int"))).alias("prompt"))
    by = Window.partitionBy("stream_id").orderBy("turn")
    chunks = talk.where("role = 'assistant'").select("stream_id", (F.row_number().over(by) - 1).cast("int").alias("chunk_seq"), "text", F.lead("turn").over(by).isNull().alias("is_last"))
    chunks = chunks.select("stream_id", "chunk_seq", F.when(F.col("chunk_seq") == 0, F.concat(F.lit("Wrote to [EMAIL_1]. "), F.col("text"))).otherwise(F.col("text")).alias("chunk"), "is_last")
    return prompts, chunks, P.Policy([P.pii(types=["email"], locales=["us"]), P.banned_topic(["drugs"])], [P.banned_topic(TOPICS)])


def _segment_rows(df: DataFrame) -> DataFrame:
    return df.select("stream_id", "seg_seq", "text", "blocked", "block_reason", F.size("findings").alias("n_findings"))


def stream_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded streams that are stored already: input stage, one segment a chunk, cut-off, rehydration."""
    prompts, chunks, policy = _guarded_talk(spark, sf_dir)
    return _segment_rows(G.guarded_talk(prompts, chunks, policy, "prompt", SENTENCE))


def stream_guard_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of chunk files."""
    prompts, chunks, policy = _guarded_talk(spark, sf_dir)
    root = scratch(spark, "guard")
    chunks.repartition(4).write.parquet(f"{root}/chunks")
    query = G.guard_stream(chunk_stream(spark, f"{root}/chunks"), prompts, policy, f"{root}/out", "prompt", SENTENCE, timeout_ms=None).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return _segment_rows(G.guarded_output(spark, f"{root}/out"))


def custom_scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's scanner as a Column function: it puts texts in brackets."""

    def frame(t: Column) -> Column:
        return T.result("frame", True, 0.0, F.concat(F.lit("<"), t, F.lit(">")), T.empty(T.FINDING), None)

    chain = [P.Scanner("frame", P.BOTH, frame), P.banned_pattern(["edor>"], action="redact")]
    return _staged(P.run_stage(_docs(spark, sf_dir, "topic"), chain, P.INPUT, "t", "s"))


def python_scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's scanner in Python that raises for some rows, failing closed."""

    def frame(text: str):
        if "drugs" in text:
            raise ValueError("no")
        return {"text": f"<{text}>"}

    return _staged(P.run_stage(_docs(spark, sf_dir, "topic"), [P.python_scanner("frame", frame)], P.INPUT, "t", "s"))


def hash32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), T.fnv1a32(F.col("text")).alias("h"))


def pii_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as a table: how many patterns each locale has."""
    rows = [(loc, p.type) for p in C.PII for loc in p.locales]
    return spark.createDataFrame(rows, "locale string, type string").groupBy("locale").agg(F.count(F.lit(1)).alias("patterns"))


def _locale(name: str):
    return _scan(_docs, "locale", lambda t: S.scan_pii(t, "warn", locales=[name]))


def _actions(name: str, source, kind: str, scan, actions=S.ACTIONS) -> dict:
    """A query for each action of a scanner."""
    return {f"{name}_{a}": _scan(source, kind, lambda t, a=a: scan(t, a)) for a in actions}


QUERIES = {
    "findings_rollup": findings_rollup,
    "pii_findings": _scan(_docs, "pii", lambda t: S.scan_pii(t, "warn")),
    "pii_redact": _scan(_docs, "pii", lambda t: S.scan_pii(t, "redact")),
    "pii_hash": _scan(_docs, "pii", lambda t: S.scan_pii(t, "hash")),
    "pii_block": _scan(_docs, "pii", lambda t: S.scan_pii(t, "block")),
    "pii_luhn": _scan(_docs, "pii", lambda t: S.scan_pii(t, "warn", ["credit_card"])),
    "pii_all_locales": _scan(_docs, "locale", lambda t: S.scan_pii(t, "warn", locales=C.LOCALES)),
    **{f"pii_locale_{x.lower()}": _locale(x) for x in C.LOCALES},
    "pii_catalogue": pii_catalogue,
    "pii_placeholder": _scan(_docs, "pii", lambda t: S.scan_pii(t, "redact", placeholder="<removed>")),
    "secret_findings": _scan(_docs, "secret", lambda t: S.scan_secret(t)),
    **_actions("secret", _docs, "secret", S.scan_secret, ("redact", "hash", "warn")),
    **_actions("injection", _talk, "injection", S.scan_injection),
    **_actions("invisible", _talk, "invisible", S.scan_invisible),
    **_actions("topic", _docs, "topic", lambda t, a: S.scan_topic(t, TOPICS, a), ("block", "redact", "warn")),
    "topic_hash": _scan(_docs, "topic", lambda t: S.scan_topic(t, ["drugs"], "hash")),
    **_actions("pattern", _docs, "topic", lambda t, a: S.scan_pattern(t, PATTERNS, a)),
    "pattern_alternatives": _scan(_docs, "topic", lambda t: S.scan_pattern(t, ALTERNATIVES)),
    "token_limit": _scan(_docs, "topic", lambda t: S.scan_tokens(t, 300)),
    "token_limit_redact": _scan(_docs, "topic", lambda t: S.scan_tokens(t, 300, "redact")),
    "repetition": _scan(_docs, "topic", lambda t: S.scan_repetition(t, 3, 0.05)),
    "repetition_warn": _scan(_docs, "topic", lambda t: S.scan_repetition(t, 3, 0.05, "warn")),
    **_actions("url", url_pages, "url", S.scan_url, ("block", "warn")),
    "language": _scan(_docs, "language", lambda t: S.scan_language(t, threshold=0.995)),
    "language_warn": _scan(_docs, "language", lambda t: S.scan_language(t, "warn", threshold=0.995)),
    "code_exec": _scan(_talk, "code", lambda t: S.scan_code(t)),
    "code_warn": _scan(_talk, "code", lambda t: S.scan_code(t, "warn")),
    "grounding": grounding("block"),
    "grounding_warn": grounding("warn"),
    "schema_validate": schema("block"),
    "schema_warn": schema("warn"),
    "chain_input": chain_input,
    "policy_from_config": policy_from_config,
    "chain_stage_skip": chain_stage_skip,
    "round_trip": round_trip,
    "audit_log": audit_log,
    "metrics_by_scanner": metrics_by_scanner,
    "metrics_observed": metrics_observed,
    "stream_segments": stream_segments,
    "stream_cutoff": stream_cutoff,
    "stream_stateful": stream_stateful,
    "stream_guard": stream_guard,
    "stream_guard_live": stream_guard_live,
    "custom_scanner": custom_scanner,
    "python_scanner": python_scanner,
    "hash32": hash32,
}
