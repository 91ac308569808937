"""Chains, configs, round-trips, audit, metrics and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.plans import policy as P
from palisade.plans import report
from palisade.plans.roundtrip import all_findings, round_trip
from palisade.streaming import segments as G


def texts(spark, *rows):
    return spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "id int, t string")


def replace(name, old, new):
    return P.Scanner(name, P.BOTH, lambda t: T.result(name, True, 0.0, F.replace(t, F.lit(old), F.lit(new)), T.empty(T.FINDING), None))


def block_if(name, word):
    return P.Scanner(name, P.BOTH, lambda t: T.result(name, ~t.contains(word), 1.0, t, T.empty(T.FINDING), f"{name} says no"))


def test_chain_and_short_circuit(spark):
    chain = [replace("a", "foo", "bar"), block_if("b", "stop"), replace("c", "bar", "qux")]
    rows = P.run_stage(texts(spark, "foo baz foo", "foo stop", None), chain, P.INPUT, "t", "s").orderBy("id").collect()
    assert rows[0].s.text == "qux baz qux" and [r.scanner for r in rows[0].s.results] == ["a", "b", "c"] and rows[0].s.blocker is None
    assert rows[1].s.text == "bar stop" and [r.scanner for r in rows[1].s.results] == ["a", "b"] and rows[1].s.blocker.reason == "b says no"
    assert rows[2].s.text is None and rows[0].asDict().keys() == {"id", "t", "s"}


def test_scanners_of_the_other_stage_are_left_out(spark):
    r = P.run_stage(texts(spark, "a b c"), [P.token_limit(max_tokens=1)], P.OUTPUT, "t", "s").first()
    assert r.s.results == [] and r.s.blocker is None and r.s.text == "a b c"


def test_maps_merge(spark):
    chain = [P.pii(types=["email"]), P.pii(types=["ssn"])]
    r = P.run_stage(texts(spark, "a@b.com 123-45-6789 a@b.com"), chain, P.INPUT, "t", "s").first().s
    assert [(x.token, x.original) for x in r.redaction] == [("[EMAIL_1]", "a@b.com"), ("[EMAIL_2]", "a@b.com"), ("[SSN_1]", "123-45-6789")]


@pytest.mark.parametrize("closed", [True, False])
def test_python_scanner_errors(spark, closed):
    def scan(t):
        if "bad" in t:
            raise RuntimeError("boom")
        return {"text": t + "!"}

    chain = [P.python_scanner("py", scan), replace("c", "o", "0")]
    rows = P.Policy(chain, fail_closed=closed).scan_input(texts(spark, "good", "bad one", None), "t", "s").orderBy("id").collect()
    assert rows[0].s.text == "g00d!"
    if closed:
        assert rows[1].s.blocker.reason == "scanner error: boom" and rows[1].s.blocker.score == 1.0
    else:
        assert rows[1].s.text == "bad 0ne" and [r.scanner for r in rows[1].s.results] == ["c"]


CONFIG = {
    "input": [{"type": "pii", "locales": ["us"]}, {"type": "secret"}, {"type": "prompt_injection", "threshold": 0.5}],
    "output": [{"type": "repetition", "threshold": 0.3}],
}


def test_config(spark):
    p = P.Policy.from_config(json.dumps(CONFIG))
    assert p.fail_closed and [s.name for s in p.input] == ["pii", "secret", "prompt_injection"]
    r = p.scan_input(texts(spark, "mail a@b.com"), "t").first().scan
    assert r.text == "mail [EMAIL_1]" and len(r.results) == 3
    kinds = [
        {"type": "invisible_text"}, {"type": "banned_topic", "topics": ["x"]}, {"type": "banned_pattern", "patterns": ["y"], "name": "mine"}, {"type": "token_limit", "maxTokens": 9},
        {"type": "url", "action": "warn"}, {"type": "language"}, {"type": "code_exec"}, {"type": "grounding", "context": "a"}, {"type": "schema", "schema": {"type": "object"}},
    ]
    assert [s.name for s in P.Policy.from_config({"output": kinds}).output][2] == "mine"
    for bad in ({"type": "nope"}, {"type": "pii", "action": "nope"}, {"type": "pii", "locales": ["mars"]}):
        with pytest.raises(ValueError):
            P.Policy.from_config({"input": [bad]})


def trips(spark, policy, *rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, prompt string, response string")
    return round_trip(df, policy, "prompt", "response")


def test_round_trip(spark):
    policy = P.Policy([P.pii(), P.banned_topic(["drugs"])], [P.banned_topic(["guns"])])
    df = trips(
        spark, policy,
        ("contact alice@example.com please", "Sure, I emailed [EMAIL_1] for you."), ("buy drugs", "never seen"), ("hi", "about guns"),
    ).orderBy("id")
    a, b, c = (r.outcome for r in df.collect())
    assert (a.blocked, a.output, a.raw_output, a.input) == (False, "Sure, I emailed alice@example.com for you.", "Sure, I emailed [EMAIL_1] for you.", "contact [EMAIL_1] please")
    assert (b.blocked, b.blocked_stage, b.input, b.output, b.output_results) == (True, "input", None, None, [])
    assert (c.blocked_stage, c.input, c.output) == ("output", "hi", None) and c.block_reason == "banned topic(s): guns"
    n = [len(r.f) for r in df.select(all_findings(F.col("outcome")).alias("f")).collect()]
    assert n == [1, 1, 1]


def test_echo_gives_the_prompt_back(spark):
    policy = P.Policy([P.pii()], [])
    prompts = ["a@b.com 123-45-6789 c@d.com", "call 555-123-4567 now", "plain", "", "4111 1111 1111 1111 x 10.0.0.1"]
    df = spark.createDataFrame([(p,) for p in prompts], "prompt string")
    rows = round_trip(df, policy, "prompt", lambda t: t).collect()
    assert [r.outcome.output for r in rows] == prompts


def test_audit_and_metrics(spark):
    policy = P.Policy([P.pii(types=["email"]), P.banned_topic(["drugs"])], [P.banned_topic(["guns"])])
    df = trips(spark, policy, ("mail a@b.com", "ok [EMAIL_1]"), ("drugs", "x"), ("hi", "guns"))
    rows = [json.loads(r.audit_json) for r in report.audit(df, "prompt", timestamp=F.lit(7).cast("bigint")).orderBy("id").collect()]
    a, b, c = rows
    assert a["timestamp_us"] == 7 and a["total_findings"] == 1 and a["scanners"][0]["finding_types"] == ["pii.email"] and "blocked_stage" not in a
    assert "finding_types" not in a["scanners"][1] and a["scanners"][0]["stage"] == "input"
    assert b["output_hash"] == 0 and b["blocked_stage"] == "input"

    def fnv(t):
        h = 2166136261
        for c in t:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return h

    assert a["input_hash"] == fnv("mail a@b.com") and a["output_hash"] == fnv("ok a@b.com") and c["output_hash"] == fnv("guns")
    got = {(r.stage, r.scanner): (r.runs, r.blocked, r.findings) for r in report.by_scanner(df).collect()}
    assert got == {("input", "pii"): (3, 0, 1), ("input", "banned_topic"): (3, 1, 1), ("output", "banned_topic"): (2, 1, 1)}
    from pyspark.sql import Observation

    seen = Observation("guard")
    o = F.col("outcome")
    df.observe(seen, F.count(F.lit(1)).alias("runs"), F.sum(o["blocked"].cast("long")).alias("blocked")).collect()
    assert seen.get == {"runs": 3, "blocked": 2}


def chunks(spark, *rows):
    return spark.createDataFrame(rows, "stream_id string, chunk_seq int, chunk string")


def test_segments(spark):
    df = chunks(spark, ("a", 1, "two\nthr"), ("a", 0, "one\n"), ("a", 2, "ee"), ("b", 0, "\n"), ("c", 0, ""))
    got = sorted((r.stream_id, r.seg_seq, r.text) for r in G.segments(df).collect())
    assert got == [("a", 0, "one\n"), ("a", 1, "two\n"), ("a", 2, "three"), ("b", 0, "\n")]
    got = [r.text for r in G.segments(chunks(spark, ("a", 0, "One. Two! Three")), r"(?<=[.!?])\s", True).orderBy("seg_seq").collect()]
    assert got == ["One. ", "Two! ", "Three"]


def test_a_blocked_segment_ends_its_stream(spark):
    df = chunks(spark, ("a", 0, "fine\nabout drugs\nnever\n"), ("b", 0, "ok\n"))
    rows = G.guarded(G.segments(df), [P.banned_topic(["drugs"])]).orderBy("stream_id", "seg_seq").collect()
    assert [(r.text, r.blocked) for r in rows] == [("fine\n", False), ("about drugs\n", True), ("ok\n", False)]


def test_one_segment_a_chunk(spark):
    df = chunks(spark, ("a", 0, "a\nb\nc"), ("a", 1, None), ("a", 2, "!\nd"), ("b", 0, "x\n\n"), ("c", 0, "n"), ("c", 1, "o"), ("d", 0, ""), ("e", 0, "1\n"), ("e", 1, "2\n"))
    got = sorted((r.stream_id, r.seg_seq, r.text) for r in G.segments(df, one_per_chunk=True).collect())
    assert got == [("a", 0, "a\n"), ("a", 1, "b\n"), ("a", 2, "c!\n"), ("a", 3, "d"), ("b", 0, "x\n"), ("b", 1, "\n"), ("c", 0, "no"), ("e", 0, "1\n"), ("e", 1, "2\n")]
    for key in "abce":
        c, s = G.Cutter(one_per_chunk=True), {"next": 0, "seg": 0, "open": "", "early": {}, "done": False}
        rows = [r.chunk for r in df.where(F.col("stream_id") == key).orderBy("chunk_seq").collect()]
        assert c.feed(s, [(n, t, n == len(rows) - 1) for n, t in enumerate(rows)]) == [(n, t) for k, n, t in got if k == key]
    with pytest.raises(ValueError):
        G.segments(df, "x", regex=True, one_per_chunk=True)


def test_guard_of_a_live_stream(spark, tmp_path):
    """Batch by batch: blocked prompts, tokens of several batches, nothing after a blocked segment, restarts."""
    from palisade.sources.tables import chunk_stream

    source, kind = tmp_path / "in", "stream_id string, chunk_seq int, chunk string, is_last boolean"
    policy = P.Policy([P.pii(types=["email"]), P.banned_topic(["guns"])], [P.banned_topic(["drugs"])])
    prompts = spark.createDataFrame([("a", "mail x@y.org"), ("b", "about guns"), ("c", "hi"), ("d", "z@z.net")], "stream_id string, prompt string")
    parts = [
        [("a", 0, "to [EMAIL_1]\nand", False), ("b", 0, "never\n", True), ("c", 0, "fine\ndrugs", False)],
        [("c", 1, " here\nmore", False), ("a", 1, " [EMAIL_", False)],
        [("c", 2, "\nstill\n", True), ("a", 2, "1]\n", True), ("d", 0, "[EMAIL_1]", True)],
    ]

    def run():
        q = G.guard_stream(chunk_stream(spark, str(source)), prompts, policy, str(tmp_path / "out"), timeout_ms=None).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    for rows in parts:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(source))
        run()
    rows = G.guarded_output(spark, str(tmp_path / "out")).orderBy("stream_id", "seg_seq").collect()
    want = [("a", 0, "to x@y.org\n", False), ("a", 1, "and x@y.org\n", False), ("b", 0, "", True), ("c", 0, "fine\n", False), ("c", 1, "drugs here\n", True), ("d", 0, "z@z.net", False)]
    assert [(r.stream_id, r.seg_seq, r.text, r.blocked) for r in rows] == want
    assert rows[2].block_reason == rows[4].block_reason.replace("drugs", "guns") and [f.type for f in rows[2].findings] == ["topic.guns"]
    stored = [(s, n, c) for batch in parts for s, n, c, _ in batch]
    again = G.guarded_talk(prompts, chunks(spark, *stored), policy).orderBy("stream_id", "seg_seq").collect()
    assert [(r.stream_id, r.seg_seq, r.text, r.blocked) for r in again] == want


def test_cutter():
    c, s = G.Cutter(one_per_chunk=True), {"next": 0, "seg": 0, "open": "", "early": {}, "done": False}
    assert c.feed(s, [(0, "a\nb\nc", False)]) == [(0, "a\n")]
    assert c.feed(s, [(2, "!", True)]) == []
    assert c.feed(s, [(1, "", False)]) == [(1, "b\n"), (2, "c!")]
    assert c.feed(s, [(3, "late\n", False)]) == []


def test_stateful_stream(spark, tmp_path):
    from palisade.sources.tables import chunk_stream

    source, kind = tmp_path / "in", "stream_id string, chunk_seq int, chunk string, is_last boolean"
    parts = [[("a", 1, "o\nthr", False), ("b", 0, "x", False)], [("a", 0, "one\ntw", False)], [("a", 2, "ee", True), ("b", 1, "y\n", True)]]
    for rows in parts:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(source))
    out = G.guarded_stream(G.stream_segments(chunk_stream(spark, str(source))), [P.banned_topic(["drugs"])])
    q = out.writeStream.format("memory").queryName("segments_out").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    want = [("a", 0, "one\n"), ("a", 1, "two\n"), ("a", 2, "three"), ("b", 0, "xy\n")]
    got, end = [], time.time() + 60
    try:
        while got != want and time.time() < end and q.exception() is None:
            time.sleep(0.5)
            got = sorted((r.stream_id, r.seg_seq, r.text) for r in spark.table("segments_out").collect())
    finally:
        q.stop()
    assert q.exception() is None and got == want


def test_cut_off(spark):
    batch = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("a", 2, False), ("b", 0, False)], "stream_id string, seg_seq int, blocked boolean")
    ended = spark.createDataFrame([("b",)], "stream_id string")
    assert sorted((r.stream_id, r.seg_seq) for r in G.cut_off(batch, ended).collect()) == [("a", 0), ("a", 1)]


def test_sources(spark, tmp_path):
    from palisade.sources.tables import texts as read
    from palisade.sources.tables import write_audit

    spark.createDataFrame([("x",), ("y",)], "t string").write.json(str(tmp_path / "j"))
    assert read(spark, str(tmp_path / "j"), "json", "t string").count() == 2
    with pytest.raises(ValueError):
        read(spark, str(tmp_path / "j"), "json")
    df = trips(spark, P.Policy(), ("a", "b"))
    write_audit(report.audit(df, "prompt"), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).where("day is not null").count() == 1


def test_queries_scan_whole_responses(spark, tmp_path):
    """A topic far behind the beginning of a long response is blocked and counted."""
    from palisade.plans.queries import audit_log, metrics_by_scanner
    from palisade.plans.queries import round_trip as outcomes

    long = "plain words and more of them " * 40
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", long + "about drugs"), (4, 0, "user", "hello"), (4, 1, "assistant", long + "the end")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    a, b = outcomes(spark, str(tmp_path)).orderBy("id").collect()
    assert (a.blocked, a.blocked_stage, a.output, a.raw_output) == (True, "output", None, None)
    assert not b.blocked and b.raw_output == f"Wrote to [EMAIL_1]. {long}the end" and b.output.endswith(f"{long}the end")
    n, m = (r.total_findings for r in audit_log(spark, str(tmp_path)).orderBy("id").collect())
    found = {(r.stage, r.scanner): r for r in metrics_by_scanner(spark, str(tmp_path)).collect()}["output", "banned_topic"]
    assert n > 0 and (found.runs, found.blocked, found.findings) == (2, 1, 1)
