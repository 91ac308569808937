"""Guarding a response that comes in chunks.

``segments`` cuts whole streams that are stored already; ``stream_segments`` does so
while chunks come in, with one state per stream. Chunks have an explicit number
(they may arrive in any order) and the last one says so. A segment ends with a
boundary; each is scanned alone; the first that is blocked ends its stream.

``guarded_talk`` and ``guard_stream`` are the whole guard, for stored and for live
streams: the prompt is scanned first, and a stream whose prompt is blocked gives
one empty blocked segment; segments are scanned as they are cut, what a scanner
makes of them gets the prompt's values back for its tokens, and nothing follows a
blocked segment.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from palisade.functions import dialect as D
from palisade.functions import text as T
from palisade.plans.policy import OUTPUT, Policy, run_stage

SEGMENT = "stream_id string, seg_seq int, text string"
GUARDED = f"stream_id string, seg_seq int, text string, blocked boolean, block_reason string, findings array<{T.FINDING}>"
#: A stream's state: the next chunk and segment, the open text, whether it has ended, and chunks that came early.
STATE = "next int, seg int, open string, done boolean, early array<struct<n:int,chunk:string,last:boolean>>"


def segments(chunks: DataFrame, boundary: str = "\n", regex: bool = False, one_per_chunk: bool = False) -> DataFrame:
    """stream_id, seg_seq, text of stored chunks (stream_id, chunk_seq, chunk).

    ``one_per_chunk``: each chunk gives one segment at most, and what is left comes
    as one with the last; for literal boundaries (where a pattern's match ends may
    depend on the chunk that hasn't come yet).
    """
    if regex and one_per_chunk:
        raise ValueError("one segment a chunk needs a literal boundary")
    pattern = D.user(boundary) if regex else D.java(D.escape(boundary))
    whole = chunks.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("chunk_seq", "chunk"))).alias("c"))
    pieces = F.transform("c", lambda x: x["chunk"])
    text = F.array_join(pieces, "")
    parts = whole.select("stream_id", F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.transform(pieces, lambda x: F.length(F.coalesce(x, F.lit("")))).alias("n"))
    joined = F.transform("p", lambda p, i: F.concat(p, F.coalesce(F.get(F.col("m"), i), F.lit(""))))
    if one_per_chunk:
        joined = T.let(joined, lambda s: _one_a_chunk(s, F.col("n")))
    return parts.select("stream_id", F.posexplode(F.filter(joined, lambda s: s != "")).alias("seg_seq", "text"))


def _one_a_chunk(parts: Column, lengths: Column) -> Column:
    """The segments that chunks of these lengths give, and the rest as one."""

    def step(acc: Column, n: Column) -> Column:
        # held: what has come and isn't given out; a part is whole once it is held, but for the last
        held, part = acc["held"] + n, F.length(F.get(parts, acc["k"]))
        ready = (acc["k"] < F.size(parts) - 1) & (part <= held)
        return F.struct(F.when(ready, acc["k"] + 1).otherwise(acc["k"]).alias("k"), F.when(ready, held - part).otherwise(held).alias("held"))

    def cut(k: Column) -> Column:
        return F.concat(F.slice(parts, F.lit(1), k), F.array(F.array_join(F.slice(parts, k + 1, F.size(parts)), "")))

    zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("held"))
    return T.let(F.aggregate(lengths, zero, step, lambda acc: acc["k"]), cut)


def guarded(parts: DataFrame, scanners: list, redaction: str | None = None) -> DataFrame:
    """stream_id, seg_seq, text, blocked, block_reason, findings: segments up to
    and with the first blocked one, which keeps its raw text. ``redaction``: a
    column of the prompt's redactions, for rehydration."""
    df = run_stage(parts, scanners, OUTPUT, "text", "__scan").withColumn("__stop", F.col("__scan.blocker").isNotNull())
    before = Window.partitionBy("stream_id").orderBy("seg_seq").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__gone", F.coalesce(F.max("__stop").over(before), F.lit(False))).where(~F.col("__gone"))
    done = F.col("__scan.text")
    if redaction:
        done = T.rehydrated(done, F.col(redaction))
    return df.select(
        "stream_id",
        "seg_seq",
        F.when(F.col("__stop"), F.col("text")).otherwise(done).alias("text"),
        F.col("__stop").alias("blocked"),
        F.col("__scan.blocker.reason").alias("block_reason"),
        F.flatten(F.transform("__scan.results", lambda r: r["findings"])).alias("findings"),
    )


def _prompts(prompts: DataFrame, policy: Policy, prompt: str) -> DataFrame:
    """stream_id, in: the input stage's result. The row number keeps filters on it
    above it: pushed below, they would have the whole stage computed again."""
    rows = prompts.select(F.col("stream_id").cast("string").alias("stream_id"), prompt)
    return policy.scan_input(rows, prompt, "in").select("stream_id", "in", F.monotonically_increasing_id().alias("at"))


def _stopped(scanned: DataFrame) -> DataFrame:
    """One empty blocked segment for each stream whose prompt is blocked."""
    found = F.flatten(F.transform("in.results", lambda r: r["findings"]))
    rows = scanned.where("in.blocker is not null and at >= 0")
    return rows.select("stream_id", F.lit(0).alias("seg_seq"), F.lit("").alias("text"), F.lit(True).alias("blocked"), F.col("in.blocker.reason").alias("block_reason"), found.alias("findings"))


def guarded_talk(prompts: DataFrame, chunks: DataFrame, policy: Policy, prompt: str = "prompt", boundary: str = "\n", one_per_chunk: bool = True) -> DataFrame:
    """The guard over stored streams: prompts (stream_id, prompt) and their chunks
    (stream_id, chunk_seq, chunk). Streams without a prompt aren't guarded by one
    and are left out; prompts without chunks give nothing, unless they are blocked."""
    scanned = _prompts(prompts, policy, prompt)
    free = scanned.where("in.blocker is null and at >= 0").select("stream_id", F.col("in.redaction").alias("__redaction"))
    parts = segments(chunks.withColumn("stream_id", F.col("stream_id").cast("string")), boundary, one_per_chunk=one_per_chunk).join(free, "stream_id")
    return guarded(parts, policy.output, "__redaction").unionByName(_stopped(scanned))


class Cutter:
    """One stream's state: chunks that came early, and the text that is open."""

    def __init__(self, boundary: str = "\n", regex: bool = False, one_per_chunk: bool = False):
        self.pattern = D.python(boundary if regex else D.escape(boundary))
        self.one = one_per_chunk

    def feed(self, state: dict, chunks: list[tuple[int, str, bool]]) -> list[tuple[int, str]]:
        """New segments; ``state``: next, seg, open, early, done."""
        if state["done"]:
            return []
        early, out = {**state["early"], **{n: (c, last) for n, c, last in chunks if n >= state["next"]}}, []

        def emit(text: str) -> None:
            out.append((state["seg"], text))
            state["seg"] += 1

        while state["next"] in early and not state["done"]:
            chunk, last = early.pop(state["next"])
            state["next"] += 1
            state["open"] += chunk or ""
            while m := self.pattern.search(state["open"]):
                emit(state["open"][: m.end()])
                state["open"] = state["open"][m.end() :]
                if self.one:
                    break
            if last:
                if state["open"]:
                    emit(state["open"])
                state["open"], state["done"], early = "", True, {}
        state["early"] = early
        return out


def stream_segments(chunks: DataFrame, boundary: str = "\n", regex: bool = False, one_per_chunk: bool = False, timeout_ms: int | None = 3_600_000) -> DataFrame:
    """Segments of a streaming DataFrame (stream_id, chunk_seq, chunk, is_last).

    ``one_per_chunk``: each chunk gives one segment at most and what is left comes
    with the last one; else all whole segments are given at once. A stream that
    is silent for ``timeout_ms`` is flushed and forgotten; with None states stay
    (a query with a time-out runs batches without data, so one that is to end by
    itself, as with ``availableNow``, needs None). Chunks that come early are held
    until those before them have come, or the stream times out.
    """
    if regex:
        D.check(boundary)
    cutter = {}

    def step(key, frames: Iterator, group):
        import pandas as pd

        if not cutter:
            cutter[0] = Cutter(boundary, regex, one_per_chunk)
        state = {"next": 0, "seg": 0, "open": "", "early": {}, "done": False}
        if group.exists:
            state["next"], state["seg"], state["open"], state["done"], early = group.get
            state["early"] = {int(x["n"]): (x["chunk"], x["last"]) for x in early}
        if group.hasTimedOut:
            out = [(state["seg"], state["open"])] if state["open"] else []
            group.remove()
        else:
            rows = [(int(n), c, bool(e)) for f in frames for n, c, e in zip(f["chunk_seq"], f["chunk"], f["is_last"])]
            out = cutter[0].feed(state, rows)
            group.update((state["next"], state["seg"], state["open"], state["done"], [{"n": n, "chunk": c, "last": e} for n, (c, e) in state["early"].items()]))
            if timeout_ms is not None:
                group.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "seg_seq": [n for n, _ in out], "text": [t for _, t in out]}).astype({"seg_seq": "int32"})

    rows = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("chunk_seq").cast("int").alias("chunk_seq"), "chunk", "is_last")
    return rows.groupBy("stream_id").applyInPandasWithState(step, SEGMENT, STATE, "append", "NoTimeout" if timeout_ms is None else "ProcessingTimeTimeout")


def guarded_stream(parts: DataFrame, scanners: list) -> DataFrame:
    """Scans a streaming DataFrame of segments; each row says whether it is blocked.
    It doesn't end a stream: ``guard_stream`` does, or ``cut_off`` in a sink of one's own."""
    df = run_stage(parts, scanners, OUTPUT, "text", "__scan")
    stop = F.col("__scan.blocker").isNotNull()
    return df.select(
        "stream_id", "seg_seq", F.when(stop, F.col("text")).otherwise(F.col("__scan.text")).alias("text"), stop.alias("blocked"), F.col("__scan.blocker.reason").alias("block_reason"),
        F.flatten(F.transform("__scan.results", lambda r: r["findings"])).alias("findings"),
    )


def cut_off(batch: DataFrame, ended: DataFrame) -> DataFrame:
    """Rows of a batch up to each stream's first blocked segment, without streams
    that ``ended`` (stream_id) in earlier batches."""
    before = Window.partitionBy("stream_id").orderBy("seg_seq").rowsBetween(Window.unboundedPreceding, -1)
    left = batch.join(ended.select("stream_id").distinct(), "stream_id", "left_anti")
    return left.withColumn("__gone", F.coalesce(F.max("blocked").over(before), F.lit(False))).where(~F.col("__gone")).drop("__gone")


def guard_stream(
    chunks: DataFrame, prompts: DataFrame, policy: Policy, path: str, prompt: str = "prompt", boundary: str = "\n", regex: bool = False, one_per_chunk: bool = True, timeout_ms: int | None = 3_600_000
) -> DataStreamWriter:
    """The guard over a stream of chunks; start it with a checkpoint location.

    ``prompts`` is a stored table (stream_id, prompt) that has a stream's prompt
    when its first segment comes; it is scanned when the query is made, and its
    results are written below ``path``. Streams whose prompts are blocked end with
    the first batch after that. Each micro-batch of segments is joined to
    them, scanned, cut off and written to a folder of its number, and the streams
    that end in it to another; a batch that runs again replaces its own folders and
    takes only earlier batches' ends into account, so a restart changes nothing.
    """
    scanned = _prompts(prompts, policy, prompt)
    scanned.write.mode("overwrite").parquet(f"{path}/prompts")

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(scanned.schema).parquet(f"{path}/prompts")
        spark.createDataFrame([], "stream_id string").write.mode("overwrite").parquet(f"{path}/ended/batch=-1")
        ended = spark.read.schema("stream_id string, batch bigint").parquet(f"{path}/ended").where(f"batch < {number}")
        free = known.where("in.blocker is null").select("stream_id", F.col("in.redaction").alias("__redaction"))
        left = batch.join(free, "stream_id").join(ended.select("stream_id").distinct(), "stream_id", "left_anti")
        stopped = _stopped(known).join(ended.select("stream_id").distinct(), "stream_id", "left_anti")
        guarded(left, policy.output, "__redaction").unionByName(stopped).write.mode("overwrite").parquet(f"{path}/segments/batch={number}")
        made = spark.read.schema(GUARDED).parquet(f"{path}/segments/batch={number}")
        made.where("blocked").select("stream_id").distinct().write.mode("overwrite").parquet(f"{path}/ended/batch={number}")

    return stream_segments(chunks, boundary, regex, one_per_chunk, timeout_ms).writeStream.foreachBatch(each)


def guarded_output(spark: SparkSession, path: str) -> DataFrame:
    """What ``guard_stream`` has written so far."""
    return spark.read.schema(f"{GUARDED}, batch bigint").parquet(f"{path}/segments").drop("batch")
