"""Policies: which scanners run on which stage, in which order, and how a stage
becomes a plan.

A stage is a chain of columns. Each scanner sees the text that the one before
has left; from the first result that didn't pass on, scanners give null, so
nothing is computed for rows that are blocked already.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import catalog as C
from palisade.functions import text as T
from palisade.operators import scanners as S

INPUT, OUTPUT = "input", "output"
BOTH = (INPUT, OUTPUT)


class Scanner(NamedTuple):
    """What a stage needs of a scanner; anything with the first three will do.
    ``scan`` maps a text column to a result column (``T.RESULT``). A scanner that
    may raise for a row also has ``scan_open``, which then gives nulls."""

    name: str
    stages: tuple[str, ...]
    scan: Callable[[Column], Column]
    scan_open: Callable[[Column], Column] | None = None


def pii(**o) -> Scanner:
    return Scanner("pii", BOTH, lambda t: S.scan_pii(t, **o))


def secret(**o) -> Scanner:
    return Scanner("secret", BOTH, lambda t: S.scan_secret(t, **o))


def prompt_injection(**o) -> Scanner:
    return Scanner("prompt_injection", (INPUT,), lambda t: S.scan_injection(t, **o))


def invisible_text(**o) -> Scanner:
    return Scanner("invisible_text", (INPUT,), lambda t: S.scan_invisible(t, **o))


def banned_topic(topics, **o) -> Scanner:
    return Scanner("banned_topic", BOTH, lambda t: S.scan_topic(t, topics, **o))


def banned_pattern(patterns, name="banned_pattern", **o) -> Scanner:
    return Scanner(name, BOTH, lambda t: S.scan_pattern(t, patterns, name=name, **o))


def token_limit(**o) -> Scanner:
    return Scanner("token_limit", (INPUT,), lambda t: S.scan_tokens(t, **o))


def repetition(**o) -> Scanner:
    return Scanner("repetition", (OUTPUT,), lambda t: S.scan_repetition(t, **o))


def url(**o) -> Scanner:
    return Scanner("url", BOTH, lambda t: S.scan_url(t, **o))


def language(**o) -> Scanner:
    return Scanner("language", BOTH, lambda t: S.scan_language(t, **o))


def code_exec(**o) -> Scanner:
    return Scanner("code_exec", (OUTPUT,), lambda t: S.scan_code(t, **o))


def grounding(context: Column | str = "", **o) -> Scanner:
    return Scanner("grounding", (OUTPUT,), lambda t: S.scan_grounding(t, context, **o))


def schema(schema: dict, **o) -> Scanner:
    return Scanner("schema", (OUTPUT,), lambda t: S.scan_schema(t, schema, **o))


def python_scanner(name: str, scan: Callable[[str], dict | None], stages=BOTH) -> Scanner:
    """A scanner in Python, run in Arrow batches. ``scan(text)`` gives the fields of
    a result (or None for a clean one). If it raises, the row is blocked with the
    error as its reason or, in a policy that fails open, the scanner is passed over."""
    fields = ["scanner", "passed", "score", "text", "findings", "reason", "redaction"]

    def udf(closed: bool):
        @F.pandas_udf(T.RESULT)
        def run(texts):
            import pandas as pd

            rows = []
            for t in texts:
                base = dict(zip(fields, (name, True, 0.0, t, [], None, [])))
                try:
                    rows.append(base if t is None else base | (scan(t) or {}))
                except Exception as e:  # noqa: BLE001 - what a user's scanner raises is the result
                    rows.append(base | {"passed": False, "score": 1.0, "reason": f"scanner error: {e}"} if closed else dict.fromkeys(fields))
            return pd.DataFrame(rows, columns=fields)

        return run

    return Scanner(name, tuple(stages), udf(True), udf(False))


def run_stage(df: DataFrame, scanners: list, stage: str, text: str, out: str, fail_closed: bool = True) -> DataFrame:
    """``df`` with ``out``: struct<text, results, blocker, redaction>.

    Scanners that don't have the stage are left out of the plan. ``results`` ends
    with the result that blocked; ``blocker`` is that one, or null.
    """
    if stage not in BOTH:
        raise ValueError(f"unknown stage: {stage}")
    made: list[str] = []
    current, blocked = F.col(text), F.lit(False)
    for k, s in enumerate(x for x in scanners if stage in x.stages):
        name = f"__{out}_{k}"
        scan = s.scan if fail_closed else getattr(s, "scan_open", None) or s.scan
        df = df.withColumn(name, F.when(~blocked, scan(current)))
        made.append(name)
        r = F.col(name)
        # a scanner that was passed over gives a row of nulls
        df = df.withColumn(name + "_t", F.coalesce(r["text"], current)).withColumn(name + "_b", blocked | ~F.coalesce(r["passed"], F.lit(True)))
        current, blocked = F.col(name + "_t"), F.col(name + "_b")
    results = F.filter(F.array(*map(F.col, made)), lambda r: r["scanner"].isNotNull()) if made else T.empty(T.RESULT)
    df = df.withColumn(f"__{out}_r", results)
    r = F.col(f"__{out}_r")
    redaction = T.merged(F.flatten(F.transform(r, lambda x: x["redaction"])), T.empty(T.TOKEN))
    whole = F.struct(current.alias("text"), r.alias("results"), F.get(F.filter(r, lambda x: ~x["passed"]), F.lit(0)).alias("blocker"), redaction.alias("redaction"))
    return df.withColumn(out, whole).drop(*[n + e for n in made for e in ("", "_t", "_b")], f"__{out}_r")


class Policy:
    """Scanners for the input and for the output of a text-to-text call."""

    def __init__(self, input=(), output=(), fail_closed: bool = True):
        self.input, self.output, self.fail_closed = list(input), list(output), fail_closed

    def scan_input(self, df: DataFrame, text: str, out: str = "scan") -> DataFrame:
        return run_stage(df, self.input, INPUT, text, out, self.fail_closed)

    def scan_output(self, df: DataFrame, text: str, out: str = "scan") -> DataFrame:
        return run_stage(df, self.output, OUTPUT, text, out, self.fail_closed)

    @classmethod
    def from_config(cls, config: dict | str) -> Policy:
        """From a dict or JSON: {"input": [...], "output": [...], "failClosed": true};
        each entry has "type" and that type's options."""
        if isinstance(config, str):
            config = json.loads(config)
        return cls([_build(x) for x in config.get("input") or ()], [_build(x) for x in config.get("output") or ()], config.get("failClosed", True))


#: Options of each type of scanner in a config: name there -> name here.
_OPTIONS = {
    "pii": (pii, {"action": "action", "locales": "locales", "types": "types"}),
    "secret": (secret, {"action": "action"}),
    "prompt_injection": (prompt_injection, {"action": "action", "threshold": "threshold"}),
    "invisible_text": (invisible_text, {"action": "action"}),
    "banned_topic": (banned_topic, {"topics": "topics", "action": "action", "caseSensitive": "case_sensitive"}),
    "banned_pattern": (banned_pattern, {"patterns": "patterns", "action": "action", "name": "name"}),
    "token_limit": (token_limit, {"maxTokens": "max_tokens", "action": "action"}),
    "repetition": (repetition, {"threshold": "threshold", "ngramSize": "ngram_size", "action": "action"}),
    "url": (url, {"action": "action"}),
    "language": (language, {"threshold": "threshold", "action": "action"}),
    "code_exec": (code_exec, {"action": "action"}),
    "grounding": (grounding, {"context": "context", "threshold": "threshold", "action": "action"}),
    "schema": (schema, {"schema": "schema", "action": "action"}),
}


def _build(entry: dict) -> Scanner:
    kind = entry.get("type")
    if kind not in _OPTIONS:
        raise ValueError(f"unknown scanner type: {kind}")
    make, names = _OPTIONS[kind]
    options = {names[k]: v for k, v in entry.items() if k in names and v is not None}
    if options.get("action", "block") not in S.ACTIONS:
        raise ValueError(f"unknown action: {options['action']}")
    if kind == "pii":
        # a config without locales means all of them, unlike the function's default
        options.setdefault("locales", list(C.LOCALES))
        S.pii_patterns(options.get("types"), options["locales"])
    if kind in ("banned_topic", "banned_pattern", "schema"):
        key = {"banned_topic": "topics", "banned_pattern": "patterns", "schema": "schema"}[kind]
        options.setdefault(key, {} if kind == "schema" else [])
    return make(**options)
