"""The scanners: each makes a result column from a text column.

All are plain Column expressions (no Python at run time). ``action`` is ``block``,
``redact``, ``hash`` or ``warn`` and decides, when the plan is built, what is made.
A null text gives a clean result with a null text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import catalog as C
from palisade.functions import dialect as D
from palisade.functions import text as T

ACTIONS = ("block", "redact", "hash", "warn")


def _action(action: str) -> str:
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}")
    return action


def _types(found: Column, cut: str = "") -> Column:
    names = F.array_distinct(F.transform(found, lambda s: s["type"]))
    return F.array_join(F.transform(names, lambda n: F.replace(n, F.lit(cut), F.lit(""))) if cut else names, ", ")


def _number(n: Column, text: str) -> Column:
    return F.format_string(text, n)


def _has_type(found: Column, type_: str) -> Column:
    return F.exists(found, lambda s: s["type"] == type_)


def _hashed(label: str) -> Callable[[Column], Column]:
    return lambda m: F.concat(F.lit(f"[{label}:"), T.hash_digits(m), F.lit("]"))


def _rewritten(t: Column, patterns: list[str] | Column, action: str, label: str) -> Column:
    """One pattern after the other, each over what the one before has made."""
    array = patterns if isinstance(patterns, Column) else T.texts(patterns)
    return T.rewritten(t, array, f"[{label}]" if action == "redact" else _hashed(label))


def _given(t: Column, scanner: str, found: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the findings where there are any, else a clean result."""
    return T.let(found, lambda f: F.when(F.size(f) > 0, body(f)).otherwise(T.clean(scanner, t)))


# personal data


def pii_patterns(types=None, locales=C.DEFAULT_LOCALES) -> list[tuple[int, C.Pii]]:
    unknown = set(locales) - set(C.LOCALES)
    if unknown:
        raise ValueError(f"unknown locale: {sorted(unknown)[0]}")
    return [(k, p) for k, p in enumerate(C.PII) if set(p.locales) & set(locales) and (types is None or p.type in types)]


def pii_spans(t: Column, types=None, locales=C.DEFAULT_LOCALES) -> Column:
    """Resolved spans of personal data, in code points."""
    chosen = [p for _, p in pii_patterns(types, locales)]
    if not chosen:
        return T.empty(T.SPAN)
    least = F.from_json(F.lit(str([p.luhn for p in chosen])), "array<int>")

    def found(skeleton: Column) -> Column:
        gates = []
        for p in chosen:
            gate = F.rlike(skeleton, F.lit(p.digits)) if p.digits else None
            literal = t.contains(p.gate) if p.gate else None
            gates.append(literal if gate is None else gate if literal is None else gate & literal)
        return T.spans_of(t, [T.Pattern(D.java(p.pattern, first=p.first), f"pii.{p.type}") for p in chosen], T.fired(gates))

    spans = T.let(T.digit_skeleton(t), found)
    if any(p.luhn for p in chosen):
        spans = F.filter(spans, lambda x: T.let(F.get(least, x["ord"]), lambda n: (n == 0) | T.luhn_ok(x["match"], n)))
    return T.resolved(spans)


def scan_pii(t: Column, action: str = "redact", types=None, locales=C.DEFAULT_LOCALES, placeholder: str | Callable[[Column], Column] | None = None) -> Column:
    """Personal data. ``placeholder``: a text or a function of a finding's column
    that replaces the numbered token when redacting."""
    _action(action)

    def tokens(f: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            bare = F.upper(F.substring(s["type"], F.lit(5), F.length(s["type"])))
            if action == "hash":
                return F.concat(F.lit("["), bare, F.lit(":"), T.hash_digits(s["match"]), F.lit("]"))
            if placeholder is not None:
                return placeholder(s) if callable(placeholder) else F.lit(placeholder)
            nth = F.size(F.filter(F.slice(f, 1, i + 1), lambda y: y["type"] == s["type"]))
            return F.concat(F.lit("["), bare, F.lit("_"), nth.cast("string"), F.lit("]"))

        return F.transform(f, one)

    def body(f: Column) -> Column:
        found = T.utf16(t, f)
        if action == "block":
            return T.result("pii", False, 1.0, t, found, F.concat(F.lit("blocked: PII detected ("), _types(f), F.lit(")")))
        if action == "warn":
            return T.result("pii", True, 0.5, t, found, "PII detected")
        word = "redacted" if action == "redact" else "hashed"

        def made(k: Column) -> Column:
            pairs = F.transform(f, lambda s, i: F.struct(F.get(k, i).alias("token"), s["match"].alias("original")))
            return T.result("pii", True, 0.5, T.spliced(t, f, k), found, f"PII {word}", T.merged(pairs, T.empty(T.TOKEN)))

        return T.let(tokens(f), made)

    return _given(t, "pii", pii_spans(t, types, locales), body)


# secrets (reconstructed: scores, tokens and reasons are this engine's own)


def scan_secret(t: Column, action: str = "block") -> Column:
    _action(action)
    rules = [(s, D.java(s.pattern, s.ignore_case)) for s in C.SECRETS]
    gates = [F.lower(t).contains(s.gate) if s.ignore_case else t.contains(s.gate) for s, _ in rules]
    found = F.array_sort(T.spans_of(t, [T.Pattern(p, f"secret.{s.rule}") for s, p in rules], T.fired(gates), match=False))

    def body(f: Column) -> Column:
        hits, kinds = T.utf16(t, f), F.concat(F.lit("secret(s) detected: "), _types(f))
        if action == "block":
            return T.result("secret", False, 1.0, t, hits, kinds)
        if action == "warn":
            return T.result("secret", True, 0.5, t, hits, kinds)
        text = _rewritten(t, [p for _, p in rules], action, "SECRET")
        return T.result("secret", True, 0.5, text, hits, kinds)

    return _given(t, "secret", found, body)


# prompt injection


def injection_score(found: Column) -> Column:
    """The sum of the weights of the signals that have a span, 1 at most."""
    total = F.lit(0.0)
    for g in C.INJECTIONS:
        total = total + F.when(_has_type(found, f"injection.{g.name}"), F.lit(g.weight)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), total)


def scan_injection(t: Column, action: str = "block", threshold: float = 0.5) -> Column:
    _action(action)
    name, limit = "prompt_injection", f"{threshold:.2f}"
    groups = [(g, [D.java(p, True) for p in g.patterns]) for g in C.INJECTIONS]
    flat = [(g, p) for g, ps in groups for p in ps]
    patterns = [T.Pattern(p, f"injection.{g.name}", g.weight) for g, p in flat]
    found = T.let(F.lower(t), lambda low: T.spans_of(t, patterns, T.literals_fired(low, C.INJECTION_GATES)))

    def body(f: Column) -> Column:
        hits, score = T.utf16(t, f), injection_score(f)

        def judged(s: Column) -> Column:
            over = F.format_string(f"prompt injection score %.2f >= threshold {limit}; signals: %s", s, _types(f, "injection."))
            under = F.format_string(f"below threshold (%.2f < {limit})", s)
            return F.when(s >= F.lit(float(threshold)), T.result(name, False, s, t, hits, over)).otherwise(T.result(name, True, s, t, hits, under))

        if action == "block":
            return T.let(score, judged)
        if action == "warn":
            return T.result(name, True, score, t, hits, None)
        seen = F.transform(f, lambda x: x["type"])
        fired = F.transform(F.filter(F.arrays_zip(T.texts(p.type for p in patterns).alias("type"), T.texts(p.regex for p in patterns).alias("regex")), lambda x: F.array_contains(seen, x["type"])), lambda x: x["regex"])
        word = "redacted" if action == "redact" else "hashed"
        return T.result(name, True, score, _rewritten(t, fired, action, "INJECTION"), hits, _number(F.size(f), f"{word} %d injection span(s)"))

    return _given(t, name, found, body)


# invisible characters


def scan_invisible(t: Column, action: str = "redact") -> Column:
    _action(action)
    name, any_ = "invisible_text", "[" + "".join(C.INVISIBLE.values()) + "]"

    def kind(m: Column) -> Column:
        out = F.lit("tag")
        for k in ("soft_hyphen", "bidi", "zero_width"):
            out = F.when(F.rlike(m, F.lit(f"[{C.INVISIBLE[k]}]")), F.lit(k)).otherwise(out)
        return out

    found = F.transform(T.spans_of(t, [T.Pattern(any_, "invisible.")]), lambda s: s.withField("type", F.concat(F.lit("invisible."), kind(s["match"]))))

    def body(f: Column) -> Column:
        hits, n = T.utf16(t, f), F.size(f)
        if action == "block":
            return T.result(name, False, 1.0, t, hits, _number(n, "found %d invisible character(s)"))
        if action == "warn":
            return T.result(name, True, 0.5, t, hits, _number(n, "found %d invisible character(s)"))
        if action == "redact":
            return T.result(name, True, 0.5, F.regexp_replace(t, F.lit(any_), F.lit("")), hits, _number(n, "stripped %d invisible character(s)"))
        text = T.replaced(t, F.lit(any_), lambda m: F.concat(F.lit("["), kind(m), F.lit(":"), T.hash_digits(m), F.lit("]")))
        return T.result(name, True, 0.5, text, hits, _number(n, "tokenized %d invisible character(s)"))

    return _given(t, name, found, body)


# banned topics and patterns


def topic_regex(topic: str, case_sensitive: bool = False) -> str:
    return D.java(rf"\b{D.escape(topic)}\b", unicode_case=not case_sensitive)


def _topic_gate(t: Column, low: Column, topic: str) -> Column | None:
    """A cheap test that texts with the topic pass. Three letters beyond ASCII are
    the same as ASCII ones when case doesn't count, but not in lower case."""
    if not topic.isascii():
        return None
    out = low.contains(topic.lower())
    for c in "\u017f\u0131\u0130":
        out = out | t.contains(c)
    return out


def scan_topic(t: Column, topics: list[str], action: str = "block", case_sensitive: bool = False) -> Column:
    _action(action)
    name = "banned_topic"
    patterns = [topic_regex(x, case_sensitive) for x in topics]
    if not topics:
        return T.clean(name, t)
    rules = [T.Pattern(p, f"topic.{x}") for x, p in zip(topics, patterns)]
    found = T.let(F.lower(t), lambda low: T.spans_of(t, rules, T.fired([_topic_gate(t, low, x) for x in topics])))

    def body(f: Column) -> Column:
        hits = T.utf16(t, f)
        if action == "block":
            return T.result(name, False, 1.0, t, hits, F.concat(F.lit("banned topic(s): "), _types(f, "topic.")))
        if action == "warn":
            return T.result(name, True, 0.5, t, hits, None)
        word = "redacted" if action == "redact" else "hashed"
        return T.result(name, True, 0.5, _rewritten(t, patterns, action, "TOPIC"), hits, _number(F.size(f), f"{word} %d topic match(es)"))

    return _given(t, name, found, body)


def scan_pattern(t: Column, patterns: list[str], action: str = "block", name: str = "banned_pattern", literal: bool = False) -> Column:
    _action(action)
    regexes = [D.java(D.escape(p)) if literal else D.user(p) for p in patterns]
    if not regexes:
        return T.clean(name, t)
    gates = [t.contains(p) if literal else None for p in patterns]
    found = T.spans_of(t, [T.Pattern(p, "banned_pattern.match") for p in regexes], T.fired(gates))
    # by start, then by pattern
    found = F.array_sort(F.transform(found, lambda s: s.withField("neg", F.lit(0))))

    def body(f: Column) -> Column:
        hits, n = T.utf16(t, f), F.size(f)
        if action == "block":
            return T.result(name, False, 1.0, t, hits, _number(n, "blocked: %d banned pattern(s) matched"))
        if action == "warn":
            return T.result(name, True, 0.5, t, hits, _number(n, "warning: %d banned pattern(s) matched"))
        word = "redacted" if action == "redact" else "hashed"
        return T.result(name, True, 0.5, _rewritten(t, regexes, action, "BANNED"), hits, _number(n, f"{word} %d banned pattern(s)"))

    return _given(t, name, found, body)


# token budget


def token_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(D.java(C.TOKEN)))


def scan_tokens(t: Column, max_tokens: int = 4096, action: str = "block") -> Column:
    _action(action)
    name = "token_limit"

    def body(n: Column) -> Column:
        reason = _number(n, f"token limit exceeded: ~%d tokens > {max_tokens}")
        one = F.array(F.struct(F.lit("token_limit.exceeded").alias("type"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(None).cast("string").alias("match"), F.lit(1.0).alias("confidence")))
        over = T.result(name, action != "block", 1.0 if action == "block" else 0.5, t, one, reason)
        return F.when(n > max_tokens, over).otherwise(T.clean(name, t))

    return T.let(token_count(t), body)


# repetition


def _finding(type_: str, match: Column, confidence: Column) -> Column:
    return F.struct(F.lit(type_).alias("type"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), match.alias("match"), confidence.cast("double").alias("confidence"))


def _percent(x: float) -> str:
    """A share in whole per cent, halves up."""
    return str(math.floor(x * 100 + 0.5))


def ngrams(t: Column, n: int) -> Column:
    """The runs of ``n`` words, each joined by a space; words at the ends may be empty."""

    def make(w: Column) -> Column:
        last = F.size(w) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))

    return T.let(F.split(t, D.java(r"\s+"), -1), make)


def scan_repetition(t: Column, ngram_size: int = 3, threshold: float = 0.3, action: str = "block") -> Column:
    _action(action)
    name = "repetition"

    def top(g: Column) -> Column:
        """The five most frequent grams that come twice or more: runs in sorted order."""

        def runs(v: Column) -> Column:
            begins = F.filter(F.transform(v, lambda y, i: F.when((i == 0) | (y["v"] != F.get(v, i - 1)["v"]), i)), lambda i: i.isNotNull())

            def counted(b: Column) -> Column:
                return F.transform(b, lambda at, j: F.struct((at - F.coalesce(F.get(b, j + 1), F.size(v))).alias("c"), F.get(v, at)["i"].alias("i"), F.get(v, at)["v"].alias("v")))

            return F.slice(F.array_sort(F.filter(T.let(begins, counted), lambda r: r["c"] < -1)), 1, 5)

        return T.let(F.array_sort(F.transform(g, lambda y, i: F.struct(y.alias("v"), i.alias("i")))), runs)

    def body(x: Column) -> Column:
        g, n = x["g"], F.size(x["g"])
        score = F.lit(1.0) - x["u"] / n.cast("double")

        def flagged(s: Column) -> Column:
            hits = F.transform(top(g), lambda r: _finding("repetition.ngram", r["v"], (-r["c"]) / n.cast("double")))
            reason = F.format_string(f"%.0f%% repetition (threshold {_percent(threshold)}%%)", s * 100)
            return F.when(s < F.lit(float(threshold)), T.clean(name, t)).otherwise(T.result(name, action == "warn", s, t, hits, reason))

        return F.when(n < 2, T.clean(name, t)).otherwise(T.let(score, flagged))

    return T.let(T.let(ngrams(t, ngram_size), lambda g: F.struct(g.alias("g"), F.size(F.array_distinct(g)).alias("u"))), body)


# URLs


def url_findings(t: Column, categories=C.URL_CATEGORIES) -> Column:
    """Spans of suspicious URLs; one URL may have several."""

    def kinds(u: Column) -> Column:
        rest = [F.when(F.rlike(u, F.lit(D.java(C.URL_CHECKS[k], k in ("punycode", "shortener", "suspicious_tld")))), F.lit(k)) for k in C.URL_CHECKS if k in categories]
        out = F.array_compact(F.array(*rest)) if rest else F.array().cast("array<string>")
        low = F.lower(u)
        for k, head in (("javascript_uri", "javascript:"), ("data_uri", "data:")):
            if k in categories:
                out = F.when(low.startswith(head), F.array(F.lit(k))).otherwise(out)
        return out

    urls = T.spans_of(t, [T.Pattern(D.java(C.URL, True), "url.")])
    return F.flatten(F.transform(urls, lambda s: F.transform(kinds(s["match"]), lambda k: s.withField("type", F.concat(F.lit("url."), k)))))


def scan_url(t: Column, action: str = "block", categories=C.URL_CATEGORIES) -> Column:
    _action(action)
    if set(categories) - set(C.URL_CATEGORIES):
        raise ValueError("unknown URL category")

    def body(f: Column) -> Column:
        hits, kinds = T.utf16(t, f), _types(f, "url.")
        if action == "warn":
            return T.result("url", True, 0.5, t, hits, F.concat(F.lit("suspicious URLs detected ("), kinds, F.lit(")")))
        return T.result("url", False, 1.0, t, hits, F.concat(F.lit("blocked: "), kinds))

    return _given(t, "url", url_findings(t, categories), body)


# scripts


def _of_scripts(t: Column, scripts) -> Column:
    """The characters of ``t`` that belong to the scripts, in order."""
    return F.regexp_replace(t, F.lit("[^" + "".join(C.SCRIPTS[k] for k in scripts) + "]+"), F.lit(""))


def scan_language(t: Column, action: str = "block", expected=("latin",), threshold: float = 0.7) -> Column:
    """Scripts are counted on what is left of a text when all that isn't theirs is
    taken out: short for what isn't expected."""
    _action(action)
    if set(expected) - set(C.SCRIPTS):
        raise ValueError("unknown script")
    name = "language"
    others = [k for k in C.SCRIPTS if k not in expected]
    own = F.length(_of_scripts(t, expected)) if expected else F.lit(0)

    def counts(x: Column) -> Column:
        """array<struct<n (negative), first, name>>"""
        one = [F.struct((-F.regexp_count(x, F.lit(f"[{C.SCRIPTS[k]}]"))).alias("n"), F.length(F.regexp_extract(x, f"^[^{C.SCRIPTS[k]}]*", 0)).alias("first"), F.lit(k).alias("name")) for k in others]
        return F.struct(own.alias("own"), F.length(x).alias("rest"), F.array(*one).alias("s"))

    def body(v: Column) -> Column:
        total = (v["own"] + v["rest"]).cast("double")

        def judged(ratio: Column) -> Column:
            top = F.slice(F.array_sort(F.filter(v["s"], lambda x: x["n"] < 0)), 1, 3)
            hits = F.transform(top, lambda x: _finding("language.unexpected_script", x["name"], (-x["n"]) / total))
            reason = F.format_string(f"%.0f%% expected script (threshold {_percent(threshold)}%%)", ratio * 100)
            bad = T.result(name, action == "warn", F.lit(1.0) - ratio, t, hits, reason)
            return F.when((total < 10) | (ratio >= F.lit(float(threshold))), T.clean(name, t)).otherwise(bad)

        return T.let(F.when(total > 0, v["own"] / total).otherwise(F.lit(1.0)), judged)

    if not others or threshold > 1:
        rest = _of_scripts(t, others) if others else F.lit("")
        return F.when(t.isNull(), T.clean(name, t)).otherwise(T.let(T.let(rest, counts) if others else F.struct(own.alias("own"), F.lit(0).alias("rest"), F.array().cast("array<struct<n:int,first:int,name:string>>").alias("s")), body))
    # most texts are of the expected scripts alone: one look decides
    some = F.rlike(t, F.lit("[" + "".join(C.SCRIPTS[k] for k in others) + "]"))
    return F.when(some, T.let(T.let(_of_scripts(t, others), counts), body)).otherwise(T.clean(name, t))


# code


def scan_code(t: Column, action: str = "block", categories=("shell", "sql", "injection", "filesystem")) -> Column:
    _action(action)
    name = "code_exec"
    chosen = [(T.Pattern(D.java(p, ci), f"code_exec.{c}"), need) for (c, p, ci), need in zip(C.CODE, C.CODE_GATES) if c in categories]
    if not chosen:
        return T.clean(name, t)
    found = T.let(F.lower(t), lambda low: T.spans_of(t, [p for p, _ in chosen], T.literals_fired(low, [need for _, need in chosen])))

    def body(f: Column) -> Column:
        hits = T.utf16(t, f)
        if action == "warn":
            seen = F.array_join(F.array_distinct(F.transform(f, lambda s: s["match"])), ", ")
            return T.result(name, True, 1.0, t, hits, F.concat(F.lit("dangerous code detected: "), seen))
        return T.result(name, False, 1.0, t, hits, "blocked: code_exec")

    return _given(t, name, found, body)


# grounding


def content_words(t: Column) -> Column:
    """Distinct lower-cased words without function words, in order of appearance."""
    words = F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(C.CONTENT_WORD), 0), lambda w: F.lower(w))
    return F.array_except(F.filter(words, lambda w: F.length(w) > 1), F.array(*map(F.lit, C.STOP_WORDS)))


def scan_grounding(t: Column, context: Column | str = "", threshold: float = 0.5, action: str = "warn") -> Column:
    """``context``: a text or a column (a joined source document)."""
    _action(action)
    name = "grounding"
    source = context if isinstance(context, Column) else F.lit(context)

    def body(x: Column) -> Column:
        w, missing = x["w"], x["missing"]
        ratio = (F.size(w) - F.size(missing)) / F.size(w).cast("double")

        def judged(r: Column) -> Column:
            hits = F.transform(F.slice(missing, 1, 10), lambda m: _finding("grounding.unsupported_claim", m, F.lit(1.0) - r))
            reason = F.format_string(f"%.0f%% grounded (threshold {_percent(threshold)}%%)", r * 100)
            return F.when(r >= F.lit(float(threshold)), T.clean(name, t)).otherwise(T.result(name, action == "warn", F.lit(1.0) - r, t, hits, reason))

        return F.when(F.size(w) < 3, T.clean(name, t)).otherwise(T.let(ratio, judged))

    return T.let(T.let(content_words(t), lambda w: F.struct(w.alias("w"), F.array_except(w, content_words(source)).alias("missing"))), body)


# JSON structure

_KINDS = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|DECIMAL"}


def _kind_ok(v: Column, kind: str) -> Column:
    """Unknown kinds always pass."""
    if kind not in _KINDS:
        return F.lit(True)
    return F.coalesce(F.rlike(F.schema_of_variant(v), F.lit(f"^(?:{_KINDS[kind]})")), F.lit(False))


def _path(key: str) -> str:
    return '$["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def scan_schema(t: Column, schema: dict, action: str = "block") -> Column:
    """``schema``: type, required, properties.<key>.type. Objects that repeat a key
    count as not parsed."""
    _action(action)
    name = "schema"

    def one(type_: str, key: str | None, message: str) -> Column:
        return F.struct(F.lit(type_).alias("type"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(key).cast("string").alias("match"), F.lit(1.0).alias("confidence"), F.lit(message).alias("m"))

    # the parser takes text after the value: a mark behind it must come out as the second element
    def parsed(mark: Column) -> Column:
        return T.let(F.try_parse_json(F.concat(F.lit("["), t, F.lit(',"'), mark, F.lit('"]'))), lambda x: checked(x, mark))

    def checked(x: Column, mark: Column) -> Column:
        return T.let(F.try_variant_get(x, "$[0]", "variant"), lambda v: violations(x, mark, v))

    def violations(x: Column, mark: Column, v: Column) -> Column:
        whole = F.coalesce((F.try_variant_get(x, "$[1]", "string") == mark) & F.try_variant_get(x, "$[2]", "variant").isNull() & v.isNotNull(), F.lit(False))
        is_object = _kind_ok(v, "object")
        found = []
        if schema.get("type"):
            found.append(F.when(~_kind_ok(v, schema["type"]), one("schema.type", None, f'expected type "{schema["type"]}"')))
        for k in schema.get("required") or ():
            found.append(F.when(is_object & F.try_variant_get(v, _path(k), "variant").isNull(), one("schema.required", k, f'missing required key "{k}"')))
        for k, spec in (schema.get("properties") or {}).items():
            if spec.get("type"):
                p = F.try_variant_get(v, _path(k), "variant")
                found.append(F.when(is_object & p.isNotNull() & ~_kind_ok(p, spec["type"]), one("schema.property", k, f'property "{k}" must be "{spec["type"]}"')))
        bad = F.array_compact(F.array(*found)) if found else F.array(one("", None, "")).cast("array<struct<type:string,start:int,end:int,match:string,confidence:double,m:string>>")
        bad = bad if found else F.filter(bad, lambda s: F.lit(False))
        return F.when(whole, bad).otherwise(F.array(one("schema.parse", None, "invalid JSON")))

    def body(f: Column) -> Column:
        reason = F.concat(F.lit("schema validation failed: "), F.array_join(F.transform(f, lambda s: s["m"]), "; "))
        hits = F.transform(f, lambda s: F.struct(s["type"], s["start"], s["end"], s["match"], s["confidence"]))
        return T.result(name, action == "warn", 0.5 if action == "warn" else 1.0, t, hits, reason)

    return _given(t, name, T.let(F.hex(F.xxhash64(t)), parsed), body)
