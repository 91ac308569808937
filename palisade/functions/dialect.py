r"""Patterns are written once, in the ECMAScript dialect without flags, and are
rendered for Java (Spark) and RE2 (the SQL oracles).

There ``\b``, ``\w`` and ``\d`` are ASCII and ``\s`` is any Unicode white space.
Java's ``\b`` looks at Unicode letters and its ``\s`` is ASCII; RE2's ``\b`` is ASCII.
"""

from __future__ import annotations

import re

#: What \s matches, to stand inside a class.
SPACE_JAVA = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
SPACE_RE2 = "\\t\\n\\x0B\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NO_BOUNDARY = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
_LETTER = re.compile(r"[A-Za-z0-9_]")


def _atoms(pattern: str):
    """(atom, in a class) one by one; an atom is a character or an escape."""
    i, inside = 0, False
    while i < len(pattern):
        n = 2 if pattern[i] == "\\" else 1
        atom = pattern[i : i + n]
        if atom == "[" and not inside:
            inside = True
            yield atom, False
        elif atom == "]" and inside:
            inside = False
            yield atom, False
        else:
            yield atom, inside
        i += n


def _sure_word(pattern: str, at: int, ahead: bool) -> bool:
    r"""Whether what stands next to a \b is surely a word character."""
    if ahead:
        rest = pattern[at:]
        if rest.startswith(("\\d", "\\w")):
            # an optional atom may match nothing
            return not re.match(r"\\[dw](?:\?|\*|\{0)", rest)
        if rest[:1] == "[":
            m = re.match(r"\[([A-Za-z0-9-]+)\](?!\?|\*|\{0)", rest)
            return bool(m)
        return bool(_LETTER.match(rest)) and not re.match(r"\w(?:\?|\*|\{0)", rest) or bool(re.match(r"\((?!\?)[a-z]", rest)) and ")?" not in rest
    before = pattern[:at]
    m = re.search(r"(?:\\[dw]|\[[A-Za-z0-9-]+\]|(?<!\\)[A-Za-z0-9_])(?:\{[1-9]\d*(?:,\d*)?\}|\+)?$", before)
    return bool(m) and not re.search(r"\\[bsBSD]$", before)


def java(pattern: str, ignore_case: bool = False, unicode_case: bool = False, first: str = "", one_sided: bool = True) -> str:
    """For Spark's functions. ``first``: a class that matches begin with, looked at
    before all else. ``one_sided``: a look to one side replaces a boundary whose other
    side is sure, as far as the first branch of a group tells (catalogue patterns)."""
    out, at = [], 0
    for atom, inside in _atoms(pattern):
        at += len(atom)
        if atom == "\\s":
            out.append(SPACE_JAVA if inside else f"[{SPACE_JAVA}]")
        elif atom == "\\S" and not inside:
            out.append(f"[^{SPACE_JAVA}]")
        elif atom == "\\b" and not inside:
            if one_sided and _sure_word(pattern, at, True):
                out.append(f"(?<!{_WORD})")
            elif one_sided and _sure_word(pattern, at - 2, False):
                out.append(f"(?!{_WORD})")
            else:
                out.append(_BOUNDARY)
        elif atom == "\\B" and not inside:
            out.append(_NO_BOUNDARY)
        elif not one_sided and not inside and atom == "$":
            out.append("\\z")
        elif not one_sided and not inside and atom == ".":
            out.append("[^\\n\\r\\u2028\\u2029]")
        elif inside and atom in "[&":
            out.append("\\" + atom)
        else:
            out.append(atom)
    text = "".join(out)
    if one_sided:
        # a run of a class without @ that an @ must follow never gives characters back
        text = re.sub(r"(\[(?!\^)[^\]@]*\]\+)@", r"\1+@", text)
    return ("(?iu)" if unicode_case else "(?i)" if ignore_case else "") + (f"(?={first})" if first else "") + text


def python(pattern: str):
    """A user's pattern for Python's side of a stream, from the same translation."""
    import regex

    return regex.compile(java(pattern, one_sided=False).replace("\\z", "\\Z"), regex.ASCII)


def re2(pattern: str, ignore_case: bool = False) -> str:
    """For DuckDB. Patterns must have no looks behind."""
    if "(?<" in pattern or "(?!" in pattern or "(?=" in pattern:
        raise ValueError(f"RE2 has no look-around: {pattern}")
    out = []
    for atom, inside in _atoms(pattern):
        if atom == "\\s":
            out.append(SPACE_RE2 if inside else f"[{SPACE_RE2}]")
        elif atom == "\\S" and not inside:
            out.append(f"[^{SPACE_RE2}]")
        elif inside and atom == "[":
            out.append("\\[")
        else:
            out.append(re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", atom))
    text = re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", "".join(out))
    return ("(?i)" if ignore_case else "") + text


def escape(text: str) -> str:
    """A literal as a pattern in either dialect."""
    return re.sub(r"([\\^$.|?*+()\[\]{}/-])", r"\\\1", text).replace("\\-", "-").replace("\\/", "/")


def compiled(pattern: str):
    """A user's pattern as java.util.regex.Pattern: the form that Spark's functions use."""
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    jvm = SparkContext.getOrCreate()._jvm
    try:
        return jvm.java.util.regex.Pattern.compile(java(pattern, one_sided=False))
    except IllegalArgumentException as e:
        raise ValueError(f"bad pattern {pattern!r}: {str(e).splitlines()[0]}") from None


def check(pattern: str) -> str:
    """A user's pattern, or ValueError: Java must compile it and it must not match the empty text."""
    if compiled(pattern).matcher("").find():
        raise ValueError(f"pattern matches the empty text: {pattern}")
    return pattern


def user(pattern: str) -> str:
    """A user's pattern, checked, for Spark's functions."""
    return java(check(pattern), one_sided=False)
