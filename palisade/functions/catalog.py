r"""Pattern catalogues as data. Patterns, weights, names and word lists."""

from __future__ import annotations

from typing import NamedTuple

# Fixed values from here to the end of the file: what is detected must not vary.
LOCALES = ("us", "eu", "india", "brazil", "mexico", "japan", "southKorea", "canada", "australia")
DEFAULT_LOCALES = ("us", "eu", "india")


class Pii(NamedTuple):
    type: str
    locales: tuple[str, ...]
    pattern: str
    luhn: int = 0  # least digits for the checksum, 0: none
    re2: str = ""  # where the pattern looks behind: the same without
    gate: str = ""  # a text that every match has
    first: str = ""  # a class that every match begins with, where the pattern's start is costly to test
    digits: str = ""  # what every match has in its text's digit skeleton


_US_PHONE = r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"

PII = (
    Pii("email", LOCALES, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", gate="@"),
    Pii("credit_card", LOCALES, r"\b(?:\d{13,19}|\d{4}(?:[ -]?\d{4}){2,4})\b", 12, first="[0-9]", digits=r"[0-9]{12}|[0-9]{4}x?[0-9]{4}x?[0-9]{4}"),
    Pii("ip", LOCALES, r"\b(?:\d{1,3}\.){3}\d{1,3}\b", first="[0-9]", digits=r"[0-9]x[0-9]{1,3}x[0-9]{1,3}x[0-9]"),
    Pii("passport", LOCALES, r"\b[A-Z]\d{7}\b", digits=r"[0-9]{7}"),
    Pii("phone", ("us",), _US_PHONE, first="[0-9+(]", digits=r"[0-9]{3}x?[0-9]{3}x?[0-9]{4}"),
    Pii("ssn", ("us",), r"\b\d{3}-\d{2}-\d{4}\b", digits=r"[0-9]{3}x[0-9]{2}x[0-9]{4}"),
    Pii("iban", ("eu",), r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", digits=r"[0-9]{2}"),
    Pii("phone", ("eu",), r"(?<!\w)\+44\s?\d{2,5}[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b", re2=r"\B\+44\s?\d{2,5}[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b", gate="+44"),
    Pii("phone", ("eu",), r"(?<!\w)\+49\s?\d{2,5}[-.\s]?\d{4,8}\b", re2=r"\B\+49\s?\d{2,5}[-.\s]?\d{4,8}\b", gate="+49"),
    Pii("phone", ("eu",), r"(?<!\w)\+33\s?\d\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{2}\b", re2=r"\B\+33\s?\d\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{2}\b", gate="+33"),
    Pii("phone", ("eu",), r"(?<!\w)\+39\s?\d{2,4}[-.\s]?\d{6,8}\b", re2=r"\B\+39\s?\d{2,4}[-.\s]?\d{6,8}\b", gate="+39"),
    Pii("phone", ("eu",), r"(?<!\w)\+34\s?\d{3}\s?\d{3}\s?\d{3}\b", re2=r"\B\+34\s?\d{3}\s?\d{3}\s?\d{3}\b", gate="+34"),
    Pii("phone", ("india",), r"(?<!\w)(?:\+?91[-.\s]?)?[6-9]\d{4}[-.\s]?\d{5}\b", re2=r"(?:\B\+91[-.\s]?|\b91[-.\s]?|\b)[6-9]\d{4}[-.\s]?\d{5}\b", digits=r"[0-9]{5}x?[0-9]{5}"),
    Pii("aadhaar", ("india",), r"\b\d{4}\s?\d{4}\s?\d{4}\b", digits=r"[0-9]{4}x?[0-9]{4}x?[0-9]{4}"),
    Pii("pan", ("india",), r"\b[A-Z]{5}\d{4}[A-Z]\b", digits=r"[0-9]{4}"),
    Pii("cpf", ("brazil",), r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", digits=r"[0-9]{3}x[0-9]{3}x[0-9]{3}x[0-9]{2}"),
    Pii("cnpj", ("brazil",), r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b", digits=r"[0-9]{2}x[0-9]{3}x[0-9]{3}x[0-9]{4}x[0-9]{2}"),
    Pii("phone", ("brazil",), r"\b(?:\+?55[-.\s]?)?\(?\d{2}\)?[-.\s]?\d{4,5}[-.\s]?\d{4}\b", first="[0-9+(]", digits=r"[0-9]{2}x?[0-9]{4,5}x?[0-9]{4}"),
    Pii("curp", ("mexico",), r"\b[A-Z]{4}\d{6}[HM][A-Z]{5}[A-Z0-9]\d\b", digits=r"[0-9]{6}"),
    Pii("rfc", ("mexico",), r"\b[A-Z&Ñ]{3,4}\d{6}[A-Z0-9]{3}\b", digits=r"[0-9]{6}"),
    Pii("phone", ("mexico",), r"\b(?:\+?52[-.\s]?)?\d{2,3}[-.\s]?\d{3,4}[-.\s]?\d{4}\b", first="[0-9+]", digits=r"[0-9]{2,3}x?[0-9]{3,4}x?[0-9]{4}"),
    Pii("my_number", ("japan",), r"\b\d{4}\s?\d{4}\s?\d{4}\b", digits=r"[0-9]{4}x?[0-9]{4}x?[0-9]{4}"),
    Pii("phone", ("japan",), r"(?<!\w)(?:\+81|0)\d[-.\s]?\d{4}[-.\s]?\d{4}\b", re2=r"(?:\B\+81|\b0)\d[-.\s]?\d{4}[-.\s]?\d{4}\b", digits=r"[0-9]x?[0-9]{4}x?[0-9]{4}"),
    Pii("rrn", ("southKorea",), r"\b\d{6}-[1-4]\d{6}\b", digits=r"[0-9]{6}x[0-9]{7}"),
    Pii("phone", ("southKorea",), r"(?<!\w)(?:\+82|0)\d{2}[-.\s]?\d{3,4}[-.\s]?\d{4}\b", re2=r"(?:\B\+82|\b0)\d{2}[-.\s]?\d{3,4}[-.\s]?\d{4}\b", digits=r"[0-9]{2}x?[0-9]{3,4}x?[0-9]{4}"),
    Pii("sin", ("canada",), r"\b\d{3}[-.\s]\d{3}[-.\s]\d{3}\b", 9, digits=r"[0-9]{3}x[0-9]{3}x[0-9]{3}"),
    Pii("phone", ("canada",), _US_PHONE, first="[0-9+(]", digits=r"[0-9]{3}x?[0-9]{3}x?[0-9]{4}"),
    Pii("tfn", ("australia",), r"\b\d{3}\s?\d{3}\s?\d{2,3}\b", digits=r"[0-9]{3}x?[0-9]{3}x?[0-9]{2}"),
    Pii("medicare", ("australia",), r"\b\d{4}\s?\d{5}\s?\d{1,2}\b", digits=r"[0-9]{4}x?[0-9]{5}x?[0-9]"),
    Pii("phone", ("australia",), r"(?<!\w)(?:\+61|0)\s?\d\s?\d{4}\s?\d{4}\b", re2=r"(?:\B\+61|\b0)\s?\d\s?\d{4}\s?\d{4}\b", digits=r"[0-9]x?[0-9]{4}x?[0-9]{4}"),
)


class Secret(NamedTuple):
    rule: str
    pattern: str
    gate: str
    ignore_case: bool = False


SECRETS = (
    Secret("aws_access_key", r"AKIA[A-Z0-9]{16}", "AKIA"),
    Secret("aws_secret", r"aws[\s\S]{0,40}?[A-Za-z0-9/+]{40}", "aws", True),
    Secret("gcp_api_key", r"AIza[A-Za-z0-9_-]{35}", "AIza"),
    Secret("github_token", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
    Secret("openai_key", r"sk-[A-Za-z0-9]{20,}", "sk-"),
    Secret("slack_token", r"xox[baprs]-[A-Za-z0-9-]{10,}", "xox"),
    Secret("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "eyJ"),
    Secret("private_key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "-----END"),
)


class Injection(NamedTuple):
    name: str
    weight: float
    patterns: tuple[str, ...]


INJECTIONS = (
    Injection("instruction_override", 0.6, (r"\b(ignore|disregard|forget|override)\b[^\n]{0,40}?\b(instructions?|prompts?|context|above|previous|prior|earlier)\b",)),
    Injection(
        "system_prompt_exfiltration",
        0.6,
        (
            r"\b(reveal|show|print|expose|display|tell me)\b[^\n]{0,30}?\b(system\s+)?(prompt|instructions?)\b",
            r"\b(repeat|print|echo|reveal|show)\b[^\n]{0,30}?\b(the (words|text|lines?) )?above\b",
            r"\bwhat (is|are) your\b[^\n]{0,25}?\b(system\s+)?(prompt|instructions?)\b",
        ),
    ),
    Injection("roleplay_jailbreak", 0.5, (r"\byou are (now )?dan\b", r"\bdo anything now\b", r"\bact as\b", r"\bdeveloper mode\b", r"\bpretend\b", r"\bjailbreak\b")),
    Injection("delimiter_attack", 0.4, (r"#{2,}\s*(system|assistant|user)\b", r"<\|im_start\|>", r"<\|im_end\|>", r"\[/?INST\]", r"<<SYS>>")),
    Injection("behavior_change", 0.35, (r"\bfrom now on\b", r"\bnew instructions?\b", r"\bfrom this (point|moment) (on|forward|onward)\b", r"\bstarting now\b")),
)

#: Lower-case literals that a text with a match has, in the order of the patterns: one of each group.
INJECTION_GATES = (
    (("ignore", "disregard", "forget", "override"),), (("prompt", "instruction"),), (("above",),), (("what is your", "what are your"),),
    (("you are ",),), (("do anything now",),), (("act as",),), (("developer mode",),), (("pretend",),), (("jailbreak",),),
    (("##",),), (("<|im_start|>",),), (("<|im_end|>",),), (("inst]",),), (("<<sys>>",),),
    (("from now on",),), (("new instruction",),), (("from this ",),), (("starting now",),),
)

#: Inside of a class, for each category.
INVISIBLE = {
    "zero_width": r"\x{200b}-\x{200d}\x{feff}\x{2060}",
    "bidi": r"\x{202a}-\x{202e}\x{2066}-\x{2069}",
    "soft_hyphen": r"\x{ad}",
    "tag": r"\x{e0000}-\x{e007f}",
}

URL = r"(?:https?://|ftp://|data:|javascript:)[^\s<>\"\)}\]]+"
URL_CHECKS = {
    "credentials": r"://[^@/\s]+:[^@/\s]+@",
    "ip_literal": r"://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "punycode": r"://[^\s/]*xn--",
    "shortener": r"(?:bit\.ly|tinyurl\.com|t\.co|goo\.gl|ow\.ly|is\.gd|v\.gd|rb\.gy|shorturl\.at|cutt\.ly)\b",
    "suspicious_tld": r"\.(?:tk|ml|ga|cf|gq|buzz|top|click|link|zip|mov|cam|surf|icu|rest)\b",
}
URL_CATEGORIES = ("data_uri", "javascript_uri", *URL_CHECKS)

#: Inside of a class, for each script.
SCRIPTS = {
    "latin": r"\x{41}-\x{24f}\x{1e00}-\x{1eff}",
    "cyrillic": r"\x{400}-\x{4ff}",
    "greek": r"\x{370}-\x{3ff}",
    "arabic": r"\x{600}-\x{6ff}",
    "devanagari": r"\x{900}-\x{97f}",
    "cjk": r"\x{4e00}-\x{9fff}",
    "hangul": r"\x{ac00}-\x{d7af}",
    "hiragana": r"\x{3040}-\x{309f}",
    "katakana": r"\x{30a0}-\x{30ff}",
    "thai": r"\x{e00}-\x{e7f}",
}

#: (category, pattern, whether upper and lower case are alike)
CODE = (
    ("shell", r"\brm\s+-[rf]{1,2}\b", True),
    ("shell", r"\brm\s+-[rf]*\s+/", True),
    ("shell", r"\bchmod\s+777\b", True),
    ("shell", r"\bcurl\b[^|]*\|\s*(?:sh|bash)\b", True),
    ("shell", r"\bwget\b[^|]*\|\s*(?:sh|bash)\b", True),
    ("shell", r"\bmkfs\b", True),
    ("shell", r"\bdd\s+if=", True),
    ("sql", r"\bDROP\s+(?:TABLE|DATABASE)\b", True),
    ("sql", r"\bTRUNCATE\s+TABLE\b", True),
    ("sql", r"\bDELETE\s+FROM\s+\S+\s*;", True),
    ("sql", r";\s*--\s*", True),
    ("injection", r"\beval\s*\(", True),
    ("injection", r"\bexec\s*\(", True),
    ("injection", r"\bos\.system\s*\(", True),
    ("injection", r"\bsubprocess\.(?:call|run|Popen)\s*\(", True),
    ("injection", r"\bRuntime\.getRuntime\(\)\.exec\s*\(", False),
    ("injection", r"\bProcess\.start\s*\(", True),
    ("injection", r"\bFunction\s*\(", False),
    ("filesystem", r"\bFile\.delete\b|\bDirectory\.delete\b", True),
    ("filesystem", r"\bunlink\s*\(", True),
    ("filesystem", r"\bshutil\.rmtree\s*\(", True),
)

#: As INJECTION_GATES, for CODE.
CODE_GATES = (
    (("rm",), ("-r", "-f")), (("rm",), ("-",), ("/",)), (("chmod",),), (("curl",), ("|",)), (("wget",), ("|",)), (("mkfs",),), (("if=",),),
    (("drop",),), (("truncate",),), (("delete",), ("from",), (";",)), ((";",), ("--",)),
    (("eval",),), (("exec",),), (("os.system",),), (("subprocess.",),), (("getruntime",),), (("process.start",),), (("function",),),
    ((".delete",),), (("unlink",),), (("shutil.rmtree",),),
)

TOKEN = r"\w+|[^\w\s]+"
CONTENT_WORD = r"[a-zA-Z'\x{c0}-\x{24f}]+"

#: English function words that don't count as content.
STOP_WORDS = tuple(
    """a an the and or but in on at to for of with by from is are was were be been being have has had do does did
    will would could should may might shall can it its this that these those i you he she we they me him her us them
    my your his our their not no if then so as up out about into over after all also just more some such than too
    very each every both few most other any only own same when where how what which who whom why there here now once
    while during before between through above below again further because""".split()
)
