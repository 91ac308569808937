"""HTML extraction: page structure and suffix arrays over a host's pages.

A page becomes blocks of text in page order. What its markup names as menu,
header, footer, sidebar, notice, advert, form, reader comment, script or style goes
at once, wherever it stands. Of a page with an article (or main) element the blocks
of that element are left, of others all. They may hold boilerplate that nothing
marks, which suffix arrays find: the token streams of a host's pages are joined to
one stream and its suffixes are sorted, which gives every run of ``MIN_RUN`` tokens
with the number of distinct pages it stands on. Blocks that such runs cover (nearly)
whole go and all others stay. Which runs count:

* In articles, those on ``MIN_PAGES`` articles or more that are also ``SHARE`` of the
  host's or more, equal articles counted once. Passages that some articles of a host
  share are text. Where more than ``COPIED`` of an article's tokens would go, it is a
  near copy of others and stays whole.
* On pages without an article, those on ``MIN_PAGES`` pages without one or more.

A host's articles are dealt to groups of about ``GROUP_BYTES`` of html by a hash of
their text, each with a suffix array of its own, so no task holds a whole host. A run
on a share of a host's articles is on that share of some group's: each group names
those, and where a host has several groups all of them count the runs that any has
named. Articles go to the groups compressed, equal ones once a task; verdicts come
back as runs, and no page is shuffled again if there are none.

Pages without an article are dealt alike (by text, not html). Where their host has
several groups, each group's array gives one row for every distinct run with the
number of its pages there; the rows are added up over the host. So the same runs
count however a host is cut.

Markup is read as browsers do: quotes matter only after an equals sign (one that is
never closed is a character like others), comments and raw elements (script, style,
...) end where their end mark stands, and every page is gone over once. Nested
articles are reader comments, as HTML defines them; elements that aren't shown
(hidden, display: none) and form controls are no text of the article, while figures,
tables, formulas, code and what is hidden from screen readers only are.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import shared_dir, shuffle_partitions, written

MIN_RUN = 8
MIN_PAGES = 3
#: Share of a block's tokens that must be covered for it to go.
COVERED = 0.9
#: Share of a host's distinct articles on which a run must stand to be boilerplate in articles.
SHARE = 0.5
#: Share of an article's tokens above which its blocks don't go: it is a near copy.
COPIED = 0.8
#: Bytes of one group: html of articles, blocks of other pages.
GROUP_BYTES = 1 << 20
#: Articles in a group on average, at least: fewer would name runs that are seldom.
GROUP_PAGES = 8

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
DROP = frozenset("nav aside footer form menu dialog button select datalist search head".split())
#: Closed by the next of their kind (or, for p, by any block).
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus reply replies footer masthead newsletter subscribe signup share sharing social related recommended widget popup modal overlay toolbar pagination pager login".split()
)
CONTENT = frozenset("article content main post entry story body".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

_OPEN = re.compile(r"<(?:!--|[!?/]|[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"""[^>"']*+>""")
_TO_VALUE = re.compile(r"[^>=]*+")
_SPACE = re.compile(r"\s*+")
_BARE = re.compile(r"[^\s>]*+")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PART = re.compile(r"[a-z0-9]+")


class Tags:
    """The tags of a page, one after the other, each part of the page read once."""

    def __init__(self, source: str):
        self.source, self.n = source, len(source)
        self._last: dict[str, int] = {}  # where the last of a mark stands, -1: nowhere
        self._ends: dict[str, list[int]] = {}

    def _find(self, mark: str, at: int) -> int:
        last = self._last.get(mark)
        if last is None:
            last = self._last[mark] = self.source.rfind(mark)
        return self.source.find(mark, at) if at <= last else -1

    def _attributes(self, at: int) -> int:
        """Where the tag ends whose attributes begin at ``at``, or -1."""
        m = _PLAIN.match(self.source, at)
        if m:
            return m.end()
        while True:
            at = _TO_VALUE.match(self.source, at).end()
            if at >= self.n:
                return -1
            if self.source[at] == ">":
                return at + 1
            at = _SPACE.match(self.source, at + 1).end()
            quote = self.source[at : at + 1]
            end = self._find(quote, at + 1) if quote in ('"', "'") else -1
            at = end + 1 if end >= 0 else _BARE.match(self.source, at).end()

    def next(self, at: int):
        """(begin, end, name, closing, attributes) of the next tag or comment
        (without a name) from ``at`` on, or None."""
        s = self.source
        while True:
            m = _OPEN.search(s, at)
            if m is None:
                return None
            begin, mark = m.start(), m.group()
            if mark == "<!--":
                if s.startswith((">", "->"), m.end()):
                    end = s.index(">", m.end()) + 1
                else:
                    end = self._find("-->", m.end())
                    end = end + 3 if end >= 0 else self.n
                return begin, end, "", False, ""
            if mark == "</" and not s[begin + 2 : begin + 3].isalpha() or mark in ("<!", "<?"):
                if mark == "</" and begin + 2 >= self.n:
                    return None
                end = self._find(">", m.end())
                return begin, end + 1 if end >= 0 else self.n, "", False, ""
            closing = mark == "</"
            name = _NAME.match(s, begin + 1 + closing)
            if name is None:
                at = begin + 1
                continue
            end = self._attributes(name.end())
            if end < 0:
                # the page ends within the tag
                return begin, self.n, "", False, ""
            return begin, end, name.group().lower(), closing, s[name.end() : end - 1]

    def raw_end(self, tag: str, at: int) -> int:
        """Where the raw element ends whose content begins at ``at``."""
        ends = self._ends.get(tag)
        if ends is None:
            ends = self._ends[tag] = [x for m in re.finditer(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", self.source, re.I) for x in m.span()]
        import bisect

        k = bisect.bisect_left(ends, at)
        k += k % 2
        return ends[k + 1] if k < len(ends) else self.n


def _dropped(tag: str, attrs: str, within: bool) -> bool:
    """Whether an element is none of the main text; ``within``: in an article."""
    if tag in DROP or tag == "header" and not within:
        return True
    if tag in ("html", "body", "main"):
        return False
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden":
            return True
        if name == "role" and value in ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id"):
            parts = set(_PART.findall(value))
            if parts & NAMES and not (parts & CONTENT and not parts & {"comment", "comments", "ad", "ads", "advert"}):
                return True
            if "header" in parts and not within:
                return True
    return False


def blocks(source: str) -> tuple[list[tuple[str, bool]], bool]:
    """(text, in an article) of each block that no markup drops, in page order,
    and whether there is an article with text."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool]] = []  # element, dropped
    where: dict[str, list[int]] = {"/": []}  # of each open element, and (/) of those that only their own end closes
    drops = articles = 0
    at, n, tags = 0, len(source), Tags(source)

    def flush():
        if held:
            text = " ".join(_html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, articles > 0))

    def pop_to(k: int):
        nonlocal drops, articles
        for tag, dropped in reversed(stack[k:]):
            drops -= dropped
            articles -= tag in ("article", "main") and not dropped
            where[tag].pop()
            if tag in ("article", "main", "body"):
                where["/"].pop()
        del stack[k:]

    while at < n:
        found = tags.next(at)
        if found is None:
            if not drops:
                held.append(source[at:])
            break
        begin, end, tag, closing, attrs = found
        if not drops and begin > at:
            held.append(source[at:begin])
        at = end
        if not tag:
            continue
        if tag in RAW:
            if not closing and not (tag == "svg" and attrs.rstrip().endswith("/")):
                at = tags.raw_end(tag, at)
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br":
            held.append(" ") if not drops else None
        if tag in VOID:
            continue
        if closing:
            own = where.get(tag)
            if own and (tag in ("html", "body", "article", "main") or not where["/"] or where["/"][-1] < own[-1]):
                pop_to(own[-1])
            continue
        if tag in BLOCK:
            for k in range(len(stack) - 1, max(-1, len(stack) - 12), -1):
                name = stack[k][0]
                if name == "p" or name in SIBLING.get(tag, ()):
                    pop_to(k)
                    break
                if name in BLOCK:
                    break
        if tag in ("article", "main") and drops and not articles:
            pop_to(0)  # an element that was never closed doesn't hide the article
        if attrs.rstrip().endswith("/") and tag not in BLOCK:
            continue
        dropped = _dropped(tag, attrs, articles > 0) or tag == "article" and bool(where.get("article"))
        where.setdefault(tag, []).append(len(stack))
        if tag in ("article", "main", "body"):
            where["/"].append(len(stack))
        stack.append((tag, dropped))
        drops += dropped
        articles += tag in ("article", "main") and not dropped
    flush()
    return out, any(a for _, a in out)


def _stream(pages: list[list[str]]):
    """All tokens of a group's pages as numbers (0 after each page) and as hashes,
    the page of each, and each page's blocks as spans."""
    import numpy as np
    import xxhash

    number: dict[str, int] = {}
    stream, owner, spans = [], [], []
    for k, page in enumerate(pages):
        own = []
        for text in page:
            begin = len(stream)
            stream += [number.setdefault(w, len(number) + 1) for w in text.split(" ")]
            own.append((begin, len(stream)))
        stream.append(0)
        owner += [k] * (len(stream) - len(owner))
        spans.append(own)
    words = np.array([0, *(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in number)], np.uint64)
    text = np.array(stream, np.int64)
    return text, words[text], np.array(owner, np.int64), spans


def _runs(text, page_of, min_run: int):
    """By the suffix array: for each distinct run of ``min_run`` tokens its first
    place, its number of distinct pages, and the run that begins at each place (-1: none)."""
    import numpy as np

    from palisade.llm.decontaminate import suffix_array

    run_at = np.full(len(text), -1, np.int64)
    sa = suffix_array(text, min_run)
    sa = sa[sa + min_run <= len(text)]
    if not len(sa):
        return sa, sa, run_at
    same, whole = np.ones(len(sa) - 1, bool), np.ones(len(sa), bool)
    for d in range(min_run):
        x = text[sa + d]
        same &= x[1:] == x[:-1]
        whole &= x > 0
    group = np.concatenate(([0], np.cumsum(~same)))
    sa, group = sa[whole], group[whole]
    if not len(sa):
        return sa, sa, run_at
    group = np.unique(group, return_inverse=True)[1]
    run_at[sa] = group
    pages = int(page_of[-1]) + 1
    n_pages = np.bincount(np.unique(group * np.int64(pages) + page_of[sa]) // pages)
    first = np.zeros(len(n_pages), np.int64)
    first[group[::-1]] = sa[::-1]
    return first, n_pages, run_at


def _hashes(words, places, min_run: int):
    """64-bit hashes of the runs that begin at ``places``."""
    import numpy as np

    from palisade.llm.jaccard_join import mix

    h = np.zeros(len(places), np.uint64)
    for i in range(min_run):
        h = mix(h * np.uint64(3) + words[places + i] + np.uint64(i + 1))
    return h.view(np.int64)


def _shares(run_at, wanted, spans, min_run: int) -> list[list[float]]:
    """For each page's blocks, the share of tokens in wanted runs."""
    import numpy as np

    edge = np.zeros(len(run_at) + 1, np.int64)
    places = np.flatnonzero(run_at >= 0)
    places = places[wanted[run_at[places]]]
    np.add.at(edge, places, 1)
    np.add.at(edge, places + min_run, -1)
    total = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] > 0)))
    return [[(total[b] - total[a]) / max(1, b - a) for a, b in own] for own in spans]


def covered(pages: list[list[str]], min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> list[list[float]]:
    """For each page's blocks, the share of tokens in runs of ``min_run`` tokens
    or more that stand on ``min_pages`` distinct pages or more."""
    text, _, page_of, spans = _stream(pages)
    _, n_pages, run_at = _runs(text, page_of, min_run)
    return _shares(run_at, n_pages >= min_pages, spans, min_run)


def _kept(page: list[str], shares: list[float]) -> str:
    return "\n\n".join([t for t, c in zip(page, shares) if c < COVERED])


def _common(articles: list[list[str]], min_run: int):
    """Hashes of the runs on ``SHARE`` of these distinct articles or more, and on how many each stands."""
    text, words, page_of, _ = _stream(articles)
    first, n_pages, _ = _runs(text, page_of, min_run)
    some = n_pages >= SHARE * len(articles)
    return _hashes(words, first[some], min_run), n_pages[some]


def _counted(articles: list[list[str]], given, min_run: int):
    """On how many of these distinct articles each of the given runs stands, if on any."""
    import numpy as np

    text, words, page_of, _ = _stream(articles)
    first, n_pages, _ = _runs(text, page_of, min_run)
    run = _hashes(words, first, min_run)
    some = np.isin(run, given)
    return run[some], n_pages[some]


def _without(articles: list[list[str]], given, min_run: int) -> list[str]:
    """The texts of articles without the blocks that the given runs cover."""
    import numpy as np

    if not len(given):
        return ["\n\n".join(x) for x in articles]
    text, words, _, spans = _stream(articles)
    breaks = np.concatenate(([0], np.cumsum(text == 0)))
    places = np.arange(max(0, len(text) - min_run + 1))
    places = places[breaks[places + min_run] == breaks[places]]
    run_at = np.full(len(text), -1, np.int64)
    run_at[places] = np.isin(_hashes(words, places, min_run), given)
    out = []
    for page, own, shares in zip(articles, spans, _shares(run_at, np.array([False, True]), spans, min_run)):
        gone = sum(b - a for (a, b), c in zip(own, shares) if c >= COVERED)
        out.append("\n\n".join(page) if gone > COPIED * (own[-1][1] - own[0][0]) else _kept(page, shares))
    return out


def main_texts(sources: list[str | None], min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> list[str]:
    """The main text of each page of one host, in one group."""
    found = [_main(s) for s in sources]
    articles = [b for b, article in found if article]
    runs, n = _common([list(x) for x in dict.fromkeys(map(tuple, articles))], min_run) if articles else ((), ())
    texts = iter(_without(articles, runs[n >= min_pages], min_run) if articles else ())
    shares = iter(covered([b for b, article in found if not article], min_run, min_pages))
    return [next(texts) if article else _kept(b, next(shares)) for b, article in found]


def _main(source: str | None) -> tuple[list[str], bool]:
    """The blocks of a page's article, or of all of it, and whether there is one."""
    found, article = blocks(source or "")
    return [t for t, inside in found if inside or not article], article


def _packed(text: str) -> bytes:
    import pyarrow as pa

    raw = text.encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(z: bytes) -> str:
    import pyarrow as pa

    return pa.decompress(z[8:], int.from_bytes(z[:8], "little"), codec="zstd", asbytes=True).decode("utf-8", "surrogatepass")


PARSED = "page_id bigint, url string, host string, part int, z binary, blocks array<string>"


def _parsed(pages: DataFrame, groups: DataFrame, once: bool) -> DataFrame:
    """The group and the packed text of pages with an article (and of those without text),
    the blocks of others. ``once``: no empty texts, equal articles of a host once a task and in one group."""
    rows = pages.join(F.broadcast(groups), "host", "left").select("page_id", "url", "html", "host", F.coalesce("groups", F.lit(1)))

    def run(batches):
        import pyarrow as pa
        import xxhash

        known: set[tuple[str, int]] = set()
        for b in batches:
            out = []
            for page_id, url, source, host, n in zip(*(c.to_pylist() for c in b.columns)):
                own, article = _main(source)
                text = "\n\n".join(own)
                key = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
                spread = xxhash.xxh3_64_intdigest(f"{page_id} {url}".encode("utf-8", "surrogatepass"), key & (2**64 - 1)) % n
                if own and not article:
                    out.append((page_id, url, host, spread, None, own))
                elif not once:
                    out.append((page_id, url, host, spread, _packed(text), None))
                elif article and (host, key) not in known:
                    known.add((host, key))
                    out.append((page_id, url, host, key % n, _packed(text), None))
            cols = zip(*out) if out else ((),) * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=["page_id", "url", "host", "part", "z", "blocks"])

    return rows.mapInArrow(run, PARSED)


def _grouped(batches, n_keys: int):
    """(key, rows) of each run of rows with equal first columns."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:n_keys] != key and held:
                yield key, held
                held = []
            key = row[:n_keys]
            held.append(row[n_keys:])
    if held:
        yield key, held


def _host_runs(rows: DataFrame, min_run: int, min_pages: int) -> DataFrame:
    """host, part, run: the runs of groups that stand on ``min_pages`` of the host's pages."""

    def count(batches):
        import pyarrow as pa

        for (host, part), held in _grouped(batches, 2):
            text, words, page_of, _ = _stream([x[0] for x in held])
            first, n_pages, _ = _runs(text, page_of, min_run)
            n = len(first)
            yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array(_hashes(words, first, min_run), pa.int64()), pa.array(n_pages, pa.int64())], names=["host", "part", "run", "n"])

    found = rows.select("host", "part", "blocks").mapInArrow(count, "host string, part int, run bigint, n bigint")
    found = written(found, shared_dir(rows.sparkSession, "host-runs"))
    wanted = found.groupBy("host", "run").agg(F.sum("n").alias("n")).where(f"n >= {min_pages}").select("host", "run")
    return found.join(wanted, ["host", "run"]).select("host", "part", "run")


def _article_groups(pages: DataFrame, group_bytes: int) -> DataFrame:
    """host, groups: the hosts with several groups, of which there are as many as the input has groups at most."""
    sizes = pages.groupBy("host").agg(F.sum(F.octet_length("html").cast("bigint")).alias("bytes"), F.count(F.lit(1)).alias("pages"))
    groups = F.least(F.ceil(F.col("bytes") / F.lit(group_bytes)), F.ceil(F.col("pages") / F.lit(GROUP_PAGES))).cast("int")
    return written(sizes.select("host", groups.alias("groups")).where("groups > 1"), shared_dir(pages.sparkSession, "html-hosts"))


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "host", "part").sortWithinPartitions("host", "part", *keys)


def _article_runs(pages: DataFrame, groups: DataFrame, min_run: int, min_pages: int) -> tuple[DataFrame, DataFrame]:
    """host, run: the boilerplate of articles; and the rows of pages without an article."""
    spark = pages.sparkSession

    def name(batches):
        import pyarrow as pa

        for (host, part), held in _grouped(batches, 2):
            articles = [x.split("\n\n") for x in dict.fromkeys(_unpacked(z) for z, *_ in held if z is not None)]
            run, n = _common(articles, min_run) if articles else ((), ())
            others = [x for x in held if x[0] is None]
            # one row with the number of articles, the runs, the pages without an article
            k, m = 1 + len(run), len(others)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([host] * (k + m), pa.string()),
                    pa.array([None, *run] + [None] * m, pa.int64()),
                    pa.array([len(articles), *n] + [None] * m, pa.int64()),
                    pa.array([None] * k + [x[1] for x in others], pa.int64()),
                    pa.array([None] * k + [x[2] for x in others], pa.string()),
                    pa.array([None] * k + [x[3] for x in others], pa.list_(pa.string())),
                ],
                names=["host", "run", "n", "page_id", "url", "blocks"],
            )

    rows = _dealt(_parsed(pages, groups, True).select("host", "part", "z", "page_id", "url", "blocks"))
    found = written(rows.mapInArrow(name, "host string, run bigint, n bigint, page_id bigint, url string, blocks array<string>"), shared_dir(spark, "html-runs"))
    named = found.where("run is not null").select("host", "run", "n")
    several = written(named.join(F.broadcast(groups), "host").select("host", "run", "groups").distinct(), shared_dir(spark, "html-named"))
    if several.isEmpty():
        exact = named
    else:

        def count(batches):
            import numpy as np
            import pyarrow as pa

            for (host, _), held in _grouped(batches, 2):
                given = np.array([x[1] for x in held if x[1] is not None], np.int64)
                articles = [x.split("\n\n") for x in dict.fromkeys(_unpacked(z) for z, _ in held if z is not None)]
                if len(given) and articles:
                    run, n = _counted(articles, given, min_run)
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(run), pa.string()), pa.array(run, pa.int64()), pa.array(n, pa.int64())], names=["host", "run", "n"])

        # at most as many hosts as have several groups
        again = pages.join(F.broadcast(several.select("host").distinct()), "host", "left_semi")
        texts = _parsed(again, groups, True).where("z is not null").select("host", "part", "z", F.lit(None).cast("bigint").alias("run"))
        runs = several.select("host", F.explode(F.expr("sequence(0, groups - 1)")).alias("part"), F.lit(None).cast("binary").alias("z"), "run")
        exact = named.join(F.broadcast(groups), "host", "left_anti").union(_dealt(texts.union(runs)).mapInArrow(count, "host string, run bigint, n bigint"))
    total = found.where("run is null and blocks is null").groupBy("host").agg(F.sum("n").alias("articles"))
    wanted = exact.groupBy("host", "run").agg(F.sum("n").alias("n")).where(f"n >= {min_pages}").join(total, "host").where(f"n >= {SHARE} * articles")
    return written(wanted.select("host", "run"), shared_dir(spark, "html-boilerplate")), found.where("blocks is not null").select("page_id", "url", "host", "blocks")


def _article_texts(pages: DataFrame, groups: DataFrame, runs: DataFrame, min_run: int) -> DataFrame:
    """page_id, url, text of pages with an article, and of those without any text."""

    def plain(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(i, u, "\n\n".join(own)) for i, u, (own, article) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(_main, b.column(2).to_pylist())) if article or not own]
            cols = zip(*rows) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], names=["page_id", "url", "text"])

    def judged(batches):
        import numpy as np
        import pyarrow as pa

        for _, held in _grouped(batches, 2):
            given = np.array([x[4] for x in held if x[0] == 0], np.int64)
            held = [x for x in held if x[0] == 1]
            texts = _without([_unpacked(x[3]).split("\n\n") for x in held], given, min_run)
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in held], pa.int64()), pa.array([x[2] for x in held], pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    out = "page_id bigint, url string, text string"
    hosts = runs.select("host").distinct()
    if runs.isEmpty():
        return pages.select("page_id", "url", "html").mapInArrow(plain, out)
    with_runs = _parsed(pages.join(hosts, "host", "left_semi"), groups, False).where("z is not null").selectExpr("host", "part", "1 as kind", "page_id", "url", "z", "cast(null as bigint) as run")
    given = runs.join(F.broadcast(groups), "host", "left").select("host", F.explode(F.expr("sequence(0, coalesce(groups, 1) - 1)")).alias("part"), "run")
    given = given.selectExpr("host", "part", "0 as kind", "cast(null as bigint) as page_id", "cast(null as string) as url", "cast(null as binary) as z", "run")
    return pages.join(hosts, "host", "left_anti").select("page_id", "url", "html").mapInArrow(plain, out).union(_dealt(with_runs.union(given), "kind").mapInArrow(judged, out))


def extract(pages: DataFrame, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row per page: page_id, url, text and n_chars.

    Null and empty html give an empty text; very long pages are parsed in one go.
    Pages with null urls form one host. Repeated rows and null ids stay, a row
    each, and count as pages of their own (equal articles as one). ``pages`` is
    read several times; other columns are not read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = pages.selectExpr("cast(page_id as bigint) as page_id", "cast(url as string) as url", "cast(html as string) as html").withColumn("host", host)
    groups = _article_groups(pages, group_bytes)
    runs, open_ = _article_runs(pages, groups, min_run, min_pages)
    out = _article_texts(pages, groups, runs, min_run)
    open_ = open_.withColumn("size", F.expr("aggregate(blocks, 0L, (a, x) -> a + octet_length(x))"))
    sizes = open_.groupBy("host").agg(F.sum("size").alias("bytes")).select("host", F.ceil(F.col("bytes") / F.lit(group_bytes)).cast("int").alias("groups"))
    n = shuffle_partitions(spark)
    if not sizes.isEmpty():
        open_ = open_.join(sizes, "host").withColumn("part", F.expr("cast(pmod(xxhash64(page_id, url, blocks), greatest(groups, 1)) as int)"))

        def placed(df: DataFrame) -> DataFrame:
            return df.repartition(n, "host", "part").sortWithinPartitions("host", "part", "kind")

        rows = open_.selectExpr("host", "part", "1 as kind", "groups", "page_id", "url", "blocks", "cast(null as bigint) as run")
        runs = _host_runs(placed(rows.where("groups > 1")), min_run, min_pages)
        every = rows.unionByName(runs.selectExpr("host", "part", "0 as kind", "cast(null as int) as groups", "cast(null as bigint) as page_id", "cast(null as string) as url", "cast(null as array<string>) as blocks", "run"))

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for _, held in _grouped(batches, 2):
                given = np.array([x[5] for x in held if x[0] == 0], np.int64)
                held = [x for x in held if x[0] == 1]
                text, words, page_of, spans = _stream([x[4] for x in held])
                first, n_pages, run_at = _runs(text, page_of, min_run)
                wanted = np.isin(_hashes(words, first, min_run), given) if held[0][1] > 1 else n_pages >= min_pages
                texts = [_kept(x[4], c) for x, c in zip(held, _shares(run_at, wanted, spans, min_run))]
                yield pa.RecordBatch.from_arrays([pa.array([x[2] for x in held], pa.int64()), pa.array([x[3] for x in held], pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

        out = out.unionByName(placed(every).mapInArrow(run, "page_id bigint, url string, text string"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
