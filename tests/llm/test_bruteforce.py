"""Operators against plain reimplementations on small tables."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

SF = "/root/testdata/sf0.001"
M = 50


def words(t):
    return tuple(re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()))


def classes(rows):
    """(id, text) -> id: (class, links, copies), all pairs compared."""
    key, shingles = {}, {}
    for i, t in rows:
        w = key[i] = words(t)
        k = min(5, len(w))
        shingles[i] = {w[j : j + k] for j in range(len(w) - k + 1)} if w else set()
    rep = {}
    for i, _ in rows:
        rep.setdefault(key[i], i)
    reps = [i for i, _ in rows if rep[key[i]] == i and shingles[i]]
    parent = {i: i for i in reps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = collections.Counter()
    for x, y in itertools.combinations(reps, 2):
        c = len(shingles[x] & shingles[y])
        if c and 5 * c >= 4 * (len(shingles[x]) + len(shingles[y]) - c):
            links[x] += 1
            links[y] += 1
            a, b = find(x), find(y)
            parent[max(a, b)] = min(a, b)
    copies = collections.Counter(key.values())
    return {i: (find(rep[key[i]]), links[rep[key[i]]], copies[key[i]] - 1) if shingles[i] else (i, 0, 0) for i, _ in rows}


def run_similar(docs):
    from palisade.llm.jaccard_join import similar

    return {r.id: (r.class_id, r.n_links, r.n_copies) for r in similar(docs, bare_scan=True).collect()}


def test_jaccard_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert run_similar(docs) == classes(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_jaccard_splits_large_buckets(spark, tmp_path, monkeypatch):
    """Buckets above the limit are split down to the last level and then compared in blocks."""
    from palisade.llm import jaccard_join as J

    monkeypatch.setattr(J, "SMALL", 8)
    monkeypatch.setattr(J, "BLOCK", 16)
    rnd = random.Random(3)
    vocab = [f"v{i}" for i in range(3000)]
    base = [rnd.choice(vocab) for _ in range(200)]
    passage = [rnd.choice(vocab) for _ in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(200)] = rnd.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(150 + i, " ".join(passage + [rnd.choice(vocab) for _ in range(120)])) for i in range(100)]
    rows += [(250 + i, " ".join(base)) for i in range(30)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(path)
    assert run_similar(spark.read.parquet(path)) == classes(rows)


def _pairs_near_the_threshold(n, size, rnd):
    """Texts that all share 55 % of their words in one passage, so buckets split down
    to the last level, in pairs of similarity 0.80 to 0.85."""
    rows = []
    for i in range(n):
        own = [f"p{i}x{rnd.randrange(10**9)}" for _ in range(size)]
        a = [f"s{j}" if j < 0.55 * size else own[j] for j in range(size)]
        b = list(a)
        # k changed words near the end, next to each other: k + 4 other shingles of size - 4
        k = rnd.randint(int(size * 0.085), int(size * 0.105)) - 4
        for j in range(size - 5 - k, size - 5):
            b[j] = f"z{i}x{j}"
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    return rows


def test_recall_end_to_end(spark, tmp_path, monkeypatch):
    """Links of similarity 0.80 to 0.85 below buckets that are split at every level: at least 0.9 are found."""
    from palisade.llm import jaccard_join as J

    monkeypatch.setattr(J, "SMALL", 32)
    monkeypatch.setattr(J, "BLOCK", 16)
    rows = _pairs_near_the_threshold(300, 200, random.Random(2)) + [(1000 + 2 * i + k, " ".join(f"t{i % 40} u v w".split() + [f"q{i} r{i} o{i} e{i} f{i}"])) for i in range(100) for k in range(2)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(path)
    got = run_similar(spark.read.parquet(path))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    near = [i for i in range(300) if 0.8 <= len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) <= 0.86]
    found = sum(got[2 * i][:2] == (2 * i, 1) and got[2 * i + 1][:2] == (2 * i, 1) for i in near)
    print(f"recall {found / len(near):.3f} of {len(near)} links")
    assert len(near) > 200 and found >= 0.9 * len(near)
    assert all(got[1000 + 2 * i + 1][0] == 1000 + 2 * i for i in range(100))


def test_one_large_component(spark, tmp_path, monkeypatch):
    """Rings around the pivot settle or leave what is compared: classes and links as by all pairs."""
    from palisade.llm import jaccard_join as J

    monkeypatch.setattr(J, "BLOCK", 8)
    rnd = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        a = rnd.randrange(100)
        for j in range(a, a + rnd.choice([0, 1, 3, 8, 15])):
            w[j] = f"c{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, " ".join(["m n o p q"] * (3 + i % 3))) for i in range(6)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(path)
    assert run_similar(spark.read.parquet(path)) == classes(rows)


def test_near_copies_are_compared_in_proportion(spark, tmp_path, monkeypatch):
    """Four times the near copies in one group: some four times the compared rows, not sixteen, and links as by all pairs."""
    from palisade.llm import jaccard_join as J

    monkeypatch.setattr(J, "SMALL", 32)
    made, compare = [], J._compare

    def spy(rows, similarity):
        made.append(rows.count())
        return compare(rows, similarity)

    monkeypatch.setattr(J, "_compare", spy)
    rnd, sums = random.Random(9), []
    vocab = [f"v{i}" for i in range(3000)]
    base = [rnd.choice(vocab) for _ in range(150)]
    for n in (200, 800):
        rows = [(i, " ".join(f"n{i}" if j in (i % 140, i % 131) else w for j, w in enumerate(base))) for i in range(n)]
        # some that share half of it, and links among them
        rows += [(10_000 + 2 * i + k, " ".join(base[:75] + [f"o{i}x{j}" if (j, k) != (9, 1) else "z" for j in range(75)])) for i in range(20) for k in range(2)]
        path = str(tmp_path / f"d{n}.parquet")
        spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(path)
        made.clear()
        got = run_similar(spark.read.parquet(path))
        sums.append(sum(made))
        if n == 200:
            assert got == classes(rows)
        else:
            assert all(got[i][0] == 0 for i in range(n))
    print(f"compared rows {sums}")
    assert sums[1] <= 6 * sums[0]


def test_near_copies_are_not_split(spark, tmp_path, monkeypatch):
    """Near copies in large buckets go by pivots where they first meet, so their paths aren't followed down; links as by all pairs."""
    from palisade.llm import jaccard_join as J

    monkeypatch.setattr(J, "SMALL", 32)
    split, children = [], J._children

    def spy(rows):
        split.append(rows.count())
        return children(rows)

    monkeypatch.setattr(J, "_children", spy)
    rnd = random.Random(11)
    base = [f"v{rnd.randrange(3000)}" for _ in range(150)]
    rows = [(i, " ".join(f"n{i}" if j in (i % 140, i % 131) else w for j, w in enumerate(base))) for i in range(300)]
    rows += [(1000 + i, " ".join(base)) for i in range(50)]
    # few texts that share a quarter of it, and links among them
    rows += [(10_000 + 2 * i + k, " ".join(base[:40] + [f"o{i}x{j}" if (j, k) != (9, 1) else "z" for j in range(110)])) for i in range(10) for k in range(2)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(path)
    assert run_similar(spark.read.parquet(path)) == classes(rows)
    print(f"split rows {split}")
    assert sum(split) <= 5 * 300


def test_runs_reach_the_recall():
    from palisade.llm import jaccard_join as J

    p = J.Paths(J.runs_for(J.RECALL, J.DEPTH), J.DEPTH, J.SIMILARITY)
    rng = np.random.default_rng(1)
    hit = 0
    for _ in range(200):
        s = rng.integers(0, 2**63, 360).astype(np.uint64)
        a, b = np.sort(s[:340]), np.sort(np.concatenate((s[:304], s[340:360])))
        inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert inter / union >= 0.8
        hit += bool({k for k, _ in p(a)} & {k for k, _ in p(b)})
    assert hit >= 0.97 * 200


def line_dedup(rows):
    """id -> (n_lines, n_removed, text): all runs of lines of a text (by increasing id)
    against all runs of the texts and lines before, without hashes or windows."""
    first, gone = {}, collections.defaultdict(set)
    for i, t in rows:
        a = [(x.strip(" \t\x0b\f\r") and x, len([w for w in re.split(r"[ \t\x0b\f\r]", x) if w])) for x in t.split("\n")]
        for p in range(len(a)):
            words = 0
            for q in range(p, len(a)):
                words += a[q][1]
                if words >= M:
                    here = (i, p)
                    if first.setdefault(hash(tuple(x for x, _ in a[p : q + 1])), here) != here:
                        gone[i] |= set(range(p, q + 1))
    return {i: (t.count("\n") + 1, len(gone[i]), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in rows}


def test_line_dedup(spark, tmp_path):
    from palisade.llm.line_dedup import dedup_lines

    rnd = random.Random(5)
    pool = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 30))) for _ in range(60)] + ["", "  "]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12)))) for i in range(200)]
    block = [rnd.choice(pool[:60]) for _ in range(90)]
    rows += [(200 + i, "\n".join([f"own {i}", *block, f"end {i}"])) for i in range(4)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(path)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in dedup_lines(spark.read.parquet(path), bare_scan=True).select("row.doc_id", "n_lines", "n_removed", "kept_text").collect()}
    want = line_dedup(rows)
    assert {i: (got[i][:2], want[i][:2]) for i in got if got[i] != want[i]} == {}


def test_line_dedup_of_many_equal_lines(spark, tmp_path):
    """A text of 10^5 lines, equal or not, is linear work."""
    from palisade.llm.line_dedup import dedup_lines

    rows = [(1, "\n".join(["one two three"] * 100_000)), (2, "\n".join(f"line {i % 60_000} of it" for i in range(100_000))), (3, "\n" * 100_000)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in dedup_lines(spark.read.parquet(path), bare_scan=True).select("row.doc_id", "n_lines", "n_removed").collect()}
    # in the first text every run from the second line on stands one line earlier
    assert got == {1: (100_000, 99_999), 2: (100_000, 40_000), 3: (100_001, 0)}


def test_line_dedup_finds_every_earlier_run(spark, tmp_path):
    """All runs of 50 words that stand somewhere earlier go, whatever else their lines stand in."""
    from palisade.llm.line_dedup import dedup_lines

    rnd = random.Random(11)
    pool = [" ".join(f"{rnd.choice('abcdefgh')}{k}" for _ in range(rnd.choice([1, 2, 9, 18, 28, 44]))) for k in range(24)] + ["", "  ", "\t"]
    cuts = [[rnd.choice(pool) for _ in range(12)] for _ in range(8)]
    rows = []
    for i in range(240):
        parts = [rnd.choice(pool) for _ in range(rnd.randint(0, 5))]
        for cut in rnd.sample(cuts, rnd.randint(0, 2)):
            a = rnd.randrange(9)
            parts += cut[a : a + rnd.randint(1, 9)] + [f"own {i}"] * rnd.randint(0, 1)
        rows.append((i, "\n".join(parts)))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(path)
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in dedup_lines(spark.read.parquet(path), bare_scan=True).select("row.doc_id", "n_removed", "kept_text").collect()}
    want = {i: v[1:] for i, v in line_dedup(rows).items()}
    assert any(n for n, _ in want.values()) and {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = list(zip(w, w[1:], w[2:]))
    c = collections.Counter(grams)
    hit = {k for i, g in enumerate(grams) if c[g] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_quality_base_and_score(spark):
    import math

    from palisade.llm import quality as Q

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.judge(docs, labels).select("row.text", "id", *Q.FEATURES).collect()
    # buckets come from Spark's own hash; all the rest is computed here
    grams = docs.selectExpr("doc_id", "array_remove(split(translate(text, '\t\n\u000b\f\r', '     '), ' '), '') as w").selectExpr("doc_id", "transform(w, (x, i) -> array({}, {})) as g".format(*Q.of_word(Q.buckets_for(docs.selectExpr("sum(octet_length(text))").first()[0]))))
    bags = {r.doc_id: [b for p in r.g for b in p if b is not None] for r in grams.collect()}
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    raw, trusted = collections.Counter(), collections.Counter()
    for i, bag in bags.items():
        raw.update(bag)
        if i in good:
            trusted.update(bag)
    share = sum(trusted.values()) / sum(raw.values())
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality(r.text)
        own = r.id in good
        total = sum(round(Q.SCALE * math.log((max(trusted[b] - own, 0) + Q.PRIOR) / (share * (raw[b] - 1) + Q.PRIOR))) for b in bags[r.id])
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        n = len(bags[r.id])
        assert r.base_failed == base and r.kept == (not base and total >= Q.THRESHOLD * Q.SCALE * n)
        assert abs(r.score - total / Q.SCALE / max(n, 1)) < 1e-9


def test_quality_held_out(spark):
    """Trusted on half of the labels, judged on the other half."""
    from palisade.llm.quality import judge

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    verdicts = {r.id: r.kept for r in judge(docs, labels.where("doc_id % 2 = 0")).select("id", "kept", "base_failed").collect() if not r.base_failed}
    rows = [r for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in verdicts]
    clean = [verdicts[r.doc_id] for r in rows if r.quality == 1 and r.toxic == 0]
    print("kept of clean and of all", sum(clean), len(clean), sum(verdicts.values()), len(verdicts))
    bad = [verdicts[r.doc_id] for r in rows if r.quality == 0]
    assert sum(clean) >= 0.95 * len(clean) and sum(bad) <= 0.2 * len(bad)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_arrays(seed):
    from palisade.llm.decontaminate import search, suffix_array

    rng = np.random.default_rng(seed)
    text = rng.integers(0, 4, 400)
    text[100:160] = text[200:260]
    sa = suffix_array(text, 16)
    assert sorted(sa.tolist()) == np.flatnonzero(text).tolist()
    # suffixes are told apart up to the end of their document
    heads = [list(itertools.takewhile(bool, text[i : i + 16].tolist())) for i in sa]
    assert heads == sorted(heads)
    query = np.concatenate((np.maximum(text[50:90], 1), rng.integers(1, 4, 40)))
    start, length = np.arange(60), rng.integers(1, 12, 60)
    lo, hi = search(text, sa, query, start, length)
    for s, n, a, b in zip(start, length, lo, hi):
        g = query[s : s + n].tolist()
        want = {i for i in range(len(text) - n + 1) if text[i : i + n].tolist() == g and text[i] > 0}
        assert set(sa[a:b].tolist()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.integers(0, 100))
def test_pfor_block(values, percentile):
    from palisade.llm.pfor import decode_block, encode_block

    ids = np.array(values, np.uint32)
    raw = encode_block(ids, percentile)
    back, end = decode_block(raw)
    assert end == len(raw) and back.tolist() == values


_PIECES = list("abcABC'stremdl 019\t\n\r\x1cΣßİéÉ日🙂<|>&$., ") + ["<|endoftext|>", "'ll", "  ", "\u0107", "c\u0301"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(_PIECES), st.characters(max_codepoint=0x24F)), max_size=60))
def test_tokenizers_agree(text):
    import array

    from tokenizers import Tokenizer

    from palisade.llm.bpe import bpe
    from palisade.llm.cells import counter, packer

    text = "".join(text)
    byte, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    ids = _tok(byte).encode(text, add_special_tokens=False).ids
    assert packer(byte).encode([text, text])[1] == array.array("I", ids).tobytes() and counter(byte).encode([text]) == [len(ids)]
    ids = _tok(word).encode(text, add_special_tokens=False).ids
    assert bpe(word).encode([text])[0] == (array.array("I", ids).tobytes(), _tok(word).decode(ids, skip_special_tokens=False))


_TOKS = {}


def _tok(path):
    from tokenizers import Tokenizer

    if path not in _TOKS:
        _TOKS[path] = Tokenizer.from_file(path)
    return _TOKS[path]


def test_components(spark, tmp_path):
    from palisade.llm.components import components

    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 200)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {v: find(v) for e in edges if e[0] != e[1] for v in e}
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), f"file://{tmp_path}").collect()}
    assert got == want


def test_html_main_text(spark):
    import html

    from palisade.llm.html_extract import extract

    rows = extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", y)).split()) for y in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_html_boilerplate():
    from palisade.llm.html_extract import blocks, main_texts

    page = """<body><div id=top class="cookie-notice">We use cookies<div>ok</div></div><header><h1>Site</h1></header><div class="sidebar">s</div><article class="post"><header>
        <h1>Title</h1></header><p>A &lt;b&gt; c&nbsp;d <b>x<p>second <i>y</i><ul><li>one<li>two</ul><div class="ad">buy</div><form>f</form><pre>a < b</pre>
        <section id="comments"><p>nice!</section><footer>by me</footer></article><footer>foot</footer>"""
    assert [t for t, _ in blocks(page)[0]] == ["Title", "A <b> c d x", "second y", "one", "two", "a < b"]
    shared = "this site is run by the friendly people of example dot com"
    sources = [f"<body><p>unique text number {k} of this page<div>{shared}</div></body>" for k in ("one", "two", "three")]
    assert main_texts(sources) == [f"unique text number {k} of this page" for k in ("one", "two", "three")]


@pytest.mark.parametrize("page, want", [
    ("<p title=it's>Main text one.</p><p>It isn't over</p><p>last</p>", ["Main text one.", "It isn't over", "last"]),
    ("<p a='b>c' d=\"e>f\">x<p a='>y", ["x", "y"]),
    ("a<!-->b<!-- > -- -->c<!x>d</ e>f<3 g< h", ["abcdf<3 g< h"]),
    ("x<script>if (a</b>) '<p>'</SCRIPT >y<style>z", ["xy"]),
    ("<article><p>a <math>E = mc</math> <span aria-hidden=true>b</span></p><button>c</button><p hidden>d</p></article>", ["a E = mc b"]),
    ("x<p", ["x"]),
])
def test_html_markup(page, want):
    from palisade.llm.html_extract import blocks

    assert [t for t, _ in blocks(page)[0]] == want


def test_html_is_read_once():
    import time

    from palisade.llm.html_extract import blocks

    t = time.time()
    for part in ("<p a='", "<p>x", "<!--", "</", "<script>", "<", "<a b=\"", "<p a=b c"):
        blocks(part * 100_000)
    blocks("<div><article>" + "<b>" * 100_000 + "</i></div>" * 100_000 + "<article>" * 50_000)
    assert time.time() - t < 20


def _covered(pages, run, least):
    on = collections.defaultdict(set)
    for k, page in enumerate(pages):
        w = " ".join(page).split(" ")
        for i in range(len(w) - run + 1):
            on[tuple(w[i : i + run])].add(k)
    out = []
    for page in pages:
        w = " ".join(page).split(" ")
        hit = {j for i in range(len(w) - run + 1) if len(on[tuple(w[i : i + run])]) >= least for j in range(i, i + run)}
        at, own = 0, []
        for t in page:
            n = len(t.split(" "))
            own.append(len(hit & set(range(at, at + n))) / n)
            at += n
        out.append(own)
    return out


def _host(rnd, k):
    parts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14))) for _ in range(9)]
    return [[rnd.choice(parts) if rnd.random() < 0.6 else f"own {i} {j} " + rnd.choice(parts) for j in range(rnd.randint(1, 5))] for i in range(k)]


def test_covered_runs():
    from palisade.llm.html_extract import covered

    rnd = random.Random(4)
    for _ in range(30):
        pages = _host(rnd, rnd.randint(1, 9))
        assert covered(pages, 4, 3) == _covered(pages, 4, 3)


def test_html_hosts_in_groups(spark):
    """Verdicts are those of the whole host, however it is cut."""
    from palisade.llm.html_extract import COVERED, extract

    rnd = random.Random(8)
    hosts = {h: _host(rnd, 25) for h in "xyz"}
    rows = [(i, f"http://{h}/{i}", "".join(f"<div>{t}</div>" for t in page)) for h, pages in hosts.items() for i, page in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = {(f"http://{h}/{i}"): "\n\n".join(t for t, c in zip(page, shares) if c < COVERED) for h, pages in hosts.items() for i, (page, shares) in enumerate(zip(pages, _covered(pages, 8, 3)))}
    for size in (1 << 20, 300, 1000):
        got = {r.url: r.text for r in extract(df, group_bytes=size).collect()}
        assert got == want


def _articles(rnd, n, shared, copies=0):
    """Articles of blocks of their own (equal ones twice, near copies); every other one, and some, with a notice."""
    own = [[" ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(9, 30))) for _ in range(rnd.randint(2, 5))] for _ in range(n)]
    pages = [[*b[:1], shared[0], *b[1:]] if rnd.random() < 0.75 else b for b in own]
    pages = [[*b, shared[1]] if rnd.random() < 0.25 else b for b in pages]
    pages += [list(b) for b in pages[:3]]
    base = [" ".join(f"c{j}x{i}" for i in range(40)) for j in range(4)]
    for k in range(copies):
        near = [b.split(" ") for b in base]
        near[k % 4][rnd.randrange(40)] = f"z{k}"
        pages.append([" ".join(b) for b in near])
    return pages


def _without_notices(pages, run=8, least=3):
    """Article blocks that stay, from all runs of all distinct articles."""
    distinct = list(dict.fromkeys(map(tuple, pages)))
    on = collections.defaultdict(set)
    for k, page in enumerate(distinct):
        w = " ".join(page).split(" ")
        for i in range(len(w) - run + 1):
            on[tuple(w[i : i + run])].add(k)
    out = []
    for page in pages:
        w = " ".join(page).split(" ")
        hit = {j for i in range(len(w) - run + 1) if 2 * len(on[tuple(w[i : i + run])]) >= max(2 * least, len(distinct)) for j in range(i, i + run)}
        at, kept, gone = 0, [], 0
        for t in page:
            n = len(t.split(" "))
            if len(hit & set(range(at, at + n))) >= 0.9 * n:
                gone += n
            else:
                kept.append(t)
            at += n
        out.append("\n\n".join(page if gone > 0.8 * at else kept))
    return out


def test_html_notices_in_articles():
    """The suffix array decides inside articles: what most of a host's articles have goes, what some share stays."""
    from palisade.llm.html_extract import main_texts

    notice, passage = "sign up for our weekly letter and never miss a story again", "a passage of eight words or more that some share"
    own = [[f"title {k}", f"text {k} of the article {k} has words {k} of its own", passage if k < 2 else f"other words {k}"] for k in range(6)]
    pages = [f"<body><nav>menu</nav><article>{''.join(f'<p>{t}</p>' for t in [*x, notice])}</article><p>{notice}</p></body>" for x in own]
    assert main_texts(pages) == ["\n\n".join(x) for x in own]
    assert main_texts(pages[:2]) == ["\n\n".join([*x, notice]) for x in own[:2]]
    assert main_texts(pages[:1] * 9) == ["\n\n".join([*own[0], notice])] * 9
    # near copies stay whole
    near = [["first block of this text with a good number of words " * 3 + str(k), "second block with words that are the same in every copy"] for k in range(9)]
    assert main_texts([f"<main>{''.join(f'<p>{t}</p>' for t in x)}</main>" for x in near]) == ["\n\n".join(x) for x in near]


def test_html_articles_in_groups(spark):
    """Boilerplate of articles is that of the whole host, however it is cut; other pages are judged alike beside it."""
    from palisade.llm.html_extract import COVERED, extract

    rnd = random.Random(5)
    hosts = {h: _articles(rnd, n, (f"notice of {h} that all its pages have somewhere in them", f"passage on {h} that is quoted by some of its articles"), c) for h, n, c in (("x", 60, 0), ("y", 40, 30), ("z", 2, 0), ("q", 12, 90))}
    rows = [(i, f"http://{h}/{i}", "<nav>m</nav><article>" + "".join(f"<p>{t}</p>" for t in page) + "</article>") for h, pages in hosts.items() for i, page in enumerate(pages)]
    want = {f"http://{h}/{i}": t for h, pages in hosts.items() for i, t in enumerate(_without_notices(pages))}
    assert sum(t.count("notice of x") for t in want.values()) == 0 and sum(t.count("passage on x") for t in want.values()) > 5
    others = {h: _host(rnd, 25) for h in "xw"}
    rows += [(i, f"http://{h}/o{i}", "".join(f"<div>{t}</div>" for t in page)) for h, pages in others.items() for i, page in enumerate(pages)]
    want |= {f"http://{h}/o{i}": "\n\n".join(t for t, c in zip(page, shares) if c < COVERED) for h, pages in others.items() for i, (page, shares) in enumerate(zip(pages, _covered(pages, 8, 3)))}
    rows += [(1, "http://x/empty", None), (None, "http://x/empty2", "<nav>m</nav>"), (7, None, "<article>a</article>")]
    want |= {"http://x/empty": "", "http://x/empty2": "", None: "a"}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    for size in (1 << 20, 1000, 9000):
        got = extract(df, group_bytes=size).collect()
        assert len(got) == len(rows) and {r.url: r.text for r in got} == want


def test_pipeline(spark):
    """run() against the stages done plainly, each on what the one before has kept."""
    import corpus_pipeline as P
    from palisade.llm.decontaminate import contamination
    from palisade.llm.quality import judge

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdict = {r.id: r.kept for r in judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).select("id", "kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if verdict[r.doc_id])
    after = line_dedup(rows)
    rows = [(i, after[i][2]) for i, _ in rows if not after[i][1] or after[i][2].strip(" ")]
    cls = classes(rows)
    rows = [(i, t) for i, t in rows if cls[i][0] == i]
    left = spark.createDataFrame(rows, "doc_id bigint, text string")
    dirty = {r.doc_id for r in contamination(left, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    tok = _tok(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in rows:
        if i not in dirty:
            ids = tok.encode(t, add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest())
    assert [n for n, _ in P.STAGES][0] == "quality rules" and len(P.STAGES) == 5
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in P.run(spark, SF).collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", "é", ".", "1", " ", "  ", "\n", " \n", "\t", "　", "\x1c", "\x85", "​", "<|endoftext|>", "'s"]), max_size=40))
def test_cells_of_odd_white_space(parts):
    """Texts are cut at every safe place, and the cells give the library's ids."""
    import array

    from palisade.llm.cells import cells, counter, packer

    text, byte = "".join(parts), public_tokenizers.path("byte_bpe_50k.json")
    ids = _tok(byte).encode(text, add_special_tokens=False).ids
    assert packer(byte).encode([text])[0] == array.array("I", ids).tobytes() and counter(byte).encode([text]) == [len(ids)]
    cut, odd = cells(text)
    assert " ".join(cut) == text and len(cut) == 1 + len([m for m in re.finditer(" ", text) if m.start() and not text[m.start() - 1].isspace()])
    assert all(any(c.isspace() for c in cut[k]) or not cut[k] for k in odd)


def test_stores_are_bounded_by_bytes():
    from palisade.llm import bpe as B

    model = B.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdefgh1.") for _ in range(20_000)) for _ in range(5)]
    tok = _tok(public_tokenizers.path("word_bpe_49k.json"))
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert model.encode([t])[0][0] == b"".join(i.to_bytes(4, "little") for i in ids)
    assert not model._chunks and max(map(len, model._words)) <= B.MAX_LENGTH


def test_long_words_take_compact_lists(monkeypatch):
    from palisade.llm import bpe as B

    monkeypatch.setattr(B, "MAX_SYMBOLS", 50)
    model, tok = B.Bpe(public_tokenizers.path("word_bpe_49k.json")), _tok(public_tokenizers.path("word_bpe_49k.json"))
    text = "reading " * 30 + "therefore" * 200 + " ending"
    assert model.encode([text])[0][0] == b"".join(i.to_bytes(4, "little") for i in tok.encode(text, add_special_tokens=False).ids)


def test_longest_matches(spark, tmp_path):
    """Overlapping, equal and short items in several blocks: hits, items and the longest match against all runs."""
    from palisade.llm.decontaminate import contamination

    rnd = random.Random(9)
    story = [f"s{i}" for i in range(80)]
    items = [(0, story[0:30]), (1, story[5:50]), (2, story[20:60]), (3, story[5:50]), (4, story[61:64]), (5, ["x", "y"] * 12)]
    items += [(k, [rnd.choice("abc") for _ in range(rnd.randint(1, 16))]) for k in range(6, 30)]
    docs = [(0, story), (1, story[5:50]), (2, story[3:27] + ["-"] + story[22:47]), (3, ["x", "y"] * 9), (4, [])]
    docs += [(k, [rnd.choice("abcz") for _ in range(rnd.randint(1, 60))] + story[rnd.randint(0, 40) : 70]) for k in range(5, 40)]
    frame = lambda rows, n: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{n} bigint, text string")
    root = f"file://{tmp_path}/blocks"
    import palisade.llm.decontaminate as D

    size = D.BLOCK_WORDS
    D.write_blocks.__defaults__ = (60,)
    try:
        got = {r.doc_id: r for r in contamination(frame(docs, "doc_id"), frame(items, "item_id"), root=root).collect()}
    finally:
        D.write_blocks.__defaults__ = (size,)
    assert len(list((tmp_path / "blocks").glob("*.pickle"))) > 3
    by = {str(i): [w for x in w_ for w in re.findall("[0-9a-z]+", x)] for i, w_ in items}
    for i, w in docs:
        w = [x for y in w for x in re.findall("[0-9a-z]+", y)]
        hit, names = set(), set()
        for name, v in by.items():
            n = min(10, len(v))
            for q in range(len(v) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[q : q + n]:
                        hit |= set(range(p, p + n))
                        names.add(name)
        held = {tuple(v[a:b]) for v in by.values() for a in range(len(v)) for b in range(a + 1, len(v) + 1)}
        best = max(((b - a, -a) for a in hit for b in range(a + 1, len(w) + 1) if set(range(a, b)) <= hit and tuple(w[a:b]) in held), default=(0, None))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(names)), i
        assert r.longest == best[0] and (not hit or (r.longest_at == -best[1] and tuple(w[r.longest_at : r.longest_at + r.longest]) in {tuple(by[r.longest_item][a : a + r.longest]) for a in range(len(by[r.longest_item]))})), (i, r, best)
