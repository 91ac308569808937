"""Every operator on odd rows and on an empty table, against defined results."""

import hashlib
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_shards(odd_docs, no_docs):
    from palisade.llm.shards import shard

    out = shard(odd_docs, n_shards=4, bare_scan=True)
    rows = out.select("doc_id", "text", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(texts(odd_docs))
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) <= set(range(4))
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert shard(no_docs, n_shards=4, bare_scan=True).count() == 0
    again = shard(odd_docs, n_shards=4, bare_scan=True).select("doc_id", "text", "shard", "slot").collect()
    assert Counter(again) == Counter(rows)


def test_matrix_is_exact():
    from palisade.llm.shards import communication_matrix, sizes_of

    rows, cells = [10, 0, 7, 100], sizes_of(117, 13)
    m = communication_matrix(rows, cells, 5)
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == cells
    import numpy as np

    from palisade.llm.shards import draw

    big = np.array([3_000_000_000, 5, 0, 2_000_000_000])
    d = draw(np.random.default_rng(1), big, 1_000_000_000)
    assert d.sum() == 1_000_000_000 and (d <= big).all() and abs(d[0] - 600_000_000) < 200_000
    mean = sum(communication_matrix(rows, cells, s)[0][0] for s in range(400)) / 400
    assert abs(mean - 10 * 9 / 117) < 0.15


def test_own_draws_follow_the_law(monkeypatch):
    """The draw for large populations, used for small ones: mean and variance of the hypergeometric law."""
    import numpy as np

    from palisade.llm import shards as S

    monkeypatch.setattr(S, "LARGE", 1)
    rng = np.random.default_rng(3)
    for good, bad, n in ((30, 50, 20), (3000, 500, 70), (5, 5, 9), (1, 400, 200)):
        x = S.hypergeometric(rng, np.full(40_000, good), np.full(40_000, bad), np.full(40_000, n))
        total = good + bad
        mean = n * good / total
        var = mean * (bad / total) * (total - n) / (total - 1)
        assert x.min() >= max(0, n - bad) and x.max() <= min(n, good)
        assert abs(x.mean() - mean) < 5 * (var / 40_000) ** 0.5 and abs(x.var() / var - 1) < 0.05


def test_whole_shuffle_is_uniform():
    """Each row is as often in each cell, and two rows meet as often, whether of one partition or of two."""
    import numpy as np

    from palisade.llm.shards import _labels, sizes_of

    rows, shards, runs = [7, 0, 12, 5], 4, 3000
    before = np.concatenate(([0], np.cumsum(rows))).astype(np.int64).tobytes()
    cells = np.array([np.concatenate([_labels(s, i, i, before, shards, 1) for i in range(4)]) for s in range(runs)])
    size = sizes_of(24, shards)
    for c in range(shards):
        assert (np.bincount((cells == c).sum(axis=1)) == [0] * size[c] + [runs]).all()
        assert abs((cells == c).mean(axis=0) - size[c] / 24).max() < 0.04
    meet = (cells[:, :, None] == cells[:, None, :]).mean(axis=0)[~np.eye(24, dtype=bool)]
    assert abs(meet - 5 / 23).max() < 0.04


def test_token_files(odd_docs, no_docs):
    from tokenizers import Tokenizer

    from palisade.llm.token_files import token_files

    tok = Tokenizer.from_file(BYTE)
    got = token_files(odd_docs, BYTE).collect()
    assert len(got) == odd_docs.count()
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))

    def crc(t):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        return len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))

    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, *crc(t)) for i, t in texts(odd_docs))
    assert token_files(no_docs, BYTE).count() == 0


def test_small_files_and_blocks(spark, tmp_path):
    from palisade.llm.token_files import read_token_files, write_token_files

    docs = spark.range(300).selectExpr("300 - id as doc_id", "repeat(concat('word', id, ' '), cast(id as int)) as text")
    root = f"file://{tmp_path}"
    files = write_token_files(docs, BYTE, root, file_ids=20_000)
    assert files.count() > 3
    rows = sorted(read_token_files(files, root).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == list(range(1, 301))
    assert rows[-1].start + rows[-1].n_tokens == files.agg(F.sum("n_ids")).first()[0]


def test_token_counts(odd_docs, no_docs):
    from tokenizers import Tokenizer

    from palisade.llm.token_counts import count_tokens

    tok = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, t in texts(odd_docs):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 1024)] += 1
    assert Counter(tuple(r) for r in count_tokens(odd_docs, BYTE).collect()) == want
    assert count_tokens(no_docs, BYTE).count() == 0
    piece = count_tokens(odd_docs.where("length(text) < 1000"), public_tokenizers.path("piece_bpe_32k.model"))
    assert piece.where("doc_id = 7").first().n_tokens > 0


def test_bpe(odd_docs, no_docs):
    from tokenizers import Tokenizer

    from palisade.llm.bpe import encode_decode

    tok = Tokenizer.from_file(WORD)
    want = Counter()
    for i, t in texts(odd_docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want[(i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in encode_decode(odd_docs, WORD).collect()) == want
    assert encode_decode(no_docs, WORD).count() == 0
    whole = encode_decode(odd_docs.where("doc_id = 7"), WORD, keep_text=True).first()
    assert whole.decoded == "x</w>" and len(whole.ids) == 1


def test_quality(odd_docs, no_docs, labels):
    from palisade.llm.quality import FEATURES, judge, keep

    rows = judge(odd_docs, labels).select("id", *FEATURES).collect()
    assert len(rows) == odd_docs.count()
    by = {r.id: r for r in rows}
    assert by[3].n_words == 0 and by[3].base_failed and not by[3].kept and by[3].score == 0.0
    assert by[5].n_words == 0 and by[6].n_words == 60_000 and by[6].n_repeat_words == 60_000
    assert by[8].n_dup_lines == 1
    kept = keep(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.kept for r in rows)
    assert judge(no_docs, labels).count() == 0
    assert {r.kept for r in judge(odd_docs, labels.where("false")).collect()} <= {True, False}


def test_decontamination(odd_docs, no_docs, benchmark):
    from palisade.llm.decontaminate import contamination, decontaminated

    by = {r.doc_id: r for r in contamination(odd_docs, benchmark).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (by[3].n_words, by[3].n_hit, by[3].items_sha256, by[3].contaminated) == (0, 0, empty, False)
    assert by[1].items_sha256 == hashlib.sha256(b",1,4").hexdigest() and by[1].n_items == 3
    # per repeat: items' 11 words, "the lazy" within it, "old river bank"
    assert by[1].n_hit == 4 * (11 + 3) and by[1].longest == 11
    kept = decontaminated(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {3, None, 4, 5, 6, 7, 9, 10}
    assert contamination(no_docs, benchmark).count() == 0
    assert contamination(odd_docs, benchmark.where("false")).where("contaminated").count() == 0
    # shards of one text and blocks of one item give the same
    small = contamination(odd_docs, benchmark, shard_chars=1).collect()
    assert Counter(tuple(r) for r in small) == Counter(tuple(r) for r in contamination(odd_docs, benchmark).collect())


def test_blocks_of_the_benchmark(spark, tmp_path):
    from palisade.llm import decontaminate as D

    items = spark.createDataFrame([(str(i), f"one two three item {i}") for i in range(9)], "item_id string, text string")
    root = f"file://{tmp_path}"
    names = D.write_blocks(items, root, 10, block_words=7)
    assert len(names) > 3
    found = D.find(["a one two three item 5 b", "one two three item", None], root, names)
    assert [(f.n_hit, f.items) for f in found] == [(5, {"5"}), (0, set()), (0, set())]


def test_line_dedup(odd_docs, no_docs):
    from palisade.llm.line_dedup import dedup_lines

    out = dedup_lines(odd_docs, bare_scan=True)
    rows = out.select("row.doc_id", "row.key", "n_lines", "n_removed", "kept_text").collect()
    assert len(rows) == odd_docs.count() and all(r.key == "other" for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id not in (2, None)}
    assert by[3].kept_text is None and by[3].n_lines == 0 and by[4].kept_text == "" and by[5].n_removed == 0
    assert by[8].n_removed == 1 and by[8].kept_text.count("\n") == 3
    # of the equal single-line documents 1, 2, 2 one copy is left
    same = [r for r in rows if r.doc_id in (1, 2)]
    assert sorted(r.n_removed for r in same) == [0, 1, 1] and sorted(r.kept_text for r in same)[:2] == ["", ""]
    assert dedup_lines(no_docs, bare_scan=True).count() == 0


def test_jaccard(odd_docs, no_docs):
    from palisade.llm.jaccard_join import first_of_each, similar

    rows = similar(odd_docs, bare_scan=True).collect()
    assert len(rows) == odd_docs.count()
    by = {r.id: r for r in rows if r.id is not None}
    assert by[1].class_id == by[2].class_id == 1 and by[1].n_copies == 2
    for i in (3, 4, 5, 6, 7, 10):
        assert (by[i].class_id, by[i].n_links, by[i].n_copies) == (i, 0, 0)
    near = [r for r in rows if r.id is None]
    assert {(r.class_id, r.n_links) for r in near} == {(1, 1), (None, 0)}
    kept = first_of_each(odd_docs, bare_scan=True)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter([1, 3, None, 4, 5, 6, 7, 8, 9, 10])
    assert similar(no_docs, bare_scan=True).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    article = "<article><h1>T</h1><p>Some &amp; text</p></article>"
    rows = [(1, "http://a.b/x", article), (2, "http://a.b/y", article), (2, "http://a.b/y", article), (3, None, None), (None, "u", ""), (None, "u", "<p>x"), (4, "http://a.b/z\r\nX: y", "é" * 50_000), (5, "q", ""), (6, "http://c.d", "<nav>m</nav>plain < text<br>two")]
    return spark.createDataFrame([(*r, "other") for r in rows], "page_id bigint, url string, html string, kind string")


def test_warc(pages):
    import base64

    from palisade.llm.warc import warc_round_trip

    rows = warc_round_trip(pages, file_bytes=300).collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert r.refers_to is None or r.record_type == "revisit"
    by = {r.page_id: r for r in rows if r.page_id not in (2, None)}
    assert by[1].record_type == "response" and by[5].record_type == "revisit" and by[5].refers_to == 3
    assert {(r.record_type, r.refers_to) for r in rows if r.page_id == 2} == {("revisit", 1)}
    assert by[4].payload_bytes == 100_000 and by[4].payload_digest == base64.b32encode(hashlib.sha1(("é" * 50_000).encode()).digest()).decode()
    assert warc_round_trip(pages.where("false")).count() == 0


def test_warc_files_are_deterministic(spark, pages, tmp_path):
    """Names and bytes are equal from run to run, whatever the order of the rows; one id may need several ranges."""
    from palisade.llm.warc import read_warc, write_warc

    more = spark.range(3000).selectExpr("id * id as page_id", "concat('http://h/', id) as url", "repeat(concat('<p>', id), cast(id % 90 as int)) as html", "'x' as kind")
    more = more.union(spark.range(400).selectExpr("7 as page_id", "concat('u', id) as url", "repeat(concat('y', id % 9), 400) as html", "'x' as kind"))
    names = []
    for k, rows in enumerate((pages.union(more), more.union(pages).orderBy("html").repartition(5))):
        root = f"file://{tmp_path}/{k}"
        files = write_warc(rows, root, file_bytes=4000, parts=9)
        names.append(sorted(tuple(r) for r in files.collect()))
        assert len({r[0] for r in names[-1]}) > 8
        back = read_warc(files, root).collect()
        assert len(back) == rows.count()
        hot = [r for r in back if r.page_id == 7]
        assert sum(r.record_type == "response" for r in hot) == 9 and {r.refers_to for r in hot} == {None, 7}
    assert names[0] == names[1]
    ids = [x for f in (tmp_path / "0").glob("*.gz") for x in __import__("gzip").decompress(f.read_bytes()).decode().split("\r\n") if x.startswith("WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == rows.count()


def test_ranges_follow_the_ids(spark):
    from palisade.llm.warc import id_ranges

    rows = spark.createDataFrame([(i, 10) for i in [*range(100), *([5] * 500), 2**62, -(2**62), None]], "page_id bigint, bytes bigint")
    starts, parts = id_ranges(rows, 10)
    assert starts == sorted(starts) and 5 in starts and parts[starts.index(5) + 1] > 1 and sum(parts) < 30
    assert id_ranges(rows.where("false"), 10) == ([], [1])


def test_html(pages):
    from palisade.llm.html_extract import extract

    rows = extract(pages).collect()
    assert len(rows) == pages.count()
    by = {r.page_id: r for r in rows if r.page_id is not None}
    assert by[1].text == "T\n\nSome & text" and by[1].n_chars == 14 and by[3].text == ""
    assert by[6].text == "plain < text two"
    assert extract(pages.where("false")).count() == 0
