"""Benchmark decontamination: suffix arrays over the documents.

Documents are gathered in shards of about ``SHARD_CHARS`` characters. Their words
become numbers (0: not in the benchmark), and the suffixes that begin with a
benchmark word are sorted once a shard, by prefix doubling. Every suffix of every
benchmark item is then looked up by binary search, word by word, in all shards;
its interval after ``window`` words holds all places where that window stands. In
the passages that are found, the longest verbatim match with an item is looked up
in the item's own suffix array: from a match that ends at a word, the next one to
try is the first that reaches beyond it, so all maximal matches are met.

Words are lower-cased in A-Z and are runs of digits, letters a-z and characters
beyond ASCII, numbered by the order of their 64-bit hashes among the benchmark's.
An item's windows are its runs of ``window`` consecutive words; an item with fewer
words (but some) is one window. A document's word is hit if it lies in any
occurrence of any window. Matches never cross documents.

Tasks write the benchmark to the shared folder in blocks of about ``BLOCK_WORDS``
words, with the windows, vocabulary and suffix array of each; only the names of the
blocks reach the driver. Every shard is searched for block after block, so neither
the benchmark's size nor the number of documents that share a passage bounds what
can be found; a worker keeps the ``KEPT`` blocks that it used last.
"""

from __future__ import annotations

import pickle
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Store, shared_dir

WINDOW = 10
SHARD_CHARS = 4 << 20
BLOCK_WORDS = 500_000
KEPT = 16
#: Words whose numbers a worker remembers.
MAX_KNOWN = 1_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def hashes(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, none of them 0."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) or 1 for w in found], np.uint64)


class Block:
    """Items of the benchmark as one stream of numbers (0 after each item), their
    windows and suffix array. ``numbered`` puts the numbers of a larger vocabulary
    in; they keep the order, so the suffix array stays."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        parts = [x for _, w in items for x in (hashes(w), np.zeros(1, np.uint64))]
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(self.hashes[self.hashes > 0])
        self.begin = np.cumsum([0, *[len(w) + 1 for _, w in items]])
        self.stream = self.numbered(self.vocabulary)
        self.sa = suffix_array(self.stream, len(self.stream))
        # equal windows are looked up once: the first of them stands for all
        first: dict[bytes, int] = {}
        start, length, owners = [], [], []
        for k, (_, w) in enumerate(items):
            n, at = min(window, len(w)), int(self.begin[k])
            for s in range(at, at + len(w) - n + 1) if w else ():
                j = first.setdefault(self.stream[s : s + n].tobytes(), len(start))
                if j == len(start):
                    start.append(s)
                    length.append(n)
                owners.append(j * len(items) + k)
        self.start, self.length = np.array(start, np.int64), np.array(length, np.int64)
        # the items of window j: owner[first_owner[j] : first_owner[j + 1]]
        owners = np.unique(np.array(owners, np.int64))
        self.owner = owners % max(1, len(items))
        self.first_owner = np.searchsorted(owners // max(1, len(items)), np.arange(len(start) + 1))

    def numbered(self, vocabulary: np.ndarray) -> np.ndarray:
        return np.where(self.hashes > 0, np.searchsorted(vocabulary, self.hashes) + 1, 0).astype(np.int64)


def write_blocks(benchmark: DataFrame, root: str, window: int, block_words: int = BLOCK_WORDS) -> list[str]:
    """The names of the blocks that the tasks have written."""
    rows = benchmark.selectExpr("cast(item_id as string) as i", "cast(text as string) as t").distinct()
    size = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("bigint"))).first()[0] or 0

    def build(batches):
        import uuid

        import pyarrow as pa

        store, names, held, n = Store(root), [], [], 0

        def flush():
            block, name = Block(held, window), f"block-{uuid.uuid4().hex}"
            vocabulary, block.vocabulary, block.stream = block.vocabulary, None, None
            with store.create(f"{name}.vocabulary") as f:
                f.write(vocabulary.tobytes())
            with store.create(f"{name}.pickle") as f:
                f.write(pickle.dumps(block, protocol=5))
            names.append(name)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(t)
                if w:
                    held.append((i or "", w))
                    n += len(w)
                if n >= block_words:
                    flush()
                    held, n = [], 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    tasks = max(1, -(-size // (8 * block_words)))
    return sorted(r[0] for r in rows.coalesce(tasks).mapInArrow(build, "name string").collect())


class Vocabulary:
    """The benchmark's words, and the numbers of a document's words."""

    def __init__(self, root: str, names: list[str]):
        parts = [np.zeros(0, np.uint64)]
        for name in names:
            with Store(root).open(f"{name}.vocabulary") as f:
                parts.append(np.frombuffer(f.read(), np.uint64))
        self.all = np.unique(np.concatenate(parts))
        self._known: dict[bytes, int] = {}

    def numbers(self, found: list[bytes]) -> list[int]:
        known = self._known
        if len(known) > MAX_KNOWN:
            known.clear()
        new = [w for w in set(found) if w not in known]
        if new and len(self.all):
            h = hashes(new)
            at = np.minimum(np.searchsorted(self.all, h), len(self.all) - 1)
            known.update(zip(new, np.where(self.all[at] == h, at + 1, 0).tolist()))
        else:
            known.update(dict.fromkeys(new, 0))
        return [known[w] for w in found]


@lru_cache(maxsize=1)
def _vocabulary(root: str, names: tuple[str, ...]) -> Vocabulary:
    return Vocabulary(root, list(names))


@lru_cache(maxsize=KEPT)
def _block(root: str, name: str, names: tuple[str, ...]) -> Block:
    with Store(root).open(f"{name}.pickle") as f:
        block = pickle.loads(f.read())
    block.stream = block.numbered(_vocabulary(root, names).all)
    return block


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions with ``text`` > 0, sorted by their next ``depth`` (rounded up to
    a power of two) numbers. Only suffixes that still tie are sorted again."""
    n = len(text)
    sa = np.flatnonzero(text > 0)
    if not len(sa):
        return sa
    rank = np.zeros(n + 1, np.int64)
    rank[:n] = text
    key = text[sa] * np.int64(int(text.max()) + 1)
    nxt = np.zeros(len(sa), np.int64)
    inside = sa + 1 < n
    nxt[inside] = text[sa[inside] + 1]
    key += nxt
    order = np.argsort(key, kind="stable")
    sa, key = sa[order], key[order]
    h = 2
    while True:
        new = np.empty(len(sa), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        # a group's rank is where it begins, plus one; ranks of other words stay 0
        begin = np.maximum.accumulate(np.where(new, np.arange(len(sa)), 0))
        rank[sa] = begin + 1
        if h >= depth:
            return sa
        size = np.diff(np.append(np.flatnonzero(new), len(sa)))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return sa
        ahead = sa[tied] + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n)], 0)
        group = begin[tied]
        order = np.lexsort((second, group))
        sa[tied] = sa[tied][order]
        key = begin * np.int64(n + 2)
        key[tied] = group[order] * np.int64(n + 2) + second[order]
        h *= 2


def search(text: np.ndarray, sa: np.ndarray, query: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``sa`` the suffixes stand that begin with each query, by binary
    search for all queries at once, word by word."""
    n, m = len(text), len(sa)
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), m, np.int64)
    for d in range(int(length.max()) if len(length) else 0):
        live = np.flatnonzero((hi > lo) & (length > d))
        if not len(live):
            break
        want = query[start[live] + d]

        def bound(strict: bool):
            a, b = lo[live].copy(), hi[live].copy()
            while True:
                go = np.flatnonzero(a < b)
                if not len(go):
                    return a
                mid = (a[go] + b[go]) >> 1
                at = sa[mid] + d
                x = np.where(at < n, text[np.minimum(at, n - 1)], -1)
                less = x <= want[go] if strict else x < want[go]
                a[go[less]] = mid[less] + 1
                b[go[~less]] = mid[~less]

        left, right = bound(False), bound(True)
        lo[live], hi[live] = left, right
    return lo, hi


class Found:
    """What one document has of the benchmark."""

    __slots__ = ("n_words", "n_hit", "items", "longest", "where")

    def __init__(self, n_words: int):
        self.n_words, self.n_hit, self.items = n_words, 0, set()
        self.longest, self.where = 0, None


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        to = min(n, at + step)
        differ = a[at:to] != b[at:to]
        if differ.any():
            return at + int(differ.argmax())
        at, step = to, step * 4
    return n


def longest_prefix(block: Block, query: np.ndarray) -> tuple[int, int]:
    """How many of the query's first words stand in an item, and where in the stream."""
    stream, sa, lo, hi, best, at = block.stream, block.sa, 0, len(block.sa), 0, -1
    while lo < hi:
        mid = (lo + hi) >> 1
        s = int(sa[mid])
        n = _common(query, stream[s : s + len(query)])
        if n > best:
            best, at = n, s
        if n == len(query):
            break
        if s + n < len(stream) and stream[s + n] > query[n]:
            hi = mid
        else:
            lo = mid + 1
    return best, at


def maximal_matches(block: Block, query: np.ndarray):
    """(begin, length, place in the stream) of matches with items that can't be extended."""
    p, e = 0, 0
    while p < len(query):
        n, at = longest_prefix(block, query[p:])
        if n and p + n > e:
            e = p + n
            yield p, n, at
        if p + n >= len(query):
            return
        # the first begin from which a match reaches beyond the end of this one
        end = p + n + 1
        lo, hi = p + 1, end
        while lo < hi:
            mid = (lo + hi) >> 1
            if longest_prefix(block, query[mid:end])[0] == end - mid:
                hi = mid
            else:
                lo = mid + 1
        p = lo


def _match(block: Block, text: np.ndarray, sa: np.ndarray, begin: np.ndarray, found: list[Found]) -> np.ndarray:
    """Looks all windows of a block up in one shard; marks the words that are hit."""
    hit = np.zeros(len(text), bool)
    if not len(block.start) or not len(sa):
        return hit
    lo, hi = search(text, sa, block.stream, block.start, block.length)
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return hit
    count = (hi - lo)[some]
    which = np.repeat(some, count)
    at = sa[np.repeat(lo[some], count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + block.length[which], -1)
    hit = np.cumsum(edge)[:-1] > 0
    doc = np.searchsorted(begin, at, "right") - 1
    pairs = np.unique(doc * np.int64(len(block.start)) + which)
    for d, q in zip((pairs // len(block.start)).tolist(), (pairs % len(block.start)).tolist()):
        found[d].items.update([block.names[k] for k in block.owner[block.first_owner[q] : block.first_owner[q + 1]].tolist()])
    # passages: runs of words that are hit (documents are apart by a word that never is)
    turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    for a, b in zip(turn[0::2].tolist(), turn[1::2].tolist()):
        d = int(np.searchsorted(begin, a, "right")) - 1
        f = found[d]
        if b - a < f.longest:
            continue
        for p, n, s in maximal_matches(block, text[a:b]):
            item = block.names[int(np.searchsorted(block.begin, s, "right")) - 1]
            if (n, -(a + p - int(begin[d]))) > (f.longest, -f.where[0] if f.where else 1):
                f.longest, f.where = n, (a + p - int(begin[d]), item)
    return hit


def find(texts: list, root: str, names: list[str]) -> list[Found]:
    names, docs = tuple(names), [words(t) for t in texts]
    found = [Found(len(w)) for w in docs]
    if not names:
        return found
    vocabulary = _vocabulary(root, names)
    begin = np.concatenate(([0], np.cumsum([len(w) + 1 for w in docs]))).astype(np.int64)
    text = np.zeros(int(begin[-1]), np.int64)
    for i, w in enumerate(docs):
        text[begin[i] : begin[i + 1] - 1] = vocabulary.numbers(w)
    window = _block(root, names[0], names).window
    sa = suffix_array(text, window)
    hit = np.zeros(len(text), bool)
    for name in names:
        hit |= _match(_block(root, name, names), text, sa, begin, found)
    total = np.concatenate(([0], np.cumsum(hit)))
    for f, a, b in zip(found, begin[:-1].tolist(), begin[1:].tolist()):
        f.n_hit = int(total[b] - total[a])
    return found


def _shards(batches, column: int, most: int):
    """Record batches cut or joined to shards of about ``most`` characters."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        first, total = 0, size
        for i, n in enumerate(lengths.tolist()):
            total += n
            if total >= most:
                held.append(b.slice(first, i + 1 - first))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, first, total = [], i + 1, 0
        size = total
        if first < b.num_rows:
            held.append(b.slice(first))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS, root: str | None = None) -> DataFrame:
    """A row per document: n_words, n_hit, n_items, items_sha256 (of the sorted
    item ids, joined by commas), contaminated, and the longest verbatim match of
    hit words with an item (``longest`` words from word ``longest_at``, the first
    of several, of ``longest_item``, an item that holds it).

    Null and empty texts have no words; very long texts are a shard of their own;
    null item ids count as the empty id and rows with equal ids as one item;
    repeated documents are rows of their own; other columns are not read. With an
    empty benchmark nothing is hit.
    """
    root = root or shared_dir(docs.sparkSession, "benchmark")
    names = write_blocks(benchmark, root, window)

    def scan(batches):
        import hashlib

        import pyarrow as pa

        kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
        columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at", "longest_item"]
        for b in _shards(batches, 1, shard_chars):
            rows = []
            for i, f in zip(b.column(0).to_pylist(), find(b.column(1).to_pylist(), root, names)):
                n = f.n_hit
                at, item = f.where or (None, None)
                rows.append((i, f.n_words, n, len(f.items), hashlib.sha256(",".join(sorted(f.items)).encode()).hexdigest(), n > 0, f.longest, at, item))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=columns)

    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest bigint, longest_at bigint, longest_item string"
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(scan, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS, root: str | None = None) -> DataFrame:
    """The documents (all columns) in which no window occurs; cases as for ``contamination``."""
    root = root or shared_dir(docs.sparkSession, "benchmark")
    names = write_blocks(benchmark, root, window)
    at = docs.columns.index("text")

    def scan(batches):
        import pyarrow as pa

        for b in _shards(batches, at, shard_chars):
            yield b.filter(pa.array([not f.n_hit for f in find(b.column(at).to_pylist(), root, names)], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
