"""N-gram Jaccard join by chosen paths.

A text's set holds the hashes of its runs of ``N`` words (of all its words, if it
has fewer). Texts with equal words are one set; only sets take part.

Splitting: at a node of a run's tree a set chooses the elements t with
``hash(node, t) < 1 / (similarity * size)`` (size: elements that its path hasn't
used), each of which leads to a child node that all sets choosing t share. Two sets at the wanted similarity share one
chosen element on average, and more the more alike they are. Which elements a
set chooses depends on node and set alone, so a set's paths are known without
looking at others: its elements of depth 1 are its buckets, and the paths below
each of them travel with it. Buckets of up to ``SMALL`` sets are compared by brute force. In
a larger one all sketches are first compared with that of a pivot. The number of
other bits is a metric: sets within ``REACH`` of the pivot (the near ones) are linked
to it and can't be similar to any beyond twice that; those between are linked as well,
unseen (the exact comparison sorts them out), so the near ones are done with and the
others are a smaller bucket. So copies of a template cost work in proportion to their
number, and their paths aren't followed down. Where no pivot has a quarter of the
bucket near it, and as many as are between, the bucket is split by the next elements
of its sets' paths, down to depth ``DEPTH``. Left are buckets that are then still
larger, and the sets whose elements end inside a large bucket. After pivots again,
what is left of them is compared in blocks, every block with every other: sets that
share passages but differ. The number of runs follows from the target
recall by the recursion p(1) = 1 - 1/e, p(d) = 1 - exp(-p(d-1)).

Comparing: in buckets, sets are compared by a sketch (one bit of each of ``BITS``
minimum hashes); sets that may be similar are linked to their group's first, so a
group of any size gives one row per set. The groups' components are then compared
exactly, so that every link inside a component counts, whichever run has found it;
tasks count links and give a spanning forest of them, never the pairs. From here on
sets travel, not texts.

A component of up to ``BLOCK`` sets is one task. In a larger one every set is first
compared with one, the pivot, and falls in a ring by its distance 1 - J. Distance is
a metric, so two sets whose distances add up to 1 - ``similarity`` at most are links
for certain, and two whose distances differ by more aren't: both are settled by the
rings' sizes. Only what is left is compared, in blocks of ``BLOCK`` sets of a ring. So
copies of a template with small changes cost work in proportion to their number;
the square is left for sets that lie between half the distance and the whole.
"""

from __future__ import annotations

import itertools
import math
import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import removed, shared_dir, shuffle_partitions, written
from palisade.llm.components import components

N = 5
SIMILARITY = 0.8
RECALL = 0.97
DEPTH = 4
#: Sets in a bucket that are compared at once.
SMALL = 1024
#: Sets of a component in one block of the exact comparison.
BLOCK = 256
#: Rings of equal width around a pivot.
RINGS = 256
BITS = 128
#: Equal bits of two sketches from which sets may be similar: 0.9 of them are equal
#: on average at 0.8; at 4 standard deviations less, 1 pair in 30,000 is missed.
LEAST_BITS = 101
#: Other bits, at most.
REACH = BITS - LEAST_BITS
#: Sets of a large bucket that are tried as its pivot.
PIVOTS = 8

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def runs_for(recall: float, depth: int) -> int:
    p = 1 - math.exp(-1)
    for _ in range(depth - 1):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that mixes all bits (murmur3's finaliser)."""
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


class Shingler:
    """Texts to sorted arrays of distinct 64-bit hashes of runs of n words."""

    def __init__(self, n: int):
        self.n, self._words = n, {}

    def words(self, text: str | None) -> np.ndarray:
        import xxhash

        w = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
        known = self._words
        if len(known) > 1_000_000:
            known.clear()
        for x in set(w):
            if x not in known:
                known[x] = xxhash.xxh3_64_intdigest(x)
        return np.array([known[x] for x in w], np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        k = min(self.n, len(w))
        h = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            h = mix(h * np.uint64(3) + w[i : len(w) - k + 1 + i] + np.uint64(i + 1))
        return np.unique(h)


class Paths:
    """A set's sketch, its buckets of depth 1 and the paths below each."""

    def __init__(self, runs: int, depth: int, similarity: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth, self.similarity = depth, similarity
        self.roots = rng.integers(1, 2**63, runs).astype(np.uint64)
        self.a = rng.integers(1, 2**63, BITS).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(self, s: np.ndarray) -> bytes:
        low = np.full(BITS, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 1024):
            np.minimum(low, (s[i : i + 1024, None] * self.a).min(axis=0), out=low)
        return np.packbits((mix(low) & np.uint64(1)).astype(np.uint8)).tobytes()

    def __call__(self, s: np.ndarray) -> list[tuple[int, bytes]]:
        """(bucket, paths): paths holds, level by level below the bucket, a count
        and (parent's index, child) pairs as 32-bit numbers."""
        def limit(left: int) -> np.uint64:
            # one choice on average that a similar set shares, of the elements that a path hasn't used
            return np.uint64(min(2**64 - 1, int(2**64 / (self.similarity * max(1, left)))))

        out = []
        run, at = np.nonzero(mix(self.roots[:, None] ^ s[None, :]) <= limit(len(s)))
        keys = mix(mix(self.roots[run] ^ s[at]) + np.uint64(1))
        if not len(keys):
            return out
        # all nodes of a level at once; top: the bucket that each node is below
        node, top, used = keys, np.arange(len(keys)), at[:, None]
        levels = []
        for level in range(1, self.depth):
            chosen = mix(node[:, None] ^ s[None, :]) <= limit(len(s) - level)
            np.put_along_axis(chosen, used, False, axis=1)
            parent, at = np.nonzero(chosen)
            child = mix(mix(node[parent] ^ s[at]) + np.uint64(1))
            levels.append((top[parent], parent, child))
            node, top, used = child, top[parent], np.concatenate((used[parent], at[:, None]), axis=1)
            if not len(node):
                break
        first = [np.arange(len(keys))]
        for t, _, _ in levels:
            first.append(t)
        for k in range(len(keys)):
            parts, before = [], np.flatnonzero(first[0] == k)
            for t, parent, child in levels:
                own = np.flatnonzero(t == k)
                if not len(own):
                    break
                parts.append(np.array([len(own)], "<u4").tobytes() + np.searchsorted(before, parent[own]).astype("<u4").tobytes() + (child[own] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
                before = own
            out.append((int(keys[k].astype(np.int64)), b"".join(parts)))
        return out


def below(key: int, paths: bytes) -> list[tuple[int, bytes]]:
    """The children of a node and the paths below each."""
    if not paths:
        return []
    levels, at = [], 0
    while at < len(paths):
        n = int.from_bytes(paths[at : at + 4], "little")
        p = np.frombuffer(paths, "<u4", n, at + 4)
        c = np.frombuffer(paths, "<u4", n, at + 4 + 4 * n)
        levels.append((p, c))
        at += 4 + 8 * n
    out = []
    for k, child in enumerate(levels[0][1].tolist()):
        own, parts = np.array([k]), []
        for p, c in levels[1:]:
            mine = np.flatnonzero(np.isin(p, own))
            if not len(mine):
                break
            parts.append(np.array([len(mine)], "<u4").tobytes() + np.searchsorted(own, p[mine]).astype("<u4").tobytes() + c[mine].astype("<u4").tobytes())
            own = mine
        new = int(mix(np.array([key], np.int64).view(np.uint64) + np.uint64(child) * np.uint64(2) + np.uint64(1)).view(np.int64)[0])
        out.append((new, b"".join(parts)))
    return out


def _groups(keys: np.ndarray):
    """(begin, end) of each run of equal keys with two rows or more."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
    some = end - begin > 1
    return zip(begin[some].tolist(), end[some].tolist())


def _stars(ids: np.ndarray, n: np.ndarray, sketches: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Sets that may be similar, linked to the first set of their group."""
    m = len(ids)
    seen, edges = np.zeros(m, bool), []
    for i in range(m):
        if seen[i]:
            continue
        todo, seen[i] = [i], True
        while todo and not seen.all():
            j = todo.pop()
            rest = np.flatnonzero(~seen)
            ratio = np.minimum(n[rest], n[j]) / np.maximum(n[rest], n[j])
            equal = BITS - np.bitwise_count(sketches[rest] ^ sketches[j]).sum(axis=1, dtype=np.int64)
            new = rest[(equal >= LEAST_BITS) & (ratio >= similarity - 1e-9)]
            seen[new] = True
            edges += [(int(ids[i]), int(x)) for x in ids[new]]
            todo += new.tolist()
    return edges


def _links(sets: list[np.ndarray], first: int, similarity: float) -> np.ndarray:
    """Which of the sets are at least ``similarity`` alike: rows 0 to ``first`` with all."""
    tokens, where = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    common = np.bincount(where) > 1
    number = np.cumsum(common) - 1
    keep = common[where]
    row, col = row[keep], number[where[keep]]
    inter = np.zeros((first, len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for a in range(0, int(common.sum()), 4096):
        i, j = np.searchsorted(col, [a, a + 4096])
        x = np.zeros((len(sets), 4096), np.float32)
        x[row[i:j], col[i:j] - a] = 1
        inter += x[:first] @ x.T
    union = sizes[:first, None] + sizes[None, :] - inter.astype(np.float64)
    return inter >= similarity * union - 1e-6


def _sets(docs: DataFrame, root: str, runs: int, depth: int, similarity: float, n: int) -> DataFrame:
    """One row per document: r, id, key (of the words), n, sketch and paths."""
    schema = "r bigint, id bigint, key binary, n int, sketch binary, paths array<struct<k:bigint,p:binary>>"

    def run(batches):
        import pyarrow as pa
        import xxhash

        shingles, paths = Shingler(n), Paths(runs, depth, similarity)
        kind = pa.list_(pa.struct([("k", pa.int64()), ("p", pa.binary())]))
        for b in batches:
            known: dict[bytes, tuple] = {}
            rows = []
            for text in b.column(2).to_pylist():
                w = shingles.words(text)
                key = xxhash.xxh3_128_digest(w.tobytes())
                if key not in known:
                    s = shingles(text)
                    known[key] = (len(s), paths.sketch(s), [{"k": k, "p": p} for k, p in paths(s)]) if len(s) else (0, b"", [])
                rows.append((key, *known[key]))
            k, m, s, p = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(k, pa.binary()), pa.array(m, pa.int32()), pa.array(s, pa.binary()), pa.array(p, kind)], names=["r", "id", "key", "n", "sketch", "paths"])

    return written(docs.mapInArrow(run, schema), f"{root}/sets")


def _compare(rows: DataFrame, similarity: float) -> DataFrame:
    """Stars (u, v) of all buckets of ``rows`` (k, r, n, sketch), each bucket whole in one task."""

    def run(batches):
        import pyarrow as pa

        def emit(held):
            t = pa.Table.from_batches(held)
            k, r, m = (t.column(c).to_numpy() for c in ("k", "r", "n"))
            s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(k), -1)
            found = [e for a, b in _groups(k) for e in _stars(r[a:b], m[a:b], s[a:b], similarity)]
            u, v = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        held, size = [], 0
        for b in batches:
            if size > 50_000 and b.num_rows:
                # up to the end of the bucket that is open
                last = held[-1].column(0)[-1].as_py()
                keys = b.column(0).to_numpy()
                cut = int(np.argmax(keys != last)) if (keys != last).any() else len(keys)
                held.append(b.slice(0, cut))
                if cut < len(keys):
                    yield emit(held)
                    held, size = [b.slice(cut)], len(keys) - cut
                continue
            if b.num_rows:
                held.append(b)
                size += b.num_rows
        if held:
            yield emit(held)

    parts = shuffle_partitions(rows.sparkSession)
    return rows.select("k", "r", "n", "sketch").repartition(parts, "k").sortWithinPartitions("k", "r").mapInArrow(run, "u bigint, v bigint")


def _children(rows: DataFrame) -> DataFrame:
    """The nodes below; rows whose paths end stay at their node, with a null p."""
    kind = "k bigint, r bigint, n int, sketch binary, p binary"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [(c, r, n, s, q) for k, r, n, s, p in zip(*(x.to_pylist() for x in b.columns)) for c, q in (below(k, p) if p else [(k, None)])]
            cols = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["k", "r", "n", "sketch", "p"])

    return rows.select("k", "r", "n", "sketch", "p").mapInArrow(run, kind)


def _candidates(sets: DataFrame, root: str, similarity: float, depth: int) -> DataFrame:
    """Edges between sets that may be similar, level by level."""
    rows = sets.select("r", "n", "sketch", F.explode("paths").alias("x")).select(F.col("x.k").alias("k"), "r", "n", "sketch", F.col("x.p").alias("p"))
    edges, left = [], []
    for level in range(depth - 1):
        found, rest = _peeled(rows, f"{root}/peel-{level}", similarity)
        edges += found
        if rest is None:
            break
        rows = written(_children(rest), f"{root}/rows-{level + 1}")
        left.append(rows.where("p is null"))
        rows = rows.where("p is not null")
    else:
        left.append(rows)
    if left:
        found, rest = _peeled(reduce(DataFrame.union, left), f"{root}/peel-{depth - 1}", similarity)
        edges += found
        if rest is not None:
            edges.append(written(_in_blocks(rest, similarity), f"{root}/blocks"))
    return reduce(DataFrame.union, edges)


def _peeled(rows: DataFrame, root: str, similarity: float) -> tuple[list[DataFrame], DataFrame | None]:
    """Stars of buckets (k, r, n, sketch, p): of small ones by brute force, of near copies in large ones by a pivot,
    round by round; and what is left, if any: large buckets (with ``count``) that no pivot has enough of near it."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            own, pivots = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1, BITS // 64) for c in (3, 5))
            bits = np.bitwise_count(own ^ pivots).sum(axis=2, dtype=np.int32)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * PIVOTS)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.ListArray.from_arrays(offsets, pa.array(bits.ravel(), pa.int32()))], names=["k", "r", "n", "sketch", "p", "h"])

    # every step is written, so each join is done once; pivots come from a few sets of each bucket, so only those are joined to find them
    edges, sparse, one_in = [], [], max(1, SMALL // (8 * PIVOTS))
    for step in itertools.count():
        count = F.count(F.lit(1)).alias("count")
        large = written(rows.groupBy("k").agg(count).where(f"count > {SMALL}").select("k"), f"{root}/large-{step}")
        edges.append(written(_compare(rows.join(large, "k", "left_anti"), similarity).distinct(), f"{root}/found-{step}"))
        if large.isEmpty():
            break
        seen = [F.min_by(F.struct("r", "sketch"), F.xxhash64("r", F.lit(step * PIVOTS + j))).alias(f"p{j}") for j in range(PIVOTS)]
        sketches, ids = (", ".join(f"p{j}.{c}" for j in range(PIVOTS)) for c in ("sketch", "r"))
        pivots = large.join(rows.where(f"pmod(xxhash64(r), {one_in}) = 0").join(large, "k").groupBy("k").agg(*seen), "k", "left")
        # a bucket without any (e to the power -64) is left
        none = F.lit(bytes(PIVOTS * BITS // 8))
        pivots = written(pivots.select("k", F.coalesce(F.expr(f"concat({sketches})"), none).alias("pivots"), F.expr(f"array({ids})").alias("ids")), f"{root}/pivots-{step}")
        judged = written(rows.join(pivots.select("k", "pivots"), "k").select("k", "r", "n", "sketch", "p", "pivots").mapInArrow(run, "k bigint, r bigint, n int, sketch binary, p binary, h array<int>"), f"{root}/bits-{step}")
        near = [F.count_if(F.col("h")[j] <= REACH).alias(f"a{j}") for j in range(PIVOTS)] + [F.count_if(F.col("h")[j].between(REACH + 1, 2 * REACH)).alias(f"b{j}") for j in range(PIVOTS)]
        best = F.array_max(F.array(*[F.struct(F.col(f"a{j}").alias("a"), (-F.col(f"b{j}")).alias("b"), F.lit(j).alias("j")) for j in range(PIVOTS)]))
        best = judged.groupBy("k").agg(count, *near).select("k", "count", best.alias("x")).join(pivots.select("k", "ids"), "k")
        best = best.select("k", "count", F.expr("4 * x.a >= count and x.a >= -x.b and ids[x.j] is not null").alias("dense"), F.col("x.j").alias("j"), F.expr("ids[x.j]").alias("u"))
        judged = written(judged.join(written(best, f"{root}/best-{step}"), "k").withColumn("h", F.expr("h[j]")), f"{root}/judged-{step}")
        edges.append(written(judged.where(f"dense and h <= {2 * REACH} and r <> u").select("u", F.col("r").alias("v")).distinct(), f"{root}/stars-{step}"))
        sparse.append(judged.where("not dense").select("k", "r", "n", "sketch", "p", "count"))
        rows = judged.where(f"dense and h > {REACH}").select("k", "r", "n", "sketch", "p")
    if not sparse:
        return edges, None
    left = reduce(DataFrame.union, sparse)
    return edges, None if left.isEmpty() else left


def _in_blocks(rest: DataFrame, similarity: float) -> DataFrame:
    """Stars of large buckets (with ``count``): blocks of about SMALL / 2 sets, each with each other and with itself."""
    rest = rest.withColumn("g", F.ceil(F.col("count") / F.lit(SMALL // 2)).cast("int")).withColumn("b", F.expr("cast(pmod(xxhash64(r), g) as int)"))
    rest = rest.withColumn("o", F.explode(F.expr("sequence(0, g - 1)"))).withColumn("k", F.expr("xxhash64(k, least(b, o), greatest(b, o))"))
    return _compare(rest, similarity).distinct()


def _members(where: DataFrame, n: int) -> DataFrame:
    """r, c, count, s: the set of each member's text."""

    def run(batches):
        import pyarrow as pa

        shingles = Shingler(n)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([shingles(t).tobytes() for t in b.column(3).to_pylist()], pa.binary())], names=["r", "c", "count", "s"])

    return where.select("r", "c", "count", "t").mapInArrow(run, "r bigint, c bigint, count bigint, s binary")


def _rings(large: DataFrame, root: str, similarity: float) -> DataFrame:
    """Members of large components with ring ``q`` and whether they are links of the pivot (``near``)."""
    # the pivot's set goes to a task for every 16 blocks of members
    parts = F.ceil(F.col("count") / F.lit(16 * BLOCK)).cast("int")
    pivots = large.where("r = c").select("c", F.col("s").alias("p"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("z"))
    rows = large.withColumn("z", F.pmod(F.xxhash64("r"), parts).cast("int")).join(pivots.hint("merge"), ["c", "z"]).select("r", "c", "s", "p")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            q, near = [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - common
                q.append(min(RINGS - 1, (union - common) * RINGS // union))
                near.append(common >= similarity * union - 1e-6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(q, pa.int32()), pa.array(near, pa.bool_())], names=["r", "c", "s", "q", "near"])

    return written(rows.mapInArrow(run, "r bigint, c bigint, s binary, q int, near boolean"), f"{root}/rings")


def _compared(members: DataFrame, root: str, similarity: float) -> DataFrame:
    """r, links, first: parts of the links of members, and edges of a forest of them."""
    small = members.where(f"count <= {BLOCK}").select(F.col("c").alias("k"), F.lit(0).cast("bigint").alias("b"), "r", F.lit(True).alias("own"), "s")
    large = members.where(f"count > {BLOCK}")
    if large.isEmpty():
        return _exact(small, similarity)
    rows = _rings(large, root, similarity)
    # rings q and w (of width 1 / RINGS): all pairs are links, or none is, or they are compared
    reach = int((1 - similarity) * RINGS * (1 - 1e-9))
    rings = rows.groupBy("c", "q").agg(F.count(F.lit(1)).alias("m")).withColumn("g", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int"))
    per = rings.groupBy("c").agg(F.collect_list(F.struct("q", "m", "g")).alias("a")).select("c", "a", F.explode("a").alias("x")).select("c", "x.q", "x.g", "a")
    sure = per.select("c", "q", "g", F.expr(f"aggregate(filter(a, y -> y.q + q + 2 <= {reach}), 0L, (n, y) -> n + y.m) - if(2 * q + 2 <= {reach}, 1, 0)").alias("sure"))
    rows = written(rows.join(sure, ["c", "q"]).withColumn("j", F.expr("cast(pmod(xxhash64(r, 1), g) as int)")), f"{root}/ring-blocks")
    open_ = F.expr(f"flatten(transform(filter(a, y -> y.q + q + 2 > {reach} and abs(y.q - q) - 1 <= {reach}), y -> transform(sequence(0, y.g - 1), i -> y.q * 4294967296L + i)))")
    blocks = per.withColumn("o", open_).select("c", "q", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j"), "o").withColumn("o", F.explode("o"))
    pairs = rows.select("c", "q", "j", "r", "s").join(blocks, ["c", "q", "j"]).withColumn("b", F.expr("q * 4294967296L + j"))
    pairs = pairs.select(F.expr("xxhash64(c, least(b, o), greatest(b, o))").alias("k"), "b", "r", F.expr("b = o").alias("own"), "s")
    settled = rows.select("r", F.col("sure").alias("links"), F.expr("if(near, c, r)").alias("first"))
    return _exact(small.union(pairs), similarity).union(settled)


def _exact(members: DataFrame, similarity: float) -> DataFrame:
    """r, links, first (edge to the first set of the same part): for each task key."""

    def run(batches):
        import pyarrow as pa

        def done(held):
            ids, block, sets = np.array([x[2] for x in held]), np.array([x[1] for x in held]), [np.frombuffer(x[4], np.uint64) for x in held]
            # of one block: all pairs; of two (the first of which stands first): pairs across only
            one = held[0][3]
            first = len(ids) if one else int((block == block[0]).sum())
            full = np.zeros((len(ids), len(ids)), bool)
            if one or first < len(ids):
                full[:first] = _links(sets, first, similarity)
            if not one:
                full[:first, :first] = False
            full |= full.T
            np.fill_diagonal(full, False)
            links = full.sum(axis=1)
            part = np.arange(len(ids))
            for i in range(len(ids)):
                if part[i] == i:
                    todo = [i]
                    while todo:
                        j = todo.pop()
                        new = np.flatnonzero(full[j] & (part > i) & (part == np.arange(len(ids))))
                        part[new] = i
                        todo += new.tolist()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(ids[part], pa.int64())], names=["r", "links", "first"])

        key, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != key and held:
                    yield done(held)
                    held = []
                key = row[0]
                held.append(row)
        if held:
            yield done(held)

    parts = shuffle_partitions(members.sparkSession)
    return members.select("k", "b", "r", "own", "s").repartition(parts, "k").sortWithinPartitions("k", "b", "r").mapInArrow(run, "r bigint, links bigint, first bigint")


def similar(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH, n: int = N, id_col: str = "doc_id", text_col: str = "text", bare_scan: bool = False) -> DataFrame:
    """r (row number), id, class_id, n_links, n_copies and first, a row per document.

    ``class_id`` is the smallest id in the document's class: documents with
    equal words, and all that links of ``similarity`` or more connect them with.
    ``n_links``: other sets (texts with other words) at least that similar;
    ``n_copies``: other documents with equal words; ``first``: whether the
    document is the one that stands for its class.

    Words are runs of digits, letters (A-Z as a-z) and characters beyond ASCII.
    Null and empty texts and texts without words are alone in their class, as
    are rows with a null id (their ``class_id`` is null) unless others join
    them. Very long texts are one set each. Repeated rows are documents of their
    own; other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    root = shared_dir(spark, "jaccard")
    if not bare_scan:
        docs = written(docs, f"{root}/input")
    texts = docs.select(F.monotonically_increasing_id().alias("r"), F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    sets = _sets(texts, root, runs_for(recall, depth), depth, similarity, n)
    # equal words: the first row stands for all
    with_words = sets.where("n > 0")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("r"))
    groups = written(with_words.groupBy("key").agg(F.min("r").alias("rep"), F.min(order).alias("low"), F.count(F.lit(1)).alias("copies")), f"{root}/groups")
    # joins with one row per document are sort-merge joins at every size: what is broadcast would grow with the input
    first = with_words.join(groups.select(F.col("rep").alias("r")).hint("merge"), "r", "left_semi")
    edges = _candidates(first, f"{root}/buckets", similarity, depth)
    parts = components(edges, f"{root}/candidates")
    removed(spark, f"{root}/buckets")
    where = parts.join(parts.groupBy("c").count(), "c").select(F.col("v").alias("r"), "c", "count")
    members = written(_members(where.hint("merge").join(texts.select("r", "t"), "r"), n), f"{root}/members")
    links = written(_compared(members, root, similarity), f"{root}/links")
    for name in ("candidates", "members", "rings", "ring-blocks"):
        removed(spark, f"{root}/{name}")
    count = links.groupBy("r").agg(F.sum("links").alias("links"))
    cls = components(links.where("r <> first").select(F.col("r").alias("u"), F.col("first").alias("v")), f"{root}/classes")
    rep = groups.join(count.withColumnRenamed("r", "rep"), "rep", "left").join(cls.select(F.col("v").alias("rep"), "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    rep = rep.join(rep.groupBy("c").agg(F.min("low").alias("best")), "c").select("key", "best", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), (F.col("copies") - 1).alias("more"))
    out = sets.select("r", "id", F.expr("if(n > 0, key, null)").alias("key")).join(rep.hint("merge"), "key", "left")
    return out.select(
        "r",
        "id",
        F.expr("if(best is null, id, best.id)").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("more", F.lit(0)).cast("bigint").alias("n_copies"),
        F.expr("best is null or best.r = r").alias("first"),
    )


def first_of_each(docs: DataFrame, bare_scan: bool = False, **options) -> DataFrame:
    """One document of each class, that with the smallest id (null ids last; of
    equal ids the one that is read first), with the columns of ``docs``."""
    if not bare_scan:
        docs = written(docs, shared_dir(docs.sparkSession, "near-input"))
    kept = similar(docs, bare_scan=True, **options).where("first").select("r")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("r"))
    return rows.join(kept.hint("merge"), "r", "left_semi").select("row.*")
