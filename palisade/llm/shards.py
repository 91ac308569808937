"""Sharding: a uniform shuffle with exact shard sizes.

How many rows each input partition sends to each cell (a block of a shard) is a
matrix with given row and column sums, drawn by the multivariate hypergeometric
law. It is drawn by halves: how many of each cell's rows come from the first half
of the partitions, then within each half, and so on; each draw has a generator of
its own, seeded by the range it splits. So a task finds its partition's row by
itself in log2(partitions) draws, and nobody holds the matrix. Each partition then
deals a random permutation of its own labels to its rows, the rows go to their
cells in one exchange, and each cell is permuted again. The law is that of one
uniform permutation of all rows, and every cell gets its exact size.

Draws follow the hypergeometric law at every size. numpy's own draw ends at 10^9
rows of a kind; above, a binomial draw is accepted with the ratio of the two laws
(Loader's form of the binomial probability, precise for large numbers).

A cell has about ``rows_per_cell`` rows at every size, so the number of cells grows
with the rows; a task holds 8 bytes for each. Only one count per input partition
reaches the driver and goes back out.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import shared_dir, shuffle_partitions, written

#: Rows of a kind from which numpy's exact draw isn't defined.
LARGE = 1_000_000_000


def sizes_of(total: int, n: int) -> list[int]:
    """``total`` in ``n`` parts, counts at most one apart."""
    return [total // n + (i < total % n) for i in range(n)]


def _error_of_stirling(n):
    """ln n! - ln(sqrt(2 pi n) (n / e)^n), for an array."""
    import math

    import numpy as np

    small = np.array([0.0] + [math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16)])
    x = np.maximum(n, 16).astype(np.float64)
    y = x * x
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / y) / y) / y) / x
    return np.where(n < 16, small[np.minimum(n, 15)], series)


def _deviance(x, mean):
    """x ln(x / mean) + mean - x, without loss where x is close to the mean."""
    import numpy as np

    x = x.astype(np.float64)
    v = (x - mean) / (x + mean)
    term, total, k = 2 * x * v, (x - mean) * v, 1
    near = np.abs(v) < 0.1
    while k < 40:
        term = term * v * v
        total = total + term / (2 * k + 1)
        k += 1
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(x > 0, x * np.log(x / mean), 0.0) + mean - x
    return np.where(near, total, far)


def _log_binomial(x, n, p):
    """ln of the binomial probability of x of n, for arrays (0 < p < 1)."""
    import numpy as np

    y = n - x
    inner = (x > 0) & (y > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = _error_of_stirling(n) - _error_of_stirling(x) - _error_of_stirling(y) - _deviance(x, n * p) - _deviance(y, n * (1 - p)) - 0.5 * np.log(2 * np.pi * x * (y / n))
    return np.where(inner, whole, np.where(x == 0, n * np.log1p(-p), n * np.log(p)))


def hypergeometric(rng, good, bad, n):
    """How many of ``n`` rows, drawn without replacement from ``good`` and ``bad``
    ones, are good; for arrays of any size up to 2^62."""
    import numpy as np

    good, bad, n = (np.asarray(x, np.int64) for x in (good, bad, n))
    large = (good >= LARGE) | (bad >= LARGE)
    if not large.any():
        return rng.hypergeometric(good, bad, n)
    out = np.zeros(len(good), np.int64)
    out[~large] = rng.hypergeometric(good[~large], bad[~large], n[~large])
    total = good + bad
    fixed = large & ((n == 0) | (n == total) | (good == 0) | (bad == 0))
    out[fixed] = np.where(bad[fixed] == 0, n[fixed], np.where(n[fixed] == 0, 0, good[fixed]))
    todo = np.flatnonzero(large & ~fixed)
    # the smaller kind is drawn by the binomial law, the other accepts or rejects
    while len(todo):
        g, b, k = good[todo], bad[todo], n[todo]
        swap = g > b
        a, c = np.where(swap, b, g), np.where(swap, g, b)
        p = k / total[todo]
        x = rng.binomial(a, p)
        rest = k - x
        mode = np.minimum(c, np.floor((c + 1) * p).astype(np.int64))
        inside = (rest >= 0) & (rest <= c)
        ratio = np.full(len(todo), -np.inf)
        ratio[inside] = (_log_binomial(rest, c, p) - _log_binomial(mode, c, p))[inside]
        ok = np.log(rng.random(len(todo))) <= ratio
        out[todo[ok]] = np.where(swap, k - x, x)[ok]
        todo = todo[~ok]
    return out


def draw(rng, cells, n: int):
    """How many of ``n`` rows, taken without replacement, are of each cell: the
    cells are halved, then the halves, and all splits of a level drawn at once."""
    import numpy as np

    cells = np.asarray(cells, np.int64)
    if not len(cells):
        return cells
    levels = [np.append(cells, np.zeros((1 << max(0, len(cells) - 1).bit_length()) - len(cells), np.int64))]
    while len(levels[-1]) > 1:
        levels.append(levels[-1][0::2] + levels[-1][1::2])
    taken = np.array([n], np.int64)
    for sums in reversed(levels[:-1]):
        left = hypergeometric(rng, sums[0::2], sums[1::2], taken)
        taken = np.stack((left, taken - left), axis=1).reshape(-1)
    return taken[: len(cells)]


def matrix_row(part: int, before, cells, seed: int):
    """Row ``part`` of the matrix; ``before``: rows in all partitions before each one, and the total."""
    import numpy as np

    lo, hi, left = 0, len(before) - 1, np.asarray(cells, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = draw(np.random.default_rng([seed, lo, hi]), left, int(before[mid] - before[lo]))
        if part < mid:
            left, hi = first, mid
        else:
            left, lo = left - first, mid
    return left


def communication_matrix(rows: list[int], cells: list[int], seed: int):
    """The whole matrix (for small numbers): row sums are ``rows``, column sums ``cells``."""
    import numpy as np

    before = np.concatenate(([0], np.cumsum(rows)))
    return np.array([matrix_row(i, before, cells, seed) for i in range(len(rows))])


@lru_cache(maxsize=2)
def _labels(seed: int, place: int, part: int, before: bytes, n_shards: int, blocks: int):
    """The cell of each row of partition ``part``, in a random order."""
    import numpy as np

    prefix = np.frombuffer(before, np.int64)
    cells = np.array([c for s in sizes_of(int(prefix[-1]), n_shards) for c in sizes_of(s, blocks)], np.int64)
    row = matrix_row(place, prefix, cells, seed)
    return np.random.default_rng([seed, part, 1]).permutation(np.repeat(np.arange(len(row), dtype=np.int32), row))


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 2024, rows_per_cell: int = 50_000, bare_scan: bool = False) -> DataFrame:
    """All rows and columns of ``docs``, with ``shard`` (0 to ``n_shards`` - 1),
    ``slot`` (0, 1, ... within the shard, without gaps) and ``cell``.

    Counts of shards differ by one at most. Nulls, equal rows and very long
    texts are rows like others (a row travels once, whole); an empty table gives
    an empty result. Columns named ``shard``, ``slot`` or ``cell`` are replaced.

    Input partitions must be the same when they are read again. A plan other
    than a plain file scan is therefore written to the shared folder first,
    unless ``bare_scan`` says that it is one.
    """
    import numpy as np

    spark = docs.sparkSession
    if not bare_scan:
        docs = written(docs, shared_dir(spark, "shard-input"))
    docs = docs.drop("shard", "slot", "cell")
    own = F.monotonically_increasing_id()
    counted = {r[0]: r[1] for r in docs.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()}
    total = sum(counted.values())
    parts = sorted(counted)
    # a shard has as many blocks as its rows ask for, and all shards a block for each task of the exchange
    blocks = max(1, -(-total // (n_shards * rows_per_cell)), -(-shuffle_partitions(spark) // n_shards))
    before = [0]
    for p in parts:
        before.append(before[-1] + counted[p])
    sent = spark.sparkContext.broadcast((np.array(before, np.int64).tobytes(), np.array(parts, np.int64)))

    @F.pandas_udf("int")
    def cell_of(at):
        import pandas as pd

        x = at.to_numpy()
        out = np.empty(len(x), np.int32)
        prefix, known = sent.value
        for p in np.unique(x >> 33).tolist():
            here = (x >> 33) == p
            out[here] = _labels(seed, int(np.searchsorted(known, p)), p, prefix, n_shards, blocks)[x[here] & ((1 << 33) - 1)]
        return pd.Series(out)

    at = "_at"
    while at in docs.columns:
        at += "_"
    n_cells = n_shards * blocks
    # cells have equal sizes, so they are dealt to tasks by number
    dealt = docs.withColumn(at, own).withColumn("cell", cell_of(at)).repartitionById(max(1, min(n_cells, 4 * shuffle_partitions(spark))), "cell")
    order = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed), F.lit("again"), at), at)
    # the first slot of a cell: block j of a shard of S rows begins at j * (S div blocks) + least(j, S mod blocks)
    size = f"({total // n_shards}L + if(cell div {blocks} < {total % n_shards}, 1, 0))"
    base = F.expr(f"(cell % {blocks}) * ({size} div {blocks}) + least(cell % {blocks}, {size} % {blocks})")
    return dealt.withColumn("slot", (F.row_number().over(order) - 1 + base).cast("bigint")).withColumn("shard", F.expr(f"cast(cell div {blocks} as int)")).drop(at)
