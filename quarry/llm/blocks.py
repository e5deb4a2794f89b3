"""Groups dealt out in bounded blocks, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import stage


def block_pairs(members: DataFrame, key: str, spread: Column, block: int, weight: str | None = None, block_weight: int = 1) -> DataFrame:
    """Deal the members of each ``key`` into blocks of about ``block`` rows (and
    ``block_weight`` in the sum of ``weight``) and return them once for each
    pair of blocks that they are part of, as columns ``bi``, ``bj`` (bi <= bj)
    and ``mine``, the block of the row. A key of one block has the pair (0, 0)
    alone, a key of one member none, and a task never holds more than about two
    blocks of a group. spread: a hash that deals them."""
    heavy = F.sum(weight) / F.lit(block_weight) if weight else F.lit(0)
    nb = F.ceil(F.greatest(F.count("*") / F.lit(block), heavy, F.lit(1))).cast("int")
    sizes = members.groupBy(key).agg(F.count("*").alias("n"), nb.alias("nb")).filter("n > 1")
    rows = members.join(sizes, key).withColumn("mine", F.pmod(spread, F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.withColumns({"bi": F.least("mine", "other"), "bj": F.greatest("mine", "other")}).drop("n", "nb", "other")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """The smallest node reachable from each node of ``edges`` (columns ``a``
    and ``b``, of one type that can be ordered): columns ``node`` and ``component``.

    Large-star and small-star rounds: each node links its larger neighbours,
    then itself and its smaller ones, to the smallest of them, until nothing
    changes. Every round ends in a written table, and a node's neighbours are
    never gathered in one place: the smallest comes from an aggregation and
    goes back over a join.
    """
    now = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    total = _mark(now)
    for _ in range(rounds):
        if total[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        # Large star: every neighbour above u moves to the smallest of u and its neighbours.
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # Small star: u and its neighbours below move to the smallest of those.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select("m", F.col("a").alias("v")).union(small.select("m", F.col("b").alias("v")))
        after = stage(small.filter("m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "edges")
        mark = _mark(after)
        if mark == total:
            break
        now, total = after, mark
    else:
        raise RuntimeError(f"no end of the components after {rounds} rounds")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return stars.union(roots)


#: Keys that ``join_hot`` takes apart, and the rows from which on it does.
HOT_KEYS, HOT_ROWS = 1000, 1000


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], times: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row for each key and
    tells in ``times`` how many rows have it. The ``HOT_KEYS`` most frequent
    keys of more than ``HOT_ROWS`` rows go to the rows by broadcast, so that no
    task gets all rows of such a key; any other key has less than a
    ``HOT_KEYS``-th of all rows. Both sides should be written tables."""
    hot = keyed.filter(F.col(times) > HOT_ROWS).orderBy(F.desc(times), *keys).limit(HOT_KEYS)
    names = F.broadcast(hot.select(*keys))
    cold = rows.join(names, keys, "left_anti").join(keyed.join(names, keys, "left_anti"), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys))


def _mark(edges: DataFrame) -> tuple:
    """Edges, and sums that change with any of them."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1 << 31))), F.sum(F.shiftrightunsigned(h, 33))).first()
    return tuple(x or 0 for x in row)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``keys`` columns, from batches sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if held and a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def roots(links: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The smallest representative that each row reaches over ``links`` (symmetric)."""
    low = rep.copy()
    while True:
        new = np.minimum(low, np.where(links, low[None, :], np.iinfo(np.int64).max).min(1))
        if (new == low).all():
            return low
        low = new
