"""Connected components and bounded joins over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import save

#: A side of a join is broadcast only if it has at most so many narrow rows (counted first); beyond that it is shuffled.
BROADCAST_ROWS = 500_000


def bounded(small: DataFrame) -> DataFrame:
    """``small`` with a broadcast hint if its counted size allows one."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], by: str, salts: int = 8) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (one narrow row a key): the rows of a key are dealt over ``salts`` tasks by a hash of the column ``by``, and the key's row goes to each."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(by), F.lit(7)), F.lit(salts)).cast("int"))
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): for each node with a link its component's smallest node.

    Alternates large-star and small-star steps (each one aggregation and one join); the table is
    written after each round. A step needs a node's minimum only; the edges of a hub are dealt over
    several tasks.
    """
    e = save(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = spread_join(both.where("b > a"), least, ["a"], "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, low, ["a"], "b").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        e = save(small, "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


class Forest:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            c = b.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
        first = tuple(b.column(k)[0].as_py() for k in keys)
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for n, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if held and (n or first != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
        last = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches cut so that no run of equal keys is torn; many small runs stay together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(key).to_numpy()
        cut = int(np.searchsorted(c, c[-1]))
        if held and (cut or held[0].column(key)[0].as_py() != c[0]):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(members: DataFrame, key: str, node: str, block: int) -> DataFrame:
    """Deals the members of each ``key`` out to pairs of blocks of about ``block`` members: columns i <= j and side (the block of this row).

    A key of up to ``block`` members is one pair (0, 0). Rows are replicated once for each block
    of their key, so that every two members meet in exactly one pair (or in their block's own).
    """
    n = members.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks"))
    m = members.join(n, key).withColumn("side", F.pmod(F.xxhash64(node, F.lit(99)), F.col("n_blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return m.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other", "n_blocks")
