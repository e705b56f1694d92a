"""Spectral-centroid clustering of series.

An iteration needs the series and the last centroids only: a series' total rotation is its best
rotation against its centroid, whatever the iterations before it. So an iteration is one pass over
the (unchanged) series that returns partial Gram matrices, ``k * T * T`` numbers a task, summed by
an aggregation; no state is kept between iterations and nothing has to be checkpointed. A table of
few different series (counted) is fetched once and iterated without jobs, with the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeflow.functions import series as S
from shapeflow.functions.kernels import dropping, dropping_distances, rolling, rolling_distances, top_eigenvectors


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


#: Values of a sum that travel as one row.
CHUNK = 1 << 16
#: Different series that a join sends to every task, at most.
MOST_SENT = 10_000
#: Ids that one of equal series takes along, at most, and rows of pairs that a task sends at once.
MEMBERS, SENT_ROWS = 1024, 1 << 20
#: Numbers in different series up to which the iterations of a clustering go on in the driver (32 MB).
TOGETHER = 1 << 22


def sum_arrays(parts: DataFrame, key: str) -> dict[int, np.ndarray]:
    """Element-wise sums of the arrays ``v`` by (key, chunk), joined again for each key. A task holds one sum for each of its rows' keys; one row a key and chunk comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, (k, c) in enumerate(zip(b.column(key).to_pylist(), b.column("chunk").to_pylist(), strict=True)):
                v = b.column("v")[i].values.to_numpy(zero_copy_only=False)
                held[k, c] = held[k, c] + v if (k, c) in held else v
        for (k, c), v in held.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([c], pa.int32()), pa.array([v], pa.list_(pa.float64()))], [key, "chunk", "v"])

    rows = parts.repartition(key, "chunk").mapInArrow(add, f"{key} int, chunk int, v array<double>").toArrow().sort_by([(key, "ascending"), ("chunk", "ascending")])
    out: dict[int, list[np.ndarray]] = {}
    for i, k in enumerate(rows.column(key).to_pylist()):
        out.setdefault(k, []).append(rows.column("v")[i].values.to_numpy(zero_copy_only=False))
    return {k: np.concatenate(v) for k, v in out.items()}


def chunked(keys: list[int], sums: list[np.ndarray], key: str) -> Iterator[pa.RecordBatch]:
    """Rows (key, chunk, v) of one task's sums."""
    for k, v in zip(keys, sums, strict=True):
        for c, i in enumerate(range(0, len(v), CHUNK)):
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([c], pa.int32()), pa.array([v[i : i + CHUNK]], pa.list_(pa.float64()))], [key, "chunk", "v"])


_PARTS = "cluster int, chunk int, v array<double>"


def _sum_rows(parts: DataFrame, k: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of partial rows: Gram matrices (k, T, T), and counts, which are the places after them."""
    out = np.zeros((k, t * t + 2))
    for c, v in sum_arrays(parts, "cluster").items():
        out[c] = v
    return out[:, : t * t].reshape(k, t, t), out[:, t * t :]


def _add(b: pa.RecordBatch, k: int, centroids: np.ndarray | None, before: np.ndarray | None) -> np.ndarray:
    """Gram matrices, counts and changes of the rows (x, cluster, shift, n), each of which counts ``n`` times."""
    x, many = _matrix(b.column("x")), b.column("n").to_numpy().astype(np.float64)
    t = x.shape[1]
    total = np.zeros((k, t * t + 2))
    if centroids is None:
        cluster, shift = b.column("cluster").to_numpy(), b.column("shift").to_numpy()
        changed = np.zeros(len(x), bool)
    else:
        cluster, shift, _ = nearest(x, centroids)
        changed = cluster != (nearest(x, before)[0] if before is not None else b.column("cluster").to_numpy())
    x = x[np.arange(len(x))[:, None], (np.arange(t)[None, :] - shift[:, None]) % t]
    n = np.sqrt((x * x).sum(1, keepdims=True))
    x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    for c in np.unique(cluster):
        own = cluster == c
        total[c, : t * t] += (x[own].T @ (x[own] * many[own, None])).ravel()
        total[c, t * t] += many[own].sum()
        total[c, t * t + 1] += many[own & changed].sum()
    return total


def _partials(k: int, centroids: np.ndarray | None, before: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = _add(b, k, centroids, before)
                total = part if total is None else total + part
        if total is not None:
            yield from chunked(list(range(k)), list(total), "cluster")

    return run


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster (least rounded distance, then least number), rotation and distances of each series."""
    d, q = rolling(centroids, x)
    c = np.argmin(np.round(d, 9), 0)
    return c, q[c, np.arange(len(x))], d.T


def _length(series: DataFrame) -> int:
    r = series.select(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b")).first()
    if r["a"] != r["b"]:
        raise ValueError(f"series differ in length: {r['a']} to {r['b']}")
    return r["a"] or 0


def centroids(series: DataFrame, k: int) -> np.ndarray:
    """Spectral centroids of (x, cluster[, shift]): for each cluster the top eigenvector of the Gram matrix of its normalised, rotated members."""
    s = series if "shift" in series.columns else series.withColumn("shift", F.lit(0))
    s = s.select("x", F.col("cluster").cast("int").alias("cluster"), F.col("shift").cast("int").alias("shift"), F.lit(1).cast("long").alias("n"))
    return top_eigenvectors(_sum_rows(s.mapInArrow(_partials(k, None, None), _PARTS), k, _length(series))[0])


def table(spark, c: np.ndarray) -> DataFrame:
    """Centroids as (cluster, c): k rows."""
    values = ",".join(f"({i}, array({','.join(repr(float(v)) + 'D' for v in row)}))" for i, row in enumerate(c))
    return spark.sql(f"select * from values {values} as t(cluster, c)")


def assign(series: DataFrame, c: np.ndarray) -> DataFrame:
    """Adds cluster, shift, dist and dists (to every centroid); the centroids go along as one broadcast matrix."""
    shared = series.sparkSession.sparkContext.broadcast(np.asarray(c, np.float64))
    names = series.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cluster, shift, dist = nearest(_matrix(b.column("x")), shared.value)
            dists = pa.ListArray.from_arrays(pa.array(np.arange(0, dist.size + 1, dist.shape[1], dtype=np.int32)), pa.array(dist.ravel()))
            new = [pa.array(cluster.astype(np.int32)), pa.array(shift.astype(np.int32)), pa.array(dist[np.arange(len(dist)), cluster]), dists]
            yield pa.record_batch([*[b.column(n) for n in names], *new], [*names, "cluster", "shift", "dist", "dists"])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in series.schema)
    return series.mapInArrow(run, f"{fields}, cluster int, shift int, dist double, dists array<double>")


@dataclass
class Clustering:
    centroids: np.ndarray
    assigned: DataFrame  # series_id, x, cluster, shift (in total), dist, dists
    iterations: int
    cost: float


def _settle(s: DataFrame, k: int, t: int, max_iter: int | None) -> tuple[np.ndarray, int]:
    """Centroids of (x, cluster, shift) after updates until no assignment changes (or centroids come back that were there before), or ``max_iter``; and the iterations.

    Equal rows are one that counts as often as it occurs. Up to ``TOGETHER`` numbers the iterations need no job of their own; more stay where they are.
    """
    one = s.groupBy("x", "cluster", "shift").agg(F.count(F.lit(1)).alias("n")).persist()
    if one.count() * t <= TOGETHER:
        rows = one.toArrow().combine_chunks().to_batches(max_chunksize=10_000)

        def sums(c: np.ndarray | None, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            total = sum((_add(b, k, c, before) for b in rows if b.num_rows), np.zeros((k, t * t + 2)))
            return total[:, : t * t].reshape(k, t, t), total[:, t * t :]
    else:

        def sums(c: np.ndarray | None, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            return _sum_rows(one.mapInArrow(_partials(k, c, before), _PARTS), k, t)

    c, before, n, seen = top_eigenvectors(sums(None, None)[0]), None, 0, set()
    while max_iter is None or n < max_iter:
        n += 1
        gram, counts = sums(c, before)
        if not counts[:, 1].sum():
            break
        before, c = c, top_eigenvectors(gram)
        if (mark := np.round(c, 9).tobytes()) in seen:
            break
        seen.add(mark)
    one.unpersist()
    return c, n


def cluster(series: DataFrame, k: int, init: str | DataFrame = "pmod(series_id, {k})", max_iter: int | None = None) -> Clustering:
    """Assign, rotate and update until no assignment changes, or ``max_iter`` times; ``init``: expression of the first cluster."""
    if max_iter is not None and max_iter < 1:
        raise ValueError("max_iter is at least 1")
    s = series.withColumn("cluster", F.expr(init.format(k=k)).cast("int")).withColumn("shift", F.lit(0)).persist()
    c, n = _settle(s, k, _length(s), max_iter)
    out = assign(series, c)
    cost = out.agg(F.avg(F.col("dist") * F.col("dist"))).first()[0]
    s.unpersist()
    return Clustering(c, out, n, cost if cost is not None else 0.0)


def write(result: Clustering, folder: str, digits: int = 5) -> None:
    """The four outputs of a clustering as white-space text, each line with its id first: centroids, assignments, shifts, and distances to every centroid."""
    numbers = lambda c: F.array_join(F.transform(c, lambda v: F.format_string(f"%.{digits}f", v)), " ")
    a = result.assigned
    outputs = {
        "centroids": table(a.sparkSession, result.centroids).select("cluster", numbers("c")),
        "assign": a.select("series_id", "cluster"), "shifts": a.select("series_id", "shift"), "dists": a.select("series_id", numbers("dists")),
    }
    for name, d in outputs.items():
        d.select(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in d.columns]).alias("value")).write.text(f"{folder}/{name}")


def restarts(series: DataFrame, k: int, runs: int = 10, max_iter: int | None = None, seed: int = 0, parallel: int = 4) -> Clustering:
    """Of ``runs`` random starts (a hash of id and seed) the one of least cost; the first of equals. ``parallel`` starts are under way at once, as independent jobs."""
    with ThreadPoolExecutor(parallel) as pool:
        every = list(pool.map(lambda r: cluster(series, k, f"pmod(xxhash64(series_id, {seed + r}), {{k}})", max_iter), range(runs)))
    return min(every, key=lambda r: r.cost)


def multiresolution(series: DataFrame, k: int, levels: int = 2, max_iter: int | None = None, seed: int = 0, scale_shifts: bool = False) -> Clustering:
    """Clusters the Haar averages from coarse to fine; each level starts from the assignment and rotation of the one before."""
    d, names = series.withColumn("x0", F.col("x")), ["x0"]
    for n in range(levels):
        d = d.withColumn(f"x{n + 1}", S.col(S.haar(f"x{n}") + ".wavelet"))
        names.append(f"x{n + 1}")
    d = d.select("series_id", *names).persist()
    start = d.select("series_id", F.expr(f"cast(pmod(xxhash64(series_id, {seed}), {k}) as int)").alias("cluster"), F.lit(0).alias("shift"))
    result = None
    for n, name in reversed(list(enumerate(names))):
        own = d.select("series_id", F.col(name).alias("x"))
        c, i = _settle(own.join(start, "series_id"), k, _length(own), max_iter)
        if n:
            start = assign(own, c).select("series_id", "cluster", (F.col("shift") * (2 if scale_shifts else 1)).alias("shift"))
        else:
            cost = assign(own, c).agg(F.avg(F.col("dist") * F.col("dist"))).first()[0]
            result = Clustering(c, assign(series.select("series_id", "x"), c), i, cost if cost is not None else 0.0)
    d.unpersist()
    return result


def _packed(series: DataFrame, n: int, *columns: str) -> DataFrame:
    """(b, s): the rows of each of ``n`` blocks, by a hash of the id."""
    return series.groupBy(F.pmod(F.xxhash64("series_id"), F.lit(n)).cast("int").alias("b")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("s"))


def _block_pairs(series: DataFrame, block: int, *columns: str, rows: int | None = None) -> DataFrame:
    """(i, j, s, s2) with i <= j: every two blocks of about ``block`` series meet in one row. A block is dealt to its n pairs by name; there is no join."""
    n = max(1, -(-(series.count() if rows is None else rows) // block))
    p = _packed(series, n, *columns).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    side = lambda k: F.first(F.when(F.col("b") == F.col(k), F.col("s")), ignorenulls=True)
    met = p.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).repartition(min(n * (n + 1) // 2, 4096), "i", "j")
    return met.groupBy("i", "j").agg(side("i").alias("s"), side("j").alias("s2")).where("s is not null and s2 is not null")


def pair_distances(series: DataFrame, block: int = 256) -> DataFrame:
    """Rolling distances of all ordered pairs: id1, id2, dist, shift (of the second).

    Every two blocks of series meet once: block * block pairs by matrix products, and the lower
    half by symmetry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s, s2 = batch.column("s")[r].values, batch.column("s2")[r].values
                i, j = s.field("series_id").to_numpy(), s2.field("series_id").to_numpy()
                d, q = rolling(_matrix(s.field("x")), _matrix(s2.field("x")))
                t = len(s.field("x")[0])
                diag = batch.column("i")[r] == batch.column("j")[r]
                for a, b, dist, shift in [(i, j, d, q)] if diag else [(i, j, d, q), (j, i, d.T, -(-q.T % t if t else q.T) if t else q.T)]:
                    shift = np.where(shift == 0, 0, shift)
                    same = a[:, None] == b[None, :]
                    dist, shift = np.where(same, 0.0, dist), np.where(same, 0, shift)
                    yield pa.record_batch([pa.array(np.repeat(a, len(b))), pa.array(np.tile(b, len(a))), pa.array(dist.ravel()), pa.array(shift.ravel().astype(np.int32))], ["id1", "id2", "dist", "shift"])

    return _block_pairs(series, block, "series_id", "x").mapInArrow(run, "id1 long, id2 long, dist double, shift int")


def pair_sums(series: DataFrame, block: int = 256) -> DataFrame:
    """Of (series_id, x, cluster): for each series and cluster the number, sum and sum of squares of the rolling distances to the cluster's series: series_id, c1 (own), c2, n, d, dd.

    The distances themselves stay in the tasks: N * k rows leave them, not N * N.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s, s2 = batch.column("s")[r].values, batch.column("s2")[r].values
                i, j = s.field("series_id").to_numpy(), s2.field("series_id").to_numpy()
                ci, cj = s.field("cluster").to_numpy(), s2.field("cluster").to_numpy()
                d, _ = rolling(_matrix(s.field("x")), _matrix(s2.field("x")))
                d[i[:, None] == j[None, :]] = 0.0
                for ids, own, others, m in [(i, ci, cj, d)] if batch.column("i")[r] == batch.column("j")[r] else [(i, ci, cj, d), (j, cj, ci, d.T)]:
                    kinds, of = np.unique(others, return_inverse=True)
                    member = np.zeros((len(others), len(kinds)))
                    member[np.arange(len(others)), of] = 1
                    n, total, squares = np.broadcast_to(member.sum(0), (len(ids), len(kinds))), m @ member, (m * m) @ member
                    yield pa.record_batch(
                        [pa.array(np.repeat(ids, len(kinds))), pa.array(np.repeat(own, len(kinds))), pa.array(np.tile(kinds, len(ids))), pa.array(n.ravel().astype(np.int64)), pa.array(total.ravel()), pa.array(squares.ravel())],
                        ["series_id", "c1", "c2", "n", "d", "dd"],
                    )

    s = series.select("series_id", "x", F.col("cluster").cast("int").alias("cluster"))
    parts = _block_pairs(s, block, "series_id", "x", "cluster").mapInArrow(run, "series_id long, c1 int, c2 int, n long, d double, dd double")
    return parts.groupBy("series_id", "c1", "c2").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("dd").alias("dd"))


def class_pairs(left: DataFrame, right: DataFrame, value: Column) -> DataFrame:
    """(id1, id2, v) for all rows of ``left`` (id1, a) with all of ``right`` (id2, b): ``value``, an expression of a and b, is taken once for every two different series."""
    one = left.groupBy("a").agg(F.collect_list("id1").alias("ids1"))
    other = right.groupBy("b").agg(F.collect_list("id2").alias("ids2")).repartition(left.sparkSession.sparkContext.defaultParallelism * 4, "b")
    if (n := one.count()) <= MOST_SENT:
        met = other.join(F.broadcast(one), F.lit(True))
    else:  # in blocks of about that many; every series of the right meets each block
        blocks = -(-n // MOST_SENT)
        met = other.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(one.withColumn("o", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int")), "o")
    met = met.select("ids1", "ids2", value.alias("v"))
    return met.select(F.explode("ids1").alias("id1"), "ids2", "v").select("id1", F.explode("ids2").alias("id2"), "v")


def _meeting(left: DataFrame, n_left: int, right: DataFrame, n_right: int) -> DataFrame:
    """(i, j, s, s2): each block (b, s) of ``left`` meets each of ``right`` in one row. Blocks are dealt by name, as in :func:`_block_pairs`."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = left.select(F.col("b").alias("i"), every(n_right).alias("j"), "s").unionByName(right.select(every(n_left).alias("i"), F.col("b").alias("j"), F.col("s").alias("s2")), allowMissingColumns=True)
    met = both.repartition(min(n_left * n_right, 4096), "i", "j").groupBy("i", "j")
    return met.agg(F.first("s", ignorenulls=True).alias("s"), F.first("s2", ignorenulls=True).alias("s2")).where("s is not null and s2 is not null")


def _classes(series: DataFrame) -> DataFrame:
    """(series_id, x, ids): equal series as one row with all their ids, or with ``MEMBERS`` of them; series_id is the first."""
    lists = f"transform(sequence(0, (size(ids) - 1) div {MEMBERS}), c -> slice(ids, c * {MEMBERS} + 1, {MEMBERS}))"
    one = series.groupBy("x").agg(F.sort_array(F.collect_list("series_id")).alias("ids"))
    return one.select("x", F.explode(F.expr(lists)).alias("ids")).withColumn("series_id", F.get("ids", 0))


def _members(left: pa.Array, right: pa.Array, dist: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of all ids of classes (lists of ids) from the distances of the classes."""
    a, b = left.flatten().to_numpy(), right.flatten().to_numpy()
    i, j = (np.repeat(np.arange(len(x)), x.value_lengths().to_numpy()) for x in (left, right))
    step = max(1, SENT_ROWS // len(b))
    for r in range(0, len(a), step):
        v = dist[r : r + step] if len(a) == len(left) else dist[i[r : r + step]]
        v = v if len(b) == len(right) else v[:, j]
        yield pa.record_batch([pa.array(np.repeat(a[r : r + step], len(b))), pa.array(np.tile(b, len(v))), pa.array(v.ravel())], names)


def _round(v: np.ndarray, digits: int | None) -> np.ndarray:
    """Distances rounded half up."""
    return v if digits is None else np.floor(v * 10.0**digits + 0.5) / 10.0**digits


def distances_of_all(series: DataFrame, dropped: bool = False, digits: int | None = None) -> DataFrame:
    """(id1, id2, dist) of all ordered pairs, as :func:`pair_distances`, or as :func:`drop_distances` if ``dropped``.

    Equal series are compared once, as one class; the task that compares two classes makes the rows of
    their members, so that no row of a pair is shuffled.
    """
    one = _classes(series)
    n, kernel = one.count(), dropping_distances if dropped else rolling_distances

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s, s2 = batch.column("s")[r].values, batch.column("s2")[r].values
                x, y, ids, ids2 = _matrix(s.field("x")), _matrix(s2.field("x")), s.field("ids"), s2.field("ids")
                same = batch.column("i")[r] == batch.column("j")[r]
                for at in range(0, len(y), 256):
                    d, back = kernel(x, y[at : at + 256])
                    if same:
                        d[np.arange(at, at + d.shape[1]), np.arange(d.shape[1])] = 0.0
                    yield from _members(ids, ids2[at : at + 256], _round(d, digits), ["id1", "id2", "dist"])
                    if not same:
                        yield from _members(ids2[at : at + 256], ids, _round(back, digits), ["id1", "id2", "dist"])

    pairs = _block_pairs(one, min(1024, max(256, n // 64)), "series_id", "x", "ids", rows=n)
    return pairs.mapInArrow(run, "id1 long, id2 long, dist double")


def drop_distances(queries: DataFrame, series: DataFrame, block: int = 256) -> DataFrame:
    """Zero-fill distances of a query set to all series (which are shifted): id1, id2, dist; block against block."""

    nq, ns = max(1, -(-queries.count() // block)), max(1, -(-series.count() // block))
    left = _packed(queries, nq, "series_id", "x").withColumn("b2", F.explode(F.sequence(F.lit(0), F.lit(ns - 1))))
    right = _packed(series, ns, "series_id", "x").select(F.col("b").alias("b2"), F.col("s").alias("s2"))
    both = left.join(right, "b2").repartition(min(nq * ns, 4096), "b", "b2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s, s2 = batch.column("s")[r].values, batch.column("s2")[r].values
                i, j = s.field("series_id").to_numpy(), s2.field("series_id").to_numpy()
                d = dropping(_matrix(s.field("x")), _matrix(s2.field("x")))
                yield pa.record_batch([pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i))), pa.array(d.ravel())], ["id1", "id2", "dist"])

    return both.select("s", "s2").mapInArrow(run, "id1 long, id2 long, dist double")
