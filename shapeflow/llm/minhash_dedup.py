"""Near-duplicate documents by MinHash bands, sequential Bayesian verification and exact confirmation.

1. One pass over the texts: distinct word shingles, a digest of the set, a MinHash signature and
   its band hashes. Documents with the same set are one class from here on, its smallest id the
   representative, so exact copies never meet as pairs.
2. Within a band's bucket, representatives' signatures are compared batch by batch; a pair is
   given up as soon as the posterior probability that its similarity reaches the threshold falls
   below ``miss``. Of the pairs that last, a spanning forest is kept.
3. The forest's components are clusters of candidates. Within a cluster, in blocks of bounded
   size, all intersections are counted exactly on the full sets (a product of sparse 0/1
   matrices); of the confirmed links a spanning forest is kept, and its components are the result.

A bucket or cluster of any size is dealt out in pairs of blocks; no row stands for a pair of
documents that are not linked, and no pair inside a cluster goes unconfirmed.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; rows
with equal ids are one document of several texts; rows with a null id are returned with a null
component and kept; very long texts are taken whole. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .graph import Forest, block_pairs, bounded, components, groups
from .runtime import read, save, small_batches

#: Hashes of a signature, and how many are compared at a time.
HASHES, BATCH = 100, 20
BLOCK = 256
_A = (np.random.default_rng(66).integers(1, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_LOW = np.uint64((1 << 54) - 1)


def shingle_sets(batch: pa.RecordBatch, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (54 bits of hash, sorted within each row) and n + 1 bounds; at most 1,023 rows."""
    data, offs = T.text_bytes(batch.column(text))
    h, row, _, _ = T.word_hashes(data, offs)
    s, row, _ = T.shingles(h, T.row_bounds(row, batch.num_rows), k)
    key = np.sort((row.astype(np.uint64) << np.uint64(54)) | (s >> np.uint64(10)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key & _LOW, np.searchsorted(key >> np.uint64(54), np.arange(batch.num_rows + 1, dtype=np.uint64))


def banding(threshold: float, miss: float) -> tuple[int, int]:
    """Bands and rows a band: the most rows with which a pair of similarity ``threshold`` shares no band with probability ``miss`` at most."""
    fit = [r for r in range(1, HASHES + 1) if (1 - threshold**r) ** (HASHES // r) <= miss]
    if not fit:
        raise ValueError(f"{HASHES} hashes cannot find pairs of similarity {threshold} at a miss probability of {miss}")
    return HASHES // max(fit), max(fit)


def posterior_floors(threshold: float, miss: float) -> list[int]:
    """For each number of compared hashes (BATCH, 2 * BATCH, ...): the fewest matches with P(similarity >= threshold | matches) >= miss, from a uniform prior."""
    s = np.linspace(0, 1, 20001)[1:-1]
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = 0
        while m < n:
            logp = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(logp - logp.max())
            if p[s >= threshold].sum() >= miss * p.sum():
                break
            m += 1
        out.append(m)
    return out


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in T.slices(batch, "text"):
                s, bounds = shingle_sets(b, "text", k)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                v = T.mix64(s)
                total = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(np.stack([v, T.mix64(s ^ np.uint64(0x5BD1E995))], 1), 0, dtype=np.uint64)])
                digest = (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)
                sig = np.zeros((b.num_rows, HASHES), np.uint64)
                if len(some):
                    for i, a in enumerate(_A):
                        sig[some, i] = np.minimum.reduceat(v * a, bounds[some])
                band = np.zeros((b.num_rows, bands), np.uint64)
                for r in range(rows):
                    band = T.mix64(band + sig[:, r : bands * rows : rows] + np.uint64(r))
                small = (T.mix64(sig) & np.uint64(0xFFFF)).astype(np.uint16)
                flat = pa.array(band.view(np.int64).ravel())
                yield pa.record_batch(
                    [b.column("doc_id"), pa.array(n), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat), pa.array([x.tobytes() for x in small], pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "bands", "sig"],
                )

    return run


def _candidates(threshold: float, miss: float):
    floors = posterior_floors(threshold, miss)

    def lasting(sig: np.ndarray, one: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Those of ``rest`` whose comparison with the signature ``one`` lasts through all batches."""
        m = np.zeros(len(rest), np.int64)
        for n, floor in enumerate(floors):
            m += (sig[rest, n * BATCH : (n + 1) * BATCH] == one[n * BATCH : (n + 1) * BATCH]).sum(1)
            rest, m = rest[m >= floor], m[m >= floor]
        return rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["bucket", "i", "j"]):
            ids, side = t.column("rep").to_numpy(), t.column("side").to_numpy()
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
            left, right = (np.flatnonzero(side == i), np.flatnonzero(side == j))
            f, edges = Forest(len(ids)), []
            # the first of the left block settles most of a group of copies; what it does not, meets all
            order = [left[np.argmin(ids[left])], *left] if len(left) else []
            done = np.zeros(len(ids), bool)
            for n, x in enumerate(order):
                rest = right[right != x] if i != j or n == 0 else right[right > x]
                if n:
                    root = np.array([f.find(y) for y in rest]) if len(rest) else rest
                    rest = rest[root != f.find(x)] if len(rest) else rest
                for y in lasting(sig, sig[x], rest):
                    if f.join(x, y):
                        edges.append((ids[x], ids[y]))
                done[x] = True
            if edges:
                e = np.array(edges, np.int64)
                yield pa.record_batch([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in T.slices(batch, "text"):
                s, bounds = shingle_sets(b, "text", k)
                yield pa.record_batch([b.column("cluster"), b.column("rep"), pa.array([s[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["cluster", "rep", "set"])

    return run


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """|A & B| for every left and right set. Only values of two sets or more have a column; columns are taken ``width`` at a time."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[inv] > 1
    col = np.cumsum(count > 1) - 1
    who, col = who[shared], col[inv[shared]]
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [at, at + width])
        x = np.zeros((len(sets), width), np.float32)
        x[who[lo:hi], col[lo:hi] - at] = 1
        out += x[left] @ x[right].T
    return out


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["cluster", "i", "j"]):
            ids, side = t.column("rep").to_numpy(), t.column("side").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
            left, right = np.flatnonzero(side == t.column("i")[0].as_py()), np.flatnonzero(side == t.column("j")[0].as_py())
            if not len(left) or not len(right) or len(ids) < 2:
                continue
            both = intersections(sets, left, right)
            n = np.array([len(s) for s in sets])
            linked = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
            f, edges = Forest(len(ids)), []
            for x, y in zip(*np.nonzero(linked), strict=True):
                if left[x] != right[y] and f.join(left[x], right[y]):
                    edges.append((ids[left[x]], ids[right[y]]))
            if edges:
                e = np.array(edges, np.int64)
                yield pa.record_batch([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept. Links: 100 * intersection >= percent * union of k-word shingle sets; a pair at the threshold is missed with a probability of ``miss`` at most by the bands, and as much by the pruning."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = save(d.mapInArrow(_sketch(k, *banding(percent / 100, miss)), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary"), "sketches")
    keys = ["n_shingles", "d1", "d2"]
    there = base.where("n_shingles > 0 and doc_id is not null")
    classes = save(there.groupBy(*keys).agg(F.min("doc_id").alias("rep")), "classes")
    reps = there.join(classes, keys).where("doc_id = rep").select("rep", "bands", "sig").dropDuplicates(["rep", "bands"])
    reps = save(reps, "reps")
    rows = reps.select("rep", F.posexplode("bands").alias("band", "h")).select("rep", F.xxhash64("band", "h").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    rows = save(block_pairs(rows.join(full, "bucket"), "bucket", "rep", 4 * BLOCK), "buckets")
    dealt = rows.join(reps.select("rep", "sig"), "rep").repartition(F.xxhash64("bucket", "i", "j")).sortWithinPartitions("bucket", "i", "j", "rep")
    cluster = components(dealt.mapInArrow(_candidates(percent / 100, miss), "a long, b long")).select(F.col("root").alias("cluster"), F.col("node").alias("rep"))
    cluster = save(cluster, "clusters")
    texts = d.join(bounded(cluster), d["doc_id"] == cluster["rep"]).select("cluster", "rep", "text")
    sets = save(texts.mapInArrow(_sets(k), "cluster long, rep long, set binary").distinct(), "sets")
    dealt = block_pairs(sets, "cluster", "rep", BLOCK).repartition(F.xxhash64("cluster", "i", "j")).sortWithinPartitions("cluster", "i", "j", "rep")
    # copies hang on their class, not on the graph; an id with texts of several classes links these
    member = save(base.select("doc_id", *keys).join(classes, keys, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "members")
    twice = member.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("m")).where("b <> m")
    same_id = member.join(twice, "doc_id").select(F.col("rep").alias("a"), "b")
    root = components(dealt.mapInArrow(_confirm(percent), "a long, b long").unionByName(same_id))
    out = member.join(root, member["rep"] == root["node"], "left")
    component = F.coalesce("root", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


ORACLE = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') as words from documents
), s as (
  select distinct doc_id, array_to_string(list_slice(words, i, i + 2), ' ') as g from (select doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) as i from w where len(words) > 0)
), n as (select doc_id, count(*) as n from s group by 1),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), l as (
  select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 85 * (x.n + y.n - c)
)
, e as (select a, b from l union all select b, a from l)
, r as (
  with recursive reach(doc_id, root) as (
    select doc_id, doc_id from documents union select reach.doc_id, e.b from reach join e on e.a = reach.root
  ) select doc_id, min(root) as component_id from reach group by 1
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, r.component_id, d.doc_id = r.component_id as kept
from documents d left join n using (doc_id) join r using (doc_id)
"""
