"""Exact substring duplicates by suffix arrays built with difference covers.

A byte is removed if it is covered by a ``LENGTH``-byte string that also starts in a document with
a smaller id. Strings of whole texts are compared as UTF-8 bytes and never cross documents.

1. Documents with the same text are one (the smallest id); a later copy of at least LENGTH bytes
   is removed whole.
2. *Where a duplicate can be.* Every LENGTH-byte string has an anchor: the GRAM-byte gram in it
   with the least hash (leftmost of equals). Equal strings have equal anchors, so a string whose
   anchor's hash occurs in one document only is no duplicate. This loses nothing and leaves a few
   hundredths of the input.
3. The stretches around the anchors left are dealt out by the anchor's hash: all equal strings
   meet in one task. Equal stretches of a batch are sent once (of the others all strings are
   known to be duplicates), so a stretch that a third of all documents share is sent once a batch.
4. Each task sorts the suffixes of its distinct stretches with the difference cover {1, 2} mod 3:
   sampled triples are named, the names' string is sorted by recursion, the remaining suffixes
   are sorted by their first symbol and the rank that follows, and merged. Comparing the LENGTH-byte
   prefixes of adjacent suffixes gives the groups of equal strings, and each group's smallest id.

Strings are compared by 64-bit hashes where whole stretches are equal, byte by byte elsewhere.

Defined results: a null text is empty; very long texts are taken whole; texts shorter than LENGTH bytes lose nothing; rows with
equal ids do not count as smaller than one another; a row with a null id is left as it is and
makes no other row a duplicate; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .graph import bounded, groups, spread_join
from .runtime import read, save, small_batches
from .windows import window_minima

LENGTH, GRAM = 50, 20
#: Bytes of input for each bucket of steps 2 and 3.
BUCKET_BYTES = 3 << 20


# ---- suffix sorting -------------------------------------------------------------------------


def _names(*symbols: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of non-negative integers."""
    widths = [max(int(s.max(initial=0)).bit_length(), 1) for s in symbols]
    if sum(widths) <= 22:  # few enough values for a table instead of a sort
        key = symbols[0].astype(np.int64)
        for s, w in zip(symbols[1:], widths[1:], strict=True):
            key = (key << w) | s.astype(np.int64)
        there = np.zeros(1 << sum(widths), bool)
        there[key] = True
        return (np.cumsum(there) - 1)[key]
    key = symbols[0].astype(np.uint64)
    for s in symbols[1:]:
        width = np.uint64(max(int(s.max(initial=0)).bit_length(), 1))
        if int(key.max(initial=0)).bit_length() + int(width) > 64:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = (key << width) | s.astype(np.uint64)
    return np.unique(key, return_inverse=True)[1]


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``s`` (integers >= 1) in an order that is right for their first ``depth`` symbols; a missing symbol is 0.

    Suffixes with the same ``depth`` symbols are adjacent, in no fixed order.
    """
    n = len(s)
    if n < 4 or depth <= 1:
        pad = np.concatenate([s, np.zeros(max(depth, 1), s.dtype)]).astype(np.int64)
        return np.lexsort([pad[k : k + n] for k in range(max(depth, 1) - 1, -1, -1)])
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
    sample = np.concatenate([np.arange(1, n, 3), np.arange(2, n, 3)])
    ones = len(range(1, n, 3))
    names = _names(t[sample], t[sample + 1], t[sample + 2]) + 1
    if depth > 3:
        # the names at 1 mod 3, an end mark, the names at 2 mod 3
        order = suffix_order(np.concatenate([names[:ones] + 1, [1], names[ones:] + 1]), -(-depth // 3) + 1)
        order = order[order != ones]
        order = order - (order > ones)
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    width = np.uint64(int(t.max()).bit_length())
    bits = np.uint64(int(n + 3).bit_length())
    put = lambda i: (t[i].astype(np.uint64) << bits) | rank[i + 1].astype(np.uint64)
    rest = np.arange(0, n, 3)
    key = put(rest)
    by = np.argsort(key, kind="stable")
    rest, key = rest[by], key[by]
    # places of the remaining suffixes among those at 1 mod 3 and at 2 mod 3
    first = order < ones
    at1, at2 = sample[order[first]], sample[order[~first]]
    before = np.searchsorted(put(at1), key)
    if int(width) * 2 + int(bits) <= 64:
        put2 = lambda i: (((t[i].astype(np.uint64) << width) | t[i + 1].astype(np.uint64)) << bits) | rank[i + 2].astype(np.uint64)
        before = before + np.searchsorted(put2(at2), put2(rest))
    else:
        pair = _names(np.concatenate([t[at2], t[rest]]), np.concatenate([t[at2 + 1], t[rest + 1]])).astype(np.uint64)
        k2, kr = (pair[: len(at2)] << bits) | rank[at2 + 2].astype(np.uint64), (pair[len(at2) :] << bits) | rank[rest + 2].astype(np.uint64)
        before = before + np.searchsorted(k2, kr)
    out = np.empty(n, np.int64)
    at = np.maximum.accumulate(before) + np.arange(len(rest))  # among equals the two counts may disagree
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = rest
    out[~taken] = sample[order]
    return out


def equal_groups(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in suffix order, and where each group of equal ``length``-byte strings begins in it. ``text``: bytes, ``length`` of them after every start."""
    alphabet = np.zeros(256, bool)
    alphabet[text] = True
    order = suffix_order(np.cumsum(alphabet)[text], length)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    sa = order[wanted[order]]
    wide = np.zeros(len(text), np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    for k in range(8):
        wide |= padded[k : k + len(text)].astype(np.uint64) << np.uint64(8 * k)
    new = np.ones(len(sa), bool)
    if len(sa) > 1:
        new[1:] = False
        for k in [*range(0, length - 7, 8), length - 8]:
            new[1:] |= wide[sa[1:] + k] != wide[sa[:-1] + k]
    return sa, np.flatnonzero(new)


# ---- anchors and stretches ------------------------------------------------------------------


def _anchors(col: pa.Array) -> tuple[np.ndarray, ...]:
    """Of the texts' LENGTH-byte strings: the anchors' hash and row, first and last start in the text; with the bytes and offsets."""
    data, offs = T.text_bytes(col)
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, data, offs
    pre = T.prefix(data)
    g = np.arange(len(data) - GRAM + 1)
    h = T.span_hashes(pre, g, g + GRAM)
    ends = np.maximum(offs[1:] - GRAM + 1, offs[:-1])  # grams of a row: [start, ends)
    # grams across rows: give every row its own run of grams
    row = np.searchsorted(offs, g, "right") - 1
    own = g < ends[row]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row[own], minlength=len(col)))])
    at, first, last = window_minima(h[own], bounds, LENGTH - GRAM + 1)
    r = np.searchsorted(bounds, at, "right") - 1
    shift = bounds[r]
    return h[own][at], r, first - shift, last - shift, data, offs


def _entries(n_buckets: int):
    """Rows (bucket, h, d): one entry for each hash of a batch; under bucket -1 all pairs of a hash that two documents of the batch have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for b in T.slices(batch, "text"):
                h, r, *_ = _anchors(b.column("text"))
                ids.append(b.column("doc_id").to_numpy()[r])
                keys.append(h)
            if not keys:
                continue
            h, d = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            pair = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])[: len(h)]
            h, d = h[pair], d[pair]
            one = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
            several = ~one
            several[:-1] |= ~one[1:]
            out = [(-1, h[several].tobytes(), d[several].tobytes())] if several.any() else []
            h, d = h[one], d[one]
            bucket = ((h >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, d, bucket = h[order], d[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(h)]).tolist()
            out += [(int(bucket[i]), h[i:j].tobytes(), d[i:j].tobytes()) for i, j in zip(cut, [*cut[1:], len(h)], strict=True)]
            if out:
                yield pa.record_batch([pa.array(c, pa.binary() if i else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], ["bucket", "h", "d"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket, the (id, hash) of hashes that more than one document has."""
    for t in groups(batches, ["bucket"]):
        h = np.frombuffer(b"".join(t.column("h").to_pylist()), np.uint64)
        d = np.frombuffer(b"".join(t.column("d").to_pylist()), np.int64)
        if t.column("bucket")[0].as_py() >= 0:
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            many = np.zeros(len(h), bool)
            many[order[1:][same]] = True
            many[order[:-1][same]] = True
            h, d = h[many], d[many]
        for i in range(0, len(h), 50_000):
            yield pa.record_batch([pa.array(d[i : i + 50_000]), pa.array(h[i : i + 50_000].view(np.int64))], ["doc_id", "h"])


def _cut_out(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The byte spans as a binary array."""
    size = hi - lo
    begin = np.concatenate([[0], np.cumsum(size)])
    out = data[np.repeat(lo - begin[:-1], size) + np.arange(begin[-1])]
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(begin.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def _stretches(n_buckets: int):
    """Rows of stretches (bucket >= 0), and of starts already known to be duplicates (bucket -1, no piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in T.slices(batch, "text"):
                h, r, first, last, data, offs = _anchors(b.column("text"))
                marks = b.column("hashes").flatten().to_numpy().view(np.uint64)
                row = np.repeat(np.arange(b.num_rows), b.column("hashes").value_lengths().to_numpy())
                known = np.unique(T.mix64(marks) + row.astype(np.uint64))
                here = T.mix64(h) + r.astype(np.uint64)
                if not len(known) or not len(here):
                    continue
                ok = known[np.minimum(np.searchsorted(known, here), len(known) - 1)] == here
                h, r, first, last = h[ok], r[ok], first[ok], last[ok]
                if not len(h):
                    continue
                ids = b.column("doc_id").to_numpy()[r]
                lo, hi = offs[r] + first, offs[r] + last + LENGTH
                alike = T.span_hashes(T.prefix(data), lo, hi) ^ h
                order = np.lexsort((ids, alike))
                a = alike[order]
                lead = np.concatenate([[True], a[1:] != a[:-1]])
                least = ids[order][np.maximum.accumulate(np.where(lead, np.arange(len(a)), 0))]
                later = np.empty(len(a), bool)
                later[order] = ids[order] > least
                bucket = np.where(later, -1, ((h >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64))
                whose = pa.array(r)
                yield pa.record_batch(
                    [pa.array(bucket), pa.array(h.view(np.int64)), b.column("doc_id").take(whose), b.column("mark").take(whose), pa.array(first), pa.array(last - first + 1), _cut_out(data, lo, np.where(later, lo, hi))],
                    ["bucket", "h", "doc_id", "mark", "at", "starts", "piece"],
                )

    return run


def _duplicates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, start, n): runs of starts in a text whose strings also start in a smaller id."""
    for t in groups(batches, ["bucket"]):
        ids, marks, at, starts = (t.column(c).to_numpy() for c in ("doc_id", "mark", "at", "starts"))
        if t.column("bucket")[0].as_py() < 0:
            yield pa.record_batch([pa.array(x) for x in (ids, marks, at, starts)], ["doc_id", "mark", "start", "n"])
            continue
        pieces = t.column("piece").combine_chunks()
        data, offs = T.text_bytes(pieces)
        order = np.lexsort((ids, T.span_hashes(T.prefix(data), offs[:-1], offs[1:])))
        h = T.span_hashes(T.prefix(data), offs[:-1], offs[1:])[order]
        lead = np.concatenate([[True], h[1:] != h[:-1]])
        kind = np.empty(len(order), np.int64)  # the distinct stretch of each row; its first row has the least id
        kind[order] = np.cumsum(lead) - 1
        rows = order[lead]
        least, n = ids[rows], starts[rows]
        begin = np.concatenate([[0], np.cumsum(n)])
        lowest = np.repeat(least, n)  # by start of a distinct stretch
        # strings of stretches of different anchors differ, and so do those of one stretch: only anchors with several stretches are sorted
        _, of_anchor, variants = np.unique(t.column("h").to_numpy()[rows], return_inverse=True, return_counts=True)
        some = np.flatnonzero(variants[of_anchor] > 1)
        if len(some):
            size = (offs[1:] - offs[:-1])[rows[some]]
            into = np.concatenate([[0], np.cumsum(size)])
            text = data[np.repeat(offs[rows[some]] - into[:-1], size) + np.arange(into[-1])]
            k = n[some]
            off = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            s, where = np.repeat(into[:-1], k) + off, np.repeat(begin[some], k) + off
            place = np.zeros(len(text), np.int64)
            place[s] = where
            sa, cut = equal_groups(text, s, LENGTH)
            own = place[sa]
            lowest[own] = np.repeat(np.minimum.reduceat(lowest[own], cut), np.diff(np.append(cut, len(sa))))
        # every row, against the least id of each of its strings
        total = starts.sum()
        row = np.repeat(np.arange(len(ids)), starts)
        off = np.arange(total) - np.repeat(np.cumsum(starts) - starts, starts)
        gone = lowest[begin[kind[row]] + off] < ids[row]
        edge = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (row[1:] != row[:-1])]))
        stop = np.flatnonzero(gone & np.concatenate([~gone[1:] | (row[1:] != row[:-1]), [True]]))
        yield pa.record_batch([pa.array(x) for x in (ids[row[edge]], marks[row[edge]], at[row[edge]] + off[edge], stop - edge + 1)], ["doc_id", "mark", "start", "n"])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text, copy (the whole text is a later copy), runs (array of start, n: starts of removed strings, null if none)."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text", text).withColumn("mark", F.xxhash64("text"))
    digests = save(d.select("doc_id", "mark", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").alias("size")), "digests")
    firsts = digests.where(f"doc_id is not null and size >= {LENGTH}").groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    copies = save(spread_join(digests.where("doc_id is not null"), firsts, ["sha"], "doc_id").where("doc_id > first").select("doc_id", "mark").distinct(), "copies")
    copied = bounded(copies)
    own = d.where(f"doc_id is not null and octet_length(text) >= {LENGTH}").join(copied, ["doc_id", "mark"], "left_anti")
    total = digests.agg(F.sum("size")).first()[0] or 0
    n_buckets = max(spark.sparkContext.defaultParallelism * 4, int(total // BUCKET_BYTES))
    entries = own.select("doc_id", "text").mapInArrow(_entries(n_buckets), "bucket long, h binary, d binary")
    spread = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("h"), F.lit(n_buckets))).otherwise(F.col("bucket"))
    shared = entries.withColumn("bucket", spread).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "doc_id long, h long")
    hashes = save(shared.groupBy("doc_id").agg(F.collect_set("h").alias("hashes")), "anchors")
    some = own.join(bounded(hashes.select("doc_id")), "doc_id")
    pieces = some.join(hashes, "doc_id").select("doc_id", "mark", "text", "hashes").mapInArrow(_stretches(n_buckets), "bucket long, h long, doc_id long, mark long, at long, starts long, piece binary")
    spread = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets))).otherwise(F.col("bucket"))
    runs = pieces.withColumn("bucket", spread).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_duplicates, "doc_id long, mark long, start long, n long")
    runs = save(runs.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("runs")), "runs")
    touched = bounded(runs.select("doc_id", "mark"))
    keys = ["doc_id", "mark"]
    cut = d.join(touched, keys).join(runs, keys).select("doc_id", "text", F.lit(False).alias("copy"), "runs")
    rest = d.join(touched, keys, "left_anti").join(copied.withColumn("copy", F.lit(True)), keys, "left")
    return cut.unionByName(rest.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), F.lit(None).cast("array<struct<start: bigint, n: bigint>>").alias("runs")))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, copy, runs in zip(b.column("text"), b.column("copy").to_pylist(), b.column("runs").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            spans = [[0, len(raw)]] if copy else []
            for x in runs or []:
                i, j = x["start"], x["start"] + x["n"] + LENGTH - 1
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], j)
                else:
                    spans.append([i, j])
            at, left = 0, hashlib.sha256()
            for i, j in spans:
                left.update(raw[at:i])
                at = j
            left.update(raw[at:])
            out.append((len(raw), sum(j - i for i, j in spans), len(spans), left.hexdigest()))
        cols = zip(*out, strict=True) if out else ([], [], [], [])
        yield pa.record_batch([b.column("doc_id"), *[pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(cols)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op5(spark, sf_dir: str) -> DataFrame:
    return repeated_bytes(read(spark, sf_dir, "documents")).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
