"""Language identification by language-bitmask n-gram filters.

Learning counts every byte n-gram of every training text for each language (partial counts in the
tasks, then one aggregation). A language has an n-gram unless that is rarer there, by
``least_ratio``, than in another language: such strays come from quotations and wrong labels. All
n-grams go into a bit-sliced Bloom filter: a slot holds one bit for each language, so that one
lookup of an n-gram (the AND of its ``HASHES`` slots) gives the mask of all languages that have
it. The filter is sized by the number of n-grams, up to ``most_slots``; beyond that it only gets
fuller. A text's hits are counted for each language, corrected by that language's false-positive
rate, and the largest corrected share decides.

Defined results: ``und`` with score 0 for a null text or one without a letter, and where nothing
was learned; ties go to the language with the most training texts, then by name; very long texts are taken whole; repeated rows
are judged one by one; an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .runtime import free_name, read, remainder, save, small_batches

GRAM, HASHES, PAD = 5, 2, 2
#: A language has an n-gram if its share of the language's n-grams is at least so much of the share in the language where it is commonest.
LEAST_RATIO = 0.02
#: Slots that are built in one piece.
SEGMENT = 1 << 18
_NOT_LETTER = np.arange(256, dtype=np.uint8)
_NOT_LETTER[[b for b in range(128) if not chr(b).isalpha()]] = 32


def _grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 5-byte n-grams of the lower-cased texts, each padded with spaces, as integers; and n + 1 bounds of the texts."""
    data, offs = T.text_bytes(pc.utf8_lower(col))
    n = np.diff(offs)
    out = np.full(len(data) + 2 * PAD * len(n), 32, np.uint64)
    out[np.arange(len(data)) + np.repeat(PAD * (2 * np.arange(len(n)) + 1), n)] = _NOT_LETTER[data]
    g = np.zeros(max(len(out) - GRAM + 1, 0), np.uint64)
    for k in range(GRAM):
        g |= out[k : len(out) - GRAM + 1 + k] << np.uint64(8 * k)
    ends = np.cumsum(n + 2 * PAD)
    inside = np.ones(len(out), bool)
    for k in range(1, GRAM):
        inside[ends - k] = False
    return g[inside[: len(g)]], np.concatenate([[0], np.cumsum(np.maximum(n + 2 * PAD - GRAM + 1, 0))])


def _count(langs: dict[str, int]):
    """Rows (gram, lang, c): a task's partial counts of n-grams, by number of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # n-gram and language in one number: 40 bits of n-gram, 24 of language
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            u, inv = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return u, np.bincount(inv, np.concatenate([c for _, c in held]), len(u)).astype(np.int64)

        def rows():
            u, c = merged()
            for i in range(0, len(u), 100_000):
                k = u[i : i + 100_000]
                yield pa.record_batch([pa.array((k >> np.uint64(24)).view(np.int64)), pa.array((k & np.uint64(0xFFFFFF)).astype(np.int32)), pa.array(c[i : i + 100_000])], ["gram", "lang", "c"])

        for batch in batches:
            for b in T.slices(batch, "text"):
                g, bounds = _grams(b.column("text"))
                own = np.array([langs[x] for x in b.column("lang").to_pylist()], np.uint64)
                held.append(np.unique((g << np.uint64(24)) | np.repeat(own, np.diff(bounds)), return_counts=True))
                size += len(held[-1][0])
                if size > 4_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 2_000_000:
                        yield from rows()
                        held, size = [], 0
        if held:
            yield from rows()

    return run


def _segments(n_langs: int, slots: int):
    """Of rows (segment, h, mask), sorted by segment: each segment's slice of the table and its number of n-grams by language."""
    width = -(-max(n_langs, 1) // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = None, None
        for b in batches:
            if not b.num_rows:
                continue
            seg, slot = b.column("segment").to_numpy(), b.column("slot").to_numpy()
            mask = np.frombuffer(b"".join(b.column("mask").to_pylist()), np.uint8).reshape(-1, width)
            cut = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])).tolist()
            for i, j in zip(cut, [*cut[1:], len(seg)], strict=True):
                if seg[i] != at:
                    if at is not None:
                        yield pa.record_batch([pa.array([at]), pa.array([table.tobytes()], pa.binary())], ["segment", "table"])
                    at, table = int(seg[i]), np.zeros((min(SEGMENT, slots), width), np.uint8)
                for k in range(width):
                    np.bitwise_or.at(table[:, k], slot[i:j], mask[i:j, k])
        if at is not None:
            yield pa.record_batch([pa.array([at]), pa.array([table.tobytes()], pa.binary())], ["segment", "table"])

    return run


@dataclass
class Filters:
    langs: list[str]
    table: np.ndarray  # (slots, bytes for all languages)
    false_rate: np.ndarray

    def masks(self, g: np.ndarray) -> np.ndarray:
        h, slots = T.mix64(g), np.uint64(len(self.table) - 1)
        out = self.table[(h & slots).view(np.int64)]
        for k in range(1, HASHES):
            out = out & self.table[((h >> np.uint64(64 // HASHES * k)) & slots).view(np.int64)]
        return out


def learn(train: DataFrame, least_ratio: float = LEAST_RATIO, most_slots: int = 1 << 24, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from all rows with a text and a language. To the driver comes the table alone: at most ``most_slots`` slots of one bit a language."""
    small_batches(train.sparkSession)
    t = train.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = {r["lang"]: r["n"] for r in t.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(rows, key=lambda x: (-rows[x], x))
    if not langs:
        return Filters([], np.zeros((1, 1), np.uint8), np.zeros(0))
    width = -(-len(langs) // 8)
    c = save(t.mapInArrow(_count({x: i for i, x in enumerate(langs)}), "gram long, lang int, c long").groupBy("gram", "lang").agg(F.sum("c").alias("c")), "grams")
    totals = {r["lang"]: r["n"] for r in c.groupBy("lang").agg(F.sum("c").alias("n")).collect()}
    share = F.col("c") / F.get(F.array(*[F.lit(float(totals.get(i, 1))) for i in range(len(langs))]), F.col("lang"))
    held = c.groupBy("gram").agg(F.collect_list(F.struct("lang", share.alias("share"))).alias("by"))  # at most one entry a language
    top = F.array_max(F.transform("by", lambda x: x["share"]))
    held = held.select("gram", F.transform(F.filter("by", lambda x: x["share"] >= least_ratio * top), lambda x: x["lang"]).alias("langs"))
    most = c.agg(F.approx_count_distinct("gram")).first()[0]
    slots = 1 << int(np.clip(int(8 * most).bit_length(), 12, int(most_slots).bit_length() - 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("langs")
            lang, mask = col.flatten().to_numpy(), np.zeros((b.num_rows, width), np.uint8)
            np.bitwise_or.at(mask, (np.repeat(np.arange(b.num_rows), col.value_lengths().to_numpy()), lang // 8), np.uint8(1) << (lang % 8).astype(np.uint8))
            masks = pa.array([m.tobytes() for m in mask], pa.binary())
            at = np.concatenate([_slots(b.column("gram").to_numpy().view(np.uint64), k, slots) for k in range(HASHES)])
            yield pa.record_batch([pa.array(at // SEGMENT), pa.array(at % SEGMENT), pa.concat_arrays([masks] * HASHES)], ["segment", "slot", "mask"])

    placed = held.mapInArrow(place, "segment long, slot long, mask binary").repartition("segment").sortWithinPartitions("segment")
    table = np.zeros((slots, width), np.uint8)
    for r in placed.mapInArrow(_segments(len(langs), slots), "segment long, table binary").toArrow().to_pylist():
        part = np.frombuffer(r["table"], np.uint8).reshape(-1, width)
        table[r["segment"] * SEGMENT : r["segment"] * SEGMENT + len(part)] = part
    full = np.array([np.mean((table[:, i // 8] >> (i % 8)) & 1) for i in range(len(langs))])
    return Filters(langs, table, full**HASHES)


def _slots(g: np.ndarray, k: int, slots: int) -> np.ndarray:
    return ((T.mix64(g) >> np.uint64(64 // HASHES * k)) & np.uint64(slots - 1)).view(np.int64)


def predict(docs: DataFrame, filters: Filters, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and lang_pred, score, n_grams."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    own = free_name("_text", keep)
    d = docs.select(*keep, F.col(text_col).alias(own))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            for b in T.slices(batch, own):
                col = b.column(own)
                g, bounds = _grams(col)
                n, share = np.diff(bounds), np.zeros((max(len(f.langs), 1), b.num_rows))
                mask = f.masks(g)
                for i in range(len(f.langs)):
                    hits = np.concatenate([[0], np.cumsum((mask[:, i // 8] >> (i % 8)) & 1, dtype=np.int64)])
                    share[i] = np.clip(((hits[bounds[1:]] - hits[bounds[:-1]]) / np.maximum(n, 1) - f.false_rate[i]) / max(1 - f.false_rate[i], 1e-9), 0, 1)
                best, total = np.argmax(share, 0), share.sum(0)
                score = np.where(total > 0, share[best, np.arange(b.num_rows)] / np.maximum(total, 1e-12), 1 / max(len(f.langs), 1))
                has = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False) & bool(f.langs)
                pred = np.array([*f.langs, "und"], object)[np.where(has, best, len(f.langs))]
                cols = [b.column(i) for i in range(len(keep))]
                yield pa.record_batch([*cols, pa.array(pred.tolist(), pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(n)], [*keep, "lang_pred", "score", "n_grams"])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in d.schema[:-1])
    return d.mapInArrow(judge, f"{fields}, lang_pred string, score double, n_grams long")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    return predict(docs, learn(docs.where(~F.col("held_out"))), ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
