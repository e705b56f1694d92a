"""Scoring texts with a hashed maximum-entropy language model and a class-factored softmax.

*Counts.* Every training token is counted (partial counts in the tasks, then one aggregation).
The ``CLASSES * WIDTH`` most frequent tokens are the model's own words, dealt into classes of
WIDTH; all others belong to one of ``CLASSES`` suffix classes and are told apart within it by
their smoothed counts.

*Model.* P(token) = P(class | context) * P(token | class, context). Both factors are softmaxes
over sums of hashed weights: the previous token, the one before it (a skip feature), and the two
together. They start as the counts' own distribution and are trained by gradient updates: in each
of ``ROUNDS`` rounds every task descends over a share of the positions of its training texts from the
same weights, each position in one round; the new weights are the mean of the tasks' rows, weighted by how often
each row was used. So a score depends, in a small way, on how the input's files fall into tasks.

*Scoring.* One pass over the texts in sparse numpy batches. Counts of the ``KNOWN`` most frequent
tokens go along as a table of fixed size; the rarer tokens of a text leave the pass as rows and
meet their counts in a join.

Defined results: a null text is empty and consists of the end token alone; a very long text is taken whole; without training rows
all counts are 0 and the score equals the base score; repeated rows are scored one by one; an
empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .runtime import read, remainder, save, small_batches

CLASSES, WIDTH, ROUNDS = 32, 64, 2
#: Rows of the two weight tables (hashed features); like CLASSES a power of two.
FEATURE_ROWS = 1 << 14
#: Tokens whose counts are broadcast. A fixed number; all other counts are joined.
KNOWN = 1 << 17
_END = T.mix64(np.array([0xE0D], np.uint64))
_LOW = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
_OUT, _START = 2 * CLASSES, CLASSES * WIDTH + CLASSES  # classes in all; the id of the place before a text


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, suffix class and row of every token, the end tokens included, in order."""
    data, offs = T.text_bytes(batch.column("text"))
    h, row, s, e = T.word_hashes(data, offs)
    low = lambda at: _LOW[data[at]]
    suffix = low(e - 1) | (low(np.maximum(e - 2, s)) << np.uint64(8)) | (low(np.maximum(e - 3, s)) << np.uint64(16)) if len(s) else np.zeros(0, np.uint64)
    n = batch.num_rows
    out, cls, rows = np.empty(len(h) + n, np.uint64), np.zeros(len(h) + n, np.int64), np.empty(len(h) + n, np.int64)
    words, ends = np.arange(len(h)) + row, np.searchsorted(row, np.arange(n), "right") + np.arange(n)
    out[words], out[ends] = h, _END
    cls[words] = (T.mix64(suffix) & np.uint64(CLASSES - 1)).view(np.int64)
    rows[words], rows[ends] = row, np.arange(n)
    return out, cls, rows


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, c, n = (np.concatenate([x[i] for x in held]) for i in range(3))
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        return u, c[first], np.bincount(inv, n, len(u)).astype(np.int32)

    def rows():
        h, c, n = held[0]
        for i in range(0, len(h), 100_000):
            yield pa.record_batch([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(c[i : i + 100_000].astype(np.int32)), pa.array(n[i : i + 100_000].astype(np.int64))], ["h", "cls", "c"])

    for batch in batches:
        for b in T.slices(batch, "text"):
            h, cls, _ = _tokens(b)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, cls[first].astype(np.int8), n.astype(np.int32)))
            size += len(u)
            if size > 600_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 400_000:
                    yield from rows()
                    held, size = [], 0
    if held:
        held = [merged()]
        yield from rows()


def open_table(keys: np.ndarray) -> np.ndarray:
    """An open-addressing table of the places of distinct keys: slot -> place, -1 where free; at most a quarter full."""
    size = 1 << max(4, (4 * len(keys)).bit_length())
    table, left, step = np.full(size, -1, np.int32), np.arange(len(keys), dtype=np.int32), 0
    while len(left):
        slot = ((keys[left] + np.uint64(step)) & np.uint64(size - 1)).view(np.int64)
        free = table[slot] < 0
        table[slot[free]] = left[free]
        left, step = left[table[slot] != left], step + 1
    return table


def find(table: np.ndarray, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of ``h`` among the keys, -1 where absent."""
    out, left, step = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    while len(left) and len(keys):
        at = table[((h[left] + np.uint64(step)) & np.uint64(len(table) - 1)).view(np.int64)]
        there = keys[at] == h[left]
        there &= at >= 0
        out[left[there]] = at[there]
        left, step = left[(at >= 0) & ~there], step + 1
    return out


@dataclass
class Model:
    total: int
    distinct: int
    known: np.ndarray  # hashes
    known_count: np.ndarray
    known_id: np.ndarray  # id of the model's words, -1 for others
    tail_total: np.ndarray  # by suffix class: tokens and distinct tokens that are not the model's words
    tail_distinct: np.ndarray
    class_bias: np.ndarray = field(default_factory=lambda: np.zeros(_OUT, np.float32))
    word_bias: np.ndarray = field(default_factory=lambda: np.zeros((CLASSES, WIDTH), np.float32))
    w1: np.ndarray = field(default_factory=lambda: np.zeros((FEATURE_ROWS, _OUT), np.float32))
    w2: np.ndarray = field(default_factory=lambda: np.zeros((FEATURE_ROWS, WIDTH), np.float32))

    def __post_init__(self):
        self.slots = open_table(self.known)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1: not among the known) and word id (-1: none) of hashes."""
        at = find(self.slots, self.known, h)
        return np.append(self.known_count, -1)[at], np.append(self.known_id, -1)[at]

    def events(self, ids: np.ndarray, cls: np.ndarray, row: np.ndarray, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, word within it (-1: told apart by count) and the three context features of the tokens ``at``."""
        own = ids >= 0
        y = np.where(own, ids // WIDTH, CLASSES + cls)
        word = np.where(own, ids % WIDTH, -1)
        seen = np.where(own, ids, CLASSES * WIDTH + cls)
        before = np.full((2, len(ids)), _START, np.int64)
        for k in (1, 2):
            same = row[k:] == row[:-k]
            before[k - 1, k:][same] = seen[:-k][same]
        one, two = before[:, at]
        f = np.stack([one, two + 100_003, one * 100_019 + two + 1_000_000_007]).astype(np.uint64)
        return y[at], word[at], (T.mix64(f) & np.uint64(FEATURE_ROWS - 1)).view(np.int64)

    def logits(self, f: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
        table, g = (self.w1, f) if y is None else (self.w2, inner(f, y))
        z = np.take(table, g[0], 0)
        z += np.take(table, g[1], 0)
        z += np.take(table, g[2], 0)
        z += self.class_bias if y is None else self.word_bias[y]
        return z


def inner(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of the second table: a context feature together with the class."""
    return (T.mix64((f * CLASSES + y).astype(np.uint64)) & np.uint64(FEATURE_ROWS - 1)).view(np.int64)


def softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.float32]:
    """exp(z - top) in place of z, its row sums, and top: the largest of a whole batch, whose rows share their biases and so lie close together."""
    top = z.max(initial=np.float32(-1e30))
    z -= top
    np.maximum(z, np.float32(-80), out=z)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], np.float32), top


def log_softmax_at(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    own = z[np.arange(len(y)), y]
    _, total, top = softmax(z)
    return own - top - np.log(total)


def count_tokens(train: DataFrame) -> DataFrame:
    small_batches(train.sparkSession)
    t = train.select("text").mapInArrow(_count, "h long, cls int, c long")
    return save(t.groupBy("h").agg(F.first("cls").alias("cls"), F.sum("c").alias("c")), "counts")


def start(counts: DataFrame) -> Model:
    """The untrained model: the counts' own distribution. To the driver come KNOWN rows and a few sums."""
    own = CLASSES * WIDTH
    # the least count of the known, from a small histogram: no task sees more rows than its own
    step = F.floor(F.log2("c") * 64)
    least, seen = None, 0
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["s"]):
        seen += r["n"]
        if seen > KNOWN and least is not None:
            break
        least = r["s"]
    few = counts.where(step >= F.lit(least)) if seen <= KNOWN or least is None or counts.where(step >= F.lit(least)).count() <= KNOWN else counts.orderBy(F.col("c").desc(), "h").limit(KNOWN)
    top = few.toArrow().sort_by([("c", "descending"), ("h", "ascending")]).slice(0, KNOWN)
    h, cls, c = top.column("h").to_numpy().view(np.uint64), top.column("cls").to_numpy(), top.column("c").to_numpy()
    by = {r["cls"]: r for r in counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n = np.array([by[k]["n"] if k in by else 0 for k in range(CLASSES)], np.float64)
    v = np.array([by[k]["v"] if k in by else 0 for k in range(CLASSES)], np.float64)
    total, distinct = int(n.sum()), int(v.sum())
    tail_n, tail_v = n - np.bincount(cls[:own], c[:own], CLASSES), v - np.bincount(cls[:own], minlength=CLASSES)
    ids = np.where(np.arange(len(h)) < own, np.arange(len(h)), -1)
    spread = np.where(ids >= 0, ids % CLASSES * WIDTH + ids // CLASSES, -1)  # each class gets words of all frequencies
    m = Model(total, distinct, h, c, spread, tail_n, tail_v)
    words = np.full(CLASSES * WIDTH, 0.1)
    words[spread[:own][spread[:own] >= 0]] = c[:own]
    words = words.reshape(CLASSES, WIDTH)
    m.word_bias = np.log(words / words.sum(1, keepdims=True)).astype(np.float32)
    mass = np.concatenate([words.sum(1), tail_n + 0.1 * (tail_v + 1)])
    m.class_bias = np.log(mass / mass.sum()).astype(np.float32)
    return m


def row_sums(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, how often each occurs, and the sums of its gradients. Most occur once or twice; longer runs are added two columns at a time, as complex numbers."""
    rows = rows.astype(np.uint16)  # places among FEATURE_ROWS, sorted by radix
    order = np.argsort(rows, kind="stable")
    r = rows[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    n = np.diff(np.append(first, len(r)))
    s = np.take(g, order[first], 0)
    two = np.flatnonzero(n == 2)
    s[two] += np.take(g, order[first[two] + 1], 0)
    many = np.flatnonzero(n > 2)
    if len(many):
        size = n[many]
        start = np.cumsum(size) - size
        at = order[np.repeat(first[many] - start, size) + np.arange(size.sum())]
        s[many] = np.add.reduceat(np.take(g, at, 0).view(np.complex64), start, 0).view(np.float32)
    return r[first].astype(np.int64), n, s


def _step(w: np.ndarray, acc: np.ndarray, used: np.ndarray, rows: np.ndarray, g: np.ndarray, rate: float, calm: float) -> None:
    """Adagrad on the rows that a batch used; ``calm`` damps a row's first steps."""
    u, n, s = row_sums(rows, g)
    a = np.take(acc, u) + np.einsum("ij,ij->i", s, s) / np.float32(s.shape[1])
    acc[u] = a
    used[u] += n
    s *= (np.float32(-rate) / np.sqrt(a + np.float32(calm)))[:, None]
    s += np.take(w, u, 0)
    w[u] = s


def _descend(shared, turn: int, rounds: int, rate: float, calm: float, batch_size: int = 2048):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        w = [m.w1.copy(), m.w2.copy()]
        own = Model(m.total, m.distinct, m.known, m.known_count, m.known_id, m.tail_total, m.tail_distinct, m.class_bias, m.word_bias, *w)
        acc, used = [np.zeros(FEATURE_ROWS, np.float32) for _ in w], [np.zeros(FEATURE_ROWS, np.float32) for _ in w]
        for batch in batches:
            for b in T.slices(batch, "text"):
                h, cls, row = _tokens(b)
                at = np.arange(len(h)) - T.row_bounds(row, b.num_rows)[row]  # by the place in its text, so that batches need not be alike in all rounds
                y, word, f = own.events(own.look_up(h)[1], cls, row, np.flatnonzero(at % rounds == turn))
                for i in range(0, len(y), batch_size):
                    a = slice(i, min(i + batch_size, len(y)))
                    p, total, _ = softmax(own.logits(f[:, a]))
                    p /= total[:, None]
                    p[np.arange(len(p)), y[a]] -= 1
                    for k in range(3):
                        _step(w[0], acc[0], used[0], f[k, a], p, rate, calm)
                    a = i + np.flatnonzero(word[a] >= 0)
                    if len(a):
                        p, total, _ = softmax(own.logits(f[:, a], y[a]))
                        p /= total[:, None]
                        p[np.arange(len(a)), word[a]] -= 1
                        g = inner(f[:, a], y[a])
                        for k in range(3):
                            _step(w[1], acc[1], used[1], g[k], p, rate, calm)
        for table, (x, n) in enumerate(zip(w, used, strict=True)):
            r = np.flatnonzero(n)
            for i in range(0, len(r), 2000):
                k = r[i : i + 2000]
                yield pa.record_batch(
                    [pa.array(np.full(len(k), table, np.int32)), pa.array(k), pa.array(n[k].astype(np.float64)), pa.array([v.tobytes() for v in x[k]], pa.binary())], ["table", "r", "n", "w"]
                )

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by table and row: the mean of a row's versions, weighted by use. Holds a batch, and the sum of the row that goes on in the next."""
    key, total, weight = None, None, 0.0

    def emit(keys, sums, weights):
        means = [(x / n).astype(np.float32).tobytes() for x, n in zip(sums, weights, strict=True)]
        return pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array(means, pa.binary())], ["table", "r", "w"])

    for b in batches:
        t, r, n = (b.column(c).to_numpy() for c in ("table", "r", "n"))
        cut = [0, *(np.flatnonzero((t[1:] != t[:-1]) | (r[1:] != r[:-1])) + 1).tolist(), len(t)]
        data, offs = T.text_bytes(b.column("w"))
        keys, sums, weights = [], [], []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if i == j:
                continue
            s, m = np.frombuffer(data[offs[i] : offs[j]], np.float32).reshape(j - i, -1).astype(np.float64), n[i:j]
            if (int(t[i]), int(r[i])) != key:
                if key is not None:
                    keys.append(key)
                    sums.append(total)
                    weights.append(weight)
                key, total, weight = (int(t[i]), int(r[i])), np.zeros(s.shape[1]), 0.0
            total, weight = total + m @ s, weight + m.sum()
        if keys:
            yield emit(keys, sums, weights)
    if key is not None:
        yield emit([key], [total], [weight])


def fit(train: DataFrame, counts: DataFrame, rounds: int = ROUNDS, rate: float = 0.15, calm: float = 0.5) -> Model:
    """Counts, then ``rounds`` of distributed gradient updates, which together use every position of the training texts once."""
    sc, m = train.sparkSession.sparkContext, start(counts)
    for turn in range(rounds if m.total else 0):
        shared = sc.broadcast(m)
        parts = train.select("text").mapInArrow(_descend(shared, turn, rounds, rate, calm), "table int, r long, n double, w binary")
        mean = parts.repartition("table", "r").sortWithinPartitions("table", "r", "n", "w").mapInArrow(_average, "table int, r long, w binary").toArrow()
        t, r = mean.column("table").to_numpy(), mean.column("r").to_numpy()
        m = Model(m.total, m.distinct, m.known, m.known_count, m.known_id, m.tail_total, m.tail_distinct, m.class_bias, m.word_bias, m.w1.copy(), m.w2.copy())
        for k, w in enumerate((m.w1, m.w2)):
            own = np.flatnonzero(t == k)
            if len(own):
                w[r[own]] = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in mean.column("w").take(pa.array(own)).combine_chunks()), np.float32).reshape(len(own), -1)
        shared.unpersist()
    return m


def _score(shared):
    log = np.log10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tail = log(np.maximum(m.tail_total + 0.1 * (m.tail_distinct + 1), 1e-300))
        for batch in batches:
            for b in T.slices(batch, "text"):
                n = b.num_rows
                h, cls, row = _tokens(b)
                count, ids = m.look_up(h)
                y, word, f = m.events(ids, cls, row)
                model = np.zeros(len(h))
                for i in range(0, len(h), 1024):
                    a = slice(i, i + 1024)
                    model[a] = log_softmax_at(m.logits(f[:, a]), y[a])
                    own = np.arange(i, min(i + 1024, len(h)))[word[a] >= 0]
                    if len(own):
                        model[own] += log_softmax_at(m.logits(f[:, own], y[own]), word[own])
                model /= np.log(10)
                rare = word < 0
                smooth = log(np.maximum(count, 0) + 0.1) * (count >= 0)
                model[rare] += smooth[rare] - tail[y[rare] - CLASSES]
                of = lambda x: pa.array(np.bincount(row, x, n))
                ints = lambda x: pa.array(np.bincount(row[x], minlength=n))
                none = pa.nulls(n, pa.int64())
                mark = pa.array(_marks(b))
                cols = [*[b.column(c) for c in ("doc_id", "held_out")], mark, none, none, ints(slice(None)), ints(count > 0), of(smooth), of(model)]
                names = ["doc_id", "held_out", "mark", "h", "times", "n_tokens", "n_known", "known_sum", "model_sum"]
                yield pa.record_batch(cols, names)
                out = np.flatnonzero(count < 0)
                order = out[np.lexsort((h[out], row[out]))]
                if len(order):
                    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])])
                    first = np.flatnonzero(new)
                    times = np.diff(np.append(first, len(order)))
                    k = order[first]
                    r, z = pa.array(row[k]), pa.nulls(len(k), pa.int64())
                    d = pa.nulls(len(k), pa.float64())
                    yield pa.record_batch([b.column("doc_id").take(r), pa.nulls(len(k), pa.bool_()), mark.take(r), pa.array(h[k].view(np.int64)), pa.array(times), z, z, d, d], names)

    return run


def _marks(b: pa.RecordBatch) -> np.ndarray:
    """A hash of each whole text, so that rows with equal ids but other texts are told apart."""
    data, offs = T.text_bytes(b.column("text"))
    return T.span_hashes(T.prefix(data), offs[:-1], offs[1:]).view(np.int64)


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """``docs``: doc_id, held_out, text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = "doc_id long, held_out boolean, mark long, h long, times long, n_tokens long, n_known long, known_sum double, model_sum double"
    s = save(docs.select("doc_id", "held_out", "text").mapInArrow(_score(shared), types), "lm-rows")
    key = F.coalesce("doc_id", F.lit(-(1 << 62)))
    rare = s.where("n_tokens is null").select(key.alias("k"), "mark", "h", "times").join(counts.select("h", "c"), "h", "left")
    rare = rare.groupBy("k", "mark").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rare_sum"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("rare_known"),
    )
    text = s.where("n_tokens is not null").withColumn("k", key)
    same = [c for c in text.columns if c not in ("h", "times", "known_sum", "model_sum")]
    text = text.groupBy(*same).agg(F.count(F.lit(1)).alias("rows"), F.max("known_sum").alias("known_sum"), F.max("model_sum").alias("model_sum"))
    out = text.join(rare, ["k", "mark"], "left").withColumn("r", F.coalesce("rare_sum", F.lit(0.0)) / F.col("rows"))
    smooth = float(np.log10(model.total + 0.1 * (model.distinct + 1)))
    base = F.col("known_sum") + F.col("r") - F.col("n_tokens") * F.lit(smooth)
    out = out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + (F.coalesce("rare_known", F.lit(0)) / F.col("rows")).cast("long")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model_sum") + F.col("r") if model.total else base).alias("score"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("row"),
    )
    return out.drop("row")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", (remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "text")
    train = docs.where(~F.col("held_out"))
    counts = count_tokens(train)
    return score(docs, counts, fit(train, counts))
