"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's documents are to be repeated ``target / source size`` times on average. The whole part
is certain; the fraction is a copy probability. Pivotal rounding takes two documents with
fractional probabilities and moves *mass* (probability times words) from one to the other, in a
random direction chosen so that each probability keeps its expectation, until one of the two is
0 or 1. The words taken stay the same at every step, so a source ends within one document of its
target. Documents are rounded in blocks of at most about ``block`` (the block is a hash of the
id, so a hot source is spread over all tasks); each block leaves one unresolved document, and
those are combined by the same step up a tree with ``block`` children to a node.

Every draw is a hash of the two ids and the seed, so reruns agree.

Defined results: documents of no words are taken 0 times and take no part; a null source is a
source of its own, last in the order; repeated rows (same id, source and size) are one unit that
gets the same number of copies for each row; an empty table gives no rows. Other columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import read, save

#: Sources' weights repeat these; a source is repeated at most MOST times.
WEIGHTS, MOST = (1, 2, 3), 3


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ (null: 0)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    return F.size(words).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n -> with target: the level L at which sum(min(most * size, L * weight)) is the total.

    Resharing a stopped source's excess by weight until none is above its stop ends at that
    level. Works on one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_stop = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    t = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    t = t.withColumn("stop", F.col("source_size") * float(most))
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    t = t.withColumn("level", left / weight)
    # the level with the first k sources stopped; the first k whose next source stays below its stop holds
    t = t.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("stop"), F.struct((F.col("stop") / F.col("w")).alias("at"), F.col("level").alias("level")))).over(every)["level"])
    return t.withColumn("target", F.coalesce(F.least(F.col("stop"), F.col("level") * F.col("w")), F.col("stop"))).drop("w", "stop", "level")


def _draw(a: Column, b: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(a, b, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(units: Column, kind: str, seed: int) -> Column:
    """Pivotal rounding through an array of (id, mass, p): struct(done: array of (id, p in {0, 1}), open: the unit left, or null)."""
    empty = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open"))

    def step(acc: Column, b: Column) -> Column:
        a = acc["open"]
        up = F.least((1 - a["p"]) * a["mass"], b["p"] * b["mass"])  # mass that can move from b to a
        down = F.least(a["p"] * a["mass"], (1 - b["p"]) * b["mass"])
        to_a = _draw(a["id"], b["id"], seed) * (up + down) < down
        moved = F.when(to_a, up).otherwise(-down)
        fills = (1 - a["p"]) * a["mass"] <= b["p"] * b["mass"]  # moving up, a becomes 1 before b is 0
        drains = a["p"] * a["mass"] <= (1 - b["p"]) * b["mass"]
        a_ends = F.when(to_a, fills).otherwise(drains)
        put = lambda u, p: F.struct(*[(p if f == "p" else u[f]).alias(f) for f in ("id", "mass", "p", "base", "copies", "source", "size", "source_size", "target")])
        held = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        ended = F.when(a_ends, put(a, F.when(to_a, F.lit(1.0)).otherwise(F.lit(0.0)))).otherwise(put(b, F.when(to_a, F.lit(0.0)).otherwise(F.lit(1.0))))
        still = F.when(a_ends, put(b, held(b["p"] - moved / b["mass"]))).otherwise(put(a, held(a["p"] + moved / a["mass"])))
        return F.when(a.isNull(), F.struct(acc["done"].alias("done"), b.alias("open"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(ended)).alias("done"), still.alias("open"))
        )

    return F.aggregate(units, empty, step)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = 64, salts: int = 32, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken."""
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    d = save(d.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    sizes = d.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    t = save(targets(sizes, weights, most), "mix-targets")
    u = _join(d, t, salts)
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = u.withColumn("base", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio)).withColumn("mass", (F.col("size") * F.col("rows")).cast("double"))
    u = u.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.greatest(F.col("n"), F.lit(1)) / block)))
    unit = F.struct("id", "mass", "p", "base", F.col("rows").alias("copies"), "source", "size", "source_size", "target")
    u = u.select("source", "block", unit.alias("u"))
    kind = u.schema["u"].dataType.simpleString()
    whole, level = u.where(F.col("u.p") <= 0).select("u"), u.where(F.col("u.p") > 0)
    out = [whole]
    most_docs = t.agg(F.max("n")).first()[0] or 0
    blocks = -(-most_docs // block)
    while True:
        g = level.groupBy("source", "block").agg(F.sort_array(F.collect_list("u")).alias("us")).select("source", "block", _fold(F.col("us"), kind, seed).alias("f"))
        g = save(g, "mix-level")
        out.append(g.select(F.explode("f.done").alias("u")))
        level = g.where(F.col("f.open").isNotNull()).select("source", F.floor(F.col("block") / block).alias("block"), F.col("f.open").alias("u"))
        if blocks <= 1:
            last = level.select("u").withColumn("u", F.col("u").withField("p", F.when(_draw(F.col("u.id"), F.col("u.id"), seed) < F.col("u.p"), 1.0).otherwise(0.0)))
            out.append(last)
            break
        blocks = -(-blocks // block)
    done = out[0]
    for x in out[1:]:
        done = done.unionByName(x)
    copies = (F.col("u.base") + F.col("u.p")).cast("long")
    done = done.select(
        F.col("u.id").alias("doc_id"), F.col("u.source").alias("source"), F.col("u.size").alias("size"), F.col("u.source_size").alias("source_size"),
        F.col("u.target").alias("target"), copies.alias("copies"), (copies * F.col("u.size")).alias("taken"), F.explode(F.array_repeat(F.lit(1), F.col("u.copies").cast("int"))).alias("row"),
    )
    return done.drop("row")


def _join(d: DataFrame, t: DataFrame, salts: int) -> DataFrame:
    """d with its source's row. A null source is told apart by a flag; the source's row goes to every salt, so a hot source is joined in many tasks."""
    key = lambda c: [F.coalesce(F.col(c), F.lit("")).alias("k"), F.col(c).isNull().alias("k_null")]
    left = d.select("*", *key("source"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    right = t.select(*key("source"), "source_size", "n", "target", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return left.join(right, ["k", "k_null", "salt"]).drop("k", "k_null", "salt")


def op1(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
