"""Benchmark decontamination by item-sized windows, in DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are runs of ``K`` words (all words of
a shorter item), by 64-bit hash, and a shingle weighs as often as it occurs.

1. A window can only reach the threshold if nearly all its shingles occur in items of its length.
   So a text's shingles are looked up in the benchmark's, and windows of the items' lengths are laid
   at every position where enough of them are inside; the others are given up (this loses nothing).
2. Every window left and every item has a 64-bit SimHash of its weighted shingles. Fingerprints that differ in
   at most ``RADIUS`` = 23 bits agree in one of 8 blocks up to 2 bits, so the items are filed by
   (length, block, value) under all values within 2 bits, and a window meets all items of its
   length within the radius by one equality join.
3. These pairs are verified by the exact weighted similarity: sum of the lesser weights over sum of
   the greater weights, at least ``threshold``. Of equally similar windows those where a shared
   shingle stands at its own place in the item come first, then the first in the text.

A pair of similarity 0.8 lies beyond the radius with a probability of about 1e-5 (simulated, 9 to 90
shingles; 15 bits would lose 2 %, with which the blocks would prune more).

The benchmark's shingles are broadcast only if their counted number allows it; else the lookup is
a shuffled join, which AQE splits where a shingle is hot.

Defined results: null or wordless texts and items match nothing; equal items match each by itself;
rows with equal ids are examined one by one and reported together; very long texts are taken whole; a null id is reported as null;
an empty table on either side gives no rows. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import bounded
from .runtime import read, save

K, RADIUS, BITS = 5, 23, 8
#: Bits in which a block may differ: within the radius one of the 64 / BITS blocks differs in no more.
SLACK = RADIUS // (64 // BITS)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _grams(words: str, k: int) -> Column:
    n = F.size(words)
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), at)).otherwise(F.array().cast("array<long>"))


def simhash(grams: str) -> Column:
    """64 bits: bit b is set if more than half of the shingles (by weight) have it."""
    ones = f"aggregate({grams}, 0, (n, g) -> n + cast(shiftrightunsigned(g, b) & 1L as int))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (p, b) -> p | if(2 * {ones} > size({grams}), shiftleft(1L, b), 0L))")


def _block(x: Column, b: Column) -> Column:
    """The block number ``b`` of a fingerprint, by name: the place of the shift has to be a literal."""
    parts = [F.shiftrightunsigned(x, k * BITS).bitwiseAND(F.lit((1 << BITS) - 1)) for k in range(64 // BITS)]
    return F.element_at(F.array(*parts), b + 1)


def weighted_similarity(a: Column, b: Column) -> Column:
    """Multiset Jaccard of two arrays of shingles."""
    times = lambda xs, d: F.size(F.filter(xs, lambda x: x == d))
    single = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    both = F.array_intersect(a, b)
    common = F.when(single, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda n, d: n + F.least(times(a, d), times(b, d))))
    return common / (F.size(a) + F.size(b) - common)


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, similarity, start_word, n_words (the best window; of equals an aligned one, then the first)."""
    items = benchmark.select(F.col(item_col).alias("item_id"), _words(F.col(item_text)).alias("words")).withColumn("len", F.size("words")).where("len > 0")
    items = save(items, "items")
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    found = None
    for k in sorted(r["k"] for r in items.select(F.least("len", F.lit(K)).alias("k")).distinct().collect()):  # at most K sizes
        one = _find(d, items.where(F.least("len", F.lit(K)) == k), k, threshold)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return d.select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words")).where("false")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "aligned", (-F.col("s")).alias("s"), "n_words")).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.s")).alias("start_word"), F.col("best.n_words").alias("n_words"))


def _find(d: DataFrame, items: DataFrame, k: int, threshold: float) -> DataFrame:
    items = save(items.withColumn("grams", _grams("words", k)).drop("words").dropDuplicates(["item_id", "grams"]), "items")
    m = F.col("len") - (k - 1)
    places = items.select("len", F.explode("grams").alias("g")).groupBy("g").agg(F.collect_set("len").alias("lens"))
    shingled = lambda t, *more: t.withColumn("words", _words(F.col("text"))).select("doc_id", "row", _grams("words", k).alias("grams"), *more)
    # outer: otherwise a filter on the array would be inferred and pushed below, where it makes the words anew for every shingle
    hits = shingled(d).select("doc_id", "row", F.posexplode_outer("grams").alias("pos", "g")).join(bounded(save(places, "places")), "g")
    hits = hits.select("doc_id", "row", "pos", F.explode("lens").alias("len")).groupBy("doc_id", "row", "len").agg(F.array_sort(F.collect_set("pos")).alias("found"))
    hits = hits.groupBy("doc_id", "row").agg(F.collect_list(F.struct("len", "found")).alias("hits"))
    hits = save(hits.withColumnRenamed("doc_id", "id"), "hits")
    text = d.join(bounded(hits), (d["row"] == hits["row"]) & d["doc_id"].eqNullSafe(hits["id"])).select("doc_id", d["row"], "text", "hits").dropDuplicates(["doc_id", "row"])
    text = save(shingled(text, "hits"), "hit-texts").select("doc_id", "row", "grams", F.explode("hits").alias("h"))
    text = text.select("doc_id", "row", "grams", "h.len", "h.found").withColumn("size", F.least(m, F.size("grams")))
    text = text.withColumn("needed", F.greatest(F.lit(1), F.ceil(threshold / (1 + threshold) * (F.col("size") + m) - 1e-9).cast("int")))  # of size + size, as similarity = shared / (sum - shared)
    # needed places in a row fit into the windows from the last's end back to the first
    low = lambda i: F.greatest(F.lit(0), F.get("found", i + F.col("needed") - 1) - F.col("size") + 1)
    high = lambda i: F.least(F.get("found", i), F.size("grams") - F.col("size"))
    runs = F.sequence(F.lit(0), F.size("found") - F.col("needed"))
    laid = F.transform(F.filter(runs, lambda i: low(i) <= high(i)), lambda i: F.sequence(low(i), high(i)))
    w = text.where(F.size("found") >= F.col("needed")).select("doc_id", "row", "grams", "len", "size", F.explode(F.array_distinct(F.flatten(laid))).alias("s"))
    w = w.select("doc_id", "row", "s", "len", F.size("grams").alias("n"), F.slice("grams", F.col("s") + 1, F.col("size")).alias("grams"))
    w = save(w, "windows")
    blocks = F.sequence(F.lit(0), F.lit(64 // BITS - 1))
    index = items.select("item_id", "len", simhash("grams").alias("item_print")).distinct().withColumn("block", F.explode(blocks))
    index = index.withColumn("value", F.explode(F.array(*[_block(F.col("item_print"), F.col("block")).bitwiseXOR(F.lit(x)) for x in range(1 << BITS) if x.bit_count() <= SLACK])))
    w = w.withColumn("print", simhash("grams"))
    near = w.withColumn("block", F.explode(blocks)).withColumn("value", _block(F.col("print"), F.col("block"))).join(bounded(save(index, "index")), ["len", "block", "value"])
    near = near.withColumn("x", F.col("print").bitwiseXOR(F.col("item_print"))).where(F.bit_count("x") <= RADIUS)
    # a pair that agrees in several blocks counts in the first
    near = near.where(f"aggregate(sequence(0, {64 // BITS - 1}), {64 // BITS}, (m, b) -> least(m, if(bit_count(shiftrightunsigned(x, b * {BITS}) & {(1 << BITS) - 1}L) <= {SLACK}, b, m))) = block")
    texts = items.select("item_id", "len", F.col("grams").alias("item_grams"))
    near = near.drop("block", "value", "print", "item_print", "x").join(bounded(texts), ["item_id", "len"])
    near = near.withColumn("similarity", weighted_similarity(F.col("grams"), F.col("item_grams"))).where(F.col("similarity") >= threshold)
    i = F.sequence(F.lit(0), F.size("grams") - 1)
    last = F.col("n") - F.size("grams")
    aligned = F.exists(i, lambda x: (F.get("grams", x) == F.get("item_grams", x)) | ((F.col("s") == 0) & F.array_contains(F.slice("item_grams", x + 1, F.size("item_grams")), F.get("grams", x))) | ((F.col("s") == last) & F.array_contains(F.slice("item_grams", F.lit(1), x + 1), F.get("grams", x))))
    return near.select("doc_id", "item_id", "similarity", "s", (F.size("grams") + k - 1).alias("n_words"), aligned.alias("aligned"))


def op9(spark, sf_dir: str) -> DataFrame:
    return find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from documents where text is not null),
b as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from benchmark where text is not null),
dg as (select doc_id, len(w) as n, i - 1 as pos, array_to_string(list_slice(w, i, i + 4), ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
bg as (select item_id, len(w) as len, i - 1 as off, array_to_string(list_slice(w, i, i + 4), ' ') as g from (select item_id, w, unnest(range(1, len(w) - 3)) as i from b where len(w) >= 5)),
win as (select distinct doc_id, item_id, len, greatest(0, least(pos - off, n - len)) as s from dg join bg using (g)),
wg as (select win.doc_id, win.item_id, win.len, win.s, g, count(*) as c from win join dg on dg.doc_id = win.doc_id and dg.pos >= win.s and dg.pos < win.s + win.len - 4 group by all),
ig as (select item_id, g, count(*) as c from bg group by all),
sim as (
  select doc_id, wg.item_id, s, len, sum(wg.c) as n, coalesce(sum(least(wg.c, ig.c)), 0) as shared from wg left join ig on ig.item_id = wg.item_id and ig.g = wg.g group by 1, 2, 3, 4
), v as (select *, shared::double / (n + len - 4 - shared)::double as similarity from sim)
select doc_id, item_id, similarity, s::int as start_word, (n + 4)::int as n_words from v where similarity >= 0.8
qualify row_number() over (partition by doc_id, item_id order by similarity desc, s, n desc) = 1
"""
