"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a predicate that rejects a text. Its cost (seconds a row) and selectivity (share of
rows it rejects) are measured on a sample; the rules are then tried in the order of rejections
per cost, and a text is dropped by the first that rejects it: later rules are not evaluated. The
order changes the time only, never the verdict, since a text is kept if no rule rejects it.

Defined results: a null or blank text has no words and fails the base rule; repeated rows are
judged one by one; very long texts are taken whole; an empty table gives no rows (the rules then keep their listed order). Other
columns of the input are ignored.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import read, save

_SPACE = "[ \\t-\\r]"
WINDOW = 5


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the counts that rules use. All of it is computed within the row, over the whole text.

    Windows found twice are looked for by 64-bit hash: an array of distinct hashes settles most
    texts in linear time, only the rest are sorted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumns({
        "words": F.filter(F.split(text, _SPACE + "+"), lambda w: w != ""),
        "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
    })
    n = F.size("words")
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    d = d.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "grams": F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), window)).otherwise(F.array().cast("array<long>")),
    }).drop("words", "lines")
    some = F.size(F.array_distinct("grams")) < F.size("grams")
    pairs = F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("sorted", F.when(some, pairs)).drop("grams")
    again = F.filter("sorted", lambda x, k: (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"]))
    at = F.sort_array(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])
    # always the value: a row's number keeps later filters above this step, where they do not make the arrays anew for every element
    return d.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, F.coalesce(covered, F.lit(0).cast("long")))).drop("sorted")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Predicates over :func:`measures` that reject a text. None depends on a language's words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda kind: F.length(F.regexp_replace(text, f"[^{kind}]+", ""))
    return {
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "repeated_lines": 10 * F.col("n_dup_lines") > 5 * F.col("n_lines"),
        "shouting": 2 * count("\\p{Lu}") > count("\\p{L}"),
        "exclaiming": 5 * count("!?") > F.col("n_words"),
        "few_letters": 10 * count("\\p{L}") < 4 * F.col("word_chars"),
        "bullets": 10 * F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike("^[ \\t]*[-*•>]"))) > 9 * F.col("n_lines"),
        "cut_lines": 10 * F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike("(\\.\\.\\.|…)[ \\t\\r]*$"))) > 3 * F.col("n_lines"),
    }


def order_rules(measured: DataFrame, named: dict[str, Column]) -> list[str]:
    """Names by rejections per second on a (bounded) measured sample, most first; ties keep the listed order. A rule's seconds are those beyond a rule that rejects nothing."""

    def judge(rule: Column) -> tuple[float, float]:
        began = time.perf_counter()
        row = measured.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(rule, 1)).alias("hit")).first()
        return time.perf_counter() - began, row["hit"] / row["n"] if row["n"] else 0.0

    judge(F.col("n_words") < 0)  # the first job pays for reading and compiling
    launch = min(judge(F.col("n_words") < -i)[0] for i in (1, 2))
    gain = {}
    for name, rule in named.items():
        seconds, share = judge(rule)
        gain[name] = share / max(seconds - launch, 1e-3)
    return sorted(named, key=lambda k: -gain[k])


def cascade(measured: DataFrame, order: list[str], named: dict[str, Column]) -> DataFrame:
    """Adds base_failed, reason (first rule that rejects, null if none; null for base failures) and kept."""
    first = None
    for name in order:
        hit = F.coalesce(named[name], F.lit(False))
        first = F.when(hit, F.lit(name)) if first is None else first.when(hit, F.lit(name))
    reason = F.when(~base_failed(), first) if first is not None else F.lit(None).cast("string")
    return measured.withColumn("base_failed", base_failed()).withColumn("reason", reason).withColumn("kept", ~F.col("base_failed") & F.col("reason").isNull())


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000, seed: int = 11) -> DataFrame:
    """Judge every text. ``sample_rows``: about so many rows, whatever the input's size, for cost and selectivity."""
    named = rules()
    total = docs.select(F.count(F.lit(1))).first()[0]
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).sample(False, min(1.0, sample_rows / max(total, 1)), seed)
    return cascade(measures(docs, id_col, text_col), order_rules(save(measures(few), "rule-sample"), named), named)


def op8(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
with d as (
  select doc_id, coalesce(text,'') as text,
    list_filter(regexp_split_to_array(coalesce(text,''), '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') as words,
    list_filter(string_split(coalesce(text,''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) as lines
  from documents
), g as (
  select doc_id, i, list_slice(words, i, i + 4) as gram from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from d where len(words) >= 5)
), r as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g) where n > 1
), c as (
  select doc_id, count(distinct i + k)::bigint as n_repeat_words from r, range(0, 5) o(k) group by doc_id
), m as (
  select d.doc_id, text, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join c using (doc_id)
), v as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    word_chars < 2 * n_words or word_chars > 20 * n_words or 10 * n_symbols > n_words or 10 * n_dup_lines > 5 * n_lines
    or 2 * length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(text, '[^\p{L}]+', '', 'g'))
    or 5 * length(regexp_replace(text, '[^!?]+', '', 'g')) > n_words
    or 10 * length(regexp_replace(text, '[^\p{L}]+', '', 'g')) < 4 * word_chars
    or 10 * len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*•>]'))) > 9 * n_lines
    or 10 * len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) > 3 * n_lines as hit
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not hit as kept from v
"""
