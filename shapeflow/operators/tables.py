"""Contingency, ranking and summary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeflow.operators.evaluation import hashed

#: Category names and their abbreviations: fixed values of the data format.
CATEGORIES = {
    "Autos&amp;Vehicles": "Vehi.",
    "Autos": "Vehi.",
    "Comedy": "Com.",
    "Education": "Edu.",
    "Entertainment": "Ent.",
    "Film": "Film",
    "Film&amp;Animation": "Film",
    "Games": "Game",
    "Gaming": "Game",
    "Howto": "Howto",
    "Howto&amp;Style": "Howto",
    "Movies": "Film",
    "Music": "Music",
    "NULL": "-",
    "News": "News",
    "News&amp;Politics": "News",
    "Nonprofit": "Nonprof.",
    "Nonprofits&amp;Activism": "Nonprof.",
    "People&amp;Blogs": "People",
    "People": "People",
    "Pets&amp;Animals": "Pets",
    "Pets": "Pets",
    "Animals": "Pets",
    "Science&amp;Technology": "Sci.",
    "Science": "Sci.",
    "Tech": "Sci.",
    "Shows": "Show",
    "Sports": "Sport",
    "Trailers": "Film",
    "Travel&amp;Events": "Travel",
    "Travel": "Travel",
}

#: Referrers and their abbreviations: fixed values of the data format.
REFERRERS = {"EXTERNAL": "EXT.", "FEATURED": "FEAT.", "INTERNAL": "INT.", "MOBILE": "MOBI.", "SEARCH": "SEAR.", "SOCIAL": "SOC.", "VIRAL": "VIR."}


def translate(df: DataFrame, column: str, table: dict[str, str] | None = None) -> DataFrame:
    """Replaces a category by its abbreviation; null is "NULL", an unknown one stays."""
    items = [F.lit(x) for kv in (table or CATEGORIES).items() for x in kv]
    c = F.coalesce(F.col(column), F.lit("NULL"))
    return df.withColumn(column, F.coalesce(F.create_map(*items)[c], c))


def share(df: DataFrame, cls: str, label: str, weight: Column | None = None) -> DataFrame:
    """(cls, label, n, share): (weighted) counts of labels within classes; only positive weights count."""
    w = F.lit(1) if weight is None else F.when(weight > 0, weight)
    g = df.groupBy(cls, label).agg(F.sum(w).alias("n")).where("n is not null")
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(cls)))


def top_labels(shares: DataFrame, cls: str, label: str, k: int = 4) -> DataFrame:
    """The k labels of the largest shares (rounded; ties by label) of each class."""
    w = Window.partitionBy(cls).orderBy(F.round("share", 9).desc(), label)
    return shares.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unpivot_share(df: DataFrame, cls: str, columns: list[str], total: str, names: dict[str, str] | None = None) -> DataFrame:
    """Share of each column's sum in the sum of ``total`` by class; only positive values count. ``names``: labels for columns, such as REFERRERS."""
    stack = ", ".join(f"'{(names or {}).get(c, c)}', `{c}`" for c in columns)
    d = df.select(cls, F.expr(f"stack({len(columns)}, {stack}) as (label, v)")).groupBy(cls, "label").agg(F.sum(F.when(F.col("v") > 0, F.col("v"))).alias("v"))
    t = df.groupBy(cls).agg(F.sum(total).alias("t"))
    return d.join(t, cls).select(cls, "label", F.try_divide("v", "t").alias("share")).where("share is not null")


#: Values that may become columns, at most.
MOST_COLUMNS = 1_000


def one_hot(df: DataFrame, column: str, prefix: str = "", values: list[str] | None = None) -> DataFrame:
    """A 0/1 column for every value, in sorted order. ``values``: the known ones; else they are looked up, MOST_COLUMNS at most."""
    if values is None:
        found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect()]
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"{column} has more than {MOST_COLUMNS} values")
        values = sorted(found)
    return df.select("*", *[F.when(F.col(column) == v, 1).otherwise(0).alias(f"{prefix}{v}") for v in values])


def category_columns(df: DataFrame, column: str, prefix: str = "") -> tuple[DataFrame, list[str]]:
    """A category by the built-in table as 0/1 columns in the order of the sorted abbreviations, and their names; an unknown category is 0 throughout."""
    values = sorted(set(CATEGORIES.values()))
    return one_hot(translate(df, column), column, prefix, values).drop(column), [f"{prefix}{v}" for v in values]


def assemble(tables: list[tuple[DataFrame, str]], id_col: str = "series_id", keep: dict[str, list[str]] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """One feature table of several (table, name), joined by id, and the place of each column. ``keep``: the columns wanted of a table by its name; else all."""
    out, places = None, {}
    for df, name in tables:
        own = [c for c in df.columns if c != id_col and (not keep or name not in keep or c in keep[name])]
        out = df.select(id_col, *own) if out is None else out.join(df.select(id_col, *own), id_col)
        places |= {c: len(places) + i for i, c in enumerate(own)}
    return out, places


def trend_table(series: DataFrame, clusters: DataFrame, features: DataFrame) -> DataFrame:
    """Features with the series' cluster as TREND and its total as FINAL_VIEWS."""
    total = series.select("series_id", F.expr("aggregate(x, 0D, (a, v) -> a + v)").alias("FINAL_VIEWS"))
    return features.join(clusters.select("series_id", F.col("cluster").alias("TREND")), "series_id").join(total, "series_id")


def rollup_means(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Means by group and in total (group null)."""
    return df.rollup(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def ratio_summary(df: DataFrame, num: str, den: str) -> DataFrame:
    """Mean, population deviation, quartile .25 and median (linear) of a ratio; rows with den = 0 are left out."""
    r = F.try_divide(num, den)
    return df.select(r.alias("r")).where("r is not null").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.percentile("r", 0.25).alias("q25"), F.percentile("r", 0.5).alias("median"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, n) of equal width from the least to the greatest value; the last bin is closed."""
    c = F.col(column)
    d = df.where(c.isNotNull()).join(F.broadcast(df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))), F.lit(True))
    b = F.when(F.expr("_lo = _hi"), F.lit(1)).otherwise(F.least(F.floor((c - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1, F.lit(bins))).cast("int")
    return d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def time_to(df: DataFrame, cls: str, start: str, ends: list[str]) -> DataFrame:
    """Mean and population deviation of end - start, by class, over rows where the end is positive."""
    diff = lambda e: F.when(F.col(e) > 0, F.col(e) - F.col(start))
    return df.groupBy(cls).agg(*[f(diff(e)).alias(f"{e}_{n}") for e in ends for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def sample(df: DataFrame, n: int, seed: int = 0, by: str | None = None, id_col: str = "series_id") -> DataFrame:
    """n rows (of each group) with the least hash of the id: the same at every run. A task keeps n rows of each group before anything is shuffled."""
    d = df.withColumn("_h", hashed(id_col, seed))
    if by is None:
        return d.orderBy("_h", id_col).limit(n).drop("_h")
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_h", id_col))).where(F.col("_r") <= n).drop("_r", "_h")


def dense_labels(df: DataFrame, column: str, out: str = "index") -> DataFrame:
    """Labels numbered from 0 in sorted order; the distinct labels are a small table."""
    d = df.select(F.col(column).alias("_l")).distinct()
    d = d.withColumn(out, (F.dense_rank().over(Window.orderBy("_l")) - 1).cast("int"))
    return df.join(d, F.col(column) == F.col("_l")).drop("_l")
