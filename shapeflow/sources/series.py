"""Building, reading and writing series tables: (series_id, x array<double>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many buckets a series is built by one aggregation with a column a bucket.
WIDE = 128


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def build(df: DataFrame, series_id: str, bucket: Column, length: int, value: Column | None = None) -> DataFrame:
    """Dense series: sum of ``value`` (default: count) by bucket 0 .. length - 1, 0.0 where there is none.

    One shuffle of partial sums for short series; long ones are summed by (id, bucket) first.
    """
    v = F.lit(1.0) if value is None else value.cast("double")
    d = df.select(F.col(series_id).alias("series_id"), bucket.cast("int").alias("b"), v.alias("v"))
    if length <= WIDE:
        sums = [F.coalesce(F.sum(F.when(F.col("b") == i, F.col("v"))), F.lit(0.0)) for i in range(length)]
        return d.groupBy("series_id").agg(F.array(*sums).alias("x"))
    g = d.groupBy("series_id", "b").agg(F.sum("v").alias("v")).groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"))
    return g.select("series_id", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("x"))


def user_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by hour of day, 24 points."""
    return build(read(spark, sf_dir, "events"), "user_id", F.hour("ts"), 24)


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by day from 2024-01-01, 30 points."""
    return build(read(spark, sf_dir, "events"), "user_id", F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")), 30)


def supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity of each supplier by month of shipping from 1995-01, 83 points."""
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    return build(read(spark, sf_dir, "lineitem"), "l_suppkey", month, 83, F.col("l_quantity"))


def load_series(spark: SparkSession, path: str, mask: DataFrame | None = None, epsilon: float = 1e-6, zero_rows_only: bool = False) -> DataFrame:
    """White-space text "id v1 ... vT"; ``mask``: (series_id, keep). ``epsilon`` is added to every point (of all-zero series only, if so asked)."""
    d = _load_series(spark, path, 0.0 if zero_rows_only else epsilon)
    if zero_rows_only:
        d = d.withColumn("x", F.when(F.forall("x", lambda v: v == 0), F.transform("x", lambda v: v + epsilon)).otherwise(F.col("x")))
    return d if mask is None else d.join(mask.where("keep").select("series_id"), "series_id", "left_semi")


def _load_series(spark: SparkSession, path: str, epsilon: float) -> DataFrame:
    parts = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')").select(
        parts[0].cast("double").cast("long").alias("series_id"),
        F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda v: v.try_cast("double") + epsilon).alias("x"),
    )


def load_lines(spark: SparkSession, path: str, name: str = "cluster") -> DataFrame:
    """White-space text of one value a line: (row, value), row is the line's number from 0 in the order of the files."""
    rows = spark.read.text(path).rdd.zipWithIndex().map(lambda p: (p[1], p[0][0]))  # the order of lines has no column form
    return spark.createDataFrame(rows, "row long, value string").where("trim(value) <> ''").select("row", F.trim("value").cast("double").cast("int").alias(name))


def load_tokens(spark: SparkSession, path: str) -> DataFrame:
    """White-space text "id user category tag...": (series_id, user, category, tags)."""
    parts = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(
        parts[0].cast("long").alias("series_id"), F.get(parts, 1).alias("user"), F.get(parts, 2).alias("category"), F.slice(parts, 4, 2147483647).alias("tags")
    )


def load_columns(spark: SparkSession, path: str, names: list[str], first: int = 1) -> DataFrame:
    """White-space text "id v1 v2 ...": the id and ``len(names)`` values from the column ``first`` on, such as referrers' weights at a fixed offset."""
    parts = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')").select(
        parts[0].cast("double").cast("long").alias("series_id"), *[F.get(parts, first + i).try_cast("double").alias(n) for i, n in enumerate(names)]
    )


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    """White-space text of integer pairs "from to", such as clusters and their labels; joined to a table by ``from``."""
    parts = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].cast("int").alias("from"), parts[1].cast("int").alias("to"))


def load_vector(spark: SparkSession, path: str, name: str = "cluster") -> DataFrame:
    """White-space text "id value"."""
    parts = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].cast("long").alias("series_id"), parts[1].cast("double").cast("int").alias(name))


def load_features(spark: SparkSession, path: str) -> DataFrame | None:
    """White-space text with a "#" header line of names; None without one. The first column is the id."""
    lines = spark.read.text(path)
    head = lines.where("startswith(ltrim(value), '#')").first()
    if head is None:
        return None
    names = head["value"].lstrip("# \t").split()
    parts = F.split(F.trim("value"), "\\s+")
    return lines.where("trim(value) <> '' and not startswith(ltrim(value), '#')").select(
        parts[0].cast("long").alias("series_id"), *[F.get(parts, i).try_cast("double").alias(n) for i, n in enumerate(names) if i]
    )


def write_matrix(df: DataFrame, path: str, digits: int = 5) -> None:
    """Series as white-space text "id v1 ... vT", rounded."""
    line = F.concat_ws(" ", F.col("series_id").cast("string"), F.array_join(F.transform("x", lambda v: F.format_string(f"%.{digits}f", v)), " "))
    df.select(line.alias("value")).write.text(path)


def write_rows(df: DataFrame, path: str, digits: int = 5) -> None:
    """Any table as white-space text, columns in order, numbers with ``digits`` places and arrays spread out: probabilities, assignments, masks."""

    def text(f):
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        number = lambda v: F.format_string(f"%.{digits}f", v.cast("double"))
        if kind.startswith("array"):
            return F.array_join(F.transform(c, number), " ")
        return number(c) if kind in ("double", "float") else c.cast("string")

    df.select(F.concat_ws(" ", *[text(f) for f in df.schema]).alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Features with a header."""
    df.write.csv(path, header=True)


def points(df: DataFrame, n: int) -> DataFrame:
    """The first n points as columns POINT_0 .. ."""
    return df.select("series_id", *[F.get("x", i).alias(f"POINT_{i}") for i in range(n)])
