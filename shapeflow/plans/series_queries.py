"""Queries on series, distances, clusters and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from shapeflow.functions import series as S
from shapeflow.operators import clustering, quality
from shapeflow.plans import sqltext as Q
from shapeflow.sources import series as src

K = 3
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, points: str | None = None):
    """Registers a query. ``points``: an array column of both results, compared as rows (i, v)."""

    def add(f):
        def rows(spark, d):
            df = f(spark, d)
            return df.select(*[c for c in df.columns if c != points], F.posexplode(points).alias("i", "v"))

        QUERIES[name] = rows if points else f
        if sql is not None:
            SQL[name] = f"select * exclude ({points}, i), (i - 1)::int as i from (select *, unnest({points}) as v, generate_subscripts({points}, 1) as i from ({sql}))" if points else sql
        return f

    return add


def _r(c: str, name: str):
    return (F.round(F.expr(c), 6) + F.lit(0.0)).alias(name)


# ---- builders and kernels -------------------------------------------------------------------

for _name, _build, _cte in (("user_hour", src.user_hour, Q.USER_HOUR), ("user_day", src.user_day, Q.USER_DAY), ("supplier_month", src.supplier_month, Q.SUPP_MONTH)):
    query(f"series_{_name}", f"with {_cte} select series_id, x from {_name}", "x")(_build)
query("load_series_epsilon", f"with {Q.USER_HOUR} select series_id, {Q.rounded('list_transform(x, lambda v: v + 1e-6)')} as x from user_hour where series_id % 2 = 0", "x")(
    lambda s, d: src.user_hour(s, d).where("series_id % 2 = 0").select("series_id", S.col(S.rounded("transform(x, v -> v + 1e-6D)")).alias("x"))
)


def _kernel(name: str, spark_expr: str, duck_expr: str, out: str = "x"):
    query(name, f"with {Q.USER_HOUR} select series_id, {duck_expr} as {out} from user_hour", "x" if out == "x" else None)(lambda s, d: src.user_hour(s, d).select("series_id", S.col(spark_expr).alias(out)))


_q, _qd = "cast(series_id % 61 - 30 as int)", "(series_id % 61 - 30)"
_kernel("shift_roll", S.roll("x", _q), Q.roll("x", _qd))
_kernel("shift_drop", S.drop("x", _q), Q.drop("x", _qd))
_kernel("sqsum", S.sqsum("x"), Q.dot("x", "x"), "v")
_kernel("norm", f"round({S.norm('x')}, 6)", f"round(sqrt({Q.dot('x', 'x')}), 6)", "v")
_kernel("peak_center", S.center_peak("x"), Q.roll("x", "12 - (list_position(x, list_max(x)) - 1)"))
_kernel("min_first", S.min_first("x"), Q.roll("x", "-(list_position(x, list_min(x)) - 1)"))
_kernel("peak_place", S.argmax("x"), "(list_position(x, list_max(x)) - 1)::int", "peak")
_kernel("total_views", S.total("x"), "list_sum(x)", "total")
_kernel("row_normalise", S.rounded(S.scale("x", S.norm("x"))), Q.rounded("list_transform(x, lambda v: v / sqrt(list_dot_product(x, x)))"))
_kernel("prefix_points", "slice(x, 1, 7)", "list_slice(x, 1, 7)")

_WAVE = "list_transform(range(0, (len({0}) + 1) // 2), lambda i: ({0}[2 * i + 1] {1} coalesce({0}[2 * i + 2], 0)) / 2)"


def haar_forward(spark, d):
    return src.supplier_month(spark, d).select("series_id", S.col(S.haar("x")).alias("h")).select("series_id", "h.wavelet", "h.coefficient")


for _part, _sign in (("wavelet", "+"), ("coefficient", "-")):
    query(f"haar_forward_{_part}", f"with {Q.SUPP_MONTH} select series_id, {_WAVE.format('x', _sign)} as {_part} from supplier_month", _part)(lambda s, d, p=_part: haar_forward(s, d).select("series_id", p))


@query("haar_inverse", f"with {Q.SUPP_MONTH} select series_id, x from supplier_month", "x")
def haar_inverse(spark, d):
    return haar_forward(spark, d).select("series_id", S.col(S.haar_inverse("wavelet", "coefficient", "83")).alias("x"))


@query("haar_pyramid", f"with {Q.SUPP_MONTH}, a as (select series_id, x as x0, {_WAVE.format('x', '+')} as x1 from supplier_month) select series_id, {_WAVE.format('x1', '+')} as x2 from a", "x2")
def haar_pyramid(spark, d):
    p = src.supplier_month(spark, d).withColumnRenamed("x", "x0").withColumn("x1", S.col(S.haar("x0") + ".wavelet"))
    return p.withColumn("x2", S.col(S.haar("x1") + ".wavelet")).select("series_id", "x2")


# ---- pairs ----------------------------------------------------------------------------------

_QUERIES = "select series_id, x from user_hour where series_id % 20 = 0"


def _some_pairs(spark, d):
    """A stated query set, every series whose id is divisible by 20, against all series."""
    u = src.user_hour(spark, d)
    return u.where("series_id % 20 = 0").select(F.col("series_id").alias("id1"), F.col("x").alias("a")).join(u.select(F.col("series_id").alias("id2"), F.col("x").alias("b")), F.lit(True))


_PAIRS = f"with {Q.USER_HOUR}, p as (select a.series_id as id1, b.series_id as id2, a.x as a, b.x as b from ({_QUERIES}) a, user_hour b)"
query("inner_prod", f"{_PAIRS} select id1, id2, list_dot_product(a, b) as v from p")(lambda s, d: _some_pairs(s, d).select("id1", "id2", S.col(S.dot("a", "b")).alias("v")))


def _fixed(rolling: bool) -> str:
    y = (Q.roll if rolling else Q.drop)("b", "(id2 % 7 - 3)")
    return f"""{_PAIRS}, s as (select *, {y} as y from p), t as (select *, case when list_dot_product(y, y) = 0 then 0 else list_dot_product(a, y) / list_dot_product(y, y) end as al from s)
select id1, id2, round(sqrt(list_sum(list_transform(list_zip(a, y), lambda z: pow(z[1] - al * z[2], 2)))) / sqrt(list_dot_product(a, a)), 6) + 0.0 as dist from t"""


for _rolling in (True, False):
    query(f"shift_dist_{'roll' if _rolling else 'drop'}", _fixed(_rolling))(
        lambda s, d, r=_rolling: _some_pairs(s, d).select("id1", "id2", _r(S.shift_dist("a", "b", "cast(id2 % 7 - 3 as int)", r), "dist"))
    )
_EVERY = f"with {Q.USER_HOUR}, p as (select a.series_id as id1, b.series_id as id2, a.x as a, b.x as b from user_hour a, user_hour b)"
query("dist_roll_struct", f"{_EVERY} select id1, id2, round({Q.roll_dist('a', 'b', '24')}, 6) + 0.0 as dist from p")(
    lambda s, d: clustering.distances_of_all(src.user_hour(s, d), digits=6)
)
_DROP_GAIN = """list_max(list_transform(range(-23, 24), lambda q: case when q >= 0 then coalesce(pow(list_dot_product(list_slice(a, q + 1, 24), list_slice(b, 1, 24 - q)), 2) / nullif(list_dot_product(list_slice(b, 1, 24 - q), list_slice(b, 1, 24 - q)), 0), 0)
 else coalesce(pow(list_dot_product(list_slice(a, 1, 24 + q), list_slice(b, 1 - q, 24)), 2) / nullif(list_dot_product(list_slice(b, 1 - q, 24), list_slice(b, 1 - q, 24)), 0), 0) end))"""
query("dist_drop_pairs", f"{_PAIRS} select id1, id2, round(sqrt(greatest(0.0, 1 - {_DROP_GAIN} / list_dot_product(a, a))), 6) + 0.0 as dist from p")(
    lambda s, d: clustering.drop_distances((u := src.user_hour(s, d)).where("series_id % 20 = 0"), u).select("id1", "id2", _r("dist", "dist"))
)
query("dist_drop_expression", f"{_EVERY} select id1, id2, round(sqrt(greatest(0.0, 1 - {_DROP_GAIN} / list_dot_product(a, a))), 6) + 0.0 as dist from p")(
    lambda s, d: clustering.distances_of_all(src.user_hour(s, d), dropped=True, digits=6)
)


@query("dist_roll_pairs", f"with {Q.USER_HOUR} select a.series_id as id1, b.series_id as id2, case when a.series_id = b.series_id then 0.0 else round({Q.roll_dist('a.x', 'b.x', '24')}, 6) + 0.0 end as dist from user_hour a, user_hour b")
def dist_roll_pairs(spark, d):
    return clustering.distances_of_all(src.user_hour(spark, d), digits=6)


@query("dist_roll_shift", f"with {Q.USER_HOUR} select a.series_id as id1, b.series_id as id2, case when a.series_id = b.series_id then 0 else (list_position(l, list_max(l)) - 24)::int end as shift from (select a.series_id, b.series_id as other, list_transform(range(-23, 1), lambda q: pow(list_dot_product(a.x, list_slice(b.x || b.x, 1 - q, 24 - q)), 2)) as l from user_hour a, user_hour b where a.series_id <= b.series_id) a, lateral (select other as series_id) b")
def dist_roll_shift(spark, d):
    return clustering.pair_distances(src.user_hour(spark, d)).where("id1 <= id2").select("id1", "id2", "shift")


# ---- clusters -------------------------------------------------------------------------------


def _start(spark, d):
    return src.user_hour(spark, d).withColumn("cluster", F.expr(f"cast(series_id % {K} as int)"))


_INIT = f"{Q.USER_HOUR}, s0 as (select series_id, x, (series_id % {K})::int as cluster from user_hour), {Q.centroid_ctes('s0', 24, 'c0')}"


def _nearest(name: str, c: str, out: str) -> str:
    d = f"""{name}_d as (select series_id, x, k.cluster, round({Q.roll_dist('k.c', 'x', '24')}, 9) as d, {Q.roll_dist('k.c', 'x', '24')} as dist,
  (list_position(list_transform(range(-23, 1), lambda q: pow(list_dot_product(k.c, list_slice(x || x, 1 - q, 24 - q)), 2)), {Q.roll_best('k.c', 'x', '24')}) - 24)::int as shift from user_hour, {c} k)"""
    return f"{d}, {out} as (select series_id, x, cluster, dist, shift from {name}_d qualify row_number() over (partition by series_id order by d, cluster) = 1)"


@query("spectral_centroid", f"with recursive {_INIT} select cluster, {Q.rounded('c')} as c from c0", "c")
def spectral_centroid(spark, d):
    return clustering.table(spark, clustering.centroids(_start(spark, d), K)).select("cluster", S.col(S.rounded("c")).alias("c"))


@query("assign_nearest", f"with recursive {_INIT}, {_nearest('n', 'c0', 'a')} select series_id, cluster, round(dist, 6) + 0.0 as dist from a")
def assign_nearest(spark, d):
    return clustering.assign(src.user_hour(spark, d), clustering.centroids(_start(spark, d), K)).select("series_id", "cluster", _r("dist", "dist"))


@query("cost", f"with recursive {_INIT}, {_nearest('n', 'c0', 'a')} select round(avg(dist * dist), 6) as cost from a")
def cost(spark, d):
    return quality.cost(clustering.assign(src.user_hour(spark, d), clustering.centroids(_start(spark, d), K))).select(_r("cost", "cost"))


@query("cluster_sizes", f"with recursive {_INIT}, {_nearest('n', 'c0', 'a')} select cluster, count(*) as n, round(avg(dist * dist), 6) + 0.0 as cost from a group by 1")
def cluster_sizes(spark, d):
    a = clustering.assign(src.user_hour(spark, d), clustering.centroids(_start(spark, d), K))
    return a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), _r("avg(dist * dist)", "cost"))


@query("cluster_ranking", f"with recursive {_INIT}, {_nearest('n', 'c0', 'a')} select series_id, cluster, (row_number() over (partition by series_id order by d, cluster) - 1)::int as rank from n_d")
def cluster_ranking(spark, d):
    a = clustering.assign(src.user_hour(spark, d), clustering.centroids(_start(spark, d), K))
    ranked = F.expr("sort_array(transform(dists, (v, i) -> named_struct('d', round(v, 9), 'i', i)))")
    return a.select("series_id", F.posexplode(ranked).alias("rank", "r")).select("series_id", F.col("r.i").alias("cluster"), "rank")


_ROLLED = f"s1 as (select series_id, {Q.roll('x', 'shift')} as x, cluster from a)"


@query("cluster_iter_fixed", f"with recursive {_INIT}, {_nearest('n', 'c0', 'a')}, {_ROLLED}, {Q.centroid_ctes('s1', 24, 'c1')}, {_nearest('m', 'c1', 'b')} select series_id, cluster, round(dist, 5) + 0.0 as dist from b")
def cluster_iter_fixed(spark, d):
    r = clustering.cluster(src.user_hour(spark, d), K, max_iter=1)
    return r.assigned.select("series_id", "cluster", (F.round("dist", 5) + F.lit(0.0)).alias("dist"))


@query("cluster_converged")
def cluster_converged(spark, d):
    r = clustering.cluster(src.user_hour(spark, d), K)
    return r.assigned.select("series_id", "cluster", "shift", "dist")


@query("cluster_outputs")
def cluster_outputs(spark, d):
    """The four outputs of a converged clustering as rows: centroids, assignments, shifts and distances to every centroid."""
    r = clustering.cluster(src.user_hour(spark, d), K)
    row = lambda what, i, j, v: F.struct(F.lit(what).alias("output"), F.col(i).cast("long").alias("row"), j.cast("int").alias("place"), v.cast("double").alias("v"))
    c = clustering.table(spark, r.centroids).select("cluster", F.posexplode("c").alias("j", "v")).select(row("centroids", "cluster", F.col("j"), F.col("v")).alias("o"))
    a = r.assigned.select(F.explode(F.array(row("assign", "series_id", F.lit(0), F.col("cluster")), row("shifts", "series_id", F.lit(0), F.col("shift")))).alias("o"))
    e = r.assigned.select("series_id", F.posexplode("dists").alias("j", "v")).select(row("dists", "series_id", F.col("j"), F.col("v")).alias("o"))
    return c.unionByName(a).unionByName(e).select("o.*")


_MEMBERS = f"with recursive {_INIT}, {_nearest('n', 'c0', 'a')} select series_id, cluster, {Q.roll('x', 'shift')} as x from a"


@query("cluster_members", _MEMBERS, "x")
def cluster_members(spark, d):
    """What a plot of a cluster's members shows: each member rotated onto its centroid."""
    a = clustering.assign(src.user_hour(spark, d), clustering.centroids(_start(spark, d), K))
    return a.select("series_id", "cluster", S.col(S.roll("x", "shift")).alias("x"))


@query("cluster_restarts")
def cluster_restarts(spark, d):
    return clustering.restarts(src.user_hour(spark, d), K, runs=10).assigned.select("series_id", "cluster", "dist")


@query("cluster_multires")
def cluster_multires(spark, d):
    return clustering.multiresolution(src.supplier_month(spark, d), K).assigned.select("series_id", "cluster", "dist")


# ---- quality --------------------------------------------------------------------------------

_ALL = f"with {Q.USER_HOUR}, p as (select a.series_id % {K} as c1, b.series_id % {K} as c2, a.series_id as id1, case when a.series_id = b.series_id then 0.0 else {Q.roll_dist('a.x', 'b.x', '24')} end as dist from user_hour a, user_hour b)"
_SPREAD = f"{_ALL}, q as (select avg(dist) filter (c1 = c2) as intra_mean, stddev_pop(dist) filter (c1 = c2) as intra_std, avg(dist) filter (c1 <> c2) as inter_mean, stddev_pop(dist) filter (c1 <> c2) as inter_std from p)"


def _spread(spark, d):
    return quality.spread(clustering.pair_sums(_start(spark, d)))


query("avg_intra", f"{_SPREAD} select round(intra_mean, 6) as intra_mean, round(intra_std, 6) as intra_std from q")(lambda s, d: _spread(s, d).select(_r("intra_mean", "intra_mean"), _r("intra_std", "intra_std")))
query("avg_inter", f"{_SPREAD} select round(inter_mean, 6) as inter_mean, round(inter_std, 6) as inter_std from q")(lambda s, d: _spread(s, d).select(_r("inter_mean", "inter_mean"), _r("inter_std", "inter_std")))
query("beta_cv", f"{_SPREAD} select round((inter_std / inter_mean) / (intra_std / intra_mean), 6) as beta_cv from q")(lambda s, d: _spread(s, d).select(_r("beta_cv", "beta_cv")))
query(
    "silhouette",
    f"{_ALL}, m as (select id1, c1, c2, avg(dist) as d from p group by all), s as (select id1, min(d) filter (c1 = c2) as a, min(d) filter (c1 <> c2) as b from m group by 1) select round(avg((b - a) / greatest(a, b)), 6) as silhouette from s",
)(lambda s, d: quality.silhouette(clustering.pair_sums(_start(s, d))).select(_r("silhouette", "silhouette")))
query("quality_sweep")(lambda s, d: quality.sweep(src.user_hour(s, d)))
