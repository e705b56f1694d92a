"""Queries of regression, ensembles, evaluation, contingency and text."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from shapeflow.functions import series as S
from shapeflow.operators import clustering, ensemble, evaluation, learners, regression, tables, text
from shapeflow.plans import sqltext as Q
from shapeflow.sources import series as src

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _r(c: str, name: str | None = None, digits: int = 6):
    return (F.round(F.expr(c), digits) + F.lit(0.0)).alias(name or c)


def _rr(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names)


# ---- regression: a user's total from the first ten days -------------------------------------


def _totals(s, d):
    return src.user_day(s, d).select(
        "series_id", F.expr("cast(series_id % 3 as int)").alias("cls"), F.expr(S.total("slice(x, 1, 10)")).alias("f"), F.expr(S.total("slice(x, 11, 5)")).alias("g"), F.expr(S.total("x")).alias("y")
    ).withColumn("p", F.col("f") * 3)


_T = f"with {Q.USER_DAY}, t as (select series_id, (series_id % 3)::int as cls, list_sum(list_slice(x, 1, 10)) as f, list_sum(list_slice(x, 11, 15)) as g, list_sum(x) as y, list_sum(list_slice(x, 1, 10)) * 3 as p from user_day)"
query("mae", f"{_T} select round(avg(abs(y - p)), 6) + 0.0 as mae from t")(lambda s, d: regression.errors(_totals(s, d)).select(_r("mae")))
query("mrse", f"{_T} select round(avg(pow(p / y - 1, 2)), 6) + 0.0 as mrse from t where y <> 0")(lambda s, d: regression.errors(_totals(s, d)).select(_r("mrse")))
query("r2_mse", f"{_T} select round(1 - avg(pow(y - p, 2)) / var_pop(y), 6) + 0.0 as r2, round(avg(pow(y - p, 2)), 6) + 0.0 as mse from t")(lambda s, d: regression.errors(_totals(s, d)).select(_r("r2"), _r("mse")))


@query("rse_ols_1d", f"{_T}, c as (select sum(f / y) / sum(pow(f / y, 2)) as b from t where y <> 0) select series_id, round(b * f, 6) + 0.0 as p from t, c")
def rse_ols_1d(s, d):
    t = _totals(s, d).drop("p")
    return regression.routed(t.withColumn("k", F.lit(0)), ["f"], regression.relative_fit(t, ["f"]), "k").select("series_id", _r("p"))


_G = "sum(f * f / (y * y)) as ff, sum(f * g / (y * y)) as fg, sum(g * g / (y * y)) as gg, sum(f / y) as fy, sum(g / y) as gy"


@query("rse_ols_by_class", f"{_T}, m as (select cls, {_G} from t where y <> 0 group by 1), c as (select cls, (gg * fy - fg * gy) / (ff * gg - fg * fg) as a, (ff * gy - fg * fy) / (ff * gg - fg * fg) as b from m) select series_id, round(a * f + b * g, 5) + 0.0 as p from t join c using (cls)")
def rse_ols_by_class(s, d):
    t = _totals(s, d).drop("p")
    return regression.routed(t, ["f", "g"], regression.relative_fit(t, ["f", "g"], group="cls"), "cls").select("series_id", _r("p", digits=5))


@query("loo_ols_1d", f"{_T}, c as (select sum(f * f) as ff, sum(f * y) / sum(f * f) as b from t) select series_id, round(pow((y - b * f) / (1 - f * f / ff), 2), 5) + 0.0 as loo from t, c")
def loo_ols_1d(s, d):
    return regression.loo_fit(_totals(s, d).drop("p"), ["f"], "y")[1].select("series_id", _r("loo", digits=5))


@query("prefix_regression")
def prefix_regression(s, d):
    e = regression.prefix_errors(src.user_day(s, d).withColumn("cls", F.expr("series_id % 3")), "cls")
    return evaluation.confidence(e, "loo", "tr")


@query("prefix_report")
def prefix_report(s, d):
    """Errors at the series' own reference days, by the model of all series and by those of the classes."""
    x = src.user_day(s, d).withColumn("x", F.transform("x", lambda v: v + 0.0001)).withColumn("cls", F.expr("cast(series_id % 3 as int)"))
    return regression.prefix_report(x.withColumn("best_by", F.expr("cast(series_id % 30 + 1 as int)")), "cls", "best_by")


class _Threshold:
    """A classifier fitted by least squares: label 1 where a + b f is 0.5 or more."""

    def fit(self, df, features, label):
        d = df.withColumn("_one", F.lit(1.0))
        g, b, _ = regression.normal_equations(d, ["_one", features[0]], label)[0]
        self.coef, self.feature = regression.solve(g, b), features[0]
        return self

    def transform(self, df):
        return df.withColumn("prediction", (F.lit(float(self.coef[0])) + F.col(self.feature) * float(self.coef[1]) >= 0.5).cast("int"))


@query("multiclass_regression", f"""{_T}, w as (select *, (y > 60)::int as big from t), k as (select regr_slope(big, f) as b, regr_intercept(big, f) as a from w), m as (select big, {_G} from w where y <> 0 group by 1),
c as (select big, (gg * fy - fg * gy) / (ff * gg - fg * fg) as a, (ff * gy - fg * fy) / (ff * gg - fg * fg) as b from m), r as (select w.*, (k.a + k.b * f >= 0.5)::int as prediction from w, k)
select series_id, prediction, round(coalesce(c.a * f + c.b * g, 0), 4) + 0.0 as p from r left join c on c.big = r.prediction""")
def multiclass_regression(s, d):
    t = _totals(s, d).drop("p").withColumn("big", F.expr("cast(y > 60 as int)"))
    return regression.multiclass_predict(t, ["f", "g"], regression.multiclass(t, ["f", "g"], "big", "y", _Threshold()), True).select("series_id", "prediction", _r("p", digits=4))


# ---- evaluation -----------------------------------------------------------------------------


def _predicted(s, d):
    return _totals(s, d).select("series_id", F.col("cls").alias("y"), F.expr("cast(f % 3 as int)").alias("p"), F.expr("cast(series_id % 5 as int)").alias("fold"))


_P = f"{_T}, q as (select series_id, cls as y, (f % 3)::int as p, (series_id % 5)::int as fold from t)"
query("confusion_norm", f"{_P} select y, p, count(*) as n, round(count(*) / sum(count(*)) over (partition by y), 6) as share from q group by y, p")(lambda s, d: evaluation.confusion(_predicted(s, d)).select("y", "p", "n", _r("share")))
query("confusion_folds", f"{_P}, g as (select fold, y, p, count(*) / sum(count(*)) over (partition by fold, y) as share from q group by fold, y, p) select y, p, round(sum(share) / (select count(distinct fold) from q), 6) as share from g group by all")(
    lambda s, d: evaluation.mean_confusion(_predicted(s, d)).select("y", "p", _r("share"))
)
_PRF = f"""{_P}, l as (select distinct y as k from q union select distinct p from q),
c as (select k, count(*) filter (y = k) as support, count(*) filter (p = k) as found, count(*) filter (y = k and p = k) as tp from q, l group by 1),
m as (select k::varchar as label, coalesce(tp / nullif(found, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall, coalesce(2.0 * tp / nullif(found + support, 0), 0) as f1, support from c),
o as (select * from m union all select 'macro', avg(precision), avg(recall), avg(f1), sum(support) from m
union all select 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from m
union all select 'micro', sum(tp) / sum(found), sum(tp) / sum(support), 2.0 * sum(tp) / (sum(found) + sum(support)), sum(support) from c)"""
query("prf_report", f"{_PRF} select label, {_rr('precision', 'recall', 'f1')}, support::bigint as support from o")(lambda s, d: evaluation.report(_predicted(s, d)).select("label", _r("precision"), _r("recall"), _r("f1"), "support"))
query("stratified_kfold", f"{_T} select series_id, ((row_number() over (partition by cls order by series_id) - 1) % 5)::int as fold from t")(lambda s, d: evaluation.stratified(_totals(s, d), 5, "cls").select("series_id", "fold"))
query("kfold_masks", f"{_T} select series_id, ((row_number() over (order by md5(series_id::varchar || ':0'), series_id) - 1) % 5)::int as fold from t")(lambda s, d: evaluation.kfold(_totals(s, d), 5).select("series_id", "fold"))
query("standardize_pop", f"{_T} select series_id, round((f - avg(f) over ()) / stddev_pop(f) over (), 6) + 0.0 as f, round((g - avg(g) over ()) / stddev_pop(g) over (), 6) + 0.0 as g from t")(
    lambda s, d: evaluation.standardise(_totals(s, d).select("series_id", "f", "g"), ["f", "g"]).select("series_id", _r("f"), _r("g"))
)
query("chrono_holdout", "select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey desc) > 500 as train from orders")(
    lambda s, d: evaluation.chronological(src.read(s, d, "orders"), "o_orderdate", 500, "o_orderkey").select("o_orderkey", "train")
)
query("mean_confidence", f"{_P} select fold, round(avg(p), 6) as mean, count(*) as n from q group by 1")(lambda s, d: evaluation.confidence(_predicted(s, d), "p", "fold").select("fold", _r("mean"), "n"))
#: Quantiles .975 of Student's t for the group sizes of the test tables (3, 30 and 300 rows): fixed values of the published tables.
_HALF = "case count(*) when 3 then 4.302652729911275 when 30 then 2.045229642132703 when 300 then 1.967929669065420 end * stddev_samp(p) / sqrt(count(*))"
query("confidence_halfwidth", f"{_P} select fold, round(avg(p), 6) + 0.0 as mean, round({_HALF}, 5) + 0.0 as half, count(*) as n from q group by 1")(
    lambda s, d: evaluation.confidence(_predicted(s, d), "p", "fold").select("fold", _r("mean"), _r("half", digits=5), "n")
)
query("clf_summary", f"{_P} select fold, printf('%.4f +- %.4f', avg(p), {_HALF}) as text from q group by 1")(lambda s, d: evaluation.summary(_predicted(s, d), "p", "fold"))
query("mquantiles", f"""{_T}, v as (select cls, list(y order by y) as a from t group by 1)
select cls, {', '.join(f"round((1 - (len(a) * {p} + {0.4 + 0.2 * p} - floor(len(a) * {p} + {0.4 + 0.2 * p}))) * a[floor(len(a) * {p} + {0.4 + 0.2 * p})::int] + (len(a) * {p} + {0.4 + 0.2 * p} - floor(len(a) * {p} + {0.4 + 0.2 * p})) * a[floor(len(a) * {p} + {0.4 + 0.2 * p})::int + 1], 6) + 0.0 as q{int(p * 100)}" for p in (0.25, 0.5, 0.75))} from v""")(
    lambda s, d: _totals(s, d).groupBy("cls").agg(F.array_sort(F.collect_list("y")).alias("a")).select("cls", *[_r(S.mquantile("a", p), f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)])
)


def _folds(s, d):
    """Clusters of two folds: nearest of two centroids, and of three numbered the other way."""
    m = src.user_hour(s, d).select("series_id", F.expr("cast(series_id % 3 as int)").alias("c0"), F.expr("cast(size(filter(x, v -> v > 3)) % 3 as int)").alias("c1"))
    return m.select("series_id", F.explode(F.array(F.struct(F.lit(0).alias("fold"), F.col("c0").alias("cluster")), F.struct(F.lit(1).alias("fold"), F.col("c1").alias("cluster")))).alias("m")).select("series_id", "m.*")


_FOLD = f"""with {Q.USER_HOUR}, u as (select series_id, (series_id % 3)::int as c0, (len(list_filter(x, lambda v: v > 3)) % 3)::int as c1 from user_hour),
m as (select series_id, 0 as fold, c0 as cluster from u union all select series_id, 1, c1 from u),
n as (select i::int as fold_i, k::int as k, j::int as fold_j, (case when i = j then k else (k + 1) % 3 end)::int as o from range(2) a(i), range(3) b(k), range(2) c(j))"""


@query("fold_agreement", f"{_FOLD}, j as (select a.fold as fold_i, b.fold as fold_j, n.o = b.cluster as same from m a join m b using (series_id) join n on n.fold_i = a.fold and n.k = a.cluster and n.fold_j = b.fold where a.fold <= b.fold) select fold_i, fold_j, count(*) filter (same) as agree, count(*) filter (not same) as differ, round(count(*) filter (same) / count(*), 6) as share from j group by 1, 2")
def fold_agreement(s, d):
    n = s.sql("select cast(i as int) fold_i, cast(k as int) k, cast(j as int) fold_j, cast(if(i = j, k, (k + 1) % 3) as int) o from (select explode(array(0, 1)) i) cross join (select explode(array(0, 1, 2)) k) cross join (select explode(array(0, 1)) j)")
    return evaluation.fold_agreement(_folds(s, d), n).select("fold_i", "fold_j", "agree", "differ", _r("share"))


@query("fold_mapping_report")
def fold_mapping_report(s, d):
    """Clusters of fold 1 named after the nearest centroid of fold 0, then one report on both folds' rows."""
    u = src.user_hour(s, d)
    a = clustering.centroids(u.where("series_id % 2 = 0").withColumn("cluster", F.expr("series_id % 3")), 3)
    b = clustering.centroids(u.where("series_id % 2 = 1").withColumn("cluster", F.expr("series_id % 3")), 3)
    onto = clustering.assign(clustering.table(s, b).select(F.col("cluster").alias("k"), F.col("c").alias("x")), a).select("k", F.col("cluster").alias("to"))
    own = clustering.assign(u.where("series_id % 2 = 1"), b).join(F.broadcast(onto), F.col("cluster") == F.col("k")).select(F.expr("cast(series_id % 3 as int)").alias("y"), F.col("to").alias("p"))
    first = clustering.assign(u.where("series_id % 2 = 0"), a).select(F.expr("cast(series_id % 3 as int)").alias("y"), F.col("cluster").alias("p"))
    return evaluation.report(first.unionByName(own))


# ---- contingency ----------------------------------------------------------------------------


def _orders(s, d):
    return src.read(s, d, "orders")


query("category_share", "select o_orderstatus, o_orderpriority, count(*)::bigint as n, round(count(*) / sum(count(*)) over (partition by o_orderstatus), 6) as share from orders group by o_orderstatus, o_orderpriority")(
    lambda s, d: tables.share(_orders(s, d), "o_orderstatus", "o_orderpriority").select("o_orderstatus", "o_orderpriority", "n", _r("share"))
)
query("weighted_share", "select event_type, dayofweek(ts)::int as dow, round(sum(value) filter (value > 0), 2) as n from events group by all having n is not null")(
    lambda s, d: tables.share(src.read(s, d, "events").withColumn("dow", F.dayofweek("ts") - 1), "event_type", "dow", F.col("value")).select("event_type", "dow", F.round("n", 2).alias("n"))
)
query("topk_labels", "select c_mktsegment, c_nationkey, n, round(share, 6) as share, rank::int as rank from (select *, row_number() over (partition by c_mktsegment order by round(share, 9) desc, c_nationkey) as rank from (select c_mktsegment, c_nationkey, count(*)::bigint as n, count(*) / sum(count(*)) over (partition by c_mktsegment) as share from customer group by c_mktsegment, c_nationkey)) where rank <= 4")(
    lambda s, d: tables.top_labels(tables.share(src.read(s, d, "customer"), "c_mktsegment", "c_nationkey"), "c_mktsegment", "c_nationkey").select("c_mktsegment", "c_nationkey", "n", _r("share"), "rank")
)
query("referrer_share", "select l_returnflag, label, round(sum(v) filter (v > 0) / any_value(t), 6) as share from (select l_returnflag, unnest(['l_discount', 'l_tax']) as label, unnest([l_discount, l_tax]) as v, sum(l_quantity) over (partition by l_returnflag) as t from lineitem) group by 1, 2")(
    lambda s, d: tables.unpivot_share(src.read(s, d, "lineitem"), "l_returnflag", ["l_discount", "l_tax"], "l_quantity").select("l_returnflag", "label", _r("share"))
)
query("cluster_volume_rollup", f"{_T} select cls, count(*) as n, round(avg(f), 6) as f, round(avg(y), 6) as y from t group by rollup (cls)")(lambda s, d: tables.rollup_means(_totals(s, d), "cls", ["f", "y"]).select("cls", "n", _r("f"), _r("y")))
query("ratio_summary", f"{_T} select round(avg(f / y), 6) as mean, round(stddev_pop(f / y), 6) as std, round(quantile_cont(f / y, 0.25), 6) as q25, round(quantile_cont(f / y, 0.5), 6) as median from t where y <> 0")(
    lambda s, d: tables.ratio_summary(_totals(s, d), "f", "y").select(_r("mean"), _r("std"), _r("q25"), _r("median"))
)
query("histogram20", "with m as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders) select least(floor((o_totalprice - lo) / (hi - lo) * 20) + 1, 20)::int as bin, count(*) as n from orders, m group by 1")(
    lambda s, d: tables.histogram(_orders(s, d), "o_totalprice")
)


def _peaks(s, d):
    return src.user_day(s, d).select(F.expr("cast(series_id % 3 as int)").alias("cls"), F.lit(1.0).alias("start"), (F.expr(S.argmax("x")) + 0.0).alias("peak"), F.expr("cast(x[0] * 10 as double)").alias("first"))


query("time_to_peak", f"with {Q.USER_DAY}, p as (select (series_id % 3)::int as cls, (list_position(x, list_max(x)) - 1)::double as peak, x[1] * 10 as first from user_day) select cls, round(avg(peak - 1) filter (peak > 0), 6) + 0.0 as peak_mean, round(stddev_pop(peak - 1) filter (peak > 0), 6) as peak_std, round(avg(first - 1) filter (first > 0), 6) + 0.0 as first_mean, round(stddev_pop(first - 1) filter (first > 0), 6) as first_std from p group by 1")(
    lambda s, d: tables.time_to(_peaks(s, d), "cls", "start", ["peak", "first"]).select("cls", _r("peak_mean"), _r("peak_std"), _r("first_mean"), _r("first_std"))
)
query("category_translate", "select coalesce(case when lang = 'en' then 'English' when lang = 'de' then 'German' when lang is null then 'NULL' else lang end) as lang, count(*) as n from documents group by 1")(
    lambda s, d: tables.translate(src.read(s, d, "documents").select("lang"), "lang", {"en": "English", "de": "German"}).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
)
query("one_hot", "select doc_id, (lang = 'de')::int as lang_de, (lang = 'en')::int as lang_en, (lang = 'es')::int as lang_es, (lang = 'fr')::int as lang_fr from documents")(
    lambda s, d: tables.one_hot(src.read(s, d, "documents").select("doc_id", "lang"), "lang", "lang_").drop("lang")
)
#: Categories made up from the type of an event, for the built-in table.
_KINDS = ["Music", "News&amp;Politics", "Autos", "Pets&amp;Animals", "Howto&amp;Style"]
_KIND = "list_value('Music', 'News&amp;Politics', 'Autos', 'Pets&amp;Animals', 'Howto&amp;Style')[(event_id % 6 + 1)::int]"
_SHORT = "case when k = 'Music' then 'Music' when k = 'News&amp;Politics' then 'News' when k = 'Autos' then 'Vehi.' when k = 'Pets&amp;Animals' then 'Pets' when k = 'Howto&amp;Style' then 'Howto' when k is null then '-' end"


def _kinds(s, d):
    return src.read(s, d, "events").select("event_id", F.get(F.array(*[F.lit(k) for k in _KINDS]), F.expr("cast(event_id % 6 as int)")).alias("k"))


query("category_builtin", f"select c, count(*) as n from (select {_SHORT} as c from (select {_KIND} as k from events)) group by 1")(
    lambda s, d: tables.translate(_kinds(s, d), "k").groupBy(F.col("k").alias("c")).agg(F.count(F.lit(1)).alias("n"))
)


@query("category_ids", f"select event_id, list_position(['-', 'Com.', 'Edu.', 'Ent.', 'Film', 'Game', 'Howto', 'Music', 'News', 'Nonprof.', 'People', 'Pets', 'Sci.', 'Show', 'Sport', 'Travel', 'Vehi.'], {_SHORT})::int - 1 as id from (select event_id, {_KIND} as k from events)")
def category_ids(s, d):
    """The place of the 1 among the columns of the sorted abbreviations."""
    t, names = tables.category_columns(_kinds(s, d), "k")
    return t.select("event_id", (F.array_position(F.array(*[F.col(f"`{n}`") for n in names]), 1) - 1).cast("int").alias("id"))


_REF = {"l_discount": "SEARCH", "l_tax": "VIRAL"}
query("referrer_names", "select l_returnflag, label, round(sum(v) filter (v > 0) / any_value(t), 6) as share from (select l_returnflag, unnest(['SEAR.', 'VIR.']) as label, unnest([l_discount, l_tax]) as v, sum(l_quantity) over (partition by l_returnflag) as t from lineitem) group by 1, 2")(
    lambda s, d: tables.unpivot_share(src.read(s, d, "lineitem"), "l_returnflag", list(_REF), "l_quantity", {c: tables.REFERRERS[r] for c, r in _REF.items()}).select("l_returnflag", "label", _r("share"))
)


def _assembled(s, d):
    own = src.user_hour(s, d).select("series_id", F.expr(S.total("x")).alias("total"), F.expr(S.argmax("x")).alias("peak"))
    return tables.assemble([(src.points(src.user_day(s, d), 5), "points"), (own, "features")], keep={"features": ["peak"]})


query("feature_assembly", f"with {Q.USER_DAY}, {Q.USER_HOUR} select d.series_id, {', '.join(f'd.x[{i + 1}] as \"POINT_{i}\"' for i in range(5))}, (list_position(h.x, list_max(h.x)) - 1)::int as peak from user_day d join user_hour h using (series_id)")(
    lambda s, d: _assembled(s, d)[0]
)
query("feature_places", "select * from (values ('POINT_0', 0), ('POINT_1', 1), ('POINT_2', 2), ('POINT_3', 3), ('POINT_4', 4), ('peak', 5)) t(name, place)")(
    lambda s, d: s.createDataFrame(list(_assembled(s, d)[1].items()), "name string, place int")
)
query("trend_table", f"with {Q.USER_DAY} select series_id, x[1] as \"POINT_0\", x[2] as \"POINT_1\", (series_id % 3)::int as \"TREND\", list_sum(x) as \"FINAL_VIEWS\" from user_day")(
    lambda s, d: tables.trend_table(u := src.user_day(s, d), u.select("series_id", F.expr("cast(series_id % 3 as int)").alias("cluster")), src.points(u, 2))
)
query("dense_relabel", "select c_custkey, (dense_rank() over (order by c_mktsegment) - 1)::int as index from customer")(lambda s, d: tables.dense_labels(src.read(s, d, "customer"), "c_mktsegment").select("c_custkey", "index"))
query("feature_table", f"with {Q.USER_DAY}, {Q.USER_HOUR} select d.series_id, d.x[1] as \"POINT_0\", d.x[2] as \"POINT_1\", d.x[3] as \"POINT_2\", list_sum(h.x) as total, (list_position(h.x, list_max(h.x)) - 1)::int as peak from user_day d join user_hour h using (series_id)")(
    lambda s, d: src.points(src.user_day(s, d), 3).join(src.user_hour(s, d).select("series_id", F.expr(S.total("x")).alias("total"), F.expr(S.argmax("x")).alias("peak")), "series_id")
)
query("features_at_decision", f"{_T}, b as (select series_id, case when series_id % 4 = 0 then null else (series_id % 6 + 1)::int end as best_by from t) select series_id, coalesce(best_by, 6)::int as num_pts, list_sum(list_slice(x, 1, coalesce(best_by, 6))) as views from b join user_day using (series_id)")(
    lambda s, d: src.user_day(s, d).select("series_id", F.expr("cast(coalesce(if(series_id % 4 = 0, null, series_id % 6 + 1), 6) as int)").alias("num_pts")).join(
        src.user_day(s, d).select("series_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("num_pts"), "x").select("series_id", "num_pts", F.expr(S.total("slice(x, 1, num_pts)")).alias("views")), ["series_id", "num_pts"]
    )
)
query("sample_rows", f"{_T} select series_id, cls, f, g, y, p from t qualify row_number() over (partition by cls order by md5(series_id::varchar || ':0'), series_id) <= 10")(lambda s, d: tables.sample(_totals(s, d), 10, by="cls"))

# ---- text -----------------------------------------------------------------------------------


def _classed(s, d):
    return src.read(s, d, "documents").select("doc_id", "text", "lang").join(src.read(s, d, "labels").select("doc_id", F.col("quality").alias("cls")), "doc_id")


def _tokens(s, d):
    return text.tokens(_classed(s, d), "text", 1).select("doc_id", "cls", "token")


_TOK = r"with rws as (select doc_id, text, lang, quality as cls from documents join labels using (doc_id)), tok as (select doc_id, cls, unnest(list_slice(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), 2, 2147483647)) as token from rws)"
query("token_counts", f"{_TOK} select token, count(*) as n from tok group by 1")(lambda s, d: _tokens(s, d).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
query("stem_counts")(lambda s, d: text.tokens(_classed(s, d), "text", 1, text.english_stop_words()).select(text.stem("token").alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n")))
query("rare_term_filter", f"{_TOK}, c as (select token, count(*) as n from tok group by 1) select token, n from c where n / (select count(*) from c) > 0.001")(
    lambda s, d: text.drop_rare(_tokens(s, d).groupBy("token").agg(F.count(F.lit(1)).alias("n")), 0.001)
)
query("tfidf", f"{_TOK}, tf as (select doc_id, token, count(*) as tf from tok group by all), df as (select token, count(*) as df from tf group by 1), w as (select doc_id, token, tf, tf * (ln((1 + (select count(distinct doc_id) from tok)) / (1 + df)) + 1) as w from tf join df using (token)) select doc_id, token, tf, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from w")(
    lambda s, d: text.tfidf(_tokens(s, d), "doc_id").select("doc_id", "token", "tf", _r("weight"))
)
query("asym_jaccard", r"with t as (select distinct lang as c, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) as token from documents), n as (select c, count(*) as n from t group by 1), b as (select x.c as a, y.c as b, count(*) as m from t x join t y using (token) group by 1, 2) select x.c as a, y.c as b, round(coalesce(m, 0) / x.n, 6) as share from n x cross join n y left join b on b.a = x.c and b.b = y.c")(
    lambda s, d: text.asymmetric_jaccard(text.tokens(src.read(s, d, "documents").select("lang", "text"), "text", distinct=True), "lang").select("a", "b", _r("share"))
)
_IG = f"{_TOK}, pr as (select cls, count(*) / (select count(*) from rws) as prior from rws group by 1), k as (select token, cls, count(*) as k from tok group by all), p as (select token, cls, k, k / sum(k) over (partition by token) as p from k), g as (select token, sum(k)::bigint as n, sum(p * ln(p / prior)) as gain from p join pr using (cls) group by 1)"
query("info_gain", f"{_IG} select token, n, round(n / (select sum(n) from g), 9) as p_token, round(gain, 6) + 0.0 as gain from g")(
    lambda s, d: text.info_gain(_tokens(s, d), _classed(s, d), "cls").select("token", "n", _r("p_token", digits=9), _r("gain"))
)
query("tf_only", f"{_TOK}, tf as (select doc_id, token, count(*) as tf from tok group by all) select doc_id, token, tf, round(tf / sqrt(sum(tf * tf) over (partition by doc_id)), 6) as weight from tf")(
    lambda s, d: text.tfidf(_tokens(s, d), "doc_id", idf=False).select("doc_id", "token", "tf", _r("weight"))
)
query("info_gain_top", f"{_IG}, r as (select token, n, gain, row_number() over (order by round(gain, 9) desc, token desc) as rank from g) select token, n, round(gain, 6) + 0.0 as gain, rank::int as rank from r where rank <= 100")(
    lambda s, d: text.top_gains(text.info_gain(_tokens(s, d), _classed(s, d), "cls")).select("token", "n", _r("gain"), "rank")
)


def _users(s, d):
    return src.read(s, d, "documents").select("doc_id", "lang", "source").join(src.read(s, d, "labels").select("doc_id", F.col("quality").alias("cls")), "doc_id")


_CG = "select '{0}' as kind, token, sum(k)::bigint as n, round(sum(k) / sum(sum(k)) over (), 9) as p_token, round(sum(p * ln(p / prior)), 6) + 0.0 as gain from (select *, k / sum(k) over (partition by token) as p from (select {0} as token, cls, count(*) as k from rws where {0} is not null group by 1, 2)) join pr using (cls) group by token"
query("info_gain_columns", f"with rws as (select lang, source, quality as cls from documents join labels using (doc_id)), pr as (select cls, count(*) / (select count(*) from rws) as prior from rws group by 1) {_CG.format('source')} union all {_CG.format('lang')}")(
    lambda s, d: text.column_gain(_users(s, d), ["source", "lang"], "cls").select("kind", "token", "n", _r("p_token", digits=9), _r("gain"))
)
query("info_gain_weights", "with r as (select l_returnflag as cls, unnest(['SEAR.', 'VIR.']) as token, unnest([l_discount, l_tax]) as w from lineitem), pr as (select l_returnflag as cls, count(*) / (select count(*) from lineitem) as prior from lineitem group by 1), k as (select token, cls, sum(w) as k from r where w > 0 group by all), p as (select *, k / sum(k) over (partition by token) as p from k) select token, round(sum(k), 2) as n, round(sum(k) / sum(sum(k)) over (), 6) as p_token, round(sum(p * ln(p / prior)), 6) + 0.0 as gain from p join pr using (cls) group by token")(
    lambda s, d: text.weight_gain(src.read(s, d, "lineitem"), list(_REF), "l_returnflag", {c: tables.REFERRERS[r] for c, r in _REF.items()}).select("token", F.round("n", 2).alias("n"), _r("p_token"), _r("gain"))
)
query("chisq_test")(lambda s, d: text.chi_square(_orders(s, d), "o_orderstatus", "o_orderpriority").withColumn("p", text.chi_square_p("chi2", F.col("dof").cast("double"))))
query("mutual_info", f"{_IG} select round(sum(n * gain) / sum(n), 6) as mi from g")(lambda s, d: text.mutual_information(text.info_gain(_tokens(s, d), _classed(s, d), "cls")).select(_r("mi")))
query("chisq_stat", "with n as (select o_orderstatus, o_orderpriority, count(*) as o from orders group by all), c as (select o_orderstatus, sum(o) as nc from n group by 1), l as (select o_orderpriority, sum(o) as nl, sum(sum(o)) over () as al from n group by 1), g as (select c.o_orderstatus, coalesce(o, 0) as o, nc * nl / al as e from c cross join l left join n on n.o_orderstatus = c.o_orderstatus and n.o_orderpriority = l.o_orderpriority) select o_orderstatus, round(sum(pow(o - e, 2) / e), 6) as chi2, count(*) - 1 as dof from g group by 1")(
    lambda s, d: text.chi_square(_orders(s, d), "o_orderstatus", "o_orderpriority").select("o_orderstatus", _r("chi2"), "dof")
)

# ---- learners and ensembles -----------------------------------------------------------------


CLASSES, DIMS = 10, 64


def _labelled(s, d):
    """Embeddings: ten labels, 64 features; B: made-up base probabilities that are right for two rows in three."""
    e = src.read(s, d, "embeddings").select(F.col("vec_id").alias("series_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("int").alias("label"))
    b = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.when(k == F.expr(f"if(series_id % 3 = 0, (label + 1) % {CLASSES}, label)"), 0.55).otherwise(0.05))
    return e.withColumn("B", b).withColumn("P", b).withColumn("fold", F.expr("cast(series_id % 3 as int)")).withColumn("label", F.col("label").cast("double"))


def _vectors(s, d):
    return _labelled(s, d).withColumn("features", array_to_vector("x"))


query("samme_alpha", f"{_P}, e as (select avg((y <> p)::int) as e from q) select round(e, 6) as error, round(ln((1 - e) / e) + ln(2), 6) as alpha from e")(
    lambda s, d: ensemble.error(_predicted(s, d)).select(_r("error"), _r("ln((1 - error) / error) + ln(2)", "alpha"))
)


@query("samme_weights", f"{_P}, e as (select avg((y <> p)::int) as e from q), w as (select series_id, case when y <> p then (1 - e) / e * 2 else 1 end as w from q, e) select series_id, round(w / sum(w) over (), 9) as w from w")
def samme_weights(s, d):
    q = _predicted(s, d).withColumn("w", F.lit(1.0))
    return ensemble.reweigh(q, ensemble.alpha(ensemble.error(q).first()[0], 3)).select("series_id", _r("w", digits=9))


query("weighted_sample")(lambda s, d: ensemble.sample_weights(_totals(s, d).select("series_id", F.col("y").alias("w")), "w", 100))
query("knn_classify", "with e as (select vec_id as id, embedding::double[] as x, label from embeddings), q as (select * from e where id % 20 = 0), p as (select q.id as qid, e.id as nid, e.label, round(list_sum(list_transform(list_zip(e.x, q.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) as d from q, e where q.id <> e.id qualify row_number() over (partition by q.id order by d, e.id) <= 5), v as (select qid, label, count(*) as v from p group by all) select qid as id, label from v qualify row_number() over (partition by qid order by v desc, label) = 1")(
    lambda s, d: learners.knn(e := src.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label"), e.where("id % 20 = 0"), 5)
)


@query("grid_search_lr")
def grid_search_lr(s, d):
    model, _ = learners.grid_search(_vectors(s, d), "lr")
    return model.transform(_vectors(s, d)).select("series_id", F.col("prediction").cast("int").alias("p"), "label")


query("cross_val_trees")(lambda s, d: learners.cross_val(_vectors(s, d).select("series_id", "features", "label", "fold"), "extra_trees").select("series_id", "fold", "prediction"))
query("tree_importances")(lambda s, d: learners.importances(_labelled(s, d).select("series_id", "label", *[F.get("x", i).alias(f"x{i}") for i in range(DIMS)]), [f"x{i}" for i in range(DIMS)]))


def _waves(s, d):
    return learners.fourier_features(_labelled(s, d), "x", DIMS, gamma=0.5)


query("rbf_svm")(lambda s, d: learners.learner("linear_svm").fit(w := _waves(s, d)).transform(w).select("series_id", "label", F.col("prediction").cast("int").alias("p")))
query("rbf_svr")(lambda s, d: learners.learner("huber_regression").fit(w := _waves(s, d)).transform(w).select("series_id", "label", "prediction"))
query("class_boost")(lambda s, d: ensemble.ClassBoost().fit(v := _vectors(s, d), CLASSES).predict(v).select("series_id", "label", "p"))
query("cotrain")(lambda s, d: ensemble.CoTrain(per_round=20).fit(v := _vectors(s, d), CLASSES).predict(v).select("series_id", "label", "p"))
for _kind in ("linear", "tree", "deco"):
    query(f"stacking_{_kind}")(lambda s, d, k=_kind: ensemble.Stacking(["lr"], k).fit(v := _vectors(s, d).drop("x"), CLASSES, B="B").predict(v).select("series_id", "label", "p"))


@query("model_comparison")
def model_comparison(s, d):
    v = _labelled(s, d).select("series_id", F.col("label").cast("double").alias("label"), *[F.get("x", i).alias(f"x{i}") for i in range(DIMS)], *[F.get("B", i).alias(f"b{i}") for i in range(CLASSES)])
    return ensemble.compare(v.where("series_id % 2 = 0"), v.where("series_id % 2 = 1"), [f"x{i}" for i in range(DIMS)], [f"b{i}" for i in range(CLASSES)], "label", CLASSES)


query("learner_comparison")(lambda s, d: learners.compare(_vectors(s, d).select("features", "label", "fold"), ["lr", "linear_svm", "extra_trees", "extra_trees_100"]))


@query("grid_search_trees")
def grid_search_trees(s, d):
    v = _vectors(s, d).select("series_id", "features", "label")
    return learners.grid_search(v, "extra_trees")[0].transform(v).select("series_id", F.col("prediction").cast("int").alias("p"), "label")


@query("grid_search_rbf")
def grid_search_rbf(s, d):
    """The metric of each gamma and C of an RBF machine's grid."""
    rows = learners.rbf_grid(_labelled(s, d), "x", DIMS)
    return s.createDataFrame(rows, "gamma double, C double, f1 double")


def _joint(s, d):
    x = src.user_day(s, d)
    f = F.transform(F.slice("x", 1, 10), lambda v: v)
    return x.select("series_id", array_to_vector(f).alias("features"), F.expr("cast(aggregate(x, 0D, (a, v) -> a + v) > 66 as double)").alias("label"), F.expr(S.total("x")).alias("y"))


@query("joint_experiment")
def joint_experiment(s, d):
    """Class and total of a user from the first ten days: both learners by grid search on stratified folds."""
    return learners.experiment_summary(learners.experiment(evaluation.stratified(_joint(s, d), 5, "label").coalesce(1).persist(), "label", "y"))


@query("holdout_experiment")
def holdout_experiment(s, d):
    """The same, tested on the last 500 orders by date: status and price from date, customer and priority."""
    o = src.read(s, d, "orders").withColumn("series_id", F.col("o_orderkey"))
    f = F.array(F.dayofyear("o_orderdate") / 366.0, F.pmod("o_custkey", F.lit(97)) / 97.0, F.substring("o_orderpriority", 1, 1).cast("double"), F.year("o_orderdate") - 1995.0)
    x = evaluation.chronological(o, "o_orderdate", 500, "o_orderkey").select(array_to_vector(f).alias("features"), (F.col("o_orderstatus") == "F").cast("double").alias("label"), F.col("o_totalprice").alias("y"), F.when(F.col("train"), 0).otherwise(1).alias("fold"))
    return learners.experiment(x.persist(), "label", "y", test_folds=[1])


@query("sparse_learner")
def sparse_learner(s, d):
    """A document's quality from its sparse tf-idf vector, out of fold."""
    v = text.sparse_features(_tokens(s, d), "doc_id").join(_classed(s, d).select("doc_id", F.col("cls").cast("double").alias("label")), "doc_id").withColumn("fold", F.expr("cast(doc_id % 3 as int)"))
    return learners.cross_val(v.persist(), "lr").select("doc_id", "fold", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("p"))


@query("probability_vectors")
def probability_vectors(s, d):
    m = learners.learner("lr").fit(_vectors(s, d))
    return m.transform(_vectors(s, d)).select("series_id", F.posexplode(vector_to_array("probability")).alias("label", "p"))
