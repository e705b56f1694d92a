"""Queries of trend prediction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shapeflow.operators import clustering, evaluation, trend
from shapeflow.plans import sqltext as Q
from shapeflow.plans import trend_pipeline
from shapeflow.sources import series as src

QUERIES: dict = {}
SQL: dict[str, str] = {}
N, G, LABELS = 5, 6, [0, 1, 2]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _r(c: str, name: str, digits: int = 6):
    return (F.round(F.expr(c), digits) + F.lit(0.0)).alias(name)


def _refs(spark, d):
    """The training series, all but every fifth, labelled id % 3."""
    return src.user_day(spark, d).where("series_id % 5 <> 0").select(F.col("series_id").alias("ref_id"), F.expr("cast(series_id % 3 as int)").alias("label"), "x")


def _own(spark, d):
    return src.user_day(spark, d).where("series_id % 5 = 0")


def _truth(spark, d):
    return _own(spark, d).select("series_id", F.expr("cast(series_id % 3 as int)").alias("y"))


def _curves(spark, d, num_pts):
    return trend.curves_against(_own(spark, d), _refs(spark, d), num_pts)


def _centroid_curves(spark, d, num_pts):
    """References as the workflow has them: the centroid of each class of training series."""
    train = src.user_day(spark, d).where("series_id % 5 <> 0").withColumn("cluster", F.expr("cast(series_id % 3 as int)"))
    return trend.curves(_own(spark, d), (LABELS, np.arange(3), clustering.centroids(train, 3)), num_pts)


def _cte(ns: str) -> str:
    return f"""with {Q.USER_DAY},
refs as (select series_id as ref_id, (series_id % 3)::int as label, x from user_day where series_id % 5 <> 0),
pre as (select series_id, n::int as n, list_slice(x, 1, n) as s from user_day, unnest({ns}) t(n) where series_id % 5 = 0),
win as (select ref_id, label, n::int as n, list_slice(x, i, i + n - 1) as w from refs, unnest({ns}) t(n), range(1, 31) o(i) where i <= 30 - n + 1),
dist as (select series_id, p.n, ref_id, label, least(1.0, min({Q.roll_dist('w', 's', 'len(s)')})) as dist from pre p join win w on p.n = w.n group by all),
score as (select series_id, n, label, sum(exp(-dist)) as score from dist group by all),
cur as (select series_id, n as num_pts, label, score, score / sum(score) over (partition by series_id, n) as p from score),
top as (select series_id, num_pts, label, p, score from cur qualify row_number() over (partition by series_id, num_pts order by round(p, 6) desc, label) = 1),
j as (select t.series_id, t.num_pts, (t.series_id % 3)::int as y, t.label, t.p, c.p as p_true from top t join cur c on c.series_id = t.series_id and c.num_pts = t.num_pts and c.label = t.series_id % 3)"""


_LIMITS = f"""{_cte('range(1, 7)')},
f1 as (select num_pts, k, coalesce(2.0 * count(*) filter (label = k and y = k) / nullif(count(*) filter (label = k) + count(*) filter (y = k), 0), 0) as f1 from j, unnest([0, 1, 2]) t(k) group by all),
first as (select k, min(num_pts) as min_pts from f1 where num_pts between 2 and {G} - 1 and round(f1, 6) >= 0.4 group by 1),
mean as (select y as k, num_pts, avg(p_true) as theta from j group by all),
lim as (select t.k::int as k, coalesce(f.min_pts, 0)::int as min_pts, coalesce(m.theta, 1.0 / 3) as theta from unnest([0, 1, 2]) t(k) left join first f on f.k = t.k left join mean m on m.k = f.k and m.num_pts = f.min_pts + 1)"""
_DECIDE = f"""{_LIMITS},
ok as (select series_id, num_pts, label, p from top join lim on lim.k = label where round(p, 6) > round(theta, 6) and num_pts >= min_pts qualify row_number() over (partition by series_id order by num_pts) = 1),
dec as (select s.series_id, ok.label, ok.num_pts as best_by, ok.p from (select series_id from user_day where series_id % 5 = 0) s left join ok using (series_id))"""

query("trend_window_dist", f"{_cte('[5]')} select series_id, ref_id, round(dist, 6) + 0.0 as dist from dist")(
    lambda s, d: trend.distances(_own(s, d), _refs(s, d), N, digits=6)
)
query("trend_scores", f"{_cte('[5]')} select series_id, label, round(score, 6) as score from cur")(lambda s, d: _curves(s, d, [N]).select("series_id", "label", _r("score", "score")))
query("trend_scores_all_refs", f"{_cte('range(1, 31)')} select series_id, num_pts, label, round(score, 5) as score from cur")(
    lambda s, d: trend.scores_against(_own(s, d), _refs(s, d), list(range(1, 31))).select("series_id", "num_pts", "label", _r("score", "score", 5))
)
query(
    "trend_centroid_curves",
    f"""with recursive {Q.USER_DAY}, tr as (select series_id, x, (series_id % 3)::int as cluster from user_day where series_id % 5 <> 0), {Q.centroid_ctes('tr', 30, 'cen', 200)},
pre as (select series_id, n::int as n, list_slice(x, 1, n) as s from user_day, unnest(range(1, 31)) t(n) where series_id % 5 = 0),
win as (select cluster as label, n::int as n, list_slice(c, i, i + n - 1) as w from cen, unnest(range(1, 31)) t(n), range(1, 31) o(i) where i <= 30 - n + 1),
dist as (select series_id, p.n, label, least(1.0, min({Q.roll_dist('w', 's', 'len(s)')})) as dist from pre p join win w on p.n = w.n group by all)
select series_id, n as num_pts, label, round(exp(-dist) / sum(exp(-dist)) over (partition by series_id, n), 4) as p from dist""",
)(lambda s, d: _centroid_curves(s, d, list(range(1, 31))).select("series_id", "num_pts", "label", _r("p", "p", 4)))


@query("trend_report_all_refs")
def trend_report_all_refs(s, d):
    """Classification reports for each number of points, with all training series as references."""
    judged = trend.judged(_curves(s, d, list(range(1, 31))), _truth(s, d))
    return evaluation.report_by(judged.withColumnRenamed("label", "p0"), "num_pts", "y", "p0")

query("trend_proba", f"{_cte('[5]')} select series_id, label, round(p, 6) as p from cur")(lambda s, d: _curves(s, d, [N]).select("series_id", "label", _r("p", "p")))
query("trend_predict", f"{_cte('[5]')} select series_id, label, label::int as index, round(p, 6) as p from cur qualify row_number() over (partition by series_id order by round(score, 6) desc, label) = 1")(
    lambda s, d: trend.predict(_curves(s, d, [N])).select("series_id", "label", "index", _r("p", "p"))
)
query("trend_curves", f"{_cte('range(1, 5)')} select series_id, num_pts, label, round(p, 6) as p from cur")(lambda s, d: _curves(s, d, [1, 2, 3, 4]).select("series_id", "num_pts", "label", _r("p", "p")))


def _judged(s, d):
    return trend.judged(_curves(s, d, list(range(1, G + 1))), _truth(s, d))


query("trend_best_by", f"{_cte('range(1, 7)')}, b as (select series_id, num_pts, p_true from j where label = y and p_true > 1.0 / 3 qualify row_number() over (partition by series_id order by num_pts) = 1) select s.series_id, b.num_pts as best_by, round(b.p_true, 6) as conf from (select distinct series_id from j) s left join b using (series_id)")(
    lambda s, d: trend.best_by(_judged(s, d), 3).select("series_id", "best_by", _r("conf", "conf"))
)
query("trend_f1", f"{_LIMITS} select num_pts, k::int as k, round(f1, 6) as f1 from f1")(lambda s, d: trend.f1_by_class(_judged(s, d), LABELS).select("num_pts", "k", _r("f1", "f1")))


def _limits(s, d):
    return trend.thresholds(_judged(s, d), LABELS, 0.4, G)


query("theta_fit", f"{_LIMITS} select k, min_pts, round(theta, 6) as theta from lim")(lambda s, d: _limits(s, d).select("k", "min_pts", _r("theta", "theta")))


def _decisions(s, d):
    c = _curves(s, d, list(range(1, G + 1)))  # one table for the limits and the decisions
    return trend.decide(c, trend.thresholds(trend.judged(c, _truth(s, d)), LABELS, 0.4, G))


query("early_decision", f"{_DECIDE} select series_id, label, best_by, round(p, 6) as p from dec")(lambda s, d: _decisions(s, d).select("series_id", "label", "best_by", _r("p", "p")))

_NAMES = [f"{c}_{p}" for c in ("peak", "left") for p in (25, 50, 75)]


def _mq(xs: str, p: float) -> str:
    h = f"(len({xs}) * {p} + {0.4 + 0.2 * p})"
    k = f"floor(least(greatest({h}, 1), len({xs}) - 1))::int"
    g = f"least(greatest({h} - {k}, 0), 1)"
    return f"case when len({xs}) = 1 then {xs}[1] else (1 - {g}) * {xs}[{k}] + {g} * {xs}[{k} + 1] end"


query(
    "decision_quantiles",
    f"""{_DECIDE}, w as (select unnest(['all', case when label = series_id % 3 then 'correct' else 'incorrect' end]) as which, (list_position(x, list_max(x)) - 1 - best_by - 1)::double as peak,
  coalesce(list_sum(list_slice(x, best_by + 1, 30)) / nullif(list_sum(x), 0), 0) as left_ from dec join user_day using (series_id) where best_by is not null),
g as (select which, count(*) as n, list(peak order by peak) as peak, list(left_ order by left_) as lf from w group by 1)
select which, n, {', '.join(f"round({_mq('peak' if c.startswith('peak') else 'lf', int(c[-2:]) / 100)}, 6) + 0.0 as {c}" for c in _NAMES)} from g""",
)(lambda s, d: trend.decision_report(_decisions(s, d), _own(s, d), _truth(s, d)).select("which", "n", *[_r(c, c) for c in _NAMES]))


def _whole(s, d):
    return trend_pipeline.run(src.user_day(s, d), k=2)


query("trend_pipeline")(lambda s, d: _whole(s, d).decisions)
query("trend_pipeline_report")(lambda s, d: _whole(s, d).report)
