"""Pieces of DuckDB SQL for the queries' oracles."""

from __future__ import annotations

ROUND = "round({}, 6) + 0.0"


def _counts(expr: str, n: int, value: str = "count(*)") -> str:
    return "[" + ", ".join(f"coalesce({value} filter ({expr} = {i}), 0)::double" for i in range(n)) + "]"


USER_HOUR = f"user_hour as (select user_id as series_id, {_counts('hour(ts)', 24)} as x from events group by 1)"
USER_DAY = f"user_day as (select user_id as series_id, {_counts(chr(100) + 'atediff(' + chr(39) + 'day' + chr(39) + ', date ' + chr(39) + '2024-01-01' + chr(39) + ', ts::date)', 30)} as x from events group by 1)"
SUPP_MONTH = f"supplier_month as (select l_suppkey as series_id, {_counts('(year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1', 83, 'sum(l_quantity)')} as x from lineitem group by 1)"


def roll(x: str, q: str) -> str:
    p = f"((({q}) % len({x}) + len({x})) % len({x}))"
    return f"(list_slice({x}, len({x}) - {p} + 1, len({x})) || list_slice({x}, 1, len({x}) - {p}))"


def drop(x: str, q: str) -> str:
    zeros = f"list_transform(range(least(abs({q}), len({x}))), lambda z: 0.0::double)"
    return f"(case when {q} >= 0 then {zeros} || list_slice({x}, 1, len({x}) - least(abs({q}), len({x}))) else list_slice({x}, least(abs({q}), len({x})) + 1, len({x})) || {zeros} end)"


def dot(a: str, b: str) -> str:
    return f"coalesce(list_dot_product({a}, {b}), 0)"


def roll_best(x: str, y: str, t: str) -> str:
    """Largest squared product over rotations."""
    return f"list_max(list_transform(range(1 - {t}, 1), lambda q: pow(list_dot_product({x}, list_slice({y} || {y}, 1 - q, {t} - q)), 2)))"


def roll_dist(x: str, y: str, t: str) -> str:
    nx, ny = f"list_dot_product({x}, {x})", f"list_dot_product({y}, {y})"
    return f"(case when {nx} = 0 then case when {ny} = 0 then 0.0 else 1.0 end when {ny} = 0 then 1.0 else sqrt(greatest(0.0, 1 - {roll_best(x, y, t)} / ({nx} * {ny}))) end)"


def rounded(x: str, digits: int = 6) -> str:
    return f"list_transform({x}, lambda v: round(v, {digits}) + 0.0)"


def centroid_ctes(source: str, t: int, name: str = "centroid", steps: int = 80) -> str:
    """CTEs from ``source`` (x, cluster; x rotated already) to ``name`` (cluster, c): power iteration on the Gram matrix."""
    return f"""
{name}_n as (select cluster, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) as u from {source} where list_dot_product(x, x) > 0),
{name}_g as (select cluster, i, j, sum(u[i] * u[j]) as v from {name}_n, range(1, {t + 1}) a(i), range(1, {t + 1}) b(j) group by all),
{name}_r as (select cluster, i, list(v order by j) as r from {name}_g group by all),
{name}_m as (select cluster, list(r order by i) as m from {name}_r group by 1),
{name}_p as (
  select cluster, m, 0 as n, list_transform(range({t}), lambda z: 1.0 / sqrt({t})) as c from {name}_m
  union all
  select cluster, m, n + 1, list_transform(w, lambda v: v / sqrt(list_dot_product(w, w))) from (select cluster, m, n, list_transform(m, lambda r: list_dot_product(r, c)) as w from {name}_p where n < {steps})
),
{name} as (select cluster, c from {name}_p where n = {steps})"""
