"""Kernels on series (array<double> columns), as SQL expression text.

Arguments and results are expression text, so that kernels nest and stay in the plan as built-in
expressions. Use :func:`col` to turn a result into a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(expression: str) -> Column:
    return F.expr(expression)


def dot(a: str, b: str) -> str:
    """Inner product, summed left to right; empty: 0."""
    return f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, v) -> s + v)"


def sqsum(a: str) -> str:
    return f"aggregate({a}, 0D, (s, v) -> s + v * v)"


def total(a: str) -> str:
    return f"aggregate({a}, 0D, (s, v) -> s + v)"


def norm(a: str) -> str:
    return f"sqrt({sqsum(a)})"


def roll(x: str, q: str) -> str:
    """out[(i + q) mod T] = x[i]; empty stays empty."""
    p = f"coalesce(try_mod(try_mod({q}, size({x})) + size({x}), size({x})), 0)"
    return f"concat(slice({x}, size({x}) - {p} + 1, {p}), slice({x}, 1, size({x}) - {p}))"


def drop(x: str, q: str) -> str:
    """Shift with zero fill: right for q > 0, left for q < 0; all zeros from |q| = T on."""
    n = f"least(abs({q}), size({x}))"
    kept = f"size({x}) - {n}"
    zeros = f"array_repeat(0D, {n})"
    return f"if({q} >= 0, concat({zeros}, slice({x}, 1, {kept})), concat(slice({x}, {n} + 1, {kept}), {zeros}))"


def shift_dist(x: str, y: str, q: str, rolling: bool) -> str:
    """Distance of x from the best multiple of y shifted by q, relative to the norm of x."""
    s = roll(y, q) if rolling else drop(y, q)
    alpha = f"coalesce(try_divide({dot(x, 'y_')}, {sqsum('y_')}), 0D)"
    rest = f"sqrt(aggregate(zip_with({x}, y_, (p, r) -> (p - al_ * r) * (p - al_ * r)), 0D, (z, v) -> z + v))"
    dist = f"case when size({x}) = 0 then 0D when {sqsum(x)} = 0 then if({sqsum('y_')} = 0, 0D, 1D) else {rest} / {norm(x)} end"
    return f"transform(array({s}), y_ -> transform(array({alpha}), al_ -> {dist})[0])[0]"  # the shifted series and its multiple are bound once


def roll_dist(x: str, y: str) -> str:
    """struct(dist, alpha, shift): least distance over all rotations of y. Closed form; the smallest rotation in [-T + 1, 0] wins ties."""
    dots = f"transform(sequence(least(1 - size({x}), 0), 0), q -> named_struct('d', {dot(x, f'slice(concat({y}, {y}), 1 - q, size({x}))')}, 'q', q))"
    best = f"array_min(transform({dots}, m -> named_struct('k', -m.d * m.d, 'q', m.q, 'd', m.d)))"
    return (
        f"transform(array({best}), m -> case when size({x}) = 0 then named_struct('dist', 0D, 'alpha', 0D, 'shift', 0) "
        f"when {sqsum(x)} = 0 then named_struct('dist', if({sqsum(y)} = 0, 0D, 1D), 'alpha', 0D, 'shift', 0) "
        f"when {sqsum(y)} = 0 or m.d = 0 then named_struct('dist', 1D, 'alpha', 0D, 'shift', 0) "
        f"else named_struct('dist', sqrt(greatest(0D, 1 + m.k / ({sqsum(x)} * {sqsum(y)}))), 'alpha', m.d / {sqsum(y)}, 'shift', m.q) end)[0]"
    )


def drop_dist(x: str, y: str) -> str:
    """Least distance over all zero-filled shifts of y; not symmetric."""
    t = f"size({x})"
    a = f"if(q >= 0, slice({x}, q + 1, {t} - q), slice({x}, 1, {t} + q))"
    b = f"if(q >= 0, slice({y}, 1, {t} - q), slice({y}, 1 - q, {t} + q))"
    gain = f"array_max(transform(sequence(least(1 - {t}, 0), greatest({t} - 1, 0)), q -> coalesce(try_divide(pow({dot(a, b)}, 2), {sqsum(b)}), 0D)))"
    return f"case when {t} = 0 then 0D when {sqsum(x)} = 0 then if({sqsum(y)} = 0, 0D, 1D) else sqrt(greatest(0D, 1 - {gain} / {sqsum(x)})) end"


def haar(x: str) -> str:
    """struct(wavelet, coefficient): pair means and half differences; an odd tail is paired with 0."""
    places = f"if(size({x}) = 0, array(), sequence(0, (size({x}) + 1) div 2 - 1))"
    side = lambda sign: f"transform({places}, i -> (get({x}, 2 * i) {sign} coalesce(get({x}, 2 * i + 1), 0D)) / 2)"
    return f"named_struct('wavelet', {side('+')}, 'coefficient', {side('-')})"


def haar_inverse(w: str, c: str, length: str | None = None) -> str:
    """Null for unequal lengths. Without ``length`` 2n values are kept for even n or n = 1, else 2n - 1."""
    n = length or f"if(size({w}) % 2 = 0 or size({w}) = 1, 2 * size({w}), 2 * size({w}) - 1)"
    return f"if(size({w}) <> size({c}), null, slice(flatten(zip_with({w}, {c}, (a, b) -> array(a + b, a - b))), 1, {n}))"


def argmax(x: str) -> str:
    """Place (from 0) of the first maximum."""
    return f"cast(array_position({x}, array_max({x})) - 1 as int)"


def argmin(x: str) -> str:
    return f"cast(array_position({x}, array_min({x})) - 1 as int)"


def center_peak(x: str) -> str:
    return roll(x, f"(size({x}) div 2 - {argmax(x)})")


def min_first(x: str) -> str:
    return roll(x, f"(-{argmin(x)})")


def scale(x: str, by: str) -> str:
    """x / by; zeros where ``by`` is 0."""
    return f"transform({x}, v -> coalesce(try_divide(v, {by}), 0D))"


def rounded(x: str, digits: int = 6) -> str:
    return f"transform({x}, v -> round(v, {digits}) + 0D)"


def mquantile(xs: str, p: float) -> str:
    """Quantile of a sorted array with plotting positions alpha = beta = 0.4; null if empty."""
    n, h = f"size({xs})", f"(size({xs}) * {p}D + {0.4 + 0.2 * p}D)"
    k = f"cast(floor(least(greatest({h}, 1), {n} - 1)) as int)"
    g = f"least(greatest({h} - {k}, 0), 1)"
    return f"case when {n} = 0 then null when {n} = 1 then get({xs}, 0) else (1 - {g}) * get({xs}, {k} - 1) + {g} * get({xs}, {k}) end"
