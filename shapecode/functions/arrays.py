"""Array-column building blocks (JVM higher-order functions, no Python UDFs).

All builders return Spark SQL expression text for ``F.expr``; they operate
inside one row, so they add no shuffle.  Floating-point operations are
written in a fixed left-to-right order so results are reproducible.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def fence(df):
    """Stop filters and projections above from being inlined into ``df``'s expressions.

    Catalyst pushes a filter on a computed column below the projection that
    computes it, duplicating the expression; for the coding pipeline that
    would run the nearest-code search twice.  A one-element ``inline`` is a
    generator node, which predicates on its output cannot cross.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def taper_values(w: int) -> list[float]:
    """Hann taper ``sin^2(pi i / (w-1))``, ``i = 0..w-1``."""
    out = []
    for i in range(w):
        y = math.sin(math.pi * i / (w - 1.0))
        out.append(y * y)
    return out


def double_literal(x: float) -> str:
    """Exact Spark SQL double literal (17 significant digits)."""
    return format(float(x), ".17E") + "D"


def array_literal(values: list[float]) -> str:
    return "array(" + ", ".join(double_literal(v) for v in values) + ")"


def taper_column(w: int) -> Column:
    return F.expr(array_literal(taper_values(w)))


def sum_expr(arr: str) -> str:
    return f"aggregate({arr}, 0D, (a, v) -> a + v)"


def sumsq_expr(arr: str) -> str:
    return f"aggregate({arr}, 0D, (a, v) -> a + v * v)"


def windows_expr(frame: str, w: int, n: int | None) -> str:
    """W3 inside a row: ``2n-1`` half-overlapping windows of a frame (``n = None``: as many as it holds)."""
    last = 2 * n - 2 if n else f"2 * CAST(size({frame}) / {w} AS INT) - 2"
    return f"transform(sequence(0, {last}), k -> slice({frame}, k * {w // 2} + 1, {w}))"


def means_expr(wins: str, w: int) -> str:
    """A3 per window."""
    return f"transform({wins}, x -> {sum_expr('x')} / {w})"


def norms_expr(wins: str) -> str:
    """A4 per window (norm of the un-centred window)."""
    return f"transform({wins}, x -> sqrt({sumsq_expr('x')}))"


def centered_features_expr(wins: str, avgs: str, nrms: str, taper: str) -> str:
    """P7 + W5: ``((x - mean) / ||x||) * taper``; NULL for an all-zero window."""
    return (f"transform(sequence(0, size({wins}) - 1), k -> IF({nrms}[k] = 0D, NULL, "
            f"zip_with(transform({wins}[k], v -> (v - {avgs}[k]) / {nrms}[k]), {taper}, (a, b) -> a * b)))")


def tapered_windows_expr(wins: str, taper: str) -> str:
    """P8 first step: taper the raw window."""
    return f"transform({wins}, x -> zip_with(x, {taper}, (a, b) -> a * b))"


def tapered_features_expr(twins: str, tnrms: str) -> str:
    """Tapered window divided by its own norm; NULL for zero norm."""
    return (f"transform(sequence(0, size({twins}) - 1), k -> IF({tnrms}[k] = 0D, NULL, "
            f"transform({twins}[k], v -> v / {tnrms}[k])))")


def sqdist_expr(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, c) -> (x - c) * (x - c)), 0D, (s, v) -> s + v)"


def nearest_expr(feats: str, book: str) -> str:
    """Nearest code per feature vector; ties go to the lowest code.

    ``book`` is ``array<struct<code:int, center:array<double>>>``.  The
    minimum over ``struct(d, code, center)`` orders by distance, then code.
    """
    return (f"transform({feats}, f -> IF(f IS NULL OR {book} IS NULL, NULL, array_min(transform({book}, "
            f"b -> named_struct('d', {sqdist_expr('f', 'b.center')}, 'code', b.code, 'center', b.center)))))")


def centers_expr(best: str, w: int) -> str:
    """Chosen centres; a window without a code contributes zeros."""
    return f"transform({best}, b -> IF(b IS NULL, array_repeat(0D, {w}), b.center))"


def reconstruct_centered_expr(cents: str, avgs: str, nrms: str, w: int) -> str:
    """Segment j = (C[j-1][H..W) + C[j][0..H)) * nrm_j + mean_j, j = 1..2n-2
    (empty for a one-window frame; ``sequence(1, 0)`` would count down)."""
    h = w // 2
    return (f"IF(size({cents}) < 2, CAST(array() AS array<double>), "
            f"flatten(transform(sequence(1, size({cents}) - 1), j -> zip_with("
            f"slice({cents}[j - 1], {h + 1}, {h}), slice({cents}[j], 1, {h}), "
            f"(p, q) -> (p + q) * {nrms}[j] + {avgs}[j]))))")


def reconstruct_tapered_expr(cents: str, tnrms: str, w: int) -> str:
    """Each centre scaled by its own window's tapered norm, halves summed."""
    h = w // 2
    return (f"IF(size({cents}) < 2, CAST(array() AS array<double>), "
            f"flatten(transform(sequence(1, size({cents}) - 1), j -> zip_with("
            f"slice({cents}[j - 1], {h + 1}, {h}), slice({cents}[j], 1, {h}), "
            f"(p, q) -> p * {tnrms}[j - 1] + q * {tnrms}[j]))))")


def residual_expr(src: str, coded: str) -> str:
    """W9."""
    return f"zip_with({src}, {coded}, (a, b) -> a - b)"


def max_abs_expr(arr: str) -> str:
    """A5: largest absolute value (= sqrt(max(min^2, max^2)))."""
    return f"array_max(transform({arr}, x -> abs(x)))"
