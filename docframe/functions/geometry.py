"""Matrices (a, b, c, d, e, f), boxes (x0, y0, x1, y1) and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "abcdef"


def matrix(*values) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in zip(FIELDS, values, strict=True)))


def concat(m: Column, n: Column) -> Column:
    """First m, then n."""
    g = lambda x: [x[k] for k in FIELDS]
    (a, b, c, d, e, f), (p, q, r, s, t, u) = g(m), g(n)
    return matrix(a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def determinant(m: Column) -> Column:
    return m["a"] * m["d"] - m["b"] * m["c"]


def expansion(m: Column) -> Column:
    return F.sqrt(F.abs(determinant(m)))


def invert(m: Column) -> Column:
    """The inverse; the identity if there is none."""
    det = determinant(m)
    i = F.lit(1.0) / F.nullif(det, F.lit(0.0))
    a, b, c, d = m["d"] * i, -m["b"] * i, -m["c"] * i, m["a"] * i
    return F.when(det == 0, matrix(1, 0, 0, 1, 0, 0)).otherwise(matrix(a, b, c, d, -(m["e"] * a + m["f"] * c), -(m["e"] * b + m["f"] * d)))


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*(c.cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)))


def apply_box(m: Column, r: Column) -> Column:
    """The box of a transformed box."""
    corners = [apply(m, r[x], r[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def is_empty(r: Column) -> Column:
    return (r["x1"] <= r["x0"]) | (r["y1"] <= r["y0"])


def intersect(r: Column, s: Column) -> Column:
    return box(F.greatest(r["x0"], s["x0"]), F.greatest(r["y0"], s["y0"]), F.least(r["x1"], s["x1"]), F.least(r["y1"], s["y1"]))


def union(r: Column, s: Column) -> Column:
    """The box of both; an empty one adds nothing."""
    both = box(F.least(r["x0"], s["x0"]), F.least(r["y0"], s["y0"]), F.greatest(r["x1"], s["x1"]), F.greatest(r["y1"], s["y1"]))
    return F.when(is_empty(r), s).when(is_empty(s), r).otherwise(both)


def contains(r: Column, s: Column) -> Column:
    return (r["x0"] <= s["x0"]) & (r["y0"] <= s["y0"]) & (r["x1"] >= s["x1"]) & (r["y1"] >= s["y1"])


def outer(r: Column) -> Column:
    """The whole pixels that cover a box."""
    return F.struct(F.floor(r["x0"]).alias("x0"), F.floor(r["y0"]).alias("y0"), F.ceil(r["x1"]).alias("x1"), F.ceil(r["y1"]).alias("y1"))


# -- colours ----------------------------------------------------------------------------------


def hex_color(s: Column) -> Column:
    """Red, green, blue, alpha (0..255) of #rgb, #rgba, #rrggbb or #rrggbbaa; null for anything else."""
    h = F.regexp_extract(s, r"^#([0-9A-Fa-f]+)$", 1)
    wide = F.when(F.length(h).isin(3, 4), F.regexp_replace(h, "(.)", "$1$1")).when(F.length(h).isin(6, 8), h)
    full = F.rpad(wide, 8, "f")
    part = lambda k: F.conv(F.substring(full, 2 * k + 1, 2), 16, 10).cast("int")
    return F.when(wide.isNotNull(), F.struct(*(part(k).alias(n) for k, n in enumerate("rgba"))))


def hsl_color(h: Column, s: Column, light: Column) -> Column:
    """Red, green, blue of a hue in degrees and shares of saturation and lightness."""
    c = (1 - F.abs(2 * light - 1)) * s
    k = F.pmod(h, F.lit(360.0)) / 60
    x = c * (1 - F.abs(F.pmod(k, F.lit(2.0)) - 1))
    zero = F.lit(0.0)
    pick = lambda *order: F.when(k < 1, order[0]).when(k < 2, order[1]).when(k < 3, order[2]).when(k < 4, order[3]).when(k < 5, order[4]).otherwise(order[5])
    m = light - c / 2
    to = lambda v: F.floor((v + m) * 255 + 0.5).cast("int")
    return F.struct(to(pick(c, x, zero, zero, x, c)).alias("r"), to(pick(x, c, c, x, zero, zero)).alias("g"), to(pick(zero, zero, x, c, c, x)).alias("b"))


def _gamma(v: Column) -> Column:
    v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def lab_color(lightness: Column, a: Column, b: Column, white: tuple[float, float, float] = (0.9505, 1.0, 1.089)) -> Column:
    """sRGB shares of a CIE L*a*b* colour under a white point near D65."""
    fy = (lightness + 16) / 116
    back = lambda t: F.when(t >= 6 / 29, t * t * t).otherwise((t - 4 / 29) * (108 / 841))
    x, y, z = white[0] * back(fy + a / 500), white[1] * back(fy), white[2] * back(fy - b / 200)
    rows = ((3.2404542, -1.5371385, -0.4985314), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))
    return F.struct(*(_gamma(p * x + q * y + r * z).alias(n) for n, (p, q, r) in zip("rgb", rows, strict=True)))


def exponential(x: Column, c0: list[float], c1: list[float], n: float) -> Column:
    """A tint by C0 + x^N (C1 - C0)."""
    return F.array(*(F.lit(p) + F.pow(x, F.lit(n)) * (q - p) for p, q in zip(c0, c1, strict=True)))
