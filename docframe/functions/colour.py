"""Colour spaces, and ways to put one colour on another. Shares are 0 to 1, samples 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White points. Fixed values.
D50, D65 = (0.9642, 1.0, 0.8249), (0.9505, 1.0, 1.089)
#: Cone responses of the Bradford transform and back, XYZ to linear sRGB. Fixed values.
CONES = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
FROM_CONES = ((0.9869929, -0.1470543, 0.1599627), (0.4323053, 0.5183603, 0.0492912), (-0.0085287, 0.0400428, 0.9684867))
TO_SRGB = ((3.2404542, -1.5371385, -0.4985314), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))


def _rows(matrix, v):
    return [sum((m * x for m, x in zip(row[1:], v[1:], strict=True)), row[0] * v[0]) for row in matrix]


def _product(a, b):
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))


def _adapted(white) -> tuple:
    """XYZ under a white point to linear sRGB, as one matrix."""
    if tuple(white) == D65:
        return TO_SRGB
    here, there = _rows(CONES, list(white)), _rows(CONES, list(D65))
    scaled = tuple(tuple(CONES[i][j] * there[i] / here[i] for j in range(3)) for i in range(3))
    return _product(TO_SRGB, _product(FROM_CONES, scaled))


def _unit(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def _companded(v: Column) -> Column:
    v = _unit(v)
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def xyz(x: Column, y: Column, z: Column, white=D65) -> Column:
    """sRGB shares of a CIE XYZ colour under a white point."""
    return F.struct(*(_unit(_companded(v)).alias(n) for n, v in zip("rgb", _rows(_adapted(white), [x, y, z]), strict=True)))


def lab(lightness: Column, a: Column, b: Column, white=D50) -> Column:
    fy = (lightness + 16) / 116
    cube = lambda t: F.when(t >= 6 / 29, t * t * t).otherwise((t - 4 / 29) * (108 / 841))
    return xyz(white[0] * cube(fy + a / 500), white[1] * cube(fy), white[2] * cube(fy - b / 200), white)


def calibrated(a: Column, b: Column, c: Column, gamma=(1.0, 1.0, 1.0), matrix=(1, 0, 0, 0, 1, 0, 0, 0, 1), white=D65) -> Column:
    """sRGB shares of a calibrated RGB colour: gammas, then the columns of a matrix to XYZ."""
    v = [F.pow(_unit(x), F.lit(float(g))) for x, g in zip((a, b, c), gamma, strict=True)]
    x, y, z = (sum((float(matrix[k + 3 * i]) * v[i] for i in (1, 2)), float(matrix[k]) * v[0]) for k in range(3))
    return xyz(x, y, z, white)


def calibrated_gray(v: Column, gamma: float = 1.0, white=D65) -> Column:
    y = F.pow(_unit(v), F.lit(float(gamma)))
    return xyz(y * white[0], y * white[1], y * white[2], white)


# -- samples ------------------------------------------------------------------------------------


def scaled(a: Column, b: Column) -> Column:
    """a * b / 255, rounded."""
    return F.floor((a.cast("long") * b + 127) / 255).cast("int")


def _byte(v: Column) -> Column:
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")


def _hard(b: Column, s: Column) -> Column:
    bright = 2 * s - 255
    return F.when(s <= 127, scaled(b, 2 * s)).otherwise(b + bright - scaled(b, bright))


def _soft(b: Column, s: Column) -> Column:
    x, y = b / 255, s / 255
    root = F.when(x <= 0.25, ((16 * x - 12) * x + 4) * x).otherwise(F.sqrt(x))
    return _byte(F.when(y <= 0.5, x - (1 - 2 * y) * x * (1 - x)).otherwise(x + (2 * y - 1) * (root - x)) * 255)


def blended(mode: Column, b: Column, s: Column) -> Column:
    """A source sample s on a backdrop sample b, by one of the modes that look at one component; normal for any other."""
    modes = {
        "Multiply": scaled(b, s), "Screen": b + s - scaled(b, s), "Overlay": _hard(s, b), "Darken": F.least(b, s), "Lighten": F.greatest(b, s),
        "ColorDodge": F.when(b == 0, 0).when(s == 255, 255).otherwise(F.least(F.lit(255), F.floor(b * 255 / F.nullif(255 - s, F.lit(0))))),
        "ColorBurn": F.when(b == 255, 255).when(s == 0, 0).otherwise(255 - F.least(F.lit(255), F.floor((255 - b) * 255 / F.nullif(s, F.lit(0))))),
        "HardLight": _hard(b, s), "SoftLight": _soft(b, s), "Difference": F.abs(b - s), "Exclusion": b + s - 2 * scaled(b, s),
    }
    out = s
    for name, v in modes.items():
        out = F.when(mode == name, v).otherwise(out)
    return out.cast("int")


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luminosity(r: Column, g: Column, b: Column) -> Column:
    return 0.3 * r + 0.59 * g + 0.11 * b


def _saturation(c) -> Column:
    return F.greatest(*c) - F.least(*c)


def _with_saturation(c, s: Column):
    """The colour stretched so that its least component is 0 and its greatest s."""
    low, width = F.least(*c), F.nullif(_saturation(c), F.lit(0.0))
    return [F.coalesce((x - low) * s / width, F.lit(0.0)) for x in c]


def _rgb(c, **more) -> Column:
    return F.struct(*(x.alias(k) for k, x in zip("rgb", c, strict=True)), *(x.alias(k) for k, x in more.items()))


def _clipped(c: Column) -> Column:
    """Samples of a colour moved towards its luminosity `light` as far as the components `low` and `high` ask."""
    light, low, high = c["light"], c["low"], c["high"]
    dark = lambda x: F.when((low < 0) & (light != low), light + (x - light) * light / F.nullif(light - low, F.lit(0.0))).otherwise(x)
    bright = lambda x: F.when((high > 1) & (high != light), light + (x - light) * (1 - light) / F.nullif(high - light, F.lit(0.0))).otherwise(x)
    return _rgb([_byte(let(dark(c[k]), bright) * 255) for k in "rgb"])


def blended_whole(mode: Column, backdrop: Column, source: Column) -> Column:
    """A colour (r, g, b samples) on another by Hue, Saturation, Color or Luminosity."""

    def shaped(c: Column) -> Column:
        b, s = [c["b"][k] for k in "rgb"], [c["s"][k] for k in "rgb"]
        hue, saturation = _with_saturation(s, _saturation(b)), _with_saturation(b, _saturation(s))
        pick = lambda k: F.when(mode == "Hue", hue[k]).when(mode == "Saturation", saturation[k]).when(mode == "Color", s[k]).otherwise(b[k])
        return let(_rgb([pick(k) for k in range(3)], target=F.when(mode == "Luminosity", luminosity(*s)).otherwise(luminosity(*b))), moved)

    def moved(c: Column) -> Column:
        by = c["target"] - luminosity(*(c[k] for k in "rgb"))
        return let(_rgb([c[k] + by for k in "rgb"]), measured)

    def measured(c: Column) -> Column:
        parts = [c[k] for k in "rgb"]
        return let(_rgb(parts, light=luminosity(*parts), low=F.least(*parts), high=F.greatest(*parts)), _clipped)

    shares = lambda c: _rgb([c[k] / 255 for k in "rgb"])
    return let(F.struct(shares(backdrop).alias("b"), shares(source).alias("s")), shaped)


def composited(op: Column, source: Column, backdrop: Column) -> Column:
    """A premultiplied colour (r, g, b, a samples) on another by a Porter-Duff operator: in, out, atop, xor or over."""
    sa, da = source["a"], backdrop["a"]
    over, behind = (255 - sa), (255 - da)
    ks = F.when(op.isin("in", "atop"), da).when(op.isin("out", "xor"), behind).otherwise(255)
    kd = F.when(op.isin("in", "out"), 0).otherwise(over)
    return F.struct(*((scaled(source[k], ks) + scaled(backdrop[k], kd)).alias(k) for k in "rgba"))
