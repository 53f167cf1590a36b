"""Colour maps as Spark expressions over values in [0, 1]."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the sRGB standard and its D65 white point.
RGB_TO_XYZ = [[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]]
XYZ_TO_RGB = [[3.2406, -1.5372, -0.4986], [-0.9689, 1.8758, 0.0415], [0.0557, -0.2040, 1.0570]]
WHITE = [0.9505, 1.0, 1.089]

RED, BLUE, GREEN = (0.706, 0.016, 0.150), (0.230, 0.299, 0.754), (0.085, 0.532, 0.201)


def unit(f: Column, low: Column, high: Column) -> Column:
    """(f - low) / (high - low), a range of 0 counting as 1."""
    return (f - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def gray(s: Column) -> Column:
    return rgb(clamp(s), clamp(s), clamp(s))


def jet(s: Column) -> Column:
    """Blue, cyan, yellow, red: three trapezoids a quarter apart."""
    tent = lambda middle: clamp(1.5 - F.abs(4 * s - middle))
    return rgb(tent(3), tent(2), tent(1))


def rgb_to_lab(color: tuple[float, float, float]) -> tuple[float, float, float]:
    linear = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in color]
    x, y, z = (sum(m * c for m, c in zip(row, linear, strict=True)) / w for row, w in zip(RGB_TO_XYZ, WHITE, strict=True))
    root = lambda t: t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116
    return 116 * root(y) - 16, 500 * (root(x) - root(y)), 200 * (root(y) - root(z))


def lab_to_msh(lab) -> tuple[float, float, float]:
    m = math.sqrt(sum(x * x for x in lab))
    return m, math.acos(lab[0] / m) if m > 0.001 else 0.0, math.atan2(lab[2], lab[1])


def angle_between(a: float, b: float) -> float:
    d = abs(a - b) % (2 * math.pi)
    return min(d, 2 * math.pi - d)


def adjusted_hue(msh, m: float) -> float:
    """The hue of an unsaturated end of magnitude m next to the colour msh, turned so that the way between them looks even."""
    if msh[0] >= m - 0.1:
        return msh[2]
    turn = msh[1] * math.sqrt(m * m - msh[0] * msh[0]) / (msh[0] * math.sin(msh[1]))
    return msh[2] + turn if msh[2] > -0.3 * math.pi else msh[2] - turn


def diverging(s: Column, low=BLUE, high=RED) -> Column:
    """Between two colours through white, evenly in Msh space (Moreland, "Diverging color maps for scientific visualization", 2009).

    White of magnitude 88 or more is put in the middle if both ends are saturated and their hues are more than 0.33 pi apart. The ends are constants, so
    only the interpolation and the way back to RGB are columns.
    """
    return let(s, lambda s: _diverging(s, low, high))


def _diverging(s: Column, low, high) -> Column:
    a, b = lab_to_msh(rgb_to_lab(low)), lab_to_msh(rgb_to_lab(high))
    if a[1] > 0.05 and b[1] > 0.05 and angle_between(a[2], b[2]) > 0.33 * math.pi:
        middle = max(a[0], b[0], 88.0)
        halves = [(a, (middle, 0.0, 0.0), 2 * s), ((middle, 0.0, 0.0), b, 2 * s - 1)]
    else:
        halves = [(a, b, s)]
    ways = []
    for p, q, t in halves:
        if p[1] < 0.05 < q[1]:
            p = (p[0], p[1], adjusted_hue(q, p[0]))
        elif q[1] < 0.05 < p[1]:
            q = (q[0], q[1], adjusted_hue(p, q[0]))
        ways.append([x + (y - x) * t for x, y in zip(p, q, strict=True)])
    m, sat, hue = ways[0] if len(ways) == 1 else [F.when(s < 0.5, x).otherwise(y) for x, y in zip(*ways, strict=True)]
    return let(F.struct(m.alias("m"), sat.alias("s"), hue.alias("h")), _msh_to_rgb)


def _msh_to_rgb(msh: Column) -> Column:
    m, sat, hue = msh["m"], msh["s"], msh["h"]
    fy = (m * F.cos(sat) + 16) / 116
    roots = F.struct((m * F.sin(sat) * F.cos(hue) / 500 + fy).alias("x"), fy.alias("y"), (fy - m * F.sin(sat) * F.sin(hue) / 200).alias("z"))
    cube = lambda t: F.when(t * t * t > 0.008856, t * t * t).otherwise((t - 16 / 116) / 7.787)

    def linear(xyz):
        return F.struct(*(sum((c * xyz[k] for c, k in zip(row, "xyz", strict=True)), F.lit(0.0)).alias(name) for row, name in zip(XYZ_TO_RGB, "rgb", strict=True)))

    gamma = lambda c: clamp(F.when(c > 0.0031308, 1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * c))
    white = lambda t: F.struct(*((cube(t[k]) * w).alias(k) for k, w in zip("xyz", WHITE, strict=True)))
    return let(roots, lambda t: let(white(t), lambda xyz: let(linear(xyz), lambda c: rgb(gamma(c["r"]), gamma(c["g"]), gamma(c["b"])))))


def region_color(count: Column, low: Column, high: Column, docked: Column | None = None) -> Column:
    """By a count in a region: dark grey and faint for 0, yellow for a docked component, else diverging over the range of counts; with alpha."""
    shade = diverging(unit(count, low, high))
    with_alpha = lambda c, a: let(c, lambda c: F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), F.lit(a).alias("a")))
    grey, yellow = rgb(F.lit(0.25), F.lit(0.25), F.lit(0.25)), rgb(F.lit(1.0), F.lit(1.0), F.lit(0.0))
    out = F.when(count == 0, with_alpha(grey, 0.2)).otherwise(with_alpha(shade, 1.0))
    return out if docked is None else F.when(docked, with_alpha(yellow, 1.0)).otherwise(out)


def composition_color(a: Column, b: Column, c: Column, totals: tuple[int, int, int]) -> Column:
    """Shares of three groups as red, green, blue: each count over its group's size, then over their sum."""
    shares = [x / F.lit(float(max(t, 1))) for x, t in zip((a, b, c), totals, strict=True)]
    whole = shares[0] + shares[1] + shares[2]
    return rgb(*(F.when(whole == 0, F.lit(0.0)).otherwise(x / whole) for x in shares))


def between(low: Column, high: Column, share: Column) -> Column:
    """The colour at a share of the way between two."""
    return rgb(*(low[k] + (high[k] - low[k]) * share for k in "rgb"))


def vertex_color(f: Column, f1: Column, f2: Column, edge_color, picked: Column, picks: dict[int, tuple[float, float, float]]) -> Column:
    """A vertex's colour: that of its edge's selection if it has one, else the edge's colour (a function of a share) where its value lies between the ends' values."""
    share = F.when(f1 == f2, F.lit(0.0)).otherwise((f - f2) / (f1 - f2))
    out = edge_color(share)
    for group, c in picks.items():
        out = F.when(picked == group, rgb(*map(F.lit, c))).otherwise(out)
    return out


def hsb(hue: Column, saturation: Column, brightness: Column) -> Column:
    """Hue (in turns), saturation and brightness to red, green, blue."""
    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + hue * 6, F.lit(6.0))
        return brightness - brightness * saturation * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return rgb(channel(5), channel(3), channel(1))
