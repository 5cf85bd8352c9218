"""Colour arithmetic as column expressions: sRGB, linear light, CIE LAB (D65) and CIEDE2000."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sRGB primaries under D65, its white point, and the constants of CIE LAB
RGB_TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.95047, 1.0, 1.08883)
EPSILON, KAPPA, OFFSET = 0.008856, 7.787, 16.0 / 116.0


def to_linear(c: Column) -> Column:
    """sRGB in 0 to 1, clipped, to linear light."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(c: Column) -> Column:
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def lab(r: Column, g: Column, b: Column) -> Column:
    """struct(L, A, B) of sRGB bytes."""
    rgb = [to_linear(c / 255.0) for c in (r, g, b)]

    def part(row, white):
        t = (row[0] * rgb[0] + row[1] * rgb[1] + row[2] * rgb[2]) / white
        return F.when(t > EPSILON, F.pow(t, F.lit(1 / 3))).otherwise(KAPPA * t + OFFSET)

    x, y, z = (part(row, white) for row, white in zip(RGB_TO_XYZ, WHITE, strict=True))
    return F.struct((116 * y - 16).alias("L"), (500 * (x - y)).alias("A"), (200 * (y - z)).alias("B"))


def rgb_of_lab(l_star: Column, a_star: Column, b_star: Column) -> Column:
    """struct(r, g, b) of bytes nearest to a LAB colour, channels clipped."""
    y = (l_star + 16) / 116

    def part(f, white):
        return white * F.when(f > EPSILON ** (1 / 3), f * f * f).otherwise((f - OFFSET) / KAPPA)

    xyz = [part(f, white) for f, white in zip((y + a_star / 500, y, y - b_star / 200), WHITE, strict=True)]
    rows = np.linalg.inv(np.array(RGB_TO_XYZ)).tolist()
    channel = lambda row: F.round(to_srgb(row[0] * xyz[0] + row[1] * xyz[1] + row[2] * xyz[2]) * 255).cast("int")
    return F.struct(*(channel(row).alias(n) for row, n in zip(rows, "rgb", strict=True)))


def with_ciede2000(rows: DataFrame, one: tuple[str, str, str], two: tuple[str, str, str], name: str) -> DataFrame:
    """Adds the CIEDE2000 difference of two LAB colours, given as columns (Sharma, Wu and Dalal 2005).

    Each step names its results, so that no expression holds another several times.
    """
    (l1, a1, b1), (l2, a2, b2) = (map(F.col, c) for c in (one, two))
    c = F.col
    turn = lambda b, a: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
    share = lambda x: F.sqrt(F.pow(x, F.lit(7.0)) / (F.pow(x, F.lit(7.0)) + 6103515625.0))  # noqa: E731  25 to the seventh
    apart, both, grey = c("_h2") - c("_h1"), c("_h1") + c("_h2"), c("_c1") * c("_c2") == 0
    wave = lambda n, shift: F.cos(F.radians(n * c("_h") + shift))
    l50 = (c("_l") - 50) * (c("_l") - 50)
    steps = [
        {"_grow": 0.5 * (1 - share((F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2))},
        {"_p1": (1 + c("_grow")) * a1, "_p2": (1 + c("_grow")) * a2},
        {"_c1": F.sqrt(c("_p1") * c("_p1") + b1 * b1), "_c2": F.sqrt(c("_p2") * c("_p2") + b2 * b2), "_h1": turn(b1, c("_p1")), "_h2": turn(b2, c("_p2"))},
        {
            "_dh": F.when(grey, 0.0).when(apart > 180, apart - 360).when(apart < -180, apart + 360).otherwise(apart),
            "_h": F.when(grey, both).when(F.abs(apart) <= 180, both / 2).when(both < 360, (both + 360) / 2).otherwise((both - 360) / 2),
            "_l": (l1 + l2) / 2,
            "_p": (c("_c1") + c("_c2")) / 2,
        },
        {"_t": 1 - 0.17 * wave(1, -30) + 0.24 * wave(2, 0) + 0.32 * wave(3, 6) - 0.20 * wave(4, -63)},
        {
            "_x": (l2 - l1) / (1 + 0.015 * l50 / F.sqrt(20 + l50)),
            "_y": (c("_c2") - c("_c1")) / (1 + 0.045 * c("_p")),
            "_z": 2 * F.sqrt(c("_c1") * c("_c2")) * F.sin(F.radians(c("_dh") / 2)) / (1 + 0.015 * c("_p") * c("_t")),
            "_r": -2 * F.sin(F.radians(60 * F.exp(-F.pow((c("_h") - 275) / 25, F.lit(2.0))))) * share(c("_p")),
        },
        {name: F.sqrt(F.greatest(F.lit(0.0), c("_x") * c("_x") + c("_y") * c("_y") + c("_z") * c("_z") + c("_r") * c("_y") * c("_z")))},
    ]
    for step in steps:
        rows = rows.withColumns(step)
    return rows.drop(*(n for step in steps for n in step if n != name))


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def rgb_of(text: Column) -> Column:
    """struct(r, g, b) of #rrggbb."""
    part = lambda at: F.conv(F.substring(text, at, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def bin_of(r: Column, g: Column, b: Column) -> Column:
    """The cell of a grid of 8 by 8 by 8."""
    cell = lambda c: F.floor(c / 32).cast("int")
    return cell(r) * 64 + cell(g) * 8 + cell(b)
