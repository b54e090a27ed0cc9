"""Colour conversions to RGB as column expressions; inputs are clamped to 0..1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(x: Column) -> Column:
    return F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0))


def gray_to_rgb(g: Column) -> Column:
    g = unit(g)
    return F.array(g, g, g)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    rest = 1 - unit(k)
    return F.array(*[(1 - unit(x)) * rest for x in (c, m, y)])


def calibrated_gray(g: Column, gamma: float = 1.0) -> Column:
    v = F.pow(unit(g), F.lit(gamma))
    return F.array(v, v, v)


def calibrated_rgb(a: Column, b: Column, c: Column, gamma=(1.0, 1.0, 1.0), matrix=(1, 0, 0, 0, 1, 0, 0, 0, 1)) -> Column:
    """Gamma for each component, then a row-major 3 x 3 matrix."""
    v = [F.pow(unit(x), F.lit(float(g))) for x, g in zip((a, b, c), gamma, strict=True)]
    return F.array(*[unit(sum((v[j] * float(matrix[3 * i + j]) for j in range(3)), F.lit(0.0))) for i in range(3)])


def lab_to_xyz(lightness: Column, a: Column, b: Column, white=(0.9505, 1.0, 1.089)) -> Column:
    """CIE 1976 L*a*b* to XYZ."""
    fy = (lightness + 16) / 116
    parts = (fy + a / 500, fy, fy - b / 200)
    edge = 6 / 29

    def inverse(t: Column) -> Column:
        return F.when(t > edge, t * t * t).otherwise(3 * edge * edge * (t - 4 / 29))

    return F.array(*[w * inverse(t) for w, t in zip(white, parts, strict=True)])


def srgb_encode(x: Column) -> Column:
    x = unit(x)
    return F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


# XYZ (D65) to linear sRGB.
XYZ_TO_SRGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))


def xyz_to_rgb(xyz: Column) -> Column:
    return F.array(*[srgb_encode(sum((xyz[j] * r[j] for j in range(3)), F.lit(0.0))) for r in XYZ_TO_SRGB])


def exponential(x: Column, c0: float, c1: float, n: float) -> Column:
    """A type 2 function over the domain 0..1."""
    return c0 + F.pow(unit(x), F.lit(float(n))) * (c1 - c0)


def direction(degrees: Column) -> Column:
    """Reading direction of text rotated by so many degrees, within five either way."""
    d = F.pmod(degrees, F.lit(360.0))
    near = lambda a: F.abs(d - a) <= 5
    return (
        F.when(near(0.0) | near(360.0), "left-to-right")
        .when(near(90.0), "bottom-to-top")
        .when(near(180.0), "right-to-left")
        .when(near(270.0), "top-to-bottom")
        .otherwise("rotated")
    )


# The bits of a document's permission flags.
PERMISSIONS = {
    "print": 1 << 2, "modify": 1 << 3, "copy": 1 << 4, "annotate": 1 << 5,
    "fill_forms": 1 << 8, "accessibility": 1 << 9, "assemble": 1 << 10, "print_high": 1 << 11,
}


def permissions(p: Column) -> list[Column]:
    """One boolean column for each permission bit."""
    return [(p.cast("long").bitwiseAND(F.lit(bit)) != 0).alias(f"can_{name}") for name, bit in PERMISSIONS.items()]
