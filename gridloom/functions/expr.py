"""Column expressions: rounding and class rules, colour spaces, size formulas, kernels of interpolation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luma weights of the gray conversion, and the constants of the size colour.
GRAY_WEIGHTS = (0.298936021293775, 0.587043074451121, 0.114020904255103)
COLOUR_TOP, COLOUR_AREA = 10000.0, 1000.0
PIXEL_LENGTH = 1.1794

#: Least and greatest value of each pixel class.
CLASS_RANGE = {"uint8": (0, 255), "uint16": (0, 65535), "int16": (-32768, 32767), "logical": (0, 1)}


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def round_half_away(x: Column | str) -> Column:
    """Half away from zero, spelled out: built-in rounding differs just under a half."""
    x = col(x)
    return F.signum(x) * F.floor(F.abs(x) + F.lit(0.5))


def saturate(x: Column | str, kind: str = "uint8") -> Column:
    """Round and clip to an integer pixel class; nothing ever overflows."""
    low, high = CLASS_RANGE[kind]
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), round_half_away(x))).cast("bigint")


def to_unit(v: Column | str, kind: str = "uint8") -> Column:
    """A pixel class on [0, 1]."""
    low, high = CLASS_RANGE[kind]
    return (col(v).cast("double") - (low if low < 0 else 0)) / (high - (low if low < 0 else 0))


def from_unit(x: Column | str) -> Column:
    return saturate(col(x) * 255.0)


def gray(red: Column | str, green: Column | str, blue: Column | str) -> Column:
    a, b, c = GRAY_WEIGHTS
    return saturate(col(red) * a + col(green) * b + col(blue) * c)


def complement(v: Column | str, kind: str = "uint8") -> Column:
    """Not for logical, maximum less v for unsigned, bit complement for signed, one less v for floats."""
    v = col(v)
    if kind == "logical":
        return 1 - v
    if kind in ("double", "single"):
        return F.lit(1.0) - v
    low, high = CLASS_RANGE[kind]
    return -1 - v if low < 0 else high - v


def cmy(band: Column | str) -> Column:
    return F.lit(1.0) - col(band)


def cmyk(red: Column, green: Column, blue: Column, removal: float = 1.0, black: float = 1.0) -> dict[str, Column]:
    c, m, y = cmy(red), cmy(green), cmy(blue)
    least = F.least(c, m, y)
    return {"cyan": c - removal * least, "magenta": m - removal * least, "yellow": y - removal * least, "black": black * least}


def hsi(red: Column, green: Column, blue: Column, full_circle: bool = False) -> dict[str, Column]:
    """Intensity, and hue and saturation from the two chromatic axes; hue of a gray is NaN unless full circle."""
    v1 = (-red - green + 2 * blue) / math.sqrt(6)
    v2 = (red - green) / math.sqrt(6) if full_circle is None else (red - green) / math.sqrt(2)
    hue = F.atan2(v2, v1) if full_circle else F.when(v1 == 0, F.when(v2 == 0, F.lit(float("nan"))).otherwise(F.signum(v2) * (math.pi / 2))).otherwise(F.atan(F.try_divide(v2, v1)))
    return {"hue": hue, "saturation": F.sqrt(v1 * v1 + v2 * v2), "intensity": (red + green + blue) / 3.0}


def size_colour(area: Column | str) -> Column:
    """Colour index of a piece by its area."""
    return (COLOUR_TOP * (1 - F.exp(-col(area) / COLOUR_AREA))).cast("bigint")


def colour_size(colour: Column | str) -> Column:
    """The area that a colour index stands for."""
    return (-round_half_away(COLOUR_AREA * F.log(1 - col(colour) / COLOUR_TOP))).cast("bigint")


def caliper_diameter(area: Column | str, scale: float = 1.0) -> Column:
    """Diameter of the disk of equal area."""
    return F.sqrt(4 * col(area) * scale * scale / math.pi)


def keys_kernel(x: Column, a: float = -0.5) -> Column:
    """Cubic convolution kernel."""
    d = F.abs(x)
    near = (a + 2) * d * d * d - (a + 3) * d * d + 1
    far = a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a
    return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)


def power_law(x: Column | str, scale: float | Column, exponent: float | Column) -> Column:
    return col(scale) * F.pow(col(x), -col(exponent))


def truncated_power_law(x: Column | str, scale: float, exponent: float, top: float) -> Column:
    return scale * (F.pow(col(x), F.lit(-exponent)) - top**-exponent)


def weibull_survival(x: Column | str, shape: float, scale: float) -> Column:
    return F.exp(-F.pow(col(x) / scale, F.lit(shape)))


def number_text(x: Column | str) -> Column:
    """Whole numbers plainly, others with max(floor(log10|x|) + 5, 5) significant digits and no trailing noughts."""
    x = col(x).cast("double")
    digits = F.greatest(F.floor(F.log10(F.abs(x))) + 5, F.lit(5))
    places = (digits - 1 - F.floor(F.log10(F.abs(x)))).cast("int")
    scaled = F.expr("0.0")
    for k in range(4, 16):
        scaled = F.when(places == k, F.format_string(f"%.{k}f", x)).otherwise(scaled.cast("string"))
    trimmed = F.regexp_replace(F.regexp_replace(scaled, "0+$", ""), "\\.$", "")
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(trimmed)


def colon(start: float, step: float, stop: float) -> Column:
    """start, start + step, ... up to stop, with the count computed once and a few units of rounding forgiven."""
    n = math.floor((stop - start) / step * (1 + 4 * 2.2e-16) + 1e-10) if step else -1
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.lit(start) + k * step) if n >= 0 else F.array().cast("array<double>")


def pixel_distance(dr: Column, dc: Column, metric: str = "euclidean") -> Column:
    if metric == "euclidean":
        return F.sqrt((dr * dr + dc * dc).cast("double"))
    return F.abs(dr) + F.abs(dc) if metric == "cityblock" else F.greatest(F.abs(dr), F.abs(dc))
