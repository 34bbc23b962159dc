"""Colour and intensity expressions: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channels() -> tuple[Column, Column, Column]:
    return F.col("red"), F.col("green"), F.col("blue")


def gray() -> Column:
    """Luminance in 0..1."""
    r, g, b = channels()
    return (F.lit(0.2125) * r + F.lit(0.7154) * g + F.lit(0.0721) * b) / 255.0


def gray8() -> Column:
    """Luminance cut to 0..255."""
    return F.floor(gray() * 255).cast("int")


def nine_variances() -> Column:
    """Nine times the population variance of the three channels, an integer."""
    r, g, b = channels()
    return 3 * (r * r + g * g + b * b) - (r + g + b) * (r + g + b)


def spread_between(low: float | None, high: float | None) -> Column:
    """Whether the standard deviation of the three channels lies strictly between the bounds."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & ((nine_variances() > 9 * low * low) if low >= 0 else F.lit(True))
    if high is not None:
        inside = inside & (nine_variances() < 9 * high * high)
    return inside


#: Rows of linear colour spaces, over channels of 0..1 (fixed values).
LINEAR = {
    "YUV": ((0.299, 0.587, 0.114), (-0.14714119, -0.28886916, 0.43601035), (0.61497538, -0.51496512, -0.10001026)),
    "YIQ": ((0.299, 0.587, 0.114), (0.59590059, -0.27455667, -0.32134392), (0.21153661, -0.52273617, 0.31119955)),
    "YPbPr": ((0.299, 0.587, 0.114), (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312)),
    "YCbCr": ((65.481, 128.553, 24.966), (-37.797, -74.203, 112.0), (112.0, -93.786, -18.214)),
    "RGB CIE": ((0.13725255, 0.08542863, 0.02730888), (0.03085069, 0.13949937, 0.02949094), (-0.00226263, 0.01286503, 0.16873715)),
}
OFFSETS = {"YCbCr": (16.0, 128.0, 128.0)}
#: XYZ of linear RGB (fixed values).
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))


def _sum(weights: tuple[float, ...], parts: tuple[Column, ...], offset: float = 0.0) -> Column:
    a, b, c = (F.lit(w) * p for w, p in zip(weights, parts))
    return a + b + c + offset if offset else a + b + c


def hsv() -> tuple[Column, Column, Column]:
    r, g, b = (x / 255.0 for x in channels())
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    turn = F.when(d == 0, 0.0).when(r == top, F.try_divide(g - b, d)).when(g == top, 2.0 + F.try_divide(b - r, d)).otherwise(4.0 + F.try_divide(r - g, d)) / 6.0
    hue = F.when(turn < 0, turn + 1.0).otherwise(turn)
    return hue, F.when(top == 0, 0.0).otherwise(F.try_divide(d, top)), top


def converted(space: str) -> tuple[Column, Column, Column]:
    """The three channels in a colour space; RGB stays raw, 0..255."""
    if space == "RGB":
        return tuple(x.cast("double") for x in channels())
    if space == "HSV":
        return hsv()
    parts = tuple(x / 255.0 for x in channels())
    if space == "XYZ":
        linear = tuple(F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, F.lit(2.4))).otherwise(x / 12.92) for x in parts)
        return tuple(_sum(row, linear) for row in XYZ)
    if space not in LINEAR:
        raise ValueError(f"no such colour space: {space}")
    return tuple(_sum(row, parts, o) for row, o in zip(LINEAR[space], OFFSETS.get(space, (0.0, 0.0, 0.0))))


#: Published stain vectors (fixed values); a zero third vector is completed to be orthogonal.
STAINS = {
    "hed": ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78)),
    "hdx": ((0.650, 0.704, 0.286), (0.268, 0.570, 0.776), (0.0, 0.0, 0.0)),
    "fgx": ((0.46420921, 0.83008335, 0.30827187), (0.94705542, 0.25373821, 0.19650764), (0.0, 0.0, 0.0)),
    "bex": ((0.834750233, 0.513556283, 0.196330403), (0.092789, 0.954111, 0.283111), (0.0, 0.0, 0.0)),
    "rbd": ((0.21393921, 0.85112669, 0.47794022), (0.74890292, 0.60624161, 0.26731082), (0.268, 0.570, 0.776)),
    "gdx": ((0.98003, 0.144316, 0.133146), (0.268, 0.570, 0.776), (0.0, 0.0, 0.0)),
    "hax": ((0.650, 0.704, 0.286), (0.2743, 0.6796, 0.6803), (0.0, 0.0, 0.0)),
    "bro": ((0.853033, 0.508733, 0.112656), (0.09289875, 0.8662008, 0.49098468), (0.10732849, 0.36765403, 0.9237484)),
    "bpx": ((0.7995107, 0.5913521, 0.10528667), (0.09997159, 0.73738605, 0.6680326), (0.0, 0.0, 0.0)),
    "ahx": ((0.874622, 0.457711, 0.158256), (0.552556, 0.7544, 0.353744), (0.0, 0.0, 0.0)),
    "hpx": ((0.644211, 0.716556, 0.266844), (0.175411, 0.972178, 0.154589), (0.0, 0.0, 0.0)),
}


def unmixing(stain: str) -> list[list[float]]:
    """The matrix from optical densities to stain concentrations."""
    if stain not in STAINS:
        raise ValueError(f"no such stain: {stain}")
    a, b, c = (list(v) for v in STAINS[stain])
    if not any(c):
        cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
        length = sum(x * x for x in cross) ** 0.5
        c = [x / length for x in cross]
    m = (a, b, c)
    det = sum(m[0][i] * (m[1][(i + 1) % 3] * m[2][(i + 2) % 3] - m[1][(i + 2) % 3] * m[2][(i + 1) % 3]) for i in range(3))
    cof = [[m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]
    return [[cof[j][i] / det for j in range(3)] for i in range(3)]


def stain_channels(stain: str = "hed") -> tuple[Column, Column, Column]:
    """Concentrations of the three stains, not under 0."""
    m = unmixing(stain)
    floor = F.lit(1e-6)
    density = tuple(F.ln(F.greatest(x / 255.0, floor)) / F.ln(floor) for x in channels())
    return tuple(F.greatest(F.lit(0.0), _sum(tuple(m[i][j] for i in range(3)), density)) for j in range(3))
