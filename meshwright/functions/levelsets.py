"""Level-set functions of points (x, y, z): negative inside. Values under 1e-14 become exactly 0."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-14


def snapped(value: Column, flip: bool = False) -> Column:
    v = F.when(F.abs(value) < TINY, F.lit(0.0)).otherwise(value)
    return -v if flip else v


def sphere(radius: float, centre: tuple[float, float, float] = (0.0, 0.0, 0.0), dims: int = 3) -> Column:
    return F.sqrt(sum((F.pow(F.col(a) - c, F.lit(2.0)) for a, c in list(zip("xyz", centre, strict=True))[:dims]), F.lit(0.0))) - radius


def cylinder(radius: float, centre: tuple[float, float] = (0.0, 0.0)) -> Column:
    return sphere(radius, (*centre, 0.0), 2)


#: Fixed values of the surface with holes: the scale of coordinates, three squares and the level.
CHEESE = (1.85, 4.0, 1.2, 12.0)


def cheese_block() -> Column:
    """A surface of degree four with holes along all axes."""
    scale, far, near, level = CHEESE
    sq = {a: F.pow(F.col(a) * scale, F.lit(2.0)) for a in "xyz"}
    pairs = sum((F.pow(sq[a] + sq[b] - far, F.lit(2.0)) for a, b in ("xy", "yz", "zx")), F.lit(0.0))
    return pairs + sum((F.pow(sq[a] - near, F.lit(2.0)) for a in "xyz"), F.lit(0.0)) - level


def distance2(centre: tuple[float, float, float]) -> Column:
    return sum((F.pow(F.col(a) - c, F.lit(2.0)) for a, c in zip("xyz", centre, strict=True)), F.lit(0.0))


def popcorn() -> Column:
    """A sphere with twelve Gaussian bumps, at the corners of an icosahedron."""
    r, sigma, height, q = 0.6, 0.2, 2.0, 0.6 / math.sqrt(5.0)
    ring = lambda turn, z: [(2 * q * math.cos(math.pi * (2 * k - turn) / 5), 2 * q * math.sin(math.pi * (2 * k - turn) / 5), z) for k in range(5)]
    bumps = [*ring(0, q), *ring(1, -q), (0.0, 0.0, r), (0.0, 0.0, -r)]
    return sphere(r) - sum((height * F.exp(-distance2(c) / sigma**2) for c in bumps), F.lit(0.0))


#: Radius and centre of each sphere of ``bullets``.
BULLETS = (
    (0.0735, (0.8541, 0.1336, 0.3054)), (0.0778, (0.8295, 0.5480, 0.4257)), (0.0866, (0.1493, 0.7994, 0.5918)), (0.0861, (0.6865, 0.7326, 0.3160)),
    (0.0712, (0.3190, 0.2573, 0.7543)), (0.0780, (0.4395, 0.3972, 0.8784)), (0.0805, (0.5375, 0.6092, 0.6805)), (0.0783, (0.8471, 0.8776, 0.3776)),
    (0.0831, (0.4355, 0.2306, 0.5659)), (0.0826, (0.8787, 0.7787, 0.1925)), (0.0758, (0.3443, 0.6135, 0.8185)), (0.0786, (0.6577, 0.4030, 0.7976)),
    (0.0703, (0.6304, 0.1800, 0.7491)), (0.0897, (0.5307, 0.4438, 0.3124)), (0.0733, (0.6553, 0.4859, 0.5740)), (0.0721, (0.6306, 0.2026, 0.1256)),
    (0.0774, (0.2477, 0.5702, 0.4414)), (0.0740, (0.2084, 0.2853, 0.3532)), (0.0798, (0.8913, 0.4095, 0.2346)), (0.0768, (0.2422, 0.5651, 0.2482)),
)


def bullets() -> Column:
    """Negative outside of twenty spheres: minus the least of their level sets."""
    return -F.least(*(sphere(r, c) for r, c in BULLETS))


def spiral(zmin: float = 0.0) -> Column:
    """A tube around a helix that begins at ``zmin``: of the helix points at the turn of (x, y), the nearest tube; then both ends."""
    rise, r, rd = 2.0 / 3.0 / (2 * math.pi), 0.20, 0.75
    x, y, z, low, top = F.col("x"), F.col("y"), F.col("z"), zmin + 1.1 * r, 4.5 * math.pi * rise
    tubes = [F.struct(F.lit(1e10).alias("a"), F.lit(-1).alias("k"), F.lit(1e10).alias("d"))]
    for k in range(6):
        alpha = rise * (F.atan2(y, x) + k * math.pi)
        d = F.sqrt(F.pow(x - rd * F.cos(alpha / rise), F.lit(2.0)) + F.pow(y - rd * F.sin(alpha / rise), F.lit(2.0)) + F.pow(z - alpha - low, F.lit(2.0))) - r
        tubes.append(F.when((alpha >= 0) & (alpha <= top), F.struct(F.abs(d).alias("a"), F.lit(k).alias("k"), d.alias("d"))))
    out = F.array_min(F.array(*tubes))["d"]
    first = F.sqrt(F.pow(x - rd, F.lit(2.0)) + F.pow(z - low, F.lit(2.0))) - r
    out = F.when((first < out) & (y <= 0), first).otherwise(out)
    last = F.sqrt(F.pow(y - rd, F.lit(2.0)) + F.pow(z - low - top, F.lit(2.0))) - r
    return F.when((last < out) & (x <= 0), last).otherwise(out)


GALLERY = {"sphere": sphere, "cylinder": cylinder, "cheese_block": cheese_block, "popcorn": popcorn, "bullets": bullets, "spiral": spiral}


def by_name(name: str, *args, flip: bool = False) -> Column:
    if name not in GALLERY:
        raise ValueError(f"no level set is called {name}; there are {sorted(GALLERY)}")
    return snapped(GALLERY[name](*args), flip)
