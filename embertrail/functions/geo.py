"""Camera rays, ground hits and triangulation as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The thermal camera. Focal lengths and centre in pixels of a 640 x 512 image.
FOCAL_X, FOCAL_Y = 9.1 * 640 / 7.68, 9.1 * 512 / 6.144
CENTRE_X, CENTRE_Y = 320.0, 256.0
# Guards.
MIN_DOWN_DEG, MIN_DISTANCE_DOWN_M, MIN_SLOPE, MAX_RANGE_M, RAY_STEPS = 15.0, 10.0, 1e-6, 1000.0, 1000
EARTH_M = 6378137.0

Vector = tuple[Column, Column, Column]


def camera_ray(px: Column, py: Column) -> Vector:
    """Unit ray of a pixel in camera axes (right, up, forward)."""
    x, y = (px - CENTRE_X) / FOCAL_X, -(py - CENTRE_Y) / FOCAL_Y
    n = F.sqrt(x * x + y * y + 1)
    return x / n, y / n, F.lit(1.0) / n


def to_world(ray: Vector, down_deg: Column, yaw_deg: Column) -> Vector:
    """Camera axes turned down and then by yaw: (east, up, north)."""
    x, y, z = ray
    p, w = F.radians(down_deg), F.radians(yaw_deg)
    up = y * F.cos(p) - z * F.sin(p)
    ahead = y * F.sin(p) + z * F.cos(p)
    return x * F.cos(w) + ahead * F.sin(w), up, -x * F.sin(w) + ahead * F.cos(w)


def flat_hit(east: Column, north: Column, altitude: Column, ray: Vector, ground: Column) -> tuple[Column, Column]:
    """Where a ray meets level ground: (easting, northing); null for rays that do not go down or run too far."""
    dx, dy, dz = ray
    t = F.when(dy < -MIN_SLOPE, (altitude - ground) / -dy)
    t = F.when(F.sqrt((t * dx) * (t * dx) + (t * dz) * (t * dz)) <= MAX_RANGE_M, t)
    return east + t * dx, north + t * dz


def distance(n1: Column, e1: Column, n2: Column, e2: Column) -> Column:
    return F.sqrt((n1 - n2) * (n1 - n2) + (e1 - e2) * (e1 - e2))


def confidence(mean_shift_m: Column) -> Column:
    """Of a hit, from the mean shift that one pixel makes."""
    return F.lit(1.0) / (F.lit(1.0) + mean_shift_m)


def to_lat_lon(north_m: Column, east_m: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Local metres to degrees around an origin (equirectangular; the projection is this engine's own choice)."""
    import math

    per_degree = math.pi * EARTH_M / 180
    return F.lit(lat0) + north_m / per_degree, F.lit(lon0) + east_m / (per_degree * math.cos(math.radians(lat0)))


def normal_sums(ce: Column, cn: Column, ca: Column, de: Column, dn: Column, da: Column) -> list[Column]:
    """The nine sums that triangulation needs: P = I - dd'/d'd is summed, and P C."""
    dd = de * de + dn * dn + da * da
    d, c = (de, dn, da), (ce, cn, ca)
    p = [[(F.lit(1.0) if i == j else F.lit(0.0)) - d[i] * d[j] / dd for j in range(3)] for i in range(3)]
    sums = [F.sum(p[i][j]).alias(f"p{i}{j}") for i in range(3) for j in range(i, 3)]
    return sums + [F.sum(p[i][0] * c[0] + p[i][1] * c[1] + p[i][2] * c[2]).alias(f"q{i}") for i in range(3)]


def solve_point() -> tuple[Column, Column, Column]:
    """Cramer's rule on the sums; null for rays that are all parallel."""
    a = {(i, j): F.col(f"p{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}
    q = [F.col(f"q{i}") for i in range(3)]

    def det(m) -> Column:
        return m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))

    whole = det(lambda i, j: a[i, j])
    return tuple(F.when(F.abs(whole) > 1e-12, det(lambda i, j, k=k: q[i] if j == k else a[i, j]) / whole) for k in range(3))
