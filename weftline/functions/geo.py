"""Geometry as column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
EARTH_MEAN_KM = 6371.0088
MAX_LAT = 85.05112878
WGS84_A, WGS84_F = 6378.137, 1 / 298.257223563
GOLDEN_ANGLE = 2.399963229728653


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    """Great-circle kilometres between positions in degrees; null without one of them."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    # least and greatest pass nulls over, so a missing position must be left out before
    return F.when(h.isNotNull(), 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))))


def mercator(lat, lon) -> tuple[Column, Column]:
    """Position in the unit square of Web Mercator, y down."""
    s = F.when(col(lat).isNotNull(), F.sin(F.radians(F.least(F.lit(MAX_LAT), F.greatest(F.lit(-MAX_LAT), col(lat))))))
    return (col(lon) + 180) / 360, 0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())


def unmercator(x, y) -> tuple[Column, Column]:
    """(latitude, longitude) of a position in the unit square."""
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * col(y))))), col(x) * 360 - 180


def unit_vector(lat, lon) -> tuple[Column, Column, Column]:
    p, t = F.radians(col(lat)), F.radians(col(lon))
    return F.cos(p) * F.cos(t), F.cos(p) * F.sin(t), F.sin(p)


def nearness(lat1, lon1, lat2, lon2) -> Column:
    """Dot product of unit vectors: larger is nearer."""
    return sum((a * b for a, b in zip(unit_vector(lat1, lon1), unit_vector(lat2, lon2), strict=True)), F.lit(0.0))


def centroid(lat, lon) -> tuple[Column, Column]:
    """Aggregates: spherical mean (latitude, longitude) of a group; null if the vectors cancel out."""
    x, y, z = (F.sum(v) for v in unit_vector(lat, lon))
    norm = F.sqrt(x * x + y * y + z * z)
    ok = norm >= 1e-9
    return F.when(ok, F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), z / norm))))), F.when(ok, F.degrees(F.atan2(y, x)))


def great_circle_path(lat1, lon1, lat2, lon2, step_km: float, most: int = 64) -> Column:
    """array<struct<lat, lon>> along the great circle, ends included; longitudes go on past the date line."""
    a, b = unit_vector(lat1, lon1), unit_vector(lat2, lon2)
    dot = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), a[0] * b[0] + a[1] * b[1] + a[2] * b[2]))
    angle = F.acos(dot)
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(angle * EARTH_KM / step_km))).cast("int")

    def at(i: Column) -> Column:
        f = i / n
        s = F.sin(angle)
        u = F.when(s < 1e-9, 1 - f).otherwise(F.sin((1 - f) * angle) / s)
        w = F.when(s < 1e-9, f).otherwise(F.sin(f * angle) / s)
        x, y, z = (u * p + w * q for p, q in zip(a, b, strict=True))
        return F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"))

    points = F.transform(F.sequence(F.lit(0), n), at)
    kind = "array<struct<lat:double,lon:double>>"
    step = lambda acc, p: F.concat(acc, F.array(F.struct(p["lat"].alias("lat"), F.when(F.size(acc) == 0, p["lon"]).otherwise(p["lon"] + 360 * F.round((F.element_at(acc, -1)["lon"] - p["lon"]) / 360)).alias("lon"))))
    return F.aggregate(points, F.array().cast(kind), step)


def ring(lat, lon, angle_deg, n: int) -> Column:
    """array<struct<lat, lon>> of n + 1 positions at a central angle around a position."""
    p, d = F.radians(col(lat)), F.radians(col(angle_deg))

    def at(i: Column) -> Column:
        az = i * (2 * 3.141592653589793 / n)
        s = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(az)
        lat2 = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), s)))
        lon2 = F.radians(col(lon)) + F.atan2(F.sin(az) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat2))
        return F.struct(F.degrees(lat2).alias("lat"), F.degrees(lon2).alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(n)), at)


def ecef(lat, lon, alt_km=0.0) -> tuple[Column, Column, Column]:
    """WGS84 geodetic position to earth-centred kilometres."""
    e2 = WGS84_F * (2 - WGS84_F)
    p, t = F.radians(col(lat)), F.radians(col(lon))
    n = WGS84_A / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))
    h = col(alt_km)
    return (n + h) * F.cos(p) * F.cos(t), (n + h) * F.cos(p) * F.sin(t), (n * (1 - e2) + h) * F.sin(p)


def geodetic(x, y, z) -> tuple[Column, Column, Column]:
    """Earth-centred kilometres to (latitude, longitude, altitude km): three rounds from the parametric latitude."""
    e2 = WGS84_F * (2 - WGS84_F)
    x, y, z = col(x), col(y), col(z)
    p = F.sqrt(x * x + y * y)
    lat = F.atan2(z, p * (1 - e2))
    for _ in range(3):
        n = WGS84_A / F.sqrt(1 - e2 * F.pow(F.sin(lat), 2))
        lat = F.atan2(z + e2 * n * F.sin(lat), p)
    n = WGS84_A / F.sqrt(1 - e2 * F.pow(F.sin(lat), 2))
    alt = F.when(F.abs(F.cos(lat)) > 1e-6, p / F.cos(lat) - n).otherwise(F.abs(z) - n * (1 - e2))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), alt


def look(site: tuple[Column, Column, Column], up: tuple[Column, Column, Column], sat: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """(elevation degrees, slant range km) of a satellite from a site; ``up`` is the site's vertical."""
    d = [s - p for s, p in zip(sat, site, strict=True)]
    slant = F.sqrt(sum((v * v for v in d), F.lit(0.0)))
    rise = sum((v * u for v, u in zip(d, up, strict=True)), F.lit(0.0))
    return F.degrees(F.asin(rise / slant)), slant


def clearance_km(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Least distance from the earth's centre of the straight line between two places."""
    d = [q - p for p, q in zip(a, b, strict=True)]
    dd = sum((v * v for v in d), F.lit(0.0))
    t = F.when(dd > 0, -sum((p * v for p, v in zip(a, d, strict=True)), F.lit(0.0)) / dd).otherwise(0.0)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.sqrt(sum((F.pow(p + v * t, 2) for p, v in zip(a, d, strict=True)), F.lit(0.0)))


def light_ms(km, index: float = 1.0) -> Column:
    """One-way time of light in milliseconds through a medium of this refractive index."""
    return col(km) * index / 299.792458


def orbit_altitude_km(revs_per_day) -> Column:
    """Mean altitude of an orbit from its mean motion."""
    n = col(revs_per_day) * (2 * 3.141592653589793 / 86400)
    return F.cbrt(398600.4418 / (n * n)) - WGS84_A


def julian_date(ms) -> Column:
    return col(ms) / 86400000 + 2440587.5


def slot_of(ms, period_ms: int = 15_000, offset_ms: int = 12_000) -> Column:
    """Number of the reassignment slot that a time in milliseconds lies in."""
    return F.floor((col(ms) - offset_ms) / period_ms)


def lon_bounds(lat, lon) -> list[Column]:
    """Aggregates: south, west, north, east around a group; goes over the date line if that is narrower; null if wider than 300 degrees."""
    lo, hi = F.min(col(lon)), F.max(col(lon))
    shifted = F.when(col(lon) < 0, col(lon) + 360).otherwise(col(lon))
    lo2, hi2 = F.min(shifted), F.max(shifted)
    over = (hi2 - lo2) < (hi - lo)
    west, east = F.when(over, lo2).otherwise(lo), F.when(over, hi2).otherwise(hi)
    ok = (east - west) <= 300
    return [F.when(ok, F.min(col(lat))).alias("south"), F.when(ok, west).alias("west"), F.when(ok, F.max(col(lat))).alias("north"), F.when(ok, east).alias("east")]


def clip_segment(x0, y0, x1, y1, west, south, east, north) -> Column:
    """struct<ok, x0, y0, x1, y1> of a segment cut to a box (parametric clipping, edges included)."""
    x0, y0, x1, y1 = col(x0), col(y0), col(x1), col(y1)
    dx, dy = x1 - x0, y1 - y0
    t0, t1, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((-dx, x0 - col(west)), (dx, col(east) - x0), (-dy, y0 - col(south)), (dy, col(north) - y0)):
        r = q / F.when(p == 0, F.lit(1.0)).otherwise(p)
        ok = ok & ~((p == 0) & (q < 0))
        t0 = F.when(p < 0, F.greatest(t0, r)).otherwise(t0)
        t1 = F.when(p > 0, F.least(t1, r)).otherwise(t1)
    ok = ok & (t0 <= t1)
    return F.struct(ok.alias("ok"), F.when(ok, x0 + dx * t0).alias("x0"), F.when(ok, y0 + dy * t0).alias("y0"), F.when(ok, x0 + dx * t1).alias("x1"), F.when(ok, y0 + dy * t1).alias("y1"))


def fixed(x, digits: int = 6) -> Column:
    """Rounded the same way in every engine: floor(x * 10^d + 0.5) / 10^d."""
    k = float(10**digits)
    return F.floor(col(x) * k + 0.5) / k
