"""Scalar functions beyond Spark's own, as column expressions that stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in metres.
EARTH_RADIUS = 6_371_000.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def idiv(a: str, b: str) -> Column:
    return F.expr(f"{a} div {b}")


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres along a great circle."""
    a1, o1, a2, o2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


#: Fixed values of the WGS84 ellipsoid: equatorial radius in metres and flattening.
WGS84_RADIUS, WGS84_FLATTENING = 6_378_137.0, 1 / 298.257223563


def distance(lat1, lon1, lat2, lon2, rounds: int = 20) -> Column:
    """Metres along the geodesic of WGS84 (Vincenty's inverse formula, its iteration as one fold of ``rounds`` steps).

    Null where it does not converge: for nearly antipodal points.
    """
    a, f = WGS84_RADIUS, WGS84_FLATTENING
    b = a * (1 - f)
    u1, u2 = (F.atan((1 - f) * F.tan(F.radians(_c(x)))) for x in (lat1, lat2))
    over = F.radians(_c(lon2)) - F.radians(_c(lon1))

    def step(s, _):
        """From the longitude difference on the auxiliary sphere to the next one, with what the length needs."""
        x = s["lam"]
        sin_s = F.sqrt(F.pow(F.cos(u2) * F.sin(x), F.lit(2.0)) + F.pow(F.cos(u1) * F.sin(u2) - F.sin(u1) * F.cos(u2) * F.cos(x), F.lit(2.0)))
        cos_s = F.sin(u1) * F.sin(u2) + F.cos(u1) * F.cos(u2) * F.cos(x)
        return F.struct(x.alias("lam"), s["lam"].alias("last"), sin_s.alias("sin"), cos_s.alias("cos"), F.atan2(sin_s, cos_s).alias("sigma"))

    def azimuth(s, _):
        sin_a = F.coalesce(F.try_divide(F.cos(u1) * F.cos(u2) * F.sin(s["lam"]), s["sin"]), F.lit(0.0))
        cos2 = 1 - sin_a * sin_a
        mid = F.coalesce(F.try_divide(-2 * F.sin(u1) * F.sin(u2), cos2), F.lit(0.0)) + s["cos"]
        c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        new = over + (1 - c) * f * sin_a * (s["sigma"] + c * s["sin"] * (mid + c * s["cos"] * (-1 + 2 * mid * mid)))
        return F.struct(new.alias("lam"), s["lam"].alias("last"), cos2.alias("cos2"), mid.alias("mid"), s["sin"].alias("sin"), s["cos"].alias("cos"), s["sigma"].alias("sigma"))

    one = F.array(F.lit(0))
    zero = F.lit(0.0)
    start = F.struct(over.alias("lam"), F.lit(10.0).alias("last"), zero.alias("cos2"), zero.alias("mid"), zero.alias("sin"), zero.alias("cos"), zero.alias("sigma"))

    def both(s, i):
        # each half is a fold over one element, so that its value is computed once and named
        first = F.aggregate(one, F.struct(s["lam"].alias("lam"), s["last"].alias("last"), zero.alias("sin"), zero.alias("cos"), zero.alias("sigma")), step)
        again = F.transform(F.array(first), lambda x: azimuth(x, i))[0]
        return F.when(F.abs(s["lam"] - s["last"]) < 1e-12, s).otherwise(again)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, both)

    def length(s):
        u = s["cos2"] * ((a * a - b * b) / (b * b))
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m = s["mid"]
        turn = small * s["sin"] * (m + small / 4 * (s["cos"] * (-1 + 2 * m * m) - small / 6 * m * (-3 + 4 * s["sin"] * s["sin"]) * (-3 + 4 * m * m)))
        return F.when(F.abs(s["lam"] - s["last"]) < 1e-9, b * big * (s["sigma"] - turn))

    same = (_c(lat1) == _c(lat2)) & (_c(lon1) == _c(lon2))
    return F.when(same, 0.0).otherwise(F.transform(F.array(end), length)[0])


def polygon(wkt) -> Column:
    """Rings of a WKT ``POLYGON`` as arrays of ``(lat, lon)``: the first is the outline, the others are holes. Null for other text."""
    body = F.regexp_extract(_c(wkt), r"(?is)^\s*POLYGON\s*\(\s*\((.*)\)\s*\)\s*$", 1)

    def corner(text: Column) -> Column:
        xy = F.split(F.trim(text), r"\s+")
        return F.struct(xy[1].try_cast("double").alias("lat"), xy[0].try_cast("double").alias("lon"))

    rings = F.transform(F.split(body, r"\)\s*,\s*\("), lambda ring: F.transform(F.split(ring, ","), corner))
    return F.when(body != "", rings)


def rings_contain(rings, lat, lon) -> Column:
    """Even-odd rule over all rings: inside the outline and in no hole."""
    y, x = _c(lat), _c(lon)

    def crossings(ring: Column) -> Column:
        edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

        def crosses(e):
            p, q = e["p"], e["q"]
            return ((p["lat"] > y) != (q["lat"] > y)) & (x < F.try_divide((q["lon"] - p["lon"]) * (y - p["lat"]), q["lat"] - p["lat"]) + p["lon"])

        return F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False))))

    return F.aggregate(F.transform(_c(rings), crossings), F.lit(0), lambda s, n: s + n) % 2 == 1


def ring_centroid(rings) -> Column:
    """Area centroid ``(lat, lon)`` of the outline, in the plane of degrees."""
    ring = _c(rings)[0]
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p["lat"].alias("y1"), p["lon"].alias("x1"), q["lat"].alias("y2"), q["lon"].alias("x2")))
    total = lambda part: F.aggregate(edges, F.lit(0.0), lambda s, e: s + part(e, e["x1"] * e["y2"] - e["x2"] * e["y1"]))
    twice = total(lambda e, c: c)
    return F.struct(F.try_divide(total(lambda e, c: (e["y1"] + e["y2"]) * c), 3 * twice).alias("lat"), F.try_divide(total(lambda e, c: (e["x1"] + e["x2"]) * c), 3 * twice).alias("lon"))


def ring_perimeter(rings) -> Column:
    """Metres around the outline, along geodesics."""
    ring = _c(rings)[0]
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: distance(p["lat"], p["lon"], q["lat"], q["lon"]))
    return F.aggregate(edges, F.lit(0.0), lambda s, d: s + d)


def within_box(lat, lon, south: float, west: float, north: float, east: float) -> Column:
    return _c(lat).between(south, north) & _c(lon).between(west, east)


def point_in_polygon(lat, lon, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against a ring of (lat, lon); the edges become one expression, the number of corners is a parameter."""
    y, x, crossings = _c(lat), _c(lon), F.lit(0)
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def valid_at(start, end, when) -> Column:
    """Open bounds are null."""
    s, e, w = _c(start), _c(end), _c(when)
    return (s.isNull() | (s <= w)) & (e.isNull() | (e >= w))


def valid_during(start, end, low, high) -> Column:
    s, e = _c(start), _c(end)
    return (s.isNull() | (s <= _c(high))) & (e.isNull() | (e >= _c(low)))


def duration(months: int = 0, days: int = 0, seconds: int = 0) -> Column:
    return F.struct(F.lit(months).alias("months"), F.lit(days).alias("days"), F.lit(seconds).cast("long").alias("seconds"))


def add_duration(when, d: Column) -> Column:
    """Calendar months, then days, then seconds."""
    shifted = F.add_months(_c(when).cast("date"), d["months"])
    time_of_day = F.unix_seconds(_c(when).cast("timestamp")) - F.unix_seconds(_c(when).cast("date").cast("timestamp"))
    return F.timestamp_seconds(F.unix_seconds(F.date_add(shifted, d["days"]).cast("timestamp")) + time_of_day + d["seconds"])


def circle(lat: float, lon: float, radius_m: float, corners: int = 32) -> list[tuple[float, float]]:
    """A ring around a point, for ``point_in_polygon``."""
    out = []
    for k in range(corners):
        t = 2 * math.pi * k / corners
        dlat = radius_m * math.cos(t) / EARTH_RADIUS
        dlon = radius_m * math.sin(t) / (EARTH_RADIUS * math.cos(math.radians(lat)))
        out.append((lat + math.degrees(dlat), lon + math.degrees(dlon)))
    return out
