"""Distances, ring measures and grid cells as Column expressions (no UDF).

A point is a struct<lat double, lon double>; a ring or trace is an array of points.
"""
import math

from pyspark.sql import Column, functions as F

from ringside import vocab
from ringside.functions.text import once

EARTH_M = 6371000.0
DEG_M = 111320.0          # metres per degree used by the local projection
LAT_DEG_M = 111132        # metres per degree of latitude used by the framing of aerial views
FINEST_LEVEL = 20


def point(lat, lon) -> Column:
    return F.struct(F.col(lat) if isinstance(lat, str) else lat, F.col(lon)
                    if isinstance(lon, str) else lon)


# ------------------------------------------------------------------------------ distances
def haversine(lat1, lon1, lat2, lon2, radius=EARTH_M) -> Column:
    """Great-circle distance, in the unit of the radius (metres by default)."""
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return haversine(lat1, lon1, lat2, lon2, 6371.0)


def points_apart(a, b) -> Column:
    return haversine(a["lat"], a["lon"], b["lat"], b["lon"])


def view_box(lat, lon, field_m, ratio=1.0) -> Column:
    """South, west, north, east of an aerial view whose width is field_m metres."""
    d_lat = field_m * F.lit(float(ratio)) / 2 / F.lit(float(LAT_DEG_M))
    d_lon = field_m / 2 / (F.lit(DEG_M) * F.cos(F.radians(lat)))
    return F.struct((lat - d_lat).alias("south"), (lon - d_lon).alias("west"),
                    (lat + d_lat).alias("north"), (lon + d_lon).alias("east"))


def view_field(lap_m, tool="page") -> Column:
    """Width in metres of the view of a venue, from its lap length."""
    if tool == "download":
        return F.when(F.coalesce(lap_m, F.lit(0)) >= 400, 400.0).otherwise(260.0)
    if tool == "candidate":
        wide = F.bround(lap_m * 2.5 / 10, 0) * 10
        return F.greatest(F.lit(150.0), F.least(F.lit(500.0), wide))
    lap = F.coalesce(lap_m, F.lit(0))
    return F.when(lap >= 400, 360.0).when(lap > 0, 260.0).otherwise(300.0)


# --------------------------------------------------------------------------- ring measures
def edges(ring) -> Column:
    """array<struct<a, b>> of the consecutive vertices of a ring."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))),
                      F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(parts, start=0.0) -> Column:
    return F.aggregate(parts, F.lit(start), lambda acc, x: acc + x)


def edge_lengths(ring) -> Column:
    return F.transform(edges(ring), lambda e: points_apart(e["a"], e["b"]))


def perimeter(ring) -> Column:
    return _total(edge_lengths(ring))


def ring_centre(ring) -> Column:
    """Mean of the vertices; the closing vertex of a closed ring counts twice."""
    n = F.size(ring)
    return F.when(n > 0, F.struct(
        (_total(F.transform(ring, lambda p: p["lat"])) / n).alias("lat"),
        (_total(F.transform(ring, lambda p: p["lon"])) / n).alias("lon")))


def is_closed(ring, tolerance_m=3.0) -> Column:
    return F.coalesce(
        (F.size(ring) > 3)
        & (points_apart(F.try_element_at(ring, F.lit(1)), F.try_element_at(ring, F.lit(-1)))
           < tolerance_m), F.lit(False))


def ring_area(ring) -> Column:
    """Shoelace area of a closed ring in square metres, on a local projection.

    Coordinates are taken from the first vertex: the area is the same, without the loss of
    digits that products of large coordinates bring.
    """
    lat0 = _total(F.transform(ring, lambda p: p["lat"])) / F.size(ring)
    k = F.cos(F.radians(lat0)) * DEG_M
    y0, x0 = F.try_element_at(ring, F.lit(1))["lat"], F.try_element_at(ring, F.lit(1))["lon"]
    cross = F.transform(edges(ring), lambda e: (
        (e["a"]["lon"] - x0) * (e["b"]["lat"] - y0) - (e["b"]["lon"] - x0) * (e["a"]["lat"] - y0)))
    return F.abs(_total(cross)) / 2 * k * DEG_M


def ring_box(ring) -> Column:
    lats = F.transform(ring, lambda p: p["lat"])
    lons = F.transform(ring, lambda p: p["lon"])
    return F.struct(F.array_min(lats).alias("south"), F.array_min(lons).alias("west"),
                    F.array_max(lats).alias("north"), F.array_max(lons).alias("east"))


def box_sides(ring) -> Column:
    """Long and short side, in metres, of the bounding box."""
    sides = lambda b: F.struct(
        haversine(b["south"], b["west"], b["south"], b["east"]).alias("wide"),
        haversine(b["south"], b["west"], b["north"], b["west"]).alias("tall"))
    return once(once(ring_box(ring), sides), lambda s: F.struct(
        F.greatest(s["wide"], s["tall"]).alias("long_m"), F.least(s["wide"], s["tall"]).alias("short_m")))


def ribbon_length(perimeter_m, area_m2, long_m, short_m, max_width=12.0, min_ratio=4.0) -> Column:
    """Longer side of the rectangle with the ring's perimeter and area, if it is narrow and fits the ring's box; else null."""
    d = (perimeter_m / 4) * (perimeter_m / 4) - area_m2
    length = perimeter_m / 4 + F.sqrt(F.greatest(d, F.lit(0.0)))
    width = F.when(length > 0, area_m2 / length).otherwise(0.0)
    diagonal = F.sqrt(long_m * long_m + short_m * short_m)
    fits = ((d > 0) & (width <= max_width) & (length >= min_ratio * width)
            & (length <= 1.05 * diagonal))
    return F.when(fits, length)


def snap_lap(metres, factor=1.03, tolerance=0.08, laps=tuple(vocab.STANDARD_LAPS)) -> Column:
    """Nearest standard lap of a measured ring, null when none is within the tolerance."""
    estimate = metres / factor
    gaps = F.array(*[F.struct(F.abs(F.lit(float(n)) - estimate).alias("gap"),
                              F.lit(n).alias("lap")) for n in laps])
    best = F.array_min(gaps)
    return F.when(best["gap"] / best["lap"] <= tolerance, best["lap"])


def in_ring(lat, lon, ring) -> Column:
    """Ray casting: does an odd number of edges lie east of the point?"""
    def crossed(e):
        y1, x1, y2, x2 = e["a"]["lat"], e["a"]["lon"], e["b"]["lat"], e["b"]["lon"]
        spans = (y1 > lat) != (y2 > lat)
        at = x1 + (lat - y1) * (x2 - x1) / F.when(y2 != y1, y2 - y1)
        return spans & F.coalesce(lon < at, F.lit(False))
    return F.size(F.filter(edges(ring), crossed)) % 2 == 1


# -------------------------------------------------------------------------------- the grid
# The world is cut in squares of 360 / 2^level degrees. Levels nest exactly, so a cell of one
# level is a bit shift of a cell of a finer one.
def cell_row(lat, level) -> Column:
    return F.floor((lat + 90.0) / 360.0 * _side_count(level)).cast("int")


def cell_col(lon, level) -> Column:
    n = _side_count(level)
    return F.pmod(F.floor((lon + 180.0) / 360.0 * n), n).cast("int")


def _side_count(level):
    return float(2 ** level) if isinstance(level, int) else F.pow(F.lit(2.0), level)


def level_for(radius_m, finest=FINEST_LEVEL):
    """Finest level whose cells are at least as tall as the radius."""
    degrees = math.degrees(radius_m / EARTH_M)
    return max(0, min(finest, int(math.floor(math.log2(360.0 / degrees)))))


def level_of(radius_m, finest=FINEST_LEVEL, step=1) -> Column:
    """The same as a Column, kept to multiples of step."""
    degrees = F.degrees(F.greatest(radius_m, F.lit(1e-3)) / EARTH_M)
    raw = F.floor(F.log2(F.lit(360.0) / degrees)).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(finest), (raw / step).cast("int") * step))


def cells_around(lat, lon, radius_m, level) -> Column:
    """Every cell a disc touches, as array<struct<cy, cx>>: exact at the poles and the antimeridian."""
    n = _side_count(level)
    radius = F.lit(float(radius_m)) if isinstance(radius_m, (int, float)) else radius_m
    slack = 1e-7
    angle = F.least(radius / EARTH_M, F.lit(math.pi))
    d_lat = F.degrees(angle) + slack
    reach = F.sin(F.least(angle, F.lit(math.pi / 2))) / F.cos(F.radians(lat))
    over_pole = (F.abs(lat) + d_lat >= 90.0) | (reach >= 1.0)
    d_lon = F.when(over_pole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(reach, F.lit(1.0)))) + slack)
    row = lambda v: F.floor((v + 90.0) / 360.0 * n).cast("int")
    col = lambda v: F.floor((v + 180.0) / 360.0 * n).cast("int")
    first = col(lon - d_lon)
    count = F.least(col(lon + d_lon) - first, F.lit(n - 1).cast("int")
                    if isinstance(level, int) else (n - 1).cast("int"))
    rows = F.sequence(row(F.greatest(lat - d_lat, F.lit(-90.0))),
                      row(F.least(lat + d_lat, F.lit(90.0))))
    return _cells(rows, F.sequence(first, first + count), n)


def cells_of_box(south, west, north, east, level) -> Column:
    """Every cell a bounding box touches (box not crossing the antimeridian)."""
    n = _side_count(level)
    rows = F.sequence(F.floor((south + 90.0) / 360.0 * n).cast("int"),
                      F.floor((north + 90.0) / 360.0 * n).cast("int"))
    cols = F.sequence(F.floor((west + 180.0) / 360.0 * n).cast("int"),
                      F.floor((east + 180.0) / 360.0 * n).cast("int"))
    return _cells(rows, cols, n)


def _cells(rows, cols, n) -> Column:
    return F.flatten(F.transform(rows, lambda y: F.transform(cols, lambda x: F.struct(
        y.alias("cy"), F.pmod(x, n).cast("int").alias("cx")))))


def degree_cell(coordinate, step) -> Column:
    """Grid key of the published cells: round half even of coordinate / step."""
    return F.bround(coordinate / F.lit(float(step)), 0).cast("int")


# ------------------------------------------------------------------------- order and boxes
CURVE_BITS = 26


def _spread(cell) -> Column:
    """The bits of a cell number, a zero bit after each."""
    out = cell.cast("bigint")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def along_curve(lat, lon) -> Column:
    """Place of a point on the Z-order curve: points of one grid cell, of any level, are one run of it."""
    return F.shiftleft(_spread(cell_row(lat, CURVE_BITS)), 1).bitwiseOR(_spread(cell_col(lon, CURVE_BITS)))


def on_sphere(lat, lon) -> list[Column]:
    """x, y, z of a point on the unit sphere: boxes and bounds there know neither poles nor an antimeridian."""
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def chord_of(metres) -> Column:
    """The straight line under a great-circle distance, in radii."""
    return F.sin(F.least(metres / (2 * EARTH_M), F.lit(math.pi / 2))) * 2


def chords_between(low, high, other_low, other_high) -> tuple[Column, Column]:
    """Least and greatest straight distance of two boxes given by their corners, in radii; a point is a box of its own."""
    near, far = F.lit(0.0), F.lit(0.0)
    for a, b, u, v in zip(low, high, other_low, other_high):
        gap = F.greatest(u - b, a - v, F.lit(0.0))
        reach = F.greatest(F.abs(b - u), F.abs(v - a))
        near, far = near + gap * gap, far + reach * reach
    return F.sqrt(near), F.sqrt(far)
