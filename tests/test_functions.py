import math

import pytest
from pyspark.sql import functions as F

from ringside.functions import geo, numbers, text

c = F.col


def values(spark, schema, rows, *columns):
    return spark.createDataFrame(rows, schema).select(*columns).collect()


def ring(lat, lon, points):
    """Points given in metres east and north of a place."""
    k = math.cos(math.radians(lat))
    return [(lat + y / 111320, lon + x / (111320 * k)) for x, y in points]


RING = "g array<struct<lat:double,lon:double>>"


def oval(perimeter, n=48):
    r = perimeter / (2 * math.pi)
    return [(r * math.cos(2 * math.pi * i / n), r * math.sin(2 * math.pi * i / n)) for i in range(n + 1)]


def test_fold_slug_and_titles(spark):
    rows = values(spark, "s string", [("STADE DE L'ÉTANG-LA-VILLE",), ("Œuvre d’été",), ("SAINT-JEAN DU  DÉSERT ",), (None,), ("LA  L’ÎLE",)],
                  text.fold(c("s")), text.slug(c("s"), "site"), text.smart_title("s"))
    assert [tuple(r) for r in rows] == [
        ("stade de l'etang-la-ville", "stade-de-l-etang-la-ville", "Stade de l'Étang-La-Ville"),
        ("œuvre d’ete", "uvre-d-ete", "Œuvre d’été"), ("saint-jean du  desert ", "saint-jean-du-desert", "Saint-Jean du Désert"),
        ("", "site", None), ("la  l’ile", "la-l-ile", "La l’Île")]


def test_fold_handles_combining_marks_and_wide_latin(spark):
    (row,) = values(spark, "s string", [("é Ǻ ế Ș",)], text.fold(c("s")))
    assert row[0] == "e a e s"


def test_lenient_numbers(spark):
    rows = values(spark, "v string", [("400.7",), ("abc",), (" 8 ",), ("1e3",), ("-3.9",), ("NaN",), ("12d",), (None,)], numbers.lenient_int(c("v")))
    assert [r[0] for r in rows] == [400, None, 8, 1000, -3, None, None, None]
    rows = values(spark, "v string", [("Oui",), (" TRUE ",), ("1",), ("false",), ("2",), (None,)], numbers.lenient_bool(c("v")))
    assert [r[0] for r in rows] == [True, True, True, False, False, None]


def test_formats(spark):
    (row,) = values(spark, "x int", [(1,)], numbers.format_date(F.lit("2026-08-03")), numbers.format_date(F.lit("bientôt")),
                    numbers.format_distance(F.lit(0.4567)), numbers.format_distance(F.lit(4.26)), numbers.format_distance(F.lit(42.5)),
                    numbers.format_thousands(F.lit(7135)), numbers.format_note(F.lit(4.25)))
    assert list(row) == ["3 août 2026", "bientôt", "457 m", "4.3 km", "43 km", "7 135", "4,2"]


def test_a_400_m_ring_snaps_to_400_and_a_circle_is_no_ribbon(spark):
    rows = values(spark, RING, [(ring(47.2, -1.5, oval(412)),), (ring(47.2, -1.5, oval(150)),)],
                  geo.snap_lap(geo.perimeter(c("g"))), geo.ribbon_length(geo.perimeter(c("g")), geo.ring_area(c("g")), geo.box_sides(c("g"))["long_m"], geo.box_sides(c("g"))["short_m"]))
    assert [tuple(r) for r in rows] == [(400, None), (None, None)]


def test_a_long_rectangle_is_a_ribbon_and_a_wide_one_is_not(spark):
    box = lambda w, h: [(0, 0), (w, 0), (w, h), (0, h), (0, 0)]
    rows = values(spark, RING, [(ring(47.2, -1.5, box(100, 8)),), (ring(47.2, -1.5, box(100, 40)),)],
                  geo.ribbon_length(geo.perimeter(c("g")), geo.ring_area(c("g")), geo.box_sides(c("g"))["long_m"], geo.box_sides(c("g"))["short_m"]))
    assert rows[0][0] == pytest.approx(100, rel=1e-2) and rows[1][0] is None


def test_snapping_ties_go_to_the_smaller_lap(spark):
    (row,) = values(spark, "m double", [(225 * 1.03,)], geo.snap_lap(c("m"), tolerance=0.2))
    assert row[0] == 200


def test_closed_rings_and_points_inside(spark):
    square = ring(47.2, -1.5, [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)])
    rows = values(spark, RING, [(square,), (square[:-1],), (square[:2],)], geo.is_closed(c("g")))
    assert [r[0] for r in rows] == [True, False, False]
    inside, outside = ring(47.2, -1.5, [(50, 50), (150, 50)])
    (row,) = values(spark, RING, [(square,)], *[geo.in_ring(F.lit(p[0]), F.lit(p[1]), c("g")) for p in (inside, outside)])
    assert list(row) == [True, False]


def test_cells_around_reach_over_the_antimeridian_and_the_pole(spark):
    rows = values(spark, "lat double, lon double", [(0.0, 179.999), (89.999, 10.0)], geo.cells_around(c("lat"), c("lon"), 1000.0, 12))
    columns = {cell.cx for cell in rows[0][0]}
    assert 0 in columns and 4095 in columns
    assert len({cell.cx for cell in rows[1][0]}) == 4096
