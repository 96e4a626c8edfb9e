"""Distance, nearest-neighbour and containment joins."""
from pyspark.sql import functions as F

from ringside.checks.registry import check
from ringside.checks.auditing import G1_ROWS, greedy_sql
from ringside.checks.tables import TWIN_TABLES, metres_sql
from ringside.functions import geo
from ringside.operators import audit, facets, spatial
from ringside.plans import coverage
from ringside.session import cut_lineage
from ringside.sources import mapped

c = F.col
M = metres_sql


AROUND = f"""SELECT city, id, round(m / 1000, 6) AS km, rank FROM (SELECT t.city, v.id, round({M('t.lat', 't.lon', 'v.lat', 'v.lon')}, 3) AS m,
     row_number() OVER (PARTITION BY t.city ORDER BY round({M('t.lat', 't.lon', 'v.lat', 'v.lon')}, 3), v.id) AS rank
   FROM city_table t JOIN ready v ON {M('t.lat', 't.lon', 'v.lat', 'v.lon')} <= 20000
   WHERE NOT EXISTS (SELECT 1 FROM city_rows r WHERE r.slug = t.slug AND r.dep = t.dep AND r.id = v.id)) WHERE rank <= 12"""


def _around(t):
    ready = cut_lineage(t.ready.select("id", "nom", "ville", "dep", "lat", "lon"))      # read by four steps
    members = cut_lineage(facets.city_members(ready))
    found = facets.around_cities(facets.cities(members), ready, members=members)
    return found.select("city", "id", F.round("km", 6).alias("km"), "rank")


@check("j5_around_cities", AROUND, ["city_table", "city_rows"])
def _(t):
    return _around(t)


@check("w3_top_twelve_per_city", f"SELECT city, count(*) AS n, max(rank) AS last FROM ({AROUND}) GROUP BY city", ["city_table", "city_rows"])
def _(t):
    return _around(t).groupBy("city").agg(F.count("*").alias("n"), F.max("rank").cast("long").alias("last"))


NEIGHBOURS = f"""SELECT id, near_id, round(m / 1000, 6) AS km, rank FROM (SELECT a.id, b.id AS near_id, round({M('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS m,
     row_number() OVER (PARTITION BY a.id ORDER BY round({M('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3), b.id) AS rank FROM ready a JOIN ready b ON a.dep = b.dep AND a.id <> b.id) WHERE rank <= 6"""


@check("j6_six_nearest_in_department", NEIGHBOURS, ["ready"])
def _(t):
    return facets.neighbours(t.ready).select("id", "near_id", F.round("km", 6).alias("km"), "rank")


@check("w2_top_six_per_venue", f"SELECT id, count(*) AS n, CAST(sum(CAST(round(km * 1e6) AS BIGINT)) AS BIGINT) AS mm FROM ({NEIGHBOURS}) GROUP BY id", ["ready"])
def _(t):
    return facets.neighbours(t.ready).groupBy("id").agg(F.count("*").alias("n"), F.sum(F.round(c("km") * 1e6).cast("long")).alias("mm"))


RING_IDS = "lap_ring_rows"
MATCHES = f"""SELECT id, longueur_piste, osm, m, metres, CASE WHEN abs(lap - m / 1.03::DOUBLE) / lap <= 0.08::DOUBLE THEN lap END AS snapped FROM (
   SELECT *, arg_min(v, ROW(abs(v - m / 1.03::DOUBLE), v)) OVER (PARTITION BY id) AS lap, v FROM (
     SELECT s.id, longueur_piste, osm, m, {M('s.lat', 's.lon', 'r.lat', 'r.lon')} AS metres FROM sites_raw s JOIN lap_ring_rows r ON {M('s.lat', 's.lon', 'r.lat', 'r.lon')} < 200
     QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY m DESC, osm) = 1), (VALUES (200), (250), (300), (333), (400)) w(v)) WHERE v = lap"""


def _matches(t):
    return audit.match_laps(t.sites_raw.select("id", "lat", "lon", "longueur_piste"), audit.lap_rings(mapped.lap_objects(t.elements)))


@check("j7_longest_ring_within_200_m", f"SELECT id, osm, round(m, 3) AS ring_m, round(metres, 3) AS metres, snapped FROM ({MATCHES})", ["sites_raw", "lap_ring_rows"])
def _(t):
    return _matches(t).select("id", "osm", F.round("ring_m", 3).alias("ring_m"), F.round("metres", 3).alias("metres"), "snapped")


OUTCOME = "CASE WHEN snapped IS NULL THEN 'refused' WHEN longueur_piste IS NULL THEN 'new' WHEN snapped = longueur_piste THEN 'agree' ELSE 'disagree' END"


@check("a15_estimate_outcomes", f"SELECT {OUTCOME} AS outcome, count(*) AS n FROM ({MATCHES}) GROUP BY 1", ["sites_raw", "lap_ring_rows"])
def _(t):
    return audit.lap_outcomes(_matches(t))


@check("o9_estimates_by_declared_length", f"SELECT id, longueur_piste, snapped FROM ({MATCHES}) ORDER BY coalesce(longueur_piste, 0)", ["sites_raw", "lap_ring_rows"])
def _(t):
    return _matches(t).select("id", "longueur_piste", "snapped").orderBy(F.coalesce("longueur_piste", F.lit(0)), "id")


PATCHES = f"""SELECT p.id, snapped AS longueur_probable, CASE WHEN contains(coalesce(s.note, ''), said) THEN s.note ELSE concat_ws(' ', nullif(s.note, ''), said) END AS note FROM (
   SELECT id, snapped, 'Développement estimé à ' || snapped || ' m d''après le tracé de l''anneau dans OpenStreetMap (' || osm || '), non mesuré sur place.' AS said FROM ({MATCHES}) WHERE snapped IS NOT NULL AND longueur_piste IS NULL) p
   LEFT JOIN sites_raw s ON s.id = p.id"""


@check("k7_estimate_patches", PATCHES, ["sites_raw", "lap_ring_rows"])
def _(t):
    return audit.lap_patches(_matches(t), t.sites_raw.select("id", "note"))


# ------------------------------------------------------------------------------ claims
TRACES = "SELECT k, concat(osm, '#', CASE WHEN role = 'outer' OR role = 'inner' OR role = 'way' THEN '0' END) AS trace_id, dep, lat, lon, m, loop, ribbon, pts, long_m, short_m, lanes, surface, name, osm, role FROM examined WHERE reason IS NULL"
INSIDE = """SELECT t.trace_id, min(v.id) AS venue_id FROM traces t JOIN sites_raw v ON v.dep = t.dep AND t.loop AND v.lat BETWEEN t.lat - 0.01 AND t.lat + 0.01
   AND (SELECT count(*) % 2 = 1 FROM (SELECT lat AS y1, lon AS x1, lead(lat) OVER (ORDER BY i) AS y2, lead(lon) OVER (ORDER BY i) AS x2 FROM vertices w WHERE w.k = t.k AND w.role = t.role)
        WHERE y2 IS NOT NULL AND (y1 > v.lat) <> (y2 > v.lat) AND v.lon < x1 + (v.lat - y1) * (x2 - x1) / (y2 - y1)) GROUP BY t.trace_id"""
# a venue inside any loop of a group is certain (that of the shortest such loop), else the nearest venue to its leader claims it
CLAIMS = f"""SELECT h.trace_id AS leader, h.dep, coalesce(s.venue_id, n.venue_id) AS venue_id, coalesce(s.metres, n.metres) AS metres, s.venue_id IS NOT NULL OR coalesce(n.metres <= 150, false) AS certain
   FROM traces h JOIN grouped g ON g.trace_id = h.trace_id AND g.leader = h.trace_id
   LEFT JOIN (SELECT g.leader, arg_min(i.venue_id, ROW(t.m, t.trace_id)) AS venue_id, arg_min({M('t.lat', 't.lon', 'v.lat', 'v.lon')}, ROW(t.m, t.trace_id)) AS metres
      FROM grouped g JOIN traces t ON t.trace_id = g.trace_id JOIN inside i ON i.trace_id = t.trace_id JOIN sites_raw v ON v.id = i.venue_id GROUP BY g.leader) s ON s.leader = h.trace_id
   LEFT JOIN (SELECT t.trace_id, s.id AS venue_id, round({M('t.lat', 't.lon', 's.lat', 's.lon')}, 3) AS metres FROM traces t JOIN sites_raw s ON s.dep = t.dep AND s.lat IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY t.trace_id ORDER BY round({M('t.lat', 't.lon', 's.lat', 's.lon')}, 3), s.id) = 1) n ON n.trace_id = h.trace_id"""
AUDIT = dict(TWIN_TABLES, traces=TRACES, inside=INSIDE, grouped=greedy_sql(G1_ROWS, 80, "trace_id"), claimed=CLAIMS)
CLAIM_NEEDS = ["sites_raw", "examined", "vertices", "traces", "inside", "grouped", "claimed"]


def groups_of(t):
    """Traces of objects that lie three to a place, grouped."""
    kept = cut_lineage(audit.candidates(audit.examine_traces(mapped.audit_objects(t.twin_elements))))
    return cut_lineage(audit.group_traces(kept))


def alone(t):
    """Every kept trace as a group of its own, so claims can be told in SQL."""
    kept = audit.candidates(audit.examine_traces(mapped.audit_objects(t.twin_elements)))
    return cut_lineage(kept.withColumn("leader", c("trace_id")))


@check("j8_claims", "SELECT leader, dep, venue_id, round(metres, 3) AS metres, certain FROM claimed", CLAIM_NEEDS, **AUDIT)
def _(t):
    return audit.claims(groups_of(t), t.sites_raw.select("id", "dep", "lat", "lon")).select("leader", "dep", "venue_id", F.round("metres", 3).alias("metres"), "certain")


@check("x11_point_in_ring", "SELECT trace_id, venue_id FROM inside", CLAIM_NEEDS[:-2], **AUDIT)
def _(t):
    loops = alone(t).where("loop").select("trace_id", "dep", "ring")
    points = t.sites_raw.select("id", "dep", "lat", "lon")
    return spatial.in_rings(points, loops, level=15, by=["dep"]).groupBy("trace_id").agg(F.min("id").alias("venue_id"))


MISSING = """SELECT h.dep, h.osm, h.trace_id, round_even(h.lat, 5) AS lat, round_even(h.lon, 5) AS lon, round_even(h.m, 1) AS perimeter, h.pts AS points, h.loop, h.ribbon,
     CAST(round_even(h.long_m, 0) AS INTEGER) AS long_m, CAST(round_even(h.short_m, 0) AS INTEGER) AS short_m, h.lanes, h.surface, h.name, (SELECT count(*) FROM grouped g WHERE g.leader = c.leader) AS loops,
     c.venue_id AS near_id, CAST(round_even(c.metres, 0) AS INTEGER) AS near_m FROM claimed c JOIN traces h ON h.trace_id = c.leader WHERE NOT certain"""


@check("o8_missing_tracks", f"""SELECT m.* EXCLUDE (trace_id), v.nom AS near_name, v.ville AS near_city, 'https://www.openstreetmap.org/' || m.osm AS url FROM ({MISSING}) m LEFT JOIN sites_raw v ON v.id = m.near_id ORDER BY near_m DESC, m.trace_id""", CLAIM_NEEDS, **AUDIT)
def _(t):
    groups = groups_of(t)
    missing = audit.missing_tracks(groups, audit.claims(groups, t.sites_raw.select("id", "dep", "lat", "lon")))
    return coverage.with_nearest_venue(missing, t.sites_raw).orderBy(F.desc("near_m"), "trace_id").drop("trace_id")


@check("a20_audit_totals", """SELECT o.dep, objects, coalesce(groups, 0) AS groups, coalesce(known, 0) AS known, coalesce(missing, 0) AS missing FROM (SELECT dep, count(*) AS objects FROM audit_objects GROUP BY dep) o
   LEFT JOIN (SELECT dep, count(*) AS groups, count(*) FILTER (WHERE certain) AS known, count(*) FILTER (WHERE NOT certain) AS missing FROM claimed GROUP BY dep) g ON g.dep = o.dep""", CLAIM_NEEDS, **AUDIT)
def _(t):
    groups = groups_of(t)
    return audit.audit_totals(mapped.audit_objects(t.twin_elements), audit.claims(groups, t.sites_raw.select("id", "dep", "lat", "lon")))


# ------------------------------------------------------------------------------ context
# facilities: mapped objects with a name, moved a little; addresses: suppliers
FACILITIES = "SELECT CAST(k % 4 AS INT) AS rank, name, lat0 + 1e-3 AS f_lat, lon0 + 5e-4 AS f_lon FROM {objects} WHERE name IS NOT NULL"
PLACES = "SELECT k, id AS trace_id, lat, lon FROM {sites_raw} WHERE lat IS NOT NULL"
ADDRESSES = "SELECT concat('a', lpad(CAST(s AS STRING), 6, '0')) AS a_id, name AS city, concat('rue ', CAST(s AS STRING)) AS street, CAST(s AS STRING) AS postcode, s_lat AS a_lat, s_lon AS a_lon FROM {supplier_points}"
plain = lambda sql: sql.replace("{", "").replace("}", "")


@check("j10_named_place_around", f"""SELECT trace_id, place, rank, round(metres, 3) AS metres FROM (SELECT p.trace_id, f.name AS place, f.rank, {M('p.lat', 'p.lon', 'f_lat', 'f_lon')} AS metres,
     row_number() OVER (PARTITION BY p.trace_id ORDER BY f.rank, {M('p.lat', 'p.lon', 'f_lat', 'f_lon')}, f.name) AS r FROM ({plain(PLACES)}) p JOIN ({plain(FACILITIES)}) f ON {M('p.lat', 'p.lon', 'f_lat', 'f_lon')} <= 200) WHERE r = 1""", ["sites_raw", "objects"])
def _(t):
    return audit.name_from_context(t.derive(PLACES), t.derive(FACILITIES)).withColumn("metres", F.round("metres", 3))


@check("w1_best_per_key", f"""SELECT trace_id, a_id, metres FROM (SELECT p.trace_id, a_id, round({M('p.lat', 'p.lon', 'a_lat', 'a_lon')}, 3) AS metres, row_number() OVER (PARTITION BY p.trace_id ORDER BY round({M('p.lat', 'p.lon', 'a_lat', 'a_lon')}, 3), a_id) AS r
   FROM ({plain(PLACES)}) p, ({plain(ADDRESSES)}) a) WHERE r = 1""", ["sites_raw", "supplier_points"])
def _(t):
    return audit.nearest_address(t.derive(PLACES), t.derive(ADDRESSES)).select("trace_id", "a_id", "metres")


@check("j17_nearest_address", f"""SELECT trace_id, a_id, city, street, postcode, metres FROM (SELECT p.trace_id, a.*, round({M('p.lat', 'p.lon', 'a_lat', 'a_lon')}, 3) AS metres,
     row_number() OVER (PARTITION BY p.trace_id ORDER BY round({M('p.lat', 'p.lon', 'a_lat', 'a_lon')}, 3), a_id) AS r FROM ({plain(PLACES)}) p, ({plain(ADDRESSES)}) a) WHERE r = 1""", ["sites_raw", "supplier_points"])
def _(t):
    return audit.nearest_address(t.derive(PLACES), t.derive(ADDRESSES)).select("trace_id", "a_id", "city", "street", "postcode", "metres")


# school enclosures and communes are boxes, so that SQL can say "inside"
@check("j11_school_enclosure", """SELECT trace_id, 'École ' || min(s) AS school FROM (SELECT id AS trace_id, lat, lon FROM sites_raw) p JOIN (SELECT lpad(s::VARCHAR, 6, '0') AS s, s_lat, s_lon FROM supplier_points) q
   ON lat >= s_lat AND lat < s_lat + 0.02 AND lon >= s_lon AND lon < s_lon + 0.03 GROUP BY trace_id""", ["sites_raw", "supplier_points"])
def _(t):
    corner = lambda dy, dx: f"named_struct('lat', s_lat + {dy}, 'lon', s_lon + {dx})"
    ring = F.expr(f"array({corner('0e0', '0e0')}, {corner('0e0', '3e-2')}, {corner('2e-2', '3e-2')}, {corner('2e-2', '0e0')}, {corner('0e0', '0e0')})")
    name = F.lpad(c("s").cast("string"), 6, "0")
    schools = t.supplier_points.select(name.alias("school_id"), F.concat(F.lit("École "), name).alias("school"), ring.alias("ring"))
    return audit.schools_around(t.sites_raw.select(c("id").alias("trace_id"), "lat", "lon"), schools)


@check("s7_commune_rings", "SELECT c, dep, part, south, west, north, east FROM commune_parts", ["commune_parts"])
def _(t):
    return mapped.commune_rings(t.commune_shapes).withColumn("b", geo.ring_box(c("ring"))).select("c", "dep", "part", *[c(f"b.{s}").alias(s) for s in ("south", "west", "north", "east")])


@check("s8_department_extent", "SELECT c_nationkey AS dep, min(lon) - 0.12::DOUBLE AS west, min(lat) - 0.1::DOUBLE AS south, max(lon) + 0.12::DOUBLE AS east, max(lat) + 0.1::DOUBLE AS north FROM (SELECT c_nationkey, s.lat, s.lon FROM customer JOIN sites_raw s ON k = c_custkey) GROUP BY c_nationkey", ["sites_raw"])
def _(t):
    centres = t.customer.select(c("c_custkey").alias("k"), c("c_nationkey").alias("dep")).join(t.sites_raw.select("k", "lat", "lon"), "k")
    return mapped.department_extent(centres)


@check("j12_inside_communes", "SELECT id FROM sites_raw WHERE EXISTS (SELECT 1 FROM commune_parts WHERE lat >= south AND lat < north AND lon >= west AND lon < east)", ["sites_raw", "commune_parts"])
def _(t):
    return audit.in_communes(t.sites_raw.select("id", "lat", "lon"), mapped.commune_rings(t.commune_shapes), key="id").select("id")


PLACE_ROWS = "SELECT concat('o', CAST(k AS STRING)) AS place_id, lat0 AS lat, lon0 AS lon FROM {objects}"


@check("j13_far_from_known_venues", f"""SELECT place_id, near_id, near_m FROM (SELECT place_id, s.id AS near_id, CAST(round_even(round({M('p.lat', 'p.lon', 's.lat', 's.lon')}, 3), 0) AS INTEGER) AS near_m, round({M('p.lat', 'p.lon', 's.lat', 's.lon')}, 3) AS m
   FROM ({plain(PLACE_ROWS)}) p, sites_raw s WHERE s.lat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY round({M('p.lat', 'p.lon', 's.lat', 's.lon')}, 3), s.id) = 1) WHERE m > 200""", ["objects", "sites_raw"])
def _(t):
    return audit.unknown_places(t.derive(PLACE_ROWS), t.sites_raw.select("id", "lat", "lon")).select("place_id", "near_id", "near_m")


@check("j14_not_already_listed", f"SELECT place_id FROM ({plain(PLACE_ROWS)}) p WHERE NOT EXISTS (SELECT 1 FROM sites_raw s WHERE {M('p.lat', 'p.lon', 's.lat', 's.lon')} <= 200)", ["objects", "sites_raw"])
def _(t):
    return audit.not_already_listed(t.derive(PLACE_ROWS), t.sites_raw.select("lat", "lon")).select("place_id")
