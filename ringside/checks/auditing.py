"""Mapped objects: scans, filters, rejections, groupings."""
from pyspark.sql import functions as F

from ringside import vocab
from ringside.checks.registry import check
from ringside.checks.tables import metres_sql
from ringside.functions import geo
from ringside.operators import audit, cluster
from ringside.session import cut_lineage
from ringside.sources import mapped

c = F.col
TOKENS = "string_split_regex(lower(coalesce({x}, '')), '[;,| ]+')"
CONTEST = "[" + ", ".join(f"'{x}'" for x in vocab.CONTEST_TAGS) + "]"


@check("s3_lap_objects", "SELECT k FROM lap_objects", ["lap_objects"])
def _(t):
    return mapped.lap_objects(t.elements).select("k")


@check("s4_audit_objects", "SELECT k FROM audit_objects", ["audit_objects"])
def _(t):
    return mapped.audit_objects(t.elements).select("k")


@check("f16_may_be_athletics", f"SELECT k, coalesce(sport, '') = '' OR len(list_intersect({TOKENS.format(x='sport')}, ['athletics', 'running'])) > 0 AS keep FROM objects", ["objects"])
def _(t):
    return t.elements.select("k", audit.may_be_athletics().alias("keep"))


@check("f17_is_athletics", "SELECT k, coalesce(sport, '') LIKE '%athletics%' OR coalesce(sport, '') LIKE '%running%' OR coalesce(athletics = 'running', false) AS keep FROM objects", ["objects"])
def _(t):
    return t.elements.select("k", audit.is_athletics().alias("keep"))


@check("f18_field_event", f"SELECT k, len(list_intersect({TOKENS.format(x='athletics')}, {CONTEST})) > 0 AS contest FROM objects", ["objects"])
def _(t):
    return t.elements.select("k", audit.is_field_event().alias("contest"))


@check("x15_ring_selection", "SELECT k, count(*) AS traces, bool_and(closed) AS closed, round(sum(perimeter), 3) AS metres FROM audit_traces GROUP BY k", ["audit_traces"])
def _(t):
    one = t.elements.select("k", F.explode(audit.traces()).alias("t"))
    return one.groupBy("k").agg(F.count("*").alias("traces"), F.bool_and("t.closed").alias("closed"), F.round(F.sum(geo.perimeter(c("t.ring"))), 3).alias("metres"))


@check("f19_point_floors", "SELECT k, pts, closed AND pts >= 10 AS lap, pts >= CASE WHEN closed THEN 8 ELSE 2 END AS audit FROM audit_traces", ["audit_traces"])
def _(t):
    one = t.elements.select("k", F.explode(audit.traces()).alias("t")).select("k", F.size("t.ring").alias("pts"), "t.closed")
    return one.select("k", "pts", (c("closed") & (c("pts") >= audit.MIN_POINTS_LAP)).alias("lap"),
                      (c("pts") >= F.when(c("closed"), audit.MIN_POINTS).otherwise(audit.MIN_POINTS_OPEN)).alias("audit"))


@check("f20_length_windows", "SELECT k, perimeter BETWEEN 60 AND 600 AS audit, perimeter BETWEEN 150 AND 520 AS lap FROM audit_traces", ["audit_traces"])
def _(t):
    one = t.elements.select("k", F.explode(audit.traces()).alias("t")).select("k", geo.perimeter(c("t.ring")).alias("m"))
    return one.select("k", c("m").between(*audit.AUDIT_BOUNDS).alias("audit"), c("m").between(*audit.LAP_BOUNDS).alias("lap"))


@check("f21_rejection_ledger", "SELECT osm, reason, CASE WHEN judged THEN loop END AS loop, CASE WHEN judged THEN ribbon END AS ribbon, CASE WHEN judged THEN round(m, 3) END AS m FROM (SELECT *, coalesce(reason NOT IN ('autre_sport', 'concours', 'sans_trace'), true) AS judged FROM examined)", ["examined"])
def _(t):
    # shape and length are only looked at once sport and field event have passed
    judged = F.coalesce(~c("reason").isin("autre_sport", "concours", "sans_trace"), F.lit(True))
    shown = lambda x, name: F.when(judged, x).alias(name)
    return audit.examine_traces(mapped.audit_objects(t.elements)).select(
        "osm", "reason", shown(c("loop"), "loop"), shown(c("ribbon"), "ribbon"), shown(F.round("m", 3), "m"))


EXAMPLE = """concat(osm, CASE reason WHEN 'autre_sport' THEN ' (sport=' || sport || ')' WHEN 'concours' THEN ' (athletics=' || athletics || ')' WHEN 'trop_peu_de_points' THEN ' (' || pts || ' points)'
   WHEN 'hors_bornes' THEN ' (' || CAST(round_even(m, 0) AS BIGINT) || ' m)' ELSE '' END)"""


@check("a14_rejections_by_reason", f"""SELECT reason, count(*) AS n, array_to_string(list(example ORDER BY trace_id)[:3], '|') AS examples FROM (SELECT *, {EXAMPLE} AS example, osm || '#0' AS trace_id FROM examined WHERE reason IS NOT NULL) GROUP BY reason ORDER BY n DESC""", ["examined"])
def _(t):
    rejected = cut_lineage(audit.rejects(audit.examine_traces(mapped.audit_objects(t.elements))).select("reason", "trace_id", "example"))
    return audit.rejection_counts(rejected).withColumn("examples", F.array_join("examples", "|")).orderBy(F.desc("n"))


# ------------------------------------------------------------------------------- places
def place_elements(t):
    """Objects whose position is told in one of the three ways a map tells it."""
    tags = F.map_filter(F.create_map(F.lit("leisure"), c("leisure2"), F.lit("highway"), c("highway"), F.lit("name"), c("name")), lambda k, v: v.isNotNull())
    spot = lambda dy, dx: f"named_struct('lat', lat0 + {dy}, 'lon', lon0 + {dx})"
    return t.objects.select(
        "type", c("k").alias("id"), tags.alias("tags"), F.expr(f"CASE WHEN k % 4 = 2 THEN array({spot('0e0', '0e0')}, {spot('1e-3', '2e-3')}) END").alias("geometry"),
        F.lit(None).cast(mapped.ELEMENT["members"].dataType).alias("members"), F.expr(f"CASE WHEN k % 4 = 0 THEN {spot('0e0', '0e0')} END").alias("center"),
        F.expr("CASE WHEN k % 4 = 1 THEN lat0 END").alias("lat"), F.expr("CASE WHEN k % 4 = 1 THEN lon0 END").alias("lon"))


TOPONYMS = """SELECT CASE WHEN leisure2 IS NOT NULL THEN 'OSM (equipement nomme)' ELSE 'OSM (voie)' END AS source, name AS nom, lat0 + CASE WHEN k % 4 = 2 THEN 5e-4 ELSE 0 END AS lat, lon0 + CASE WHEN k % 4 = 2 THEN 1e-3 ELSE 0 END AS lon, type || '/' || k AS osm
   FROM objects WHERE k % 4 <> 3 AND ((highway IS NOT NULL AND regexp_matches(name, '(?i)stade|sports?')) OR (leisure2 IS NOT NULL AND name IS NOT NULL))"""
ROUNDED = "source, nom, round(lat, 8) AS lat, round(lon, 8) AS lon, osm"


def rounded(df):
    return df.withColumns({"lat": F.round("lat", 8), "lon": F.round("lon", 8)})


@check("s5_sporting_toponyms", f"SELECT {ROUNDED} FROM ({TOPONYMS})", ["objects"])
def _(t):
    return rounded(mapped.sporting_places(place_elements(t)))


# one pitch per part, as GeoJSON of every depth; whole degrees keep both texts alike
GEOJSON = """concat('{"type":"', CASE k % 4 WHEN 0 THEN 'Point","coordinates":[' WHEN 1 THEN 'LineString","coordinates":[[' WHEN 2 THEN 'Polygon","coordinates":[[[' ELSE 'MultiPolygon","coordinates":[[[[' END,
   CAST(k % 90 AS STRING), ',', CAST(40 + k % 10 AS STRING), CASE k % 4 WHEN 0 THEN ']}' ELSE concat('],[', CAST(k % 90 + 2 AS STRING), ',', CAST(44 + k % 10 AS STRING), CASE k % 4 WHEN 1 THEN ']]}' WHEN 2 THEN ']]]}' ELSE ']]]]}' END) END)"""
NATURE = "CASE WHEN k % 3 = 0 THEN 'Terrain de tennis' ELSE 'Petit terrain multi-sports' END"
DETAIL = "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'City-stade' END"
PITCHES = f"""SELECT 'BD TOPO (city-stade)' AS source, coalesce(nullif({DETAIL}, ''), 'Plateau multisports') AS nom, 40e0 + k % 10 + CASE WHEN k % 4 = 0 THEN 0 ELSE 2 END AS lat, 0e0 + k % 90 + CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS lon, NULL::VARCHAR AS osm FROM objects WHERE k % 3 <> 0"""


def pitches(t):
    shaped = t.objects.select(F.expr(NATURE).alias("nature"), F.expr(DETAIL).alias("nature_detaillee"), F.expr(GEOJSON).alias("g"))
    return mapped.multisport_pitches(shaped.withColumn("coordinates", mapped.as_multipolygon(c("g"))))


@check("s6_multisport_pitches", PITCHES, ["objects"])
def _(t):
    return pitches(t)


@check("u2_toponyms_and_pitches", f"SELECT {ROUNDED} FROM ({TOPONYMS} UNION ALL {PITCHES})", ["objects"])
def _(t):
    return rounded(mapped.sporting_places(place_elements(t)).unionByName(pitches(t)))


def greedy_sql(rows, radius_m, out):
    """Greedy leader grouping as a walk over `rows` (id, g, lat, lon, in order i from 1) that carries the leaders found so far."""
    return f"""SELECT id AS {out}, leader FROM (WITH RECURSIVE o AS ({rows}), walk AS (
       SELECT 0::BIGINT AS i, NULL::VARCHAR AS id, NULL::VARCHAR AS leader, []::STRUCT(id VARCHAR, g VARCHAR, lat DOUBLE, lon DOUBLE)[] AS leaders
       UNION ALL SELECT i, id, coalesce(f.id, id), CASE WHEN f IS NULL THEN list_append(leaders, {{'id': id, 'g': g, 'lat': lat, 'lon': lon}}) ELSE leaders END
       FROM (SELECT o.*, leaders, list_filter(leaders, lambda l: l.g = o.g AND {metres_sql('l.lat', 'l.lon', 'o.lat', 'o.lon')} <= {radius_m})[1] AS f FROM walk JOIN o ON o.i = walk.i + 1))
     SELECT id, leader FROM walk WHERE i > 0)"""


G1_ROWS = """SELECT row_number() OVER (ORDER BY m, osm) AS i, concat(osm, '#0') AS id, dep AS g, lat, lon FROM examined WHERE reason IS NULL"""
G2_ROWS = f"SELECT row_number() OVER (ORDER BY osm) AS i, osm AS id, '' AS g, lat, lon FROM ({TOPONYMS})"


@check("g1_trace_groups", greedy_sql(G1_ROWS, 80, "trace_id"), ["examined"])
def _(t):
    kept = cut_lineage(audit.candidates(audit.examine_traces(mapped.audit_objects(t.elements))))
    return audit.group_traces(kept).select("trace_id", "leader")


def grouped_places(t):
    places = mapped.sporting_places(place_elements(t)).withColumns({"seq": c("osm"), "id": c("osm")})
    return cluster.leader_groups(cut_lineage(places), 200.0, ["seq"]).withColumnRenamed("id", "place_id")


@check("g2_place_groups", greedy_sql(G2_ROWS, 200, "place_id"), ["objects"])
def _(t):
    return grouped_places(t).select("place_id", "leader")


# clusters of known members: places of one postcode-like key, so SQL can say who speaks for each
CLUSTERED = "SELECT k, concat('p', lpad(CAST(k AS STRING), 9, '0')) AS place_id, concat('g', CAST(k % 97 AS STRING)) AS leader, CASE WHEN k % 97 < 30 AND k % 2 = 0 THEN 'OSM (equipement nomme)' WHEN k % 97 < 60 AND k % 5 = 0 THEN 'OSM (voie)' ELSE 'BD TOPO (city-stade)' END AS source, name AS nom, lat0 AS lat, lon0 AS lon, CAST(NULL AS STRING) AS osm FROM {objects}"


@check("a19_cluster_representative", """SELECT leader, arg_min(place_id, ROW(r, k)) AS place_id, arg_min(source, ROW(r, k)) AS source, count(*) AS members, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources
   FROM (SELECT *, CASE source WHEN 'OSM (equipement nomme)' THEN 0 WHEN 'OSM (voie)' THEN 1 ELSE 2 END AS r FROM (""" + CLUSTERED.replace("{objects}", "objects") + ")) GROUP BY leader", ["objects"])
def _(t):
    heads = audit.cluster_heads(t.derive(CLUSTERED), "k")
    return heads.select("leader", "place_id", "source", "members", F.array_join("sources", "|").alias("sources"))


@check("a19_cluster_names", "SELECT DISTINCT leader, nom FROM (" + CLUSTERED.replace("{objects}", "objects") + ") WHERE coalesce(nom, '') <> ''", ["objects"])
def _(t):
    return audit.cluster_names(t.derive(CLUSTERED))


@check("o10_department_codes", "SELECT DISTINCT dep FROM sites_raw WHERE dep IS NOT NULL", ["sites_raw"])
def _(t):
    return t.sites_raw.where("dep IS NOT NULL").select("dep").distinct().orderBy(F.length("dep"), "dep")


@check("k6_candidate_json", """SELECT concat('{"osm":"', osm, '","dep":"', dep, '","points":', pts, ',"loop":', loop::VARCHAR, ',"ribbon":', ribbon::VARCHAR, '}') AS line FROM examined WHERE reason IS NULL""", ["examined"])
def _(t):
    kept = audit.candidates(audit.examine_traces(mapped.audit_objects(t.elements)))
    return kept.select(F.to_json(F.struct("osm", "dep", c("pts").alias("points"), "loop", "ribbon")).alias("line"))
