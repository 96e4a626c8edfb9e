"""Whole jobs (E1, E4-E9) over derived tables. Their parts are checked one by one elsewhere."""
from pyspark.sql import functions as F

from ringside.checks.auditing import TOPONYMS, greedy_sql, place_elements
from ringside.checks.building import CENSUS_ROWS, PARTS
from ringside.checks.placing import ADDRESSES, AUDIT, CLAIM_NEEDS, FACILITIES, MISSING, PATCHES, plain
from ringside.checks.registry import check
from ringside.checks.tables import CTES, EQUIPMENT_ORDER, metres_sql
from ringside.checks.validating import CASES, EXPECTED, KEY, records as broken_records
from ringside.operators import facets, overlay, publish, rollup
from ringside.plans import coverage
from ringside.sources import mapped, patches as patch_source

c = F.col

# patches on a third of the venues, and new ones: events give the keys and values
E1_PATCH = """concat('{"id":"', CASE WHEN event_id % 5 = 0 THEN concat('c-new-', CAST(user_id AS STRING)) ELSE concat('I', lpad(CAST(user_id * 3 AS STRING), 9, '0')) END, '"',
   CASE event_type WHEN 'click' THEN concat(',"couloirs":', CASE WHEN value < 60 THEN 'null' ELSE CAST(CAST(floor(value / 60) AS INT) AS STRING) END)
     WHEN 'view' THEN concat(',"surface":"', CASE WHEN value < 200 THEN 'bitume' ELSE 'sable' END, '"')
     WHEN 'purchase' THEN concat(',"longueur_piste":', CAST(CAST(floor(value) AS INT) AS STRING)) WHEN 'signup' THEN concat(',"longueur_probable":', CAST(CAST(floor(value) AS INT) AS STRING))
     ELSE ',"lat":47.5,"lon":-1.25' END, CASE WHEN event_id % 97 = 0 THEN ',"supprime":true' ELSE '' END, '}')"""
E1_FILE = "concat('p', lpad(CAST(event_id AS STRING), 9, '0'), '.json')"
ROLLED = ("SELECT inst_numero AS id, " + ", ".join(f"{sql} AS {name}" for part in ("coordinates", "track", "lanes", "surface") for name, sql in PARTS[part]) + " FROM census_rows GROUP BY inst_numero")
last = lambda key, kind: f"CAST(arg_max_null(json_extract_string(doc, '$.{key}'), file) FILTER (WHERE list_contains(json_keys(doc), '{key}')) AS {kind})"
has = lambda key: f"coalesce(bool_or(list_contains(json_keys(doc), '{key}')), false)"
KEYS = {"couloirs": "INTEGER", "surface": "VARCHAR", "longueur_piste": "INTEGER", "lat": "DOUBLE", "lon": "DOUBLE", "supprime": "BOOLEAN"}
E1_FOLD = ("SELECT json_extract_string(doc, '$.id') AS id, count(*) AS n, " + ", ".join(f"{last(k, v)} AS {k}, {has(k)} AS has_{k}" for k, v in KEYS.items())
           + ", CAST(arg_max_null(json_extract_string(doc, '$.longueur_probable'), file) FILTER (WHERE list_contains(json_keys(doc), 'longueur_probable') OR list_contains(json_keys(doc), 'longueur_piste')) AS INTEGER) AS longueur_probable"
           + f" FROM (SELECT {E1_FILE} AS file, CAST({E1_PATCH} AS JSON) AS doc FROM events) GROUP BY 1")
pick = lambda key: f"CASE WHEN has_{key} THEN f.{key} ELSE b.{key} END"


@check("e1_dataset_build", f"""SELECT * FROM (SELECT coalesce(b.id, f.id) AS id, coalesce(b.piste, true) AS piste, nullif({pick('couloirs')}, 0) AS couloirs, {pick('surface')} AS surface, nullif({pick('longueur_piste')}, 0) AS longueur_piste, nullif(f.longueur_probable, 0) AS longueur_probable,
     nullif(round_even({pick('lat')}, 5), 0) AS lat, nullif(round_even({pick('lon')}, 5), 0) AS lon, CASE WHEN b.id IS NULL AND n = 1 THEN 2 WHEN f.id IS NOT NULL THEN 1 END AS source
   FROM rolled b FULL OUTER JOIN folded_patches f ON b.id = f.id WHERE NOT coalesce(supprime, false) AND {pick('lat')} IS NOT NULL AND {pick('lon')} IS NOT NULL)""",
       ["equipment", "census_rows", "rolled", "folded_patches"], census_rows=CENSUS_ROWS, rolled=ROLLED, folded_patches=E1_FOLD)
def _(t):
    files = t.events.select(F.expr(E1_FILE).alias("file"), F.expr(E1_PATCH).alias("text"))
    typed = patch_source.typed_patches(patch_source.split_records(files))
    merged = overlay.apply_patches(rollup.rollup(t.census, EQUIPMENT_ORDER), typed, ("file", "pos"))
    tracks = publish.compact(publish.located(merged))
    return tracks.select(c("i").alias("id"), (c("p") == 1).alias("piste"), c("cl").alias("couloirs"), c("s").alias("surface"), c("lp").alias("longueur_piste"),
                         c("lpp").alias("longueur_probable"), c("y").alias("lat"), c("x").alias("lon"), c("sr").alias("source"))


@check("e4_facet_and_cell_build", """SELECT 'lists' AS what, count(*) AS n FROM (SELECT DISTINCT facet, value, dep FROM members UNION ALL SELECT DISTINCT facet, value, NULL FROM members WHERE facet NOT IN ('department', 'city'))
   UNION ALL SELECT 'cells', count(*) FROM (SELECT DISTINCT round_even(y / 0.1::DOUBLE, 0), round_even(x / 0.1::DOUBLE, 0) FROM idx) UNION ALL SELECT 'venues', count(*) FROM idx""", ["members", "idx"])
def _(t):
    said = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    cells = facets.geo_cells(t.index).select("cell_y", "cell_x").distinct()
    return said(facets.facet_counts(t.index), "lists").unionByName(said(cells, "cells")).unionByName(said(t.index, "venues"))


@check("e5_neighbourhood_build", """SELECT 'cities' AS what, count(*) AS n FROM city_table UNION ALL SELECT 'departments', count(DISTINCT dep) FROM ready UNION ALL SELECT 'criteria', count(*) FROM kept_criteria
   UNION ALL SELECT 'neighbours', sum(least(n - 1, 6) * n)::BIGINT FROM (SELECT dep, count(*) AS n FROM ready GROUP BY dep)""", ["city_table", "kept_criteria", "ready"])
def _(t):
    said = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    parts = {"cities": facets.cities(facets.city_members(t.ready)), "departments": facets.department_index(t.ready),
             "criteria": facets.criterion_counts(t.ready), "neighbours": facets.neighbours(t.ready)}
    out = None
    for what, df in parts.items():
        out = said(df, what) if out is None else out.unionByName(said(df, what))
    return out


@check("e6_lap_estimation", PATCHES, ["sites_raw", "lap_ring_rows"])
def _(t):
    venues = t.sites_raw.select("id", "lat", "lon", "longueur_piste")
    return coverage.estimate_laps(venues, t.elements, t.sites_raw.select("id", "note"))[2]


AT = metres_sql
WHOLE_OBJECTS = f"({CTES['objects']})"
NEAREST_ADDRESS = lambda rows, key: f"""(SELECT p.{key}, a.city, a.street, a.postcode FROM {rows} p, ({plain(ADDRESSES)}) a
   QUALIFY row_number() OVER (PARTITION BY p.{key} ORDER BY round({AT('p.lat', 'p.lon', 'a_lat', 'a_lon')}, 3), a_id) = 1)"""
# groups, claims and context of the missing tracks in one text
E7 = f"""SELECT m.* EXCLUDE (trace_id), v.nom AS near_name, v.ville AS near_city, 'https://www.openstreetmap.org/' || m.osm AS url, f.place, s.school, a.city, a.street, a.postcode
   FROM missing_rows m LEFT JOIN sites_raw v ON v.id = m.near_id
   LEFT JOIN (SELECT trace_id, f.name AS place FROM missing_rows p JOIN ({FACILITIES.replace('{objects}', WHOLE_OBJECTS)}) f ON {AT('p.lat', 'p.lon', 'f_lat', 'f_lon')} <= 200
      QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY f.rank, {AT('p.lat', 'p.lon', 'f_lat', 'f_lon')}, f.name) = 1) f ON f.trace_id = m.trace_id
   LEFT JOIN (SELECT trace_id, arg_min(q.name, CAST(q.s AS VARCHAR)) AS school FROM missing_rows p JOIN supplier_points q ON lat >= s_lat AND lat < s_lat + 2e-2 AND lon >= s_lon AND lon < s_lon + 3e-2 GROUP BY trace_id) s ON s.trace_id = m.trace_id
   LEFT JOIN {NEAREST_ADDRESS('missing_rows', 'trace_id')} a ON a.trace_id = m.trace_id"""


@check("e7_coverage_audit", E7, [*CLAIM_NEEDS, "supplier_points", "missing_rows"], **AUDIT, missing_rows=MISSING)
def _(t):
    box = "array(named_struct('lat', s_lat, 'lon', s_lon), named_struct('lat', s_lat, 'lon', s_lon + 3e-2), named_struct('lat', s_lat + 2e-2, 'lon', s_lon + 3e-2), named_struct('lat', s_lat + 2e-2, 'lon', s_lon), named_struct('lat', s_lat, 'lon', s_lon))"
    schools = t.supplier_points.select(c("s").cast("string").alias("school_id"), c("name").alias("school"), F.expr(box).alias("ring"))
    out = coverage.audit_coverage(t.sites_raw.select("id", "nom", "ville", "dep", "lat", "lon"), t.twin_elements, t.derive(FACILITIES), schools, t.derive(ADDRESSES))
    return out["missing"].drop("trace_id")


# toponyms and pitches inside the communes, grouped by a walk in the order of layer and hash
LOOKED = f"""SELECT *, md5(place_id) AS hash FROM (SELECT *, concat_ws('|', CAST(layer AS VARCHAR), coalesce(osm, ''), printf('%.7f', lat), printf('%.7f', lon), nom) AS place_id FROM (
     SELECT 0 AS layer, source, nom, lat, lon, osm FROM ({TOPONYMS}) UNION ALL SELECT 1, 'BD TOPO (city-stade)', 'City', lat0 + 1e-2, lon0 + 1e-2, NULL FROM objects))
   WHERE EXISTS (SELECT 1 FROM commune_parts WHERE lat >= south AND lat < north AND lon >= west AND lon < east)"""
LOOKED_GROUPS = greedy_sql("SELECT row_number() OVER (ORDER BY layer, hash) AS i, place_id AS id, '' AS g, lat, lon FROM looked", 200, "place_id")
LOOKED_HEADS = f"""SELECT h.*, v.venue_id AS near_id, CAST(round_even(v.m, 0) AS INTEGER) AS near_m FROM (
     SELECT leader, arg_min(p.place_id, o) AS place_id, arg_min(source, o) AS source, arg_min(nom, o) AS nom, arg_min(lat, o) AS lat, arg_min(lon, o) AS lon, arg_min_null(osm, o) AS osm, count(*) AS members,
       array_to_string(list_sort(list(DISTINCT source)), '|') AS sources
     FROM looked_groups g JOIN (SELECT *, ROW(CASE source WHEN 'OSM (equipement nomme)' THEN 0 WHEN 'OSM (voie)' THEN 1 ELSE 2 END, layer, hash) AS o FROM looked) p ON p.place_id = g.place_id GROUP BY leader) h
   JOIN (SELECT p.place_id, s.id AS venue_id, round({AT('p.lat', 'p.lon', 's.lat', 's.lon')}, 3) AS m FROM looked p JOIN sites_raw s ON s.lat IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY p.place_id ORDER BY round({AT('p.lat', 'p.lon', 's.lat', 's.lon')}, 3), s.id) = 1) v ON v.place_id = h.place_id
   WHERE v.m > 200 AND NOT EXISTS (SELECT 1 FROM objects o WHERE o.k % 50 = 0 AND {AT('h.lat', 'h.lon', 'o.lat0', 'o.lon0')} <= 200)"""
E8_TABLES = dict(looked=LOOKED, looked_groups=LOOKED_GROUPS, looked_heads=LOOKED_HEADS)
E8_NEEDS = ["sites_raw", "objects", "commune_parts", "supplier_points", "looked", "looked_groups", "looked_heads"]


def looked_at(t):
    listed = t.objects.where("k % 50 = 0").select(c("lat0").alias("lat"), c("lon0").alias("lon"))
    shaped = t.objects.select(F.lit("Petit terrain multi-sports").alias("nature"), F.lit("City").alias("nature_detaillee"),
                              F.expr("array(array(array(array(lon0 + 1e-2, lat0 + 1e-2))))").alias("coordinates"))
    return coverage.places_to_look_at(t.sites_raw.select("id", "nom", "lat", "lon"), place_elements(t), shaped, t.commune_shapes, listed, t.derive(ADDRESSES))


@check("e8_places_to_look_at", f"""SELECT h.* EXCLUDE (lat, lon), round(lat, 8) AS lat, round(lon, 8) AS lon, v.nom AS near_name, a.city, a.street, a.postcode FROM looked_heads h LEFT JOIN (SELECT id, nom FROM sites_raw) v ON v.id = h.near_id
   LEFT JOIN {NEAREST_ADDRESS('looked_heads', 'place_id')} a ON a.place_id = h.place_id""", E8_NEEDS, **E8_TABLES)
def _(t):
    return looked_at(t)["places"].withColumns({"lat": F.round("lat", 8), "lon": F.round("lon", 8), "sources": F.array_join("sources", "|")})


@check("e8_cluster_names", "SELECT DISTINCT g.leader, p.nom FROM looked_groups g JOIN looked p ON p.place_id = g.place_id JOIN looked_heads h ON h.leader = g.leader WHERE coalesce(p.nom, '') <> ''", E8_NEEDS, **E8_TABLES)
def _(t):
    return looked_at(t)["names"]


PHOTO_CASE = next(i for i, (text, _) in enumerate(CASES) if "a.png" in text)


@check("e9_contribution_validation", f"""SELECT rule, count(*) AS n FROM ({EXPECTED} UNION ALL SELECT concat('r', lpad(c_custkey::VARCHAR, 9, '0'), '.json'), CASE WHEN c_custkey % 5 = 0 OR name = 'a.png' THEN 'photo_missing' WHEN c_custkey % 3 = 0 THEN 'photo_too_large' END, name
   FROM customer, (VALUES ('a.png'), ('a.JPEG')) f(name) WHERE c_custkey % {len(CASES)} = {PHOTO_CASE}) WHERE rule IS NOT NULL GROUP BY rule""")
def _(t):
    name = F.expr(f"concat('I', {KEY})")
    files = t.customer.where("c_custkey % 5 <> 0").select(name.alias("id"), F.lit("a.JPEG").alias("file"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 409601 ELSE 9 END").alias("length"))
    return coverage.check_contributions(broken_records(t), files).groupBy("rule").agg(F.count("*").alias("n"))
