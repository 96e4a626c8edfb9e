"""Inputs of the checks, derived from the driver's tables.

Each derivation is one SQL text that Spark and the SQL checker both understand, so the two
sides start from the same rows. Only rings need a text per engine, because arrays of vertices
are written differently; both follow the same arithmetic.
"""
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ringside.operators import publish

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

LAT = "44e0 + (({k} * 7919) % 30000) / 1e4"
LON = "-1e0 + (({k} * 104729) % 40000) / 1e4"

# ------------------------------------------------------------------ texts for both engines
EQUIPMENT = """
SELECT CASE WHEN l_orderkey % 211 = 5 THEN '' ELSE concat('I', lpad(CAST(l_orderkey AS STRING), 9, '0')) END AS inst_numero,
  CASE l_orderkey % 3 WHEN 0 THEN concat('STADE MUNICIPAL DE L''ÉTANG-NEUF ', CAST(l_suppkey AS STRING))
       WHEN 1 THEN concat('Complexe sportif ', CAST(l_partkey AS STRING)) ELSE concat('GYMNASE-DES LE LAC ', CAST(l_linenumber AS STRING)) END AS inst_nom,
  concat(CAST(l_linenumber AS STRING), ' RUE DU STADE') AS inst_adresse,
  lpad(CAST(1000 + l_partkey % 95000 AS STRING), 5, '0') AS inst_cp,
  CASE WHEN l_orderkey % 10 = 0 THEN concat('Lyon ', CAST(1 + l_suppkey % 9 AS STRING), 'e Arrondissement')
       ELSE concat('SAINT-JEAN ', CAST(l_orderkey % 40 AS STRING)) END AS new_name,
  CAST(l_orderkey % 95 AS STRING) AS dep_code, concat('Département ', CAST(l_orderkey % 95 AS STRING)) AS dep_nom,
  concat('Région ', CAST(l_orderkey % 13 AS STRING)) AS reg_nom, CAST(l_orderkey AS STRING) AS new_code,
  CASE WHEN l_partkey % 6 = 0 THEN '0440001A' ELSE NULL END AS inst_uai,
  concat('E', CAST(l_partkey AS STRING)) AS equip_numero,
  CASE l_partkey % 15 WHEN 0 THEN 'Sautoir en LONGUEUR' WHEN 1 THEN 'Triple saut' WHEN 2 THEN 'Saut à la perche'
       WHEN 3 THEN 'Hauteur' WHEN 4 THEN 'Lancer du poids' WHEN 5 THEN 'Cage de disque' WHEN 6 THEN 'Marteau'
       WHEN 7 THEN 'Javelot' WHEN 8 THEN 'Rivière de steeple' WHEN 9 THEN 'Aire de saut' WHEN 10 THEN 'Aire de lancer'
       WHEN 11 THEN 'Piste' WHEN 12 THEN 'Sautoir longeur et hauteur' WHEN 13 THEN 'Superpoidsx' ELSE NULL END AS equip_nom,
  CASE WHEN l_linestatus = 'O' AND l_partkey % 2 = 0 THEN 'Stade d’athlétisme' WHEN l_linestatus = 'O' THEN 'Piste d''athlétisme isolée'
       WHEN l_partkey % 3 = 0 THEN 'Aire de saut' WHEN l_partkey % 3 = 1 THEN 'Aire de lancer' ELSE NULL END AS equip_type_name,
  CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 17 = 0 THEN 0e0 ELSE 41e0 + ((l_partkey * 7919) % 100000) / 1e4 END AS lat,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE -1e0 + ((l_suppkey * 104729) % 40000) / 1e4 END AS lon,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_returnflag = 'R' THEN 'Synthétique (hors gazon)' WHEN l_returnflag = 'A' THEN 'Stabilisé/cendrée'
       WHEN l_suppkey % 3 = 0 THEN 'Inconnu' ELSE 'Béton' END AS equip_sol,
  CASE l_suppkey % 5 WHEN 0 THEN 'Intérieur' WHEN 1 THEN 'Découvrable' ELSE 'Découvert' END AS equip_nature,
  CAST(CAST(l_quantity AS INT) % 9 AS STRING) AS equip_piste_nb,
  CASE WHEN l_quantity > 40e0 THEN 'abc' WHEN l_quantity > 30e0 THEN '400.7' WHEN l_quantity > 20e0 THEN '0'
       ELSE CAST(200 + 50 * (l_partkey % 5) AS STRING) END AS equip_piste_long,
  CASE WHEN l_discount > 0.075e0 THEN 'true' WHEN l_discount > 0.035e0 THEN 'false' ELSE NULL END AS equip_eclair,
  CASE WHEN l_tax > 0.065e0 THEN 'Oui' WHEN l_tax > 0.025e0 THEN 'non' ELSE NULL END AS equip_acc_libre,
  CASE WHEN l_suppkey % 7 = 0 THEN '1' ELSE '0' END AS equip_ouv_public_bool,
  CASE WHEN l_suppkey % 11 = 0 THEN ' TRUE ' ELSE NULL END AS equip_douche,
  CASE WHEN l_partkey % 9 = 0 THEN 'oui' ELSE 'faux' END AS equip_sanit,
  CAST(l_suppkey % 3 AS STRING) AS equip_vest_sport, CAST(l_partkey % 4 * 100 AS STRING) AS equip_trib_nb,
  CASE l_partkey % 7 WHEN 0 THEN ' stade.example.org ' WHEN 1 THEN 'http://club.example.org' WHEN 2 THEN '' ELSE NULL END AS equip_url,
  CASE WHEN l_suppkey % 6 = 0 THEN '0' ELSE CAST(year(l_shipdate) AS STRING) END AS equip_service_date,
  CASE WHEN l_suppkey % 5 = 0 THEN 'n/a' ELSE CAST(year(l_shipdate) + 3 AS STRING) END AS equip_travaux_date,
  concat('P', CAST(l_suppkey % 4 AS STRING)) AS equip_prop_type, concat('G', CAST(l_suppkey % 5 AS STRING)) AS equip_gest_type,
  CASE WHEN l_partkey % 19 = 0 THEN 'Salle' ELSE 'Equipement d''athlétisme' END AS equip_type_famille,
  l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
FROM {lineitem}"""
EQUIPMENT_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                   "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

SITES_RAW = f"""
SELECT c.k AS k, concat('I', lpad(CAST(c.k AS STRING), 9, '0')) AS id,
  CASE WHEN c.k % 13 = 0 THEN '' WHEN c.k % 29 = 0 THEN NULL ELSE concat('Stade Émile ', c.seg, ' ', CAST(c.k % 50 AS STRING)) END AS nom,
  CASE WHEN c.k % 17 = 0 THEN '' ELSE concat(CAST(c.k % 90 AS STRING), ' rue du Stade') END AS adresse,
  lpad(CAST(1000 + c.k % 95000 AS STRING), 5, '0') AS cp,
  CASE WHEN c.k % 10 = 0 THEN concat(CASE c.k % 3 WHEN 0 THEN 'Lyon' WHEN 1 THEN 'Paris' ELSE 'Marseille' END, ' ', CAST(1 + c.k % 20 AS STRING), 'e Arrondissement')
       WHEN c.k % 31 = 0 THEN NULL WHEN c.k % 11 = 0 THEN upper(concat('Évry-', substr(c.seg, 1, 3), ' ', CAST(c.k % 7 AS STRING)))
       ELSE concat('Évry-', substr(c.seg, 1, 3), ' ', CAST(c.k % 7 AS STRING)) END AS ville,
  c.dep AS dep,
  CASE WHEN c.dep IS NULL THEN NULL WHEN c.dep = '69' THEN 'Rhône' WHEN c.dep = '75' THEN 'Paris' WHEN n.n_name IS NULL THEN NULL
       WHEN c.dep IN ('3', '4') THEN 'Même nom' ELSE concat('Département ', n.n_name) END AS dep_nom,
  CASE WHEN c.dep IS NULL THEN NULL WHEN c.dep = '69' THEN 'Auvergne' WHEN c.dep = '75' THEN 'Île' ELSE r.r_name END AS region,
  CASE WHEN c.k % 97 = 0 THEN NULL ELSE {LAT.format(k='c.k')} END AS lat,
  CASE WHEN c.k % 97 = 0 THEN NULL ELSE {LON.format(k='c.k')} END AS lon,
  c.k % 10 <> 3 AS piste, CAST(nullif(c.k % 9, 0) AS INT) AS couloirs,
  CAST(CASE WHEN c.k % 23 = 0 THEN 300 + c.k % 101 ELSE CASE c.k % 7 WHEN 0 THEN 400 WHEN 1 THEN 250 WHEN 2 THEN 333 WHEN 3 THEN 0 ELSE NULL END END AS INT) AS longueur_piste,
  CAST(CASE c.k % 5 WHEN 0 THEN 200 WHEN 1 THEN 400 ELSE NULL END AS INT) AS longueur_probable,
  CASE c.k % 8 WHEN 0 THEN 'synthetique' WHEN 1 THEN 'bitume' WHEN 2 THEN 'cendree' WHEN 3 THEN 'sable' WHEN 4 THEN 'gazon' WHEN 5 THEN 'naturel' WHEN 6 THEN 'interieur' ELSE NULL END AS surface,
  c.k % 12 = 1 AS couvert, c.k % 4 = 1 AS eclairage, c.k % 5 = 2 AS acces_libre, c.k % 3 = 1 AS ouvert_public,
  c.k % 6 = 1 AS vestiaires, c.k % 7 = 1 AS douches, c.k % 9 = 1 AS sanitaires, c.k % 8 = 1 AS scolaire,
  CAST(c.k % 4 * 50 AS INT) AS tribunes, CAST(1950 + c.k % 70 AS INT) AS annee, CAST(CASE WHEN c.k % 2 = 0 THEN 2000 + c.k % 20 ELSE NULL END AS INT) AS renovation,
  CASE WHEN c.k % 6 = 0 THEN concat('https://club', CAST(c.k AS STRING), '.example.org') ELSE NULL END AS url,
  CAST(c.k % 3 AS INT) AS source,
  concat_ws(',', CASE WHEN c.k % 4 = 0 THEN 'longueur' END, CASE WHEN c.k % 6 = 0 THEN 'poids' END, CASE WHEN c.k % 7 = 0 THEN 'disque' END,
     CASE WHEN c.k % 9 = 0 THEN 'perche' END, CASE WHEN c.k % 10 = 0 THEN 'hauteur' END, CASE WHEN c.k % 14 = 0 THEN 'steeple' END,
     CASE WHEN c.k % 15 = 0 THEN 'javelot' END, CASE WHEN c.k % 21 = 0 THEN 'triple' END, CASE WHEN c.k % 22 = 0 THEN 'marteau' END) AS agres_csv,
  concat_ws(',', CASE WHEN c.k % 5 = 0 THEN 'longueur' END, CASE WHEN c.k % 8 = 3 THEN 'saut_indetermine' END, CASE WHEN c.k % 11 = 3 THEN 'poids' END) AS agres_probables_csv,
  CAST(c.k % 3 AS BIGINT) AS nb_sautoirs, CAST(c.k % 4 AS BIGINT) AS nb_aires_lancer,
  CAST(CASE WHEN c.k % 6 = 0 THEN 1 + c.k % 4 ELSE 0 END AS INT) AS nb_avis,
  CASE WHEN c.k % 6 = 0 THEN (10 + c.k % 40) / 1e1 ELSE NULL END AS note_moyenne,
  CAST(CASE WHEN c.k % 8 = 0 THEN c.k % 3 ELSE 0 END AS INT) AS n_photos,
  CASE WHEN c.k % 30 = 0 THEN concat('Note ', c.seg) ELSE NULL END AS note
FROM (SELECT c_custkey AS k, c_mktsegment AS seg,
        CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 10 = 0 AND c_nationkey % 2 = 0 THEN CASE c_custkey % 3 WHEN 0 THEN '69' WHEN 1 THEN '75' ELSE '13' END
             ELSE CAST(c_nationkey AS STRING) END AS dep FROM {{customer}}) c
LEFT JOIN {{nation}} n ON CAST(n.n_nationkey AS STRING) = c.dep
LEFT JOIN {{region}} r ON r.r_regionkey = n.n_regionkey"""

DEPS = """
SELECT CAST(n_nationkey AS STRING) AS dep, concat(CASE n_nationkey % 3 WHEN 0 THEN 'Bouches-' WHEN 1 THEN 'Côtes ' ELSE '' END, n_name) AS dep_nom,
  r_name AS region, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 2018 + n_nationkey % 5 ELSE NULL END AS INT) AS ortho_annee
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""

PATCH_EVENTS = """
SELECT user_id * 11 AS id, ts, event_id, event_type AS pkey, value,
  CASE WHEN value < 20 THEN NULL ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) END AS v
FROM {events}"""

# mapped objects: one row per part, with its tags as plain columns and the shape of its trace
OBJECTS = f"""
SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 4 THEN 'relation' ELSE 'way' END AS type,
  CASE p_partkey % 4 WHEN 2 THEN 'pitch' WHEN 3 THEN NULL ELSE 'track' END AS leisure,
  CASE p_partkey % 5 WHEN 1 THEN 'athletics' WHEN 2 THEN 'soccer;athletics' WHEN 3 THEN 'Soccer' WHEN 4 THEN 'running' ELSE NULL END AS sport,
  CASE WHEN p_partkey % 13 = 0 THEN 'sprint;long_jump' WHEN p_partkey % 17 = 0 THEN 'running' WHEN p_partkey % 19 = 0 THEN 'sprint' ELSE NULL END AS athletics,
  CASE WHEN p_partkey % 6 = 1 THEN 'residential' ELSE NULL END AS highway,
  CASE WHEN p_partkey % 7 = 3 THEN NULL WHEN p_partkey % 3 = 0 THEN concat('Rue du Stade ', p_name) WHEN p_partkey % 3 = 1 THEN concat('Rue des SPORTS ', p_brand) ELSE p_name END AS name,
  CASE p_partkey % 8 WHEN 0 THEN 'sports_centre' WHEN 1 THEN 'stadium' ELSE NULL END AS leisure2,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(2 + p_partkey % 7 AS STRING) ELSE NULL END AS lanes,
  CASE WHEN p_partkey % 2 = 0 THEN 'tartan' ELSE NULL END AS surface,
  p_partkey % 29 = 1 AS no_trace, p_partkey % 6 = 0 AS is_ribbon, p_partkey % 11 = 3 AS is_open,
  CAST(p_size + 8 AS INT) AS n, 40e0 + p_size AS r,
  {LAT.format(k='p_partkey')} + (p_partkey % 7) * 4e-4 AS lat0, {LON.format(k='p_partkey')} AS lon0
FROM {{part}}"""

# the same objects three to a place, some 35 m apart, so that traces group and any of them can be a venue's
TWINS = f"""
SELECT k, type, leisure, sport, athletics, highway, name, leisure2, lanes, surface, no_trace, is_ribbon, is_open, n, r,
  {LAT.format(k='(k - k % 3)')} + (k % 3) * 3e-4 AS lat0, {LON.format(k='(k - k % 3)')} AS lon0 FROM ({OBJECTS})"""

SUPPLIER_POINTS = """
SELECT s_suppkey AS s, s_name AS name, 44e0 + ((s_suppkey * 31337) % 30000) / 1e4 AS s_lat,
  -1e0 + ((s_suppkey * 7477) % 40000) / 1e4 AS s_lon, CAST(s_suppkey % 4 AS INT) AS rank FROM {supplier}"""

NAMES = """
SELECT DISTINCT p_name AS author FROM {part} UNION SELECT DISTINCT split_part(p_name, ' ', 1) AS author FROM {part}
UNION SELECT DISTINCT concat(upper(p_name), ' ', p_type) AS author FROM {part} WHERE p_partkey % 3 = 0"""

SHOTS = """
SELECT concat('I', lpad(CAST(o_custkey AS STRING), 9, '0')) AS id, concat(CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE '' END, p_name, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE '' END) AS credit
FROM {orders} JOIN {part} ON p_partkey = o_custkey WHERE o_orderstatus = 'F'
UNION ALL SELECT concat('I', lpad(CAST(o_custkey AS STRING), 9, '0')) AS id, CASE WHEN o_orderkey % 2 = 0 THEN '  ' ELSE NULL END AS credit FROM {orders} WHERE o_orderstatus = 'P'"""
REVIEWS = """
SELECT concat('I', lpad(CAST(o_custkey AS STRING), 9, '0')) AS id, CASE WHEN o_orderkey % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS author
FROM {orders} JOIN {part} ON p_partkey = o_custkey + 1 WHERE o_orderstatus = 'O'"""

TALKS = """
SELECT conv_id AS id, turn AS seq, text AS texte, role AS auteur,
  CASE WHEN turn = 3 THEN NULL ELSE concat('2026-0', CAST(1 + (conv_id + turn * 2) % 6 AS STRING), '-1', CAST(turn % 3 AS STRING)) END AS date,
  CAST(CASE WHEN role = 'system' OR turn % 4 = 2 THEN NULL ELSE 1 + (turn + conv_id) % 5 END AS INT) AS note
FROM {conversations}"""

HISTORY = """
SELECT concat('I', lpad(CAST(o_custkey AS STRING), 9, '0')) AS id, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'M' ELSE 'R' END AS status,
  substr(CAST(o_orderdate AS STRING), 1, 10) AS date FROM {orders}"""
STAMPS = """
SELECT concat('I', lpad(CAST(c_custkey AS STRING), 9, '0')) AS id, concat('2026-01-', lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')) AS mtime
FROM {customer} WHERE c_custkey % 5 <> 0"""
SAMPLES = """
SELECT CAST(c_nationkey AS STRING) AS dep, o_orderkey AS seq, CAST(CASE WHEN c_nationkey % 3 = 0 THEN 2020 ELSE year(o_orderdate) END AS INT) AS year
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

# communes: one per nation; odd ones in two parts
COMMUNES = """
SELECT n_nationkey AS c, CAST(n_nationkey % 4 AS STRING) AS dep, CASE WHEN n_nationkey % 2 = 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind,
  44e0 + (n_nationkey % 5) * 0.6e0 AS south, -1e0 + floor(n_nationkey / 5) * 0.8e0 AS west FROM {nation}"""

# records whose fields are broken by key
BAD_RECORDS = f"""
SELECT k, concat('f', lpad(CAST(k % 700 AS STRING), 4, '0'), '.json') AS file, CAST(floor(k / 700) AS INT) AS pos, {{json}} AS text
FROM (SELECT c_custkey AS k, c_name AS name FROM {{customer}})"""

TEXTS = dict(equipment=EQUIPMENT, sites_raw=SITES_RAW, deps=DEPS, patch_events=PATCH_EVENTS, objects=OBJECTS,
             supplier_points=SUPPLIER_POINTS, names=NAMES, shots=SHOTS, reviews=REVIEWS, talks=TALKS,
             history=HISTORY, stamps=STAMPS, samples=SAMPLES, communes=COMMUNES)

# ------------------------------------------------------------------ texts for the SQL checker
SLUG = "trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9]+', '-', 'g'), '-')"
FOLD = "lower(strip_accents(coalesce({x}, '')))"
PARENT = "nullif(regexp_extract(coalesce({x}, ''), '(?i)^(.+?)\\s+\\d+(?:er|e|eme|ème)\\s+Arrondissement$', 1), '')"
HAV = ("(2 * {r} * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2}))"
       " * pow(sin(radians({x2} - {x1}) / 2), 2)))))")


def slug_sql(x):
    return SLUG.format(x=x)


def fold_sql(x):
    return FOLD.format(x=x)


def parent_sql(x):
    return PARENT.format(x=x)


def metres_sql(y1, x1, y2, x2, r="6371000::DOUBLE"):
    return HAV.format(y1=y1, x1=x1, y2=y2, x2=x2, r=r)


def list_sql(csv):
    return f"list_sort(list_filter(string_split({csv}, ','), lambda x: x <> ''))"


CTES = {name: sql.format(**{t: t for t in BASE}) for name, sql in TEXTS.items()}
CTES["sites"] = ("SELECT *, " + list_sql("agres_csv") + " AS agres, " + list_sql("agres_probables_csv")
                 + " AS agres_probables FROM sites_raw")
CTES["idx"] = """SELECT id AS i, nom AS n, ville AS v, dep AS d, cp, lat AS y, lon AS x, CASE WHEN piste THEN 1 ELSE 0 END AS p,
  nullif(longueur_piste, 0) AS lp, nullif(longueur_probable, 0) AS lpp, nullif(couloirs, 0) AS cl, nullif(surface, '') AS s,
  CASE WHEN acces_libre THEN 1 END AS al, CASE WHEN len(agres) > 0 THEN agres END AS g,
  CASE WHEN len(agres_probables) > 0 THEN agres_probables END AS gp, nullif(nb_avis, 0) AS nv, nullif(note_moyenne, 0) AS nt
  FROM sites WHERE lat IS NOT NULL AND lon IS NOT NULL"""
CTES["ready"] = """SELECT * EXCLUDE (dep, dep_nom), CASE WHEN coalesce(dep, '') = '' AND coalesce(dep_nom, '') = '' THEN 'Département non renseigné' ELSE dep_nom END AS dep_nom,
  CASE WHEN coalesce(dep, '') = '' THEN '00' ELSE dep END AS dep
  FROM sites WHERE lat IS NOT NULL AND lon IS NOT NULL AND coalesce(id, '') <> '' AND NOT regexp_matches(id, '[^A-Za-z0-9._-]')"""
# vertices of every trace of every object: a way has role 'way', a relation has inner (even keys) and outer rings
CTES["vertices"] = """SELECT k, type, role, i, lat0 + dy / 111320 AS lat, lon0 + dx / (111320 * cos(radians(lat0))) AS lon FROM (
    SELECT o.k, o.type, role, i, lat0, lon0,
      CASE WHEN is_ribbon THEN CASE WHEN i IN (2, 3) THEN 8e0 ELSE 0e0 END ELSE (r + grow) * sin(2 * pi() * i / n) END AS dy,
      CASE WHEN is_ribbon THEN CASE WHEN i IN (1, 2) THEN 100e0 ELSE 0e0 END ELSE (r + grow) * cos(2 * pi() * i / n) END AS dx
    FROM (SELECT *, unnest(CASE WHEN type = 'way' THEN ['way'] WHEN k % 2 = 0 THEN ['inner', 'outer'] ELSE ['outer'] END) AS role,
            unnest(CASE WHEN type = 'way' THEN [0e0] WHEN k % 2 = 0 THEN [0e0, 8e0] ELSE [8e0] END) AS grow FROM objects WHERE NOT no_trace) o,
      LATERAL (SELECT unnest(range(0, (CASE WHEN is_ribbon THEN 4 ELSE n END) + CASE WHEN is_open THEN 0 ELSE 1 END)) AS i))"""
# every trace with its measures; rel is its role order
CTES["measures"] = """SELECT k, any_value(type) AS type, role, count(*)::INTEGER AS pts, avg(lat) AS lat, avg(lon) AS lon, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east,
    sum(CASE WHEN nlat IS NOT NULL THEN """ + metres_sql("lat", "lon", "nlat", "nlon") + """ END) AS perimeter,
    count(*) > 3 AND """ + metres_sql("arg_min(lat, i)", "arg_min(lon, i)", "arg_max(lat, i)", "arg_max(lon, i)") + """ < 3 AS closed
  FROM (SELECT *, lead(lat) OVER (PARTITION BY k, role ORDER BY i) AS nlat, lead(lon) OVER (PARTITION BY k, role ORDER BY i) AS nlon FROM vertices)
  GROUP BY k, role"""
CTES["areas"] = """SELECT v.k, v.role, abs(sum((v.lon - mx) * kk * (v.nlat - my) * 111320 - (v.nlon - mx) * kk * (v.lat - my) * 111320)) / 2 AS area FROM
    (SELECT *, lead(lat) OVER (PARTITION BY k, role ORDER BY i) AS nlat, lead(lon) OVER (PARTITION BY k, role ORDER BY i) AS nlon FROM vertices) v
    JOIN (SELECT k, role, cos(radians(lat)) * 111320 AS kk, lat AS my, lon AS mx FROM measures) m ON v.k = m.k AND v.role = m.role WHERE v.nlat IS NOT NULL GROUP BY v.k, v.role"""
CTES["shapes"] = """SELECT *, CASE WHEN d > 0 AND w <= 12 AND len >= 4 * w AND len <= 1.05 * sqrt(long_m * long_m + short_m * short_m) AND closed THEN len END AS straight FROM (
  SELECT *, CASE WHEN len > 0 THEN area / len ELSE 0 END AS w FROM (
  SELECT m.*, area, pow(perimeter / 4, 2) - area AS d, perimeter / 4 + sqrt(greatest(pow(perimeter / 4, 2) - area, 0)) AS len,
    greatest(wide, tall) AS long_m, least(wide, tall) AS short_m
  FROM (SELECT *, """ + metres_sql("south", "west", "south", "east") + " AS wide, " + metres_sql("south", "west", "north", "west") + """ AS tall FROM measures) m
  JOIN areas a ON m.k = a.k AND m.role = a.role))"""
# traces the audit looks at: way, or inner before outer
CTES["audit_traces"] = "SELECT s.* FROM shapes s WHERE role IN ('way', 'inner') OR NOT EXISTS (SELECT 1 FROM shapes t WHERE t.k = s.k AND t.role = 'inner')"
CTES["examined"] = """SELECT o.k, concat(o.type, '/', o.k) AS osm, coalesce(CAST(t.role AS VARCHAR), '') AS role, o.dep, t.lat, t.lon, t.pts,
    CASE WHEN coalesce(sport, '') <> '' AND len(list_intersect(string_split_regex(lower(sport), '[;,| ]+'), ['athletics', 'running'])) = 0 THEN 'autre_sport'
         WHEN len(list_intersect(string_split_regex(lower(coalesce(athletics, '')), '[;,| ]+'), ['long_jump','triple_jump','high_jump','pole_vault','shot_put','discus_throw','javelin_throw','hammer_throw'])) > 0 THEN 'concours'
         WHEN t.k IS NULL THEN 'sans_trace'
         WHEN t.pts < CASE WHEN closed AND straight IS NULL THEN 8 ELSE 2 END THEN 'trop_peu_de_points'
         WHEN NOT coalesce(straight, perimeter) BETWEEN 60 AND 600 THEN 'hors_bornes' END AS reason,
    coalesce(straight, perimeter) AS m, closed AND straight IS NULL AS loop, straight IS NOT NULL AS ribbon, long_m, short_m, sport, athletics, lanes, surface, name
  FROM audit_objects o LEFT JOIN audit_traces t ON o.k = t.k"""
TWIN_TABLES = {"objects": TWINS.format(**{t: t for t in BASE}), "located_objects": "SELECT o.*, coalesce(s.dep, '0') AS dep FROM objects o LEFT JOIN sites_raw s ON s.k = o.k - o.k % 3"}
CTES["located_objects"] = "SELECT o.*, coalesce(s.dep, '0') AS dep FROM objects o LEFT JOIN sites_raw s ON s.k = o.k"
CTES["audit_objects"] = """SELECT * FROM located_objects WHERE leisure = 'track' OR (leisure = 'pitch' AND regexp_matches(sport, 'athletics|running')) OR athletics IS NOT NULL"""
CTES["lap_objects"] = """SELECT * FROM located_objects WHERE (leisure IN ('track', 'pitch') AND regexp_matches(sport, 'athletics|running')) OR athletics IS NOT NULL"""
CTES["lap_ring_rows"] = """SELECT o.k, o.type, t.role, concat(substr(o.type, 1, 1), o.k) AS osm, t.pts, t.perimeter AS m, t.lat, t.lon FROM lap_objects o JOIN audit_traces t ON o.k = t.k
  WHERE (coalesce(sport, '') LIKE '%athletics%' OR coalesce(sport, '') LIKE '%running%' OR coalesce(athletics = 'running', false)) AND closed AND pts >= 10 AND perimeter BETWEEN 150 AND 520"""
CTES["commune_parts"] = """SELECT c, dep, part, south, west + part * 0.3e0 AS west, south + 0.5e0 AS north, west + part * 0.3e0 + CASE WHEN kind = 'Polygon' THEN 0.7e0 ELSE 0.2e0 END AS east
  FROM (SELECT *, unnest(CASE WHEN kind = 'Polygon' THEN [0] ELSE [0, 1] END) AS part FROM communes)"""
CTES["city_rows"] = f"""SELECT *, {slug_sql('ville')} AS slug, NULL AS parent FROM ready WHERE {slug_sql('ville')} <> ''
    AND NOT EXISTS (SELECT 1 FROM parent_rows p WHERE p.slug = {slug_sql('ready.ville')} AND p.dep = ready.dep)
  UNION ALL SELECT * FROM parent_rows"""
CTES["parent_rows"] = f"""SELECT *, {slug_sql(parent_sql('ville'))} AS slug, {parent_sql('ville')} AS parent FROM ready
  WHERE ({parent_sql('ville')}, dep) IN (('Paris', '75'), ('Lyon', '69'), ('Marseille', '13'))"""
CTES["city_table"] = """SELECT CASE WHEN count(*) OVER (PARTITION BY slug) = 1 THEN slug ELSE slug || '-' || dep END AS city, * FROM (
  SELECT slug, dep, arg_min(coalesce(parent, ville), ROW(lower(coalesce(ville, '')), lower(coalesce(nom, '')), id)) AS name, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon
  FROM city_rows GROUP BY slug, dep)"""
CTES["members"] = """SELECT facet, value, coalesce(d, '00') AS dep, i FROM idx, LATERAL (
    SELECT 'department' AS facet, coalesce(d, '00') AS value
    UNION ALL SELECT 'city', """ + slug_sql("v") + " WHERE " + slug_sql("v") + """ <> ''
    UNION ALL SELECT 'city', """ + slug_sql(parent_sql("v")) + " WHERE " + parent_sql("v") + """ IS NOT NULL
    UNION ALL SELECT 'length', lp::VARCHAR WHERE lp IS NOT NULL
    UNION ALL SELECT 'lanes', unnest(range(1, coalesce(cl, 0) + 1))::VARCHAR
    UNION ALL SELECT 'surface', CASE s WHEN 'synthetique' THEN 'synthetic' WHEN 'bitume' THEN 'asphalt' WHEN 'cendree' THEN 'cinder' WHEN 'sable' THEN 'sand' WHEN 'gazon' THEN 'grass' WHEN 'naturel' THEN 'natural' ELSE 'indoor' END WHERE s IS NOT NULL
    UNION ALL SELECT 'reviewed', 'true' WHERE nv > 0 UNION ALL SELECT 'free-access', 'true' WHERE al = 1
    UNION ALL SELECT 'discipline', p FROM (VALUES ('long_jump','longueur'),('triple_jump','triple'),('high_jump','hauteur'),('pole_vault','perche'),('shot_put','poids'),('discus','disque'),('hammer','marteau'),('javelin','javelot'),('steeplechase','steeple')) t(p, a) WHERE list_contains(g, a))"""
CTES["criteria"] = """SELECT kind, criterion, dep, dep_nom, id, ROW(lower(coalesce(ville, '')), lower(coalesce(nom, '')), id) AS place FROM ready, LATERAL (
    SELECT 'length' AS kind, longueur_piste::VARCHAR AS criterion WHERE longueur_piste > 0
    UNION ALL SELECT 'lanes', unnest(range(2, least(coalesce(couloirs, 0), 8) + 1))::VARCHAR
    UNION ALL SELECT 'free-access', 'free-access' WHERE acces_libre
    UNION ALL SELECT 'surface', surface WHERE surface IS NOT NULL
    UNION ALL SELECT 'discipline', unnest(agres))"""
CTES["kept_criteria"] = """SELECT kind, criterion, count(*) AS n FROM criteria GROUP BY kind, criterion
  HAVING count(*) >= CASE kind WHEN 'length' THEN 15 WHEN 'lanes' THEN 5 ELSE 1 END"""
CTES["canon"] = f"""SELECT n.author AS name, coalesce(arg_min(l.author, ROW(-length(l.author), l.author)), n.author) AS canonical FROM named n
  LEFT JOIN named l ON starts_with({fold_sql('l.author')}, {fold_sql('n.author')} || ' ') GROUP BY n.author"""
CTES["contribs"] = """SELECT trim(credit) AS author, 'photo' AS kind, id FROM shots WHERE trim(coalesce(credit, '')) <> ''
  UNION ALL SELECT trim(author), 'review', id FROM reviews WHERE trim(coalesce(author, '')) <> ''"""

DEPENDS = {
    "sites": ["sites_raw"], "idx": ["sites"], "ready": ["sites"], "vertices": ["objects"], "measures": ["vertices"],
    "areas": ["measures"], "shapes": ["areas"], "audit_traces": ["shapes"], "located_objects": ["objects", "sites_raw"],
    "audit_objects": ["located_objects"], "lap_objects": ["located_objects"], "examined": ["audit_objects", "audit_traces"],
    "lap_ring_rows": ["lap_objects", "audit_traces"], "commune_parts": ["communes"], "parent_rows": ["ready"],
    "city_rows": ["ready", "parent_rows"], "city_table": ["city_rows"], "members": ["idx"], "criteria": ["ready"],
    "kept_criteria": ["criteria"], "contribs": ["shots", "reviews"],
}


def with_tables(names, body, **extra) -> str:
    """`body` behind the WITH list of the derived tables it reads."""
    texts, needs, out = {**CTES, **extra}, dict(DEPENDS), []

    def add(name):
        if name in out:
            return
        for needed in needs.get(name, []):
            add(needed)
        out.append(name)
    for name in names:
        add(name)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({texts[n]})" for n in out) + "\n" if out else "") + body


class Tables:
    """The driver's tables and everything derived from them, as lazy frames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name):
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in TEXTS:
            return self.derive(TEXTS[name])
        raise AttributeError(name)

    def derive(self, sql: str) -> DataFrame:
        used = {t: getattr(self, t) for t in (*BASE, *TEXTS) if "{" + t + "}" in sql}
        return self.spark.sql(sql, **used)

    @cached_property
    def census(self) -> DataFrame:
        return self.derive(TEXTS["equipment"]).withColumn("equip_coordonnees", F.struct("lat", "lon")).drop("lat", "lon")

    @cached_property
    def sites(self) -> DataFrame:
        items = lambda name: F.array_sort(F.filter(F.split(name, ","), lambda x: x != ""))
        return self.sites_raw.withColumns({"agres": items("agres_csv"), "agres_probables": items("agres_probables_csv")})

    @cached_property
    def index(self) -> DataFrame:
        return publish.index_rows(self.sites)

    @cached_property
    def ready(self) -> DataFrame:
        return publish.publishable(self.sites)

    @cached_property
    def elements(self) -> DataFrame:
        """Mapped objects with their tags as a map and their traces as geometry or members."""
        return self.elements_of(self.objects.join(self.sites_raw.select("k", "dep"), "k", "left"))

    @cached_property
    def twin_elements(self) -> DataFrame:
        """Objects three to a place, in the department of the venue there."""
        at = self.sites_raw.select(F.col("k").alias("_k"), "dep")
        twins = self.derive(TWINS)
        return self.elements_of(twins.join(at, F.col("k") - F.col("k") % 3 == F.col("_k"), "left").drop("_k"))

    def elements_of(self, objects: DataFrame) -> DataFrame:
        tags = F.map_filter(F.create_map(*[x for t in ("leisure", "sport", "athletics", "highway", "name", "lanes", "surface")
                                           for x in (F.lit(t), F.col(t))]), lambda k, v: v.isNotNull())
        objects = objects.withColumn("dep", F.coalesce("dep", F.lit("0")))
        last = F.expr("(CASE WHEN is_ribbon THEN 4 ELSE n END) - CASE WHEN is_open THEN 1 ELSE 0 END")

        def ring(grow):
            dy = (f"CASE WHEN is_ribbon THEN CASE WHEN i IN (2, 3) THEN 8e0 ELSE 0e0 END ELSE (r + {grow}) * sin(2 * pi() * i / n) END")
            dx = (f"CASE WHEN is_ribbon THEN CASE WHEN i IN (1, 2) THEN 100e0 ELSE 0e0 END ELSE (r + {grow}) * cos(2 * pi() * i / n) END")
            return F.expr(f"transform(sequence(0, last), i -> named_struct('lat', lat0 + ({dy}) / 111320e0, "
                          f"'lon', lon0 + ({dx}) / (111320e0 * cos(radians(lat0)))))")
        member = lambda role, g: F.struct(F.lit(role).alias("role"), g.alias("geometry"))
        way = (F.col("type") == "way") & ~F.col("no_trace")
        relation = (F.col("type") == "relation") & ~F.col("no_trace")
        return objects.withColumn("last", last).select(
            "type", F.col("k").alias("id"), tags.alias("tags"), F.when(way, ring("0e0")).alias("geometry"),
            F.when(relation & (F.col("k") % 2 == 0), F.array(member("inner", ring("0e0")), member("outer", ring("8e0"))))
            .when(relation, F.array(member("outer", ring("8e0")))).alias("members"),
            F.lit(None).cast("struct<lat:double,lon:double>").alias("center"), F.lit(None).cast("double").alias("lat"),
            F.lit(None).cast("double").alias("lon"), "dep", "k")

    @cached_property
    def commune_shapes(self) -> DataFrame:
        """Communes as GeoJSON-like coordinates, longitude first."""
        box = lambda w, e: (f"array(array({w}, south), array({e}, south), array({e}, south + 0.5e0), array({w}, south + 0.5e0), array({w}, south))")
        parts = F.expr(f"CASE WHEN kind = 'Polygon' THEN array(array({box('west', '(west + 0.7e0)')})) ELSE "
                       f"array(array({box('west', '(west + 0.2e0)')}), array({box('(west + 0.3e0)', '(west + 0.3e0 + 0.2e0)')})) END")
        return self.communes.select("c", "dep", "kind", parts.alias("coordinates"))
