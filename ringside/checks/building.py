"""Census scan, rollup, overlay and their parts."""
from pyspark.sql import functions as F

from ringside import vocab
from ringside.checks.expressions import case_of, title_sql
from ringside.checks.registry import check
from ringside.checks.tables import EQUIPMENT_ORDER, fold_sql
from ringside.operators import overlay, rollup
from ringside.sources import census as census_source, patches as patch_source

c = F.col
sql_list = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
NUM = "CAST(trunc(TRY_CAST(trim({x}) AS DOUBLE)) AS INTEGER)"
num = lambda x: NUM.format(x=x)
yes = lambda x: f"coalesce(lower(trim({x})) IN ('true', '1', 'oui'), false)"
WORDS = f"({fold_sql('equip_nom')} || ' ' || {fold_sql('equip_type_name')})"
HITS = ", ".join(f"regexp_matches(words, '{p}') AS d_{n}" for n, p in vocab.DISCIPLINE_PATTERNS)
SURE = "(" + " OR ".join(f"d_{n}" for n in vocab.DISCIPLINES) + ")"

CENSUS_ROWS = f"""SELECT *, {HITS} FROM (SELECT *, {WORDS} AS words, {fold_sql('equip_type_name')} AS folded_type,
    coalesce(equip_type_name IN ({sql_list(vocab.TRACK_TYPES)}), false) AS track, coalesce(lat <> 0 AND lon <> 0, false) AS located,
    {case_of(vocab.SURFACE_OF_LABEL, fold_sql('equip_sol'))} AS sol,
    row_number() OVER (PARTITION BY inst_numero ORDER BY {', '.join(EQUIPMENT_ORDER)}) AS seq
  FROM equipment WHERE inst_numero <> '')"""

# every part of the rollup as (column, SQL aggregate)
PARTS = {
    "first": [("nom", title_sql("arg_min_null(inst_nom, seq)")), ("adresse", title_sql("arg_min_null(inst_adresse, seq)")),
              ("cp", "arg_min_null(inst_cp, seq)"), ("ville", title_sql("arg_min_null(new_name, seq)")),
              ("insee", "arg_min_null(new_code, seq)"), ("dep", "arg_min_null(dep_code, seq)"), ("dep_nom", "arg_min_null(dep_nom, seq)"),
              ("region", "arg_min_null(reg_nom, seq)"), ("scolaire", "coalesce(arg_min_null(inst_uai, seq) <> '', false)"),
              ("proprietaire", "arg_min_null(equip_prop_type, seq)"), ("gestionnaire", "arg_min_null(equip_gest_type, seq)")],
    "coordinates": [(x, f"""CASE WHEN bool_or(track AND located) THEN arg_max({x}, seq) FILTER (WHERE track AND located)
        WHEN arg_min_null(lat, seq) IS NOT NULL THEN arg_min_null({x}, seq) ELSE arg_min({x}, seq) FILTER (WHERE located) END""") for x in ("lat", "lon")],
    "track": [("piste", "bool_or(track)")],
    "lanes": [("couloirs", f"max(nullif({num('equip_piste_nb')}, 0)) FILTER (WHERE track)"),
              ("longueur_piste", f"max(nullif({num('equip_piste_long')}, 0)) FILTER (WHERE track)")],
    "surface": [("surface", "CASE WHEN bool_or(track AND sol = 'synthetique') THEN 'synthetique' ELSE arg_min(sol, seq) FILTER (WHERE track AND sol IS NOT NULL) END")],
    "covered": [("couvert", f"coalesce(bool_or(track AND equip_nature IN ({sql_list(vocab.COVERED_NATURES)})), false)")],
    "disciplines": [("agres", "concat_ws(',', " + ", ".join(f"CASE WHEN bool_or(d_{n}) THEN '{n}' END" for n in sorted(vocab.DISCIPLINES)) + ")"),
                    ("agres_probables", f"concat_ws(',', CASE WHEN bool_or(NOT {SURE} AND words NOT LIKE '%saut%' AND words LIKE '%lancer%') THEN 'lancer_indetermine' END, CASE WHEN bool_or(NOT {SURE} AND words LIKE '%saut%') THEN 'saut_indetermine' END)")],
    "areas": [("nb_sautoirs", "count(*) FILTER (WHERE folded_type LIKE '%saut%' OR " + " OR ".join(f"d_{n}" for n in vocab.JUMPS) + ")"),
              ("nb_aires_lancer", "count(*) FILTER (WHERE folded_type LIKE '%lancer%' OR " + " OR ".join(f"d_{n}" for n in vocab.THROWS) + ")")],
    "services": [("eclairage", f"bool_or({yes('equip_eclair')})"), ("acces_libre", f"bool_or({yes('equip_acc_libre')})"),
                 ("ouvert_public", f"bool_or({yes('equip_ouv_public_bool')})"), ("douches", f"bool_or({yes('equip_douche')})"),
                 ("sanitaires", f"bool_or({yes('equip_sanit')})"), ("vestiaires", f"coalesce(bool_or({num('equip_vest_sport')} <> 0), false)")],
    "extremes": [("tribunes", f"max(nullif({num('equip_trib_nb')}, 0))"), ("annee", f"min(nullif({num('equip_service_date')}, 0))"),
                 ("renovation", f"max(nullif({num('equip_travaux_date')}, 0))"),
                 ("url", "(CASE WHEN trim(arg_min(equip_url, seq) FILTER (WHERE equip_url <> '')) LIKE 'http%' THEN '' ELSE 'https://' END) || trim(arg_min(equip_url, seq) FILTER (WHERE equip_url <> ''))")],
}


def part_sql(*names):
    columns = ", ".join(f"{sql} AS {name}" for part in names for name, sql in PARTS[part])
    return f"SELECT inst_numero AS id, {columns} FROM census_rows GROUP BY inst_numero"


def rolled(t, *names):
    out = rollup.rollup(t.census, EQUIPMENT_ORDER)
    wanted = [name for part in names for name, _ in PARTS[part]]
    return out.select("id", *[F.array_join(n, ",").alias(n) if n.startswith("agres") else c(n) for n in wanted])


def register_part(name, *parts):
    check(name, part_sql(*parts), ["equipment", "census_rows"], census_rows=CENSUS_ROWS)(lambda t: rolled(t, *parts))


register_part("a1_venue_rollup", *PARTS)
register_part("a1a_first_row_attributes", "first")
register_part("a1b_coordinates", "coordinates")
register_part("a1c_has_track", "track")
register_part("a1d_lanes_and_length", "lanes")
register_part("a1e_surface", "surface")
register_part("a1f_covered", "covered")
register_part("a1g_discipline_sets", "disciplines")
register_part("a1h_jump_and_throw_areas", "areas")
register_part("a1i_services", "services")
register_part("a1j_extremes_and_url", "extremes")


@check("a1k_equipment_list", "SELECT inst_numero AS id, l_linenumber, l_partkey, l_suppkey, l_quantity, coalesce(equip_type_name, '') AS type, coalesce(equip_nom, '') AS nom FROM equipment WHERE inst_numero <> ''", ["equipment"])
def _(t):
    return rollup.equipment_list(t.census, ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))


@check("s1_census_scan", "SELECT inst_numero, equip_numero, equip_nom, equip_piste_nb, lat, lon FROM equipment WHERE equip_type_famille = 'Equipement d''athlétisme'", ["equipment"])
def _(t):
    return census_source.select_family(t.census).select("inst_numero", "equip_numero", "equip_nom", "equip_piste_nb", "equip_coordonnees.lat", "equip_coordonnees.lon")


@check("u4_discipline_sets_union_and_overlap", """SELECT id, array_to_string(list_sort(list_distinct(list_concat(agres, agres_probables))), ',') AS either,
  len(list_intersect(agres, ['longueur','hauteur','perche','triple'])) > 0 AS any_jump, len(list_intersect(agres, ['poids','disque','marteau','javelot'])) > 0 AS any_throw FROM sites""", ["sites"])
def _(t):
    family = lambda names: F.array(*[F.lit(n) for n in names])
    return t.sites.select("id", F.array_join(F.array_sort(F.array_union("agres", "agres_probables")), ",").alias("either"),
                          F.arrays_overlap("agres", family(vocab.JUMPS)).alias("any_jump"), F.arrays_overlap("agres", family(vocab.THROWS)).alias("any_throw"))


# --------------------------------------------------------------------------------- patches
# events as patch files: one key per event, an array of two records for every seventh event
PATCH_TEXT = """CASE WHEN event_id % 50 = 7 THEN concat('{bad', CAST(event_id AS STRING))
  WHEN event_id % 7 = 0 THEN concat('[{"id":"', CAST(user_id AS STRING), '","', event_type, '":', CAST(event_id AS STRING), '},{"id":"x', CAST(user_id AS STRING), '","note":null}]')
  ELSE concat('{"id":"', CAST(user_id AS STRING), '","', event_type, '":', CASE WHEN value < 20 THEN 'null' ELSE CAST(event_id AS STRING) END, '}') END"""
PATCH_FILE = "concat(CASE WHEN event_id % 10 = 3 THEN '_' ELSE '' END, 'p', lpad(CAST(event_id AS STRING), 9, '0'), '.json')"


def _patch_files(t):
    return t.events.select(F.expr(PATCH_FILE).alias("file"), F.expr(PATCH_TEXT).alias("text")).where(~c("file").startswith("_"))


@check("s2_patch_scan", f"""SELECT file, i::INTEGER AS pos, ok = false AS parse_error,
    CASE WHEN ok THEN json_extract_string(CASE WHEN json_type(text) = 'ARRAY' THEN json_extract(text, concat('$[', i, ']')) ELSE text::JSON END, '$.id') END AS id,
    CASE WHEN ok THEN array_to_string(list_sort(json_keys(CASE WHEN json_type(text) = 'ARRAY' THEN json_extract(text, concat('$[', i, ']')) ELSE text::JSON END)), ',') END AS keys
  FROM (SELECT *, unnest(CASE WHEN ok AND json_type(CASE WHEN ok THEN text ELSE '0' END) = 'ARRAY' THEN range(0, json_array_length(text)::BIGINT) ELSE [0] END) AS i FROM (SELECT {PATCH_FILE} AS file, {PATCH_TEXT} AS text, json_valid({PATCH_TEXT}) AS ok FROM events) WHERE NOT starts_with(file, '_'))""")
def _(t):
    records = patch_source.split_records(_patch_files(t))
    record = c("record")
    return records.select("file", "pos", "parse_error", F.try_variant_get(record, "$.id", "string").alias("id"),
                          F.array_join(F.array_sort(patch_source.present_keys(record)), ",").alias("keys"))


KEYS = ["click", "error", "purchase", "signup", "view"]
FOLDED = """SELECT id, pkey, arg_max_null(v, ROW(ts, event_id)) AS v FROM (
    SELECT id, pkey, v, ts, event_id FROM patch_events UNION ALL SELECT id, 'error', NULL, ts, event_id FROM patch_events WHERE pkey = 'purchase') GROUP BY id, pkey"""


def _key_patches(t):
    """Patches of one key each, wide: the keys present and a typed column per key."""
    return t.patch_events.select("id", "ts", "event_id", F.array("pkey").alias("keys"),
                                 *[F.when(c("pkey") == k, c("v")).alias(k) for k in KEYS])


@check("j1_patch_fold", "SELECT id, " + ", ".join(f"max(v) FILTER (WHERE pkey = '{k}') AS {k}, count(*) FILTER (WHERE pkey = '{k}') > 0 AS has_{k}" for k in KEYS)
       + " FROM folded GROUP BY id", ["patch_events", "folded"], folded=FOLDED)
def _(t):
    return overlay.fold_patches(_key_patches(t), ("ts", "event_id"), KEYS, {"purchase": "error"}).drop("n_patches")


BASE_VENUES = "SELECT c_custkey AS id, CAST(c_custkey % 7 AS INT) AS click, CAST(NULL AS INT) AS error, CAST(c_custkey % 3 AS INT) AS view, c_custkey % 2 = 0 AS piste, 'res' AS source FROM {customer}"


@check("j1_patch_overlay", """SELECT coalesce(b.id, f.id) AS id, CASE WHEN has_click THEN f.click ELSE b.click END AS click, CASE WHEN has_error THEN f.error ELSE b.error END AS error,
    CASE WHEN has_view THEN f.view ELSE b.view END AS "view", f.purchase AS purchase, f.signup AS signup, CASE WHEN b.id IS NULL THEN true ELSE b.piste END AS piste,
    CASE WHEN b.id IS NULL AND n = 1 THEN 'communaute' WHEN f.id IS NOT NULL THEN 'res+communaute' ELSE b.source END AS source
  FROM (""" + BASE_VENUES.format(customer="customer") + """) b FULL OUTER JOIN (SELECT p.id, n, """ + ", ".join(f"max(v) FILTER (WHERE pkey = '{k}') AS {k}, count(*) FILTER (WHERE pkey = '{k}') > 0 AS has_{k}" for k in KEYS)
       + """ FROM folded p JOIN (SELECT id, count(*) AS n FROM patch_events GROUP BY id) q ON p.id = q.id GROUP BY p.id, n) f ON b.id = f.id""", ["patch_events", "folded"], folded=FOLDED)
def _(t):
    return overlay.apply_patches(t.derive(BASE_VENUES), _key_patches(t), ("ts", "event_id"), KEYS, {"purchase": "error"})


@check("u6_unknown_keys", """SELECT file, i::INTEGER AS pos, array_to_string(list_sort(list_filter(json_keys(doc), lambda k: k NOT IN ('id', 'note', 'view', 'click'))), ',') AS unknown FROM (
    SELECT file, i, CASE WHEN json_type(text) = 'ARRAY' THEN json_extract(text, concat('$[', i, ']')) ELSE text::JSON END AS doc FROM (
      SELECT *, unnest(CASE WHEN json_type(text) = 'ARRAY' THEN range(0, json_array_length(text)::BIGINT) ELSE [0] END) AS i FROM (SELECT """ + f"{PATCH_FILE} AS file, {PATCH_TEXT} AS text FROM events WHERE json_valid({PATCH_TEXT})" + ") WHERE NOT starts_with(file, '_')))")
def _(t):
    records = patch_source.split_records(_patch_files(t)).where("NOT parse_error")
    known = F.array(*[F.lit(k) for k in ("id", "note", "view", "click")])
    keys = patch_source.present_keys(c("record"))
    return records.select("file", "pos", F.array_join(F.array_sort(F.array_except(keys, known)), ",").alias("unknown"))
