"""Scalar functions (X), on whole columns of the driver's tables."""
from pyspark.sql import functions as F

from ringside import vocab
from ringside.checks.registry import check
from ringside.checks.tables import fold_sql, metres_sql, parent_sql, slug_sql
from ringside.functions import geo, numbers, text
from ringside.operators import publish, rollup, search

c = F.col


@check("x1_accent_free_lower", f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", text.fold(c("text")).alias("folded"))


@check("x2_slug", f"SELECT doc_id, {slug_sql('text')} AS slug, coalesce(nullif({slug_sql('source')}, ''), 'site') AS source_slug FROM documents")
def _(t):
    return t.documents.select("doc_id", text.slug(c("text")).alias("slug"), text.slug(c("source"), "site").alias("source_slug"))


SMALL = ", ".join(f"'{w}'" for w in vocab.SMALL_WORDS)
PIECES = "regexp_extract_all(w, '([-''’]|[^-''’]+)', 1)"
TITLE = f"""CASE WHEN length(regexp_replace({{x}}, '[^\\p{{{{L}}}}]', '', 'g')) > 0 AND length(regexp_replace({{x}}, '[^\\p{{{{Lu}}}}]', '', 'g')) >= 0.8 * length(regexp_replace({{x}}, '[^\\p{{{{L}}}}]', '', 'g'))
  THEN array_to_string(list_transform(string_split_regex(regexp_replace(lower({{x}}), '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda w, wi:
    array_to_string(list_transform({PIECES}, lambda p, pi: CASE WHEN wi > 1 AND pi = 1 AND p IN ({SMALL}) THEN p ELSE upper(p[1]) || p[2:] END), '')), ' ')
  ELSE regexp_replace({{x}}, '^\\s+|\\s+$', '', 'g') END""".replace("{{{{", "{{").replace("}}}}", "}}")


def title_sql(x):
    return TITLE.replace("{{x}}", x).replace("{{", "{").replace("}}", "}").replace("{x}", x)


@check("x3_smart_title", f"SELECT doc_id, {title_sql('text')} AS as_is, {title_sql('shout')} AS recased FROM (SELECT doc_id, text, upper(replace(text, 'ß', 'ss')) AS shout FROM documents)")
def _(t):
    return t.documents.select("doc_id", text.smart_title("text").alias("as_is"), text.smart_title(F.upper(F.replace(c("text"), F.lit("ß"), F.lit("ss")))).alias("recased"))


MESSY = "CASE doc_id % 9 WHEN 0 THEN CAST(n_chars AS STRING) WHEN 1 THEN concat(' ', CAST(n_chars AS STRING), '.7 ') WHEN 2 THEN 'abc' WHEN 3 THEN 'OUI' WHEN 4 THEN ' true' WHEN 5 THEN '1' WHEN 6 THEN concat('-', CAST(n_chars AS STRING), '.9') WHEN 7 THEN NULL ELSE '1e3' END"


@check("x4_lenient_bool_and_int", f"""SELECT doc_id, CASE WHEN m IS NULL THEN NULL ELSE lower(trim(m)) IN ('true', '1', 'oui') END AS as_bool, CAST(trunc(TRY_CAST(trim(m) AS DOUBLE)) AS INTEGER) AS as_int FROM (SELECT doc_id, {MESSY} AS m FROM documents)""")
def _(t):
    messy = F.expr(MESSY)
    return t.documents.select("doc_id", messy.alias("m")).select(
        "doc_id", numbers.lenient_bool(c("m")).alias("as_bool"), numbers.lenient_int(c("m")).alias("as_int"))


LABELS = list(vocab.SURFACE_OF_LABEL)
PICK = "CASE doc_id % 18 " + " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(LABELS)) + " WHEN 16 THEN 'TARTAN' ELSE 'Béton' END"


@check("x5_surface_code", f"SELECT doc_id, CASE {fold_sql('label')} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.SURFACE_OF_LABEL.items()) + f" END AS surface FROM (SELECT doc_id, {PICK} AS label FROM documents)")
def _(t):
    return t.documents.select("doc_id", rollup.surface_code(F.expr(PICK)).alias("surface"))


WORDS = f"({fold_sql('equip_nom')} || ' ' || {fold_sql('equip_type_name')})"
FOUND = "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({WORDS}, '{p}') THEN '{n}' END" for n, p in vocab.DISCIPLINE_PATTERNS) + "], lambda x: x IS NOT NULL))"


@check("x6_discipline_detection", f"""SELECT inst_numero, l_linenumber, l_partkey, array_to_string(sure, ',') AS sure,
  CASE WHEN len(sure) > 0 THEN '' WHEN words LIKE '%saut%' THEN 'saut_indetermine' WHEN words LIKE '%lancer%' THEN 'lancer_indetermine' ELSE '' END AS maybe
  FROM (SELECT *, {FOUND} AS sure, {WORDS} AS words FROM equipment)""", ["equipment"])
def _(t):
    found = rollup.disciplines_of(c("equip_nom"), c("equip_type_name"))
    return t.census.select("inst_numero", "l_linenumber", "l_partkey", found.alias("d")).select(
        "inst_numero", "l_linenumber", "l_partkey", F.array_join("d.sure", ",").alias("sure"), F.array_join("d.maybe", ",").alias("maybe"))


@check("x7_haversine", f"""SELECT k, round({metres_sql('lat', 'lon', '46.5::DOUBLE', '2.25::DOUBLE', '6371::DOUBLE')}, 5) AS km, round({metres_sql('lat', 'lon', '46.5::DOUBLE', '2.25::DOUBLE')}, 2) AS m FROM sites_raw WHERE lat IS NOT NULL""", ["sites_raw"])
def _(t):
    there = F.lit(46.5), F.lit(2.25)
    return t.sites_raw.where("lat IS NOT NULL").select(
        "k", F.round(geo.haversine_km(c("lat"), c("lon"), *there), 5).alias("km"), F.round(geo.haversine(c("lat"), c("lon"), *there), 2).alias("m"))


LAPS = "m / 1.03::DOUBLE"


@check("x14_lap_snapping", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN gap / lap <= 0.08::DOUBLE THEN lap END AS snapped FROM (
  SELECT *, arg_min(lap, ROW(gap, lap)) OVER w AS best FROM (SELECT *, abs(lap - (150 + l_quantity * 6) / 1.03::DOUBLE) AS gap FROM lineitem, (VALUES (200), (250), (300), (333), (400)) v(lap))
  WINDOW w AS (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) QUALIFY lap = best)""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", geo.snap_lap(150 + c("l_quantity") * 6).alias("snapped"))


@check("x16_parent_city", f"SELECT id, {parent_sql('ville')} AS parent FROM sites_raw", ["sites_raw"])
def _(t):
    return t.sites_raw.select("id", text.parent_city(c("ville")).alias("parent"))


TYPED = """CASE k % 8 WHEN 0 THEN dep WHEN 1 THEN '0' || dep WHEN 2 THEN cp WHEN 3 THEN dep_nom WHEN 4 THEN substr(dep_nom, 1, 9) WHEN 5 THEN ' ' || dep || ' · ' || dep_nom WHEN 6 THEN 'cotes nation_1' ELSE '' END"""
CANON = "CASE WHEN regexp_matches(upper(trim({x})), '^[0-9]+$') THEN coalesce(nullif(ltrim(upper(trim({x})), '0'), ''), '0') ELSE upper(trim({x})) END"


@check("x17_department_resolver", f"""SELECT id, typed, CASE WHEN trim(typed) = '' THEN '' ELSE coalesce(
    (SELECT min(dep) FROM deps WHERE {CANON.format(x='deps.dep')} = {CANON.format(x="split_part(trim(typed), '·', 1)")}),
    (SELECT min(dep) FROM deps WHERE regexp_matches(trim(typed), '^[0-9]{{5}}$') AND {CANON.format(x='deps.dep')} = {CANON.format(x="CASE WHEN trim(typed) LIKE '97%' THEN substr(trim(typed), 1, 3) ELSE substr(trim(typed), 1, 2) END")}),
    (SELECT min(dep) FROM deps WHERE {fold_sql('deps.dep_nom')} = {fold_sql('trim(typed)')} OR {fold_sql("concat(CASE WHEN length(deps.dep) = 1 THEN '0' ELSE '' END, deps.dep, ' · ', deps.dep_nom)")} = {fold_sql('trim(typed)')}),
    (SELECT CASE WHEN count(*) = 1 THEN min(dep) END FROM deps WHERE starts_with({fold_sql('deps.dep_nom')}, {fold_sql('trim(typed)')}))) END AS dep
  FROM (SELECT id, {TYPED} AS typed FROM sites_raw)""", ["sites_raw", "deps"])
def _(t):
    asked = t.sites_raw.select("id", F.expr(TYPED).alias("typed"))
    return search.resolve_departments(asked, t.deps)


@check("x18_distance_format", """SELECT id, CASE WHEN km < 1 THEN CAST(CAST(round(km * 1000) AS INTEGER) AS VARCHAR) || ' m' WHEN km < 10 THEN format('{:.1f} km', km) ELSE CAST(CAST(round(km) AS INTEGER) AS VARCHAR) || ' km' END AS shown
  FROM (SELECT id, (k % 137) * (k % 137) / 128e0 AS km FROM sites_raw)""", ["sites_raw"])
def _(t):
    km = F.expr("(k % 137) * (k % 137) / 128e0")
    return t.sites_raw.select("id", numbers.format_distance(km).alias("shown"))


MONTHS_FR = "[" + ", ".join(f"'{m}'" for m in vocab.MONTHS["fr"]) + "]"


@check("x19_note_date_thousands_format", f"""SELECT o_orderkey, replace(format('{{:.1f}}', (o_orderkey % 50) / 1e1), '.', ',') AS note_fr, format('{{:.1f}}', (o_orderkey % 50) / 1e1) AS note_en,
  CASE WHEN o_orderkey % 9 = 0 THEN 'hier' ELSE concat(day(o_orderdate), ' ', {MONTHS_FR}[month(o_orderdate)], ' ', year(o_orderdate)) END AS date_fr,
  replace(format('{{:,}}', o_orderkey), ',', chr(8239)) AS n_fr, format('{{:,}}', o_orderkey) AS n_en FROM orders""")
def _(t):
    note = (c("o_orderkey") % 50) / F.lit(10.0)
    iso = F.when(c("o_orderkey") % 9 == 0, F.lit("hier")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", numbers.format_note(note).alias("note_fr"), numbers.format_note(note, "en").alias("note_en"),
                           numbers.format_date(iso).alias("date_fr"), numbers.format_thousands(c("o_orderkey")).alias("n_fr"),
                           numbers.format_thousands(c("o_orderkey"), "en").alias("n_en"))


@check("x20_natural_list", """SELECT id, CASE len(agres) WHEN 0 THEN '' WHEN 1 THEN agres[1] ELSE array_to_string(agres[:-2], ', ') || ' et ' || agres[-1] END AS fr,
  CASE len(agres) WHEN 0 THEN '' WHEN 1 THEN agres[1] ELSE array_to_string(agres[:-2], ', ') || ' and ' || agres[-1] END AS en FROM sites""", ["sites"])
def _(t):
    return t.sites.select("id", text.natural_list(c("agres")).alias("fr"), text.natural_list(c("agres"), "en").alias("en"))


@check("x21_rounding", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round_even(l_extendedprice / 7, 5) AS coord, round(l_extendedprice / 7, 1) AS km, round_even(l_quantity / 2, 0) AS half FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", numbers.rounded_coordinate(c("l_extendedprice") / 7).alias("coord"),
                             numbers.half_up(c("l_extendedprice") / 7, 1).alias("km"), numbers.half_even(c("l_quantity") / 2, 0).alias("half"))


ADDRESS = "CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^https?://', '') WHEN 1 THEN concat(' ', url, ' ') WHEN 2 THEN '' ELSE url END"


@check("x22_url_normaliser", f"SELECT page_id, CASE WHEN u = '' THEN NULL WHEN trim(u) LIKE 'http%' THEN trim(u) ELSE 'https://' || trim(u) END AS url FROM (SELECT page_id, {ADDRESS} AS u FROM pages)")
def _(t):
    return t.pages.select("page_id", text.normal_url(F.expr(ADDRESS)).alias("url"))


IDENT = "CASE c_custkey % 5 WHEN 0 THEN concat('I', lpad(CAST(c_custkey AS STRING), 9, '0')) WHEN 1 THEN concat('c-stade-', CAST(c_custkey AS STRING)) WHEN 2 THEN c_name WHEN 3 THEN 'I12' ELSE 'c-X_' END"


@check("x23_id_syntax", f"SELECT c_custkey, regexp_matches(id, '{vocab.ID_PATTERN}') AS valid FROM (SELECT c_custkey, {IDENT} AS id FROM customer)")
def _(t):
    return t.customer.select("c_custkey", text.is_valid_id(F.expr(IDENT)).alias("valid"))


def case_of(labels, x):
    q = lambda s: s.replace("'", "''")
    return f"CASE {x} " + " ".join(f"WHEN '{q(k)}' THEN '{q(v)}'" for k, v in labels.items()) + " END"


@check("x24_labels", "SELECT id, a, " + case_of(vocab.DISCIPLINE_LABEL["fr"], "a") + " AS fr, " + case_of(vocab.DISCIPLINE_LABEL["en"], "a") + " AS en, "
       + case_of(vocab.SURFACE_LABEL["fr"], "surface") + " AS sol_fr, " + case_of(vocab.SURFACE_LABEL["en"], "surface") + " AS sol_en FROM (SELECT id, surface, unnest(agres) AS a FROM sites)", ["sites"])
def _(t):
    rows = t.sites.select("id", "surface", F.explode("agres").alias("a"))
    name = lambda table, lang, x: text.label_of(c(x), table[lang])
    return rows.select("id", "a", name(vocab.DISCIPLINE_LABEL, "fr", "a").alias("fr"), name(vocab.DISCIPLINE_LABEL, "en", "a").alias("en"),
                       name(vocab.SURFACE_LABEL, "fr", "surface").alias("sol_fr"), name(vocab.SURFACE_LABEL, "en", "surface").alias("sol_en"))


# ------------------------------------------------------------------------- ring measures
CLOSED_OR_OPEN = ["measures", "areas", "shapes"]


def _rings(t):
    """One row per trace with its role, as the checker's `shapes`."""
    members = F.when(c("type") == "way", F.array(F.struct(F.lit("way").alias("role"), c("geometry")))).otherwise(c("members"))
    return t.elements.select("k", F.explode(members).alias("m")).select("k", "m.role", c("m.geometry").alias("ring")).where("ring IS NOT NULL")


@check("x8_ring_perimeter", "SELECT k, role, pts, round(perimeter, 4) AS metres FROM shapes", CLOSED_OR_OPEN)
def _(t):
    return _rings(t).select("k", "role", F.size("ring").alias("pts"), F.round(geo.perimeter(c("ring")), 4).alias("metres"))


@check("x9_ring_centre", "SELECT k, role, round(lat, 9) AS lat, round(lon, 9) AS lon FROM shapes", CLOSED_OR_OPEN)
def _(t):
    return _rings(t).select("k", "role", geo.ring_centre(c("ring")).alias("p")).select(
        "k", "role", F.round("p.lat", 9).alias("lat"), F.round("p.lon", 9).alias("lon"))


@check("x10_ring_area", "SELECT k, role, round(area, 2) AS m2 FROM shapes WHERE closed", CLOSED_OR_OPEN)
def _(t):
    return _rings(t).where(geo.is_closed(c("ring"))).select("k", "role", F.round(geo.ring_area(c("ring")), 2).alias("m2"))


@check("x12_box_sides", "SELECT k, role, round(long_m, 4) AS long_m, round(short_m, 4) AS short_m FROM shapes", CLOSED_OR_OPEN)
def _(t):
    return _rings(t).select("k", "role", geo.box_sides(c("ring")).alias("b")).select(
        "k", "role", F.round("b.long_m", 4).alias("long_m"), F.round("b.short_m", 4).alias("short_m"))


@check("x13_ribbon_test", "SELECT k, role, round(straight, 3) AS straight FROM shapes", CLOSED_OR_OPEN)
def _(t):
    g = c("ring")
    sized = _rings(t).select("k", "role", geo.perimeter(g).alias("p"), geo.ring_area(g).alias("a"), geo.box_sides(g).alias("b"), geo.is_closed(g).alias("closed"))
    length = F.when(c("closed"), geo.ribbon_length(c("p"), c("a"), c("b.long_m"), c("b.short_m")))
    return sized.select("k", "role", F.round(length, 3).alias("straight"))


@check("f23_closed_ring", "SELECT k, role, closed FROM shapes", CLOSED_OR_OPEN)
def _(t):
    return _rings(t).select("k", "role", geo.is_closed(c("ring")).alias("closed"))


@check("w7_edge_lengths", "SELECT k, role, i, round(" + metres_sql("lat", "lon", "nlat", "nlon") + """, 5) AS metres FROM (
  SELECT *, lead(lat) OVER (PARTITION BY k, role ORDER BY i) AS nlat, lead(lon) OVER (PARTITION BY k, role ORDER BY i) AS nlon FROM vertices) WHERE nlat IS NOT NULL""", ["vertices"])
def _(t):
    return _rings(t).select("k", "role", F.posexplode(geo.edge_lengths(c("ring"))).alias("i", "m")).select(
        "k", "role", "i", F.round("m", 5).alias("metres"))


@check("p11_aerial_box", """SELECT id, round(lat - f * 540 / 960 / 2 / 111132, 9) AS south, round(lon - f / 2 / (111320 * cos(radians(lat))), 9) AS west, round(lat + f * 540 / 960 / 2 / 111132, 9) AS north,
    round(lon + f / 2 / (111320 * cos(radians(lat))), 9) AS east, round(lat - g / 2 / 111132, 9) AS tool_south
  FROM (SELECT id, lat, lon, CASE WHEN tour >= 400 THEN 360e0 WHEN tour > 0 THEN 260e0 ELSE 300e0 END AS f, CASE WHEN coalesce(longueur_piste, 0) >= 400 THEN 400e0 ELSE 260e0 END AS g
        FROM (SELECT *, coalesce(nullif(longueur_piste, 0), longueur_probable, 0) AS tour FROM sites_raw WHERE lat IS NOT NULL))""", ["sites_raw"])
def _(t):
    return t.sites.where("lat IS NOT NULL").select("id", publish.aerial_box().alias("b"), publish.aerial_box("download").alias("d")).select(
        "id", *[F.round(f"b.{s}", 9).alias(s) for s in ("south", "west", "north", "east")], F.round("d.south", 9).alias("tool_south"))
