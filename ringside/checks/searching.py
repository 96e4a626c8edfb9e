"""Filters, rankings and paging (F, O, E2, E3, J4)."""
from functools import reduce

from pyspark.sql import functions as F

from ringside.checks.publishing import BASE_URL
from ringside.checks.registry import check
from ringside.checks.tables import fold_sql, metres_sql, slug_sql
from ringside.operators import facets, search

c = F.col
KM = lambda lat, lon: metres_sql(f"{lat}::DOUBLE", f"{lon}::DOUBLE", "y", "x", "6371::DOUBLE")

TESTS = {
    "piste": "piste", "synth": "surface = 'synthetique'", "libre": "acces_libre", "perche": "list_contains(agres, 'perche')",
    "long": "list_contains(agres, 'longueur') OR list_contains(agres, 'triple')", "haut": "list_contains(agres, 'hauteur')",
    "poids": "list_contains(agres, 'poids')", "lancer": "list_contains(agres, 'disque') OR list_contains(agres, 'marteau') OR list_contains(agres, 'javelot')",
    "sauts": "nb_sautoirs > 0", "ecl": "eclairage", "couv": "couvert", "vest": "vestiaires", "noeco": "NOT scolaire",
    "photo": "n_photos > 0", "avis": "nb_avis > 0", "noavis": "nb_avis = 0",
}


def _venues(t):
    """Sites with photo and review lists as long as their counts."""
    some = lambda n: F.array_repeat(F.lit(1), c(n).cast("int"))
    return t.sites.withColumns({"photos": some("n_photos"), "avis": some("nb_avis")})


@check("f1_named_predicates", " UNION ALL ".join(f"SELECT '{n}' AS test, id FROM sites WHERE {w}" for n, w in TESTS.items()), ["sites"])
def _(t):
    venues = _venues(t)
    passed = F.array_compact(F.array(*[F.when(search.browse_test(n), F.lit(n)) for n in search.BROWSE_TESTS]))
    return venues.select(F.explode(passed).alias("test"), "id")


@check("f1_predicates_together", "SELECT id FROM sites WHERE piste AND nb_sautoirs > 0 AND NOT scolaire AND nb_avis = 0", ["sites"])
def _(t):
    return _venues(t).where(search.all_of([search.browse_test(n) for n in ("piste", "sauts", "noeco", "noavis")])).select("id")


@check("f3_department", "SELECT id FROM sites_raw WHERE dep = '13'", ["sites_raw"])
def _(t):
    return t.sites.where(c("dep") == "13").select("id")


@check("f4_lap_length", "SELECT id FROM sites_raw WHERE coalesce(nullif(longueur_piste, 0), nullif(longueur_probable, 0)) = 400", ["sites_raw"])
def _(t):
    return t.sites.where(search.lap_is(400)).select("id")


HAY = fold_sql("concat_ws(' ', coalesce(nom, ''), coalesce(ville, ''), coalesce(cp, ''), coalesce(dep_nom, ''), coalesce(dep, ''))")


@check("f5_all_words", f"SELECT id FROM sites_raw WHERE contains({HAY}, 'emile') AND contains({HAY}, 'nation_1') AND contains({HAY}, 'evry')", ["sites_raw"])
def _(t):
    return t.sites.where(search.contains_words("  Émile NATION_1 évry")).select("id")


@check("f5_all_words_in_documents", f"SELECT doc_id FROM documents WHERE contains({fold_sql('text')}, 'etion') AND contains({fold_sql('text')}, 'que')")
def _(t):
    whole = t.documents.select("doc_id", c("text").alias("nom"), *[F.lit("").alias(x) for x in ("ville", "cp", "dep_nom", "dep")])
    return whole.where(search.contains_words("Étion que")).select("doc_id")


@check("f6_city_by_slug", f"SELECT i FROM idx WHERE {slug_sql('v')} = 'lyon' OR starts_with({slug_sql('v')}, 'lyon-')", ["idx"])
def _(t):
    return t.index.where(search.in_city("Lyon")).select("i")


@check("f7_reviewed", "SELECT i, nv > 0 AS has FROM idx WHERE nv > 0 UNION ALL SELECT i, false FROM idx WHERE coalesce(nv, 0) = 0", ["idx"])
def _(t):
    side = lambda yes: t.index.where(search.reviewed(yes)).select("i", F.lit(yes).alias("has"))
    return side(True).unionByName(side(False))


@check("f8_access", "SELECT i, 'true' AS state FROM idx WHERE al = 1 UNION ALL SELECT i, 'unknown' FROM idx WHERE al IS NULL", ["idx"])
def _(t):
    free = t.index.where(search.access(True)).select("i", F.lit("true").alias("state"))
    return free.unionByName(t.index.where(search.access("unknown")).select("i", F.lit("unknown").alias("state")))


@check("f9_length_range", "SELECT i FROM idx WHERE lp BETWEEN 300 AND 400", ["idx"])
def _(t):
    return t.index.where(search.length_between(*search.parse_query({"track_length": "300-400"}).length)).select("i")


@check("f10_lanes_at_least", "SELECT i FROM idx WHERE cl >= 6", ["idx"])
def _(t):
    return t.index.where(search.at_least_lanes(search.parse_query({"lanes_min": "6"}).lanes_min)).select("i")


@check("f11_surface", "SELECT i FROM idx WHERE s = 'cendree'", ["idx"])
def _(t):
    return t.index.where(search.has_surface("cinder")).select("i")


POOLS = {"declared": "coalesce(g, [])", "probable": "coalesce(gp, [])", "any": "list_concat(coalesce(g, []), coalesce(gp, []))"}


@check("f12_disciplines", " UNION ALL ".join(f"SELECT '{k}' AS certainty, i FROM idx WHERE list_contains({p}, 'longueur') AND list_contains({p}, 'poids')" for k, p in POOLS.items()), ["idx"])
def _(t):
    one = lambda k: t.index.where(search.has_disciplines(["longueur", "poids"], k)).select(F.lit(k).alias("certainty"), "i")
    return reduce(lambda a, b: a.unionByName(b), map(one, POOLS))


@check("f13_radius", f"SELECT i, round({KM(45.5, 0.8)}, 5) AS km FROM idx WHERE {KM(45.5, 0.8)} <= 42", ["idx"])
def _(t):
    return search.within_km(t.index, 45.5, 0.8, 42.0).select("i", F.round("distance_km", 5).alias("km"))


@check("f14_near_me", f"SELECT id, round({KM(46.1, 1.9)}, 5) AS km FROM (SELECT *, lat AS y, lon AS x FROM sites_raw WHERE lat IS NOT NULL) WHERE {KM(46.1, 1.9)} <= 30", ["sites_raw"])
def _(t):
    return search.browse(_venues(t), (), near=(46.1, 1.9), near_only=True).select("id", F.round("distance_km", 5).alias("km"))


@check("j4_id_lookup", "SELECT i, n FROM idx WHERE i = 'I000000321'", ["idx"])
def _(t):
    return search.by_id(t.index, "I000000321").select("i", "n")


@check("o1_dataset_order", "SELECT id, dep, ville, nom FROM sites_raw ORDER BY coalesce(dep, ''), coalesce(ville, ''), coalesce(nom, '')", ["sites_raw"])
def _(t):
    return t.sites_raw.select("id", "dep", "ville", "nom").orderBy(*[F.coalesce(x, F.lit("")) for x in ("dep", "ville", "nom")], "id")


@check("o2_list_order", "SELECT id, ville, nom FROM sites_raw ORDER BY lower(coalesce(ville, '')), lower(coalesce(nom, ''))", ["sites_raw"])
def _(t):
    return t.sites_raw.select("id", "ville", "nom").orderBy(*facets.list_key(), "id")


# base letters first; words that differ in case alone: the small letter before the capital, wherever they first differ
CASES = lambda x: f"regexp_replace(regexp_replace(strip_accents(coalesce({x}, '')), '[A-Z]', '~', 'g'), '[^~]', ' ', 'g')"


@check("o3_french_order", f"SELECT id, row_number() OVER (ORDER BY {fold_sql('ville')}, {CASES('ville')}, {fold_sql('nom')}, {CASES('nom')}, id) - 1 AS position FROM sites_raw", ["sites_raw"])
def _(t):
    return search.french_positions(t.sites_raw, ("ville", "nom"))


@check("o4_distance_order", f"SELECT i FROM (SELECT i, {KM(45.0, 1.0)} AS km FROM idx) ORDER BY km, i LIMIT 100", ["idx"])
def _(t):
    return search.browse(_venues(t), (), near=(45.0, 1.0)).limit(100).select(c("id").alias("i"))


CITY, NAME = fold_sql("ville"), fold_sql("nom")


@check("o5_relevance", f"""SELECT id, CASE WHEN {CITY} = 'evry-bui 3' THEN 0 WHEN cp = 'evry-bui 3' THEN 1 WHEN starts_with({CITY}, 'evry-bui 3') THEN 2 WHEN contains({NAME}, 'evry-bui 3') THEN 3
   WHEN contains({CITY}, 'evry-bui 3') THEN 4 WHEN contains({NAME}, 'evry-bui') AND contains({NAME}, '3') THEN 5 ELSE 6 END AS level FROM sites_raw""", ["sites_raw"])
def _(t):
    return t.sites.select("id", search.relevance("Évry-BUI 3").alias("level"))


@check("o6_page_and_total", """SELECT i, total, total > 150 AS more FROM (SELECT i, n, v, count(*) OVER () AS total FROM idx WHERE p = 1) ORDER BY lower(coalesce(v, '')), lower(coalesce(n, '')), i LIMIT 50 OFFSET 100""", ["idx"])
def _(t):
    kept = t.index.where("p = 1")
    order = [F.lower(F.coalesce("v", F.lit(""))), F.lower(F.coalesce("n", F.lit(""))), c("i")]
    total = kept.agg(F.count("*").alias("total")).scalar()
    return search.page_of(kept, order, 50, 3).select("i", total.alias("total")).withColumn("more", c("total") > 150)


@check("e2_search", f"""SELECT 'a' AS q, count(*) AS total FROM idx WHERE d = '13' AND al IS NULL AND cl >= 2
   UNION ALL SELECT 'b', count(*) FROM idx WHERE lp BETWEEN 200 AND 400 AND s = 'gazon' AND coalesce(nv, 0) = 0
   UNION ALL SELECT 'c', count(*) FROM idx WHERE {KM(46.0, 1.5)} <= 100 AND list_contains(coalesce(g, []), 'longueur')
   UNION ALL SELECT 'd', count(*) FROM idx WHERE {slug_sql('v')} = 'paris' OR starts_with({slug_sql('v')}, 'paris-')""", ["idx"])
def _(t):
    asked = {"a": {"department": "13", "free_access": "unknown", "lanes_min": "2"},
             "b": {"track_length": "200-400", "surface": "grass", "has_reviews": "no"},
             "c": {"lat": "46.0", "lon": "1.5", "radius": "100", "long_jump": "true"}, "d": {"city": "Paris"}}
    one = lambda k: search.search(t.index, asked[k], BASE_URL, "census", "open licence").select(F.lit(k).alias("q"), "total")
    return reduce(lambda a, b: a.unionByName(b), map(one, asked))


NEAR_PAGE = lambda q, y, x, km, test: f"""SELECT '{q}' AS q, total, 2 AS page, CASE WHEN total > 20 THEN 3 END AS next, pos - 11 AS pos, i AS id
   FROM (SELECT i, row_number() OVER (ORDER BY km, i) AS pos, count(*) OVER () AS total FROM (SELECT *, {KM(y, x)} AS km FROM idx) WHERE km <= {km} AND {test}) WHERE pos BETWEEN 11 AND 20"""


@check("e2_search_page", f"{NEAR_PAGE('c', 46.0, 1.5, 100, 'cl >= 2')} UNION ALL {NEAR_PAGE('e', 45.2, 0.4, 60, 'cl >= 4')}", ["idx"])
def _(t):
    asked = {"c": {"lat": "46.0", "lon": "1.5", "radius": "100", "lanes_min": "2", "limit": "10", "page": "2"},
             "e": {"lat": "45.2", "lon": "0.4", "radius": "60", "lanes_min": "4", "limit": "10", "page": "2"}}
    one = lambda k: search.search(t.index, asked[k], BASE_URL, "census", "open licence").select(
        F.lit(k).alias("q"), "total", "page", "next", F.posexplode("results").alias("pos", "r")).select("q", "total", "page", "next", "pos", "r.id")
    return reduce(lambda a, b: a.unionByName(b), map(one, asked))


@check("e3_browse", f"""SELECT id, CASE WHEN {CITY} = 'lyon' THEN 0 WHEN cp = 'lyon' THEN 1 WHEN starts_with({CITY}, 'lyon') THEN 2 WHEN contains({NAME}, 'lyon') THEN 3 WHEN contains({CITY}, 'lyon') THEN 4 ELSE 6 END AS level
   FROM sites WHERE piste AND contains({HAY}, 'lyon') AND coalesce(nullif(longueur_piste, 0), nullif(longueur_probable, 0)) IS NOT NULL""", ["sites"])
def _(t):
    found = search.browse(_venues(t), ("piste",), "LYON")
    return found.where(F.coalesce(F.nullif("longueur_piste", F.lit(0)), F.nullif("longueur_probable", F.lit(0))).isNotNull()).select("id", "level")


@check("a21_result_box", """SELECT round(min(lat) - (max(lat) - min(lat)) * 0.15, 7) AS south, round(min(lon) - (max(lon) - min(lon)) * 0.15, 7) AS west, round(max(lat) + (max(lat) - min(lat)) * 0.15, 7) AS north, round(max(lon) + (max(lon) - min(lon)) * 0.15, 7) AS east
   FROM (SELECT lat, lon FROM sites_raw WHERE lat IS NOT NULL ORDER BY lower(coalesce(ville, '')), lower(coalesce(nom, '')), id LIMIT 2000)""", ["sites_raw"])
def _(t):
    ordered = t.sites_raw.where("lat IS NOT NULL").orderBy(*facets.list_key(), "id")
    return search.result_box(ordered).select(*[F.round(x, 7).alias(x) for x in ("south", "west", "north", "east")])


# ---------------------------------------------------------------------------- parameters
# requests made of events: each parameter is there for some of them, with good and bad values
PARAMS = {
    "free_access": "CASE event_id % 9 WHEN 0 THEN 'false' WHEN 1 THEN 'maybe' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'YES' END",
    "lat": "CASE user_id % 11 WHEN 0 THEN 'x' WHEN 1 THEN '91' WHEN 2 THEN ' 47.5 ' WHEN 3 THEN '-12.25' WHEN 4 THEN '1e1' END",
    "lon": "CASE WHEN user_id % 11 < 5 AND event_id % 13 <> 0 OR event_id % 17 = 0 THEN CASE event_id % 5 WHEN 0 THEN '181' WHEN 1 THEN '' ELSE '-1.5' END END",
    "radius": "CASE event_id % 8 WHEN 0 THEN '0' WHEN 1 THEN '101' WHEN 2 THEN 'far' WHEN 3 THEN '2.5' WHEN 4 THEN '100' END",
    "track_length": "CASE event_id % 10 WHEN 0 THEN '4-' WHEN 1 THEN '300-400' WHEN 2 THEN '250' WHEN 3 THEN 'abc' END",
    "lanes_min": "CASE event_id % 12 WHEN 0 THEN '2.5' WHEN 1 THEN '0' WHEN 2 THEN '6' WHEN 3 THEN '8.0' END",
    "surface": "CASE event_id % 14 WHEN 0 THEN 'moon' WHEN 1 THEN 'Grass' WHEN 2 THEN 'bitume' END",
    "has_reviews": "CASE event_id % 15 WHEN 0 THEN 'some' WHEN 1 THEN 'no' WHEN 2 THEN '1' END",
    "certainty": "CASE event_id % 16 WHEN 0 THEN 'sure' WHEN 1 THEN 'any' WHEN 2 THEN '' END",
    "shot_put": "CASE event_id % 18 WHEN 0 THEN 'false' WHEN 1 THEN 'true' END",
    "limit": "CASE event_id % 19 WHEN 0 THEN '0' WHEN 1 THEN '9999' WHEN 2 THEN '20' END",
    "page": "CASE event_id % 21 WHEN 0 THEN '-1' WHEN 1 THEN '3' END"}
REQUESTS = "SELECT event_id, " + ", ".join(f"{sql} AS {k}" for k, sql in PARAMS.items()) + " FROM {events}"
NUM_OF = lambda k: f"(CASE WHEN trim({k}) = '' THEN 0 ELSE TRY_CAST(trim({k}) AS DOUBLE) END)"
WHOLE_OF = lambda k: f"({k} IS NOT NULL AND NOT coalesce({NUM_OF(k)} >= 1 AND {NUM_OF(k)} = floor({NUM_OF(k)}), false))"
GIVEN = lambda k: f"lower(coalesce({k}, ''))"
REFUSED = f"""CASE WHEN {GIVEN('free_access')} IN ('false', '0', 'no') THEN 'free_access' WHEN {GIVEN('free_access')} NOT IN ('', 'true', '1', 'yes', 'unknown') THEN 'free_access'
   WHEN (lat IS NULL) <> (lon IS NULL) THEN CASE WHEN lat IS NULL THEN 'lat' ELSE 'lon' END
   WHEN lat IS NOT NULL AND NOT coalesce(abs({NUM_OF('lat')}) <= 90 AND abs({NUM_OF('lon')}) <= 180, false) THEN 'lat/lon'
   WHEN lat IS NOT NULL AND radius IS NOT NULL AND NOT coalesce({NUM_OF('radius')} > 0 AND {NUM_OF('radius')} <= 100, false) THEN 'radius'
   WHEN track_length <> '' AND NOT regexp_full_match(track_length, '[0-9]+(-[0-9]+)?') THEN 'track_length' WHEN {WHOLE_OF('lanes_min')} THEN 'lanes_min'
   WHEN surface IS NOT NULL AND {GIVEN('surface')} NOT IN ('grass', 'bitume') THEN 'surface' WHEN has_reviews IS NOT NULL AND {GIVEN('has_reviews')} NOT IN ('true', '1', 'yes', 'false', '0', 'no') THEN 'has_reviews'
   WHEN {GIVEN('certainty')} NOT IN ('', 'declared', 'probable', 'any') THEN 'certainty' WHEN {GIVEN('shot_put')} NOT IN ('', 'true', '1', 'yes') THEN 'shot_put'
   WHEN {WHOLE_OF('limit_')} THEN 'limit' WHEN {WHOLE_OF('page')} THEN 'page' END""".replace("limit_", '"limit"')


@check("f15_parameter_checks", f"""SELECT event_id, parameter, CASE WHEN parameter = 'radius' AND {NUM_OF('radius')} > 100 THEN 413 WHEN parameter IS NOT NULL THEN 400 END AS status,
     CASE WHEN parameter IS NULL AND lat IS NOT NULL THEN {NUM_OF('lat')} END AS lat, CASE WHEN parameter IS NULL AND lat IS NOT NULL THEN {NUM_OF('lon')} END AS lon,
     CASE WHEN parameter IS NULL THEN CASE WHEN lat IS NOT NULL AND radius IS NOT NULL THEN {NUM_OF('radius')} ELSE 10 END END AS radius,
     CASE WHEN parameter IS NULL THEN CAST(string_split(track_length, '-')[1] AS INTEGER) END AS low, CASE WHEN parameter IS NULL THEN CAST(string_split(track_length, '-')[-1] AS INTEGER) END AS high,
     CASE WHEN parameter IS NULL THEN CAST({NUM_OF('lanes_min')} AS BIGINT) END AS lanes_min, CASE WHEN parameter IS NULL THEN CASE lower(surface) WHEN 'grass' THEN 'gazon' ELSE lower(surface) END END AS surface,
     CASE WHEN parameter IS NULL THEN has_reviews = '1' END AS has_reviews, CASE WHEN parameter IS NULL THEN coalesce(nullif(lower(certainty), ''), 'declared') END AS certainty,
     CASE WHEN parameter IS NULL AND free_access IS NOT NULL THEN CASE WHEN lower(free_access) = 'unknown' THEN 'unknown' ELSE 'true' END END AS free_access,
     CASE WHEN parameter IS NULL THEN CASE WHEN shot_put IS NULL THEN '' ELSE 'poids' END END AS disciplines,
     CASE WHEN parameter IS NULL THEN CAST(least(coalesce({NUM_OF('"limit"')}, 50), 500) AS INTEGER) END AS "limit", CASE WHEN parameter IS NULL THEN CAST(coalesce({NUM_OF('page')}, 1) AS BIGINT) END AS page
   FROM (SELECT *, {REFUSED} AS parameter FROM ({REQUESTS.replace('{events}', 'events').replace('AS limit', 'AS "limit"')}))""")
def _(t):
    rows = t.derive(REQUESTS)
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), c(k).alias("value")) for k in PARAMS]), lambda e: e["value"].isNotNull())
    found = search.checked(rows.select("event_id", F.map_from_entries(entries).alias("params")))
    q = lambda k: c(f"query.{k}").alias(k)
    return found.select("event_id", "refusal.parameter", "refusal.status", *[q(k) for k in ("lat", "lon", "radius")], "query.length.low", "query.length.high",
                        *[q(k) for k in ("lanes_min", "surface", "has_reviews", "certainty", "free_access")], F.array_join("query.disciplines", ",").alias("disciplines"), q("limit"), q("page"))
