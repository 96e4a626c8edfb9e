"""Facets, cells, criteria, cities, departments, pages."""
from pyspark.sql import functions as F

from ringside import vocab
from ringside.checks.publishing import BASE_URL, PHOTO_SQL, _listed_photos
from ringside.checks.registry import check
from ringside.checks.tables import slug_sql
from ringside.operators import facets, publish, spatial
from ringside.session import new_folder
from ringside.sources import published

c = F.col
LISTS = "(SELECT facet, value, dep, i FROM members UNION ALL SELECT facet, value, NULL, i FROM members WHERE facet NOT IN ('department', 'city'))"


@check("a5_facet_counts", f"SELECT facet, value, dep, count(*) AS n FROM {LISTS} GROUP BY facet, value, dep", ["members"])
def _(t):
    return facets.facet_counts(t.index)


@check("k4_facet_lists", f"SELECT facet, value, dep, i AS id FROM {LISTS}", ["members"])
def _(t):
    return facets.facet_lists(t.index).select("facet", "value", "dep", "id")


@check("j3_facet_rows", f"SELECT facet, value, l.dep, l.i AS id, n, v, cl FROM {LISTS} l JOIN idx ON idx.i = l.i", ["members", "idx"])
def _(t):
    return facets.facet_lists(t.index).select("facet", "value", "dep", "id", "n", "v", "cl")


CELLS = "(SELECT i AS id, CAST(round_even(y / 0.1::DOUBLE, 0) AS INTEGER) AS cell_y, CAST(round_even(x / 0.1::DOUBLE, 0) AS INTEGER) AS cell_x FROM idx)"


@check("a6_geo_cells", f"SELECT * FROM {CELLS}", ["idx"])
def _(t):
    return facets.geo_cells(t.index)


NEAR = f"""SELECT DISTINCT a.cell_y, a.cell_x, b.cell_y AS near_y, b.cell_x AS near_x FROM {CELLS} a JOIN {CELLS} b
   ON abs(a.cell_y - b.cell_y) <= 1 AND abs(a.cell_x - b.cell_x) <= 1 AND (a.cell_y <> b.cell_y OR a.cell_x <> b.cell_x)"""


@check("j16_live_neighbour_cells", NEAR, ["idx"])
def _(t):
    return facets.live_neighbours(facets.geo_cells(t.index))


@check("k5_cell_lists", f"SELECT c.cell_y, c.cell_x, count(DISTINCT c.id) AS venues, count(DISTINCT (near_y, near_x)) FILTER (WHERE near_y IS NOT NULL) AS neighbours FROM {CELLS} c LEFT JOIN ({NEAR}) n ON n.cell_y = c.cell_y AND n.cell_x = c.cell_x GROUP BY c.cell_y, c.cell_x", ["idx"])
def _(t):
    cells = facets.geo_cells(t.index)
    around = facets.live_neighbours(cells).groupBy("cell_y", "cell_x").agg(F.count("*").alias("neighbours"))
    return cells.groupBy("cell_y", "cell_x").agg(F.count("*").alias("venues")).join(around, ["cell_y", "cell_x"], "left").withColumn(
        "neighbours", F.coalesce("neighbours", F.lit(0).cast("long")))


@check("a7_department_index", "SELECT dep, coalesce(nullif(arg_min_null(dep_nom, ROW(lower(coalesce(ville, '')), lower(coalesce(nom, '')), id)), ''), dep) AS dep_nom, coalesce(arg_min_null(region, ROW(lower(coalesce(ville, '')), lower(coalesce(nom, '')), id)), '') AS region, count(*) AS n FROM ready GROUP BY dep ORDER BY region, dep_nom", ["ready"])
def _(t):
    return facets.department_index(t.ready).orderBy("region", "dep_nom")


@check("a8_criteria", "SELECT * FROM kept_criteria", ["kept_criteria"])
def _(t):
    return facets.criterion_counts(t.ready)


PER_DEP = "SELECT c.kind, c.criterion, c.dep, arg_min_null(c.dep_nom, place) AS dep_nom, count(*) AS n FROM criteria c JOIN kept_criteria k ON k.kind = c.kind AND k.criterion = c.criterion GROUP BY c.kind, c.criterion, c.dep"


@check("a9_criterion_by_department", PER_DEP + " ORDER BY n DESC, dep_nom", ["kept_criteria"])
def _(t):
    return facets.criterion_by_department(t.ready).orderBy(F.desc("n"), "dep_nom")


@check("a10_criterion_departments_kept", f"SELECT kind, criterion, dep, n FROM ({PER_DEP}) WHERE n >= 3", ["kept_criteria"])
def _(t):
    return facets.criterion_by_department(t.ready).where(c("n") >= facets.MIN_PER_DEPARTMENT).select("kind", "criterion", "dep", "n")


@check("j19_criterion_links", f"SELECT kind, criterion, dep, n, CASE WHEN n >= 3 THEN 'criterion' ELSE 'department' END AS target FROM ({PER_DEP})", ["kept_criteria"])
def _(t):
    return facets.criterion_links(facets.criterion_by_department(t.ready)).drop("dep_nom")


@check("a16_city_slugs", "SELECT city, slug, dep, n FROM city_table", ["city_table"])
def _(t):
    return facets.cities(facets.city_members(t.ready)).select("city", "slug", "dep", "n")


@check("a17_parent_cities", "SELECT slug, dep, parent, id FROM city_rows", ["city_rows"])
def _(t):
    return facets.city_members(t.ready).select("slug", "dep", "parent", "id")


@check("u3_districts_and_parents", "SELECT parent IS NOT NULL AS whole_city, count(*) AS n FROM city_rows GROUP BY 1", ["city_rows"])
def _(t):
    return facets.city_members(t.ready).groupBy(c("parent").isNotNull().alias("whole_city")).agg(F.count("*").alias("n"))


@check("a18_city_centroids", "SELECT city, name, round(lat, 8) AS lat, round(lon, 8) AS lon FROM city_table", ["city_table"])
def _(t):
    return facets.cities(facets.city_members(t.ready)).select("city", "name", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


DEP_INDEX = "(SELECT dep, coalesce(nullif(arg_min_null(dep_nom, ROW(lower(coalesce(ville, '')), lower(coalesce(nom, '')), id)), ''), dep) AS dep_nom FROM ready GROUP BY dep)"


@check("w5_department_slugs", f"""SELECT dep, dep_nom, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY dep) > 1 THEN s || '-' || dep ELSE s END AS slug FROM (SELECT *, coalesce(nullif({slug_sql('dep_nom')}, ''), dep) AS s FROM {DEP_INDEX})""", ["ready"])
def _(t):
    return facets.department_slugs(facets.department_index(t.ready))


@check("w6_list_positions", "SELECT facet, value, i, position FROM (SELECT facet, value, m.i, row_number() OVER (PARTITION BY facet, value ORDER BY lower(coalesce(v, '')), lower(coalesce(n, '')), m.i) AS position FROM members m JOIN idx ON idx.i = m.i WHERE facet NOT IN ('department', 'city')) WHERE position <= 200", ["members", "idx"])
def _(t):
    members = facets.facet_members(t.index).where(~c("facet").isin("department", "city")).select(
        "facet", "value", "i", c("i").alias("id"), c("v").alias("ville"), c("n").alias("nom"))
    return facets.list_positions(members, ["facet", "value"]).select("facet", "value", "i", "position")


@check("w8_list_headings", "SELECT dep, heading, id FROM (SELECT dep, coalesce(ville, '') AS heading, id, lag(coalesce(ville, '')) OVER (PARTITION BY dep ORDER BY lower(coalesce(ville, '')), lower(coalesce(nom, '')), id) AS before FROM ready) WHERE before IS DISTINCT FROM heading", ["ready"])
def _(t):
    return facets.list_headings(t.ready)


PARAM_SQL = "CASE criterion " + " ".join(f"WHEN '{code}' THEN '{param.replace('_', '-')}'" for param, code in vocab.DISCIPLINE_OF_PARAM.items()) + " END"
SURFACE_SQL = "CASE criterion " + " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in vocab.SURFACE_ENGLISH.items()) + " END"
CRITERION_KEY = f"""CASE kind WHEN 'length' THEN criterion || 'm' WHEN 'lanes' THEN criterion || CASE lang WHEN 'fr' THEN '-couloirs' ELSE '-lanes' END
   WHEN 'free-access' THEN CASE lang WHEN 'fr' THEN 'acces-libre' ELSE 'free-access' END WHEN 'discipline' THEN CASE lang WHEN 'fr' THEN criterion ELSE {PARAM_SQL} END
   ELSE CASE lang WHEN 'fr' THEN criterion ELSE {SURFACE_SQL} END END"""
LANGS = "(VALUES ('fr'), ('en')) l(lang)"
URLS = f"""SELECT * FROM (SELECT 'home' AS kind, '' AS key, '1.0' AS priority, 0 AS images UNION ALL SELECT 'departments', '', '0.8', 0 UNION ALL SELECT 'contributors', '', '0.7', 0
   UNION ALL SELECT 'department', dep, '0.7', 0 FROM {DEP_INDEX}
   UNION ALL SELECT 'city', city, '0.6', 0 FROM city_table UNION ALL SELECT 'venue', id, '0.6', coalesce(n_photos, 0) FROM ready), {LANGS}
   UNION ALL SELECT 'criterion', {CRITERION_KEY}, '0.6', 0, lang FROM kept_criteria, {LANGS}
   UNION ALL SELECT 'criterion-department', {CRITERION_KEY} || '/' || slug, '0.5', 0, lang FROM ({PER_DEP}) p JOIN
     (SELECT dep, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY dep) > 1 THEN s || '-' || dep ELSE s END AS slug FROM (SELECT *, coalesce(nullif({slug_sql('dep_nom')}, ''), dep) AS s FROM {DEP_INDEX})) d ON d.dep = p.dep, {LANGS} WHERE n >= 3"""


@check("k8_url_inventory", URLS, ["kept_criteria", "city_table"])
def _(t):
    venues, _files = _listed_photos(t)
    return facets.url_inventory(t.ready, venues.select("id", F.explode("photos")))


@check("a23_pages_per_language", f"SELECT lang, kind, count(*) AS pages FROM ({URLS}) GROUP BY lang, kind", ["kept_criteria", "city_table"])
def _(t):
    venues, _files = _listed_photos(t)
    return facets.url_inventory(t.ready, venues.select("id", F.explode("photos"))).groupBy("lang", "kind").agg(F.count("*").alias("pages"))


UNNAMED = {lang: name.replace("'", "''") for lang, name in publish.UNNAMED.items()}


@check("k8_image_entries", f"""SELECT lang, id, '{BASE_URL}/' || f AS loc, name AS title, CASE WHEN l IS NOT NULL THEN l || ' — ' || place ELSE place END AS caption FROM (
   SELECT lang, p.id, f, l, name, concat_ws(', ', name, nullif(ville, '')) AS place FROM ({PHOTO_SQL}) p
   JOIN (SELECT *, coalesce(nullif(nom, ''), CASE lang WHEN 'fr' THEN '{UNNAMED["fr"]}' ELSE '{UNNAMED["en"]}' END) AS name FROM ready, {LANGS}) v ON v.id = p.id)""", ["ready"])
def _(t):
    return facets.image_entries(t.ready, publish.photo_entries(*_listed_photos(t)), BASE_URL)


@check("s10_file_manifest", "SELECT CAST(page_id AS VARCHAR) AS id, 'txt' AS kind, CAST(strlen(coalesce(html, '')) + 1 AS BIGINT) AS length FROM pages")
def _(t):
    """Pages written as files and listed again: the manifest reads names and sizes, never contents."""
    root = new_folder(t.spark, "files")
    published.write_texts(t.pages.select(c("page_id").alias("id"), c("html").alias("text")), root)
    files = published.photo_manifest(t.spark, root)
    return files.select(F.regexp_replace("id", "^id=", "").alias("id"), F.regexp_extract("file", "[.]([a-z]+)$", 1).alias("kind"), "length")
