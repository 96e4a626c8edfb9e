"""Pre-computed lists: facets, geographic cells, criteria, cities and department pages.

Lists stay in long form (one row per list and venue), never one array per list: the list of a
large department or of "lanes >= 1" would otherwise hold a large share of all venues. Counts
come from partial aggregates over the same rows.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from ringside import vocab
from ringside.functions import geo, text
from ringside.operators import publish, ranking, spatial
from ringside.operators.publish import MISSING_DEP
from ringside.session import cut_lineage

c = F.col
# fixed values: cities published whole although the census only knows their districts
PARENT_CITIES = (("Paris", "75"), ("Lyon", "69"), ("Marseille", "13"))
MIN_PER_DEPARTMENT, MIN_LENGTH, MIN_LANES = 3, 15, 5


def _entry(facet, value) -> Column:
    return F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value"))


def _when(condition, entry) -> Column:
    return F.when(condition, entry)


def _disciplines(array_name, entry):
    return [F.when(F.array_contains(c(array_name), value), entry(param, value))
            for param, value in vocab.DISCIPLINE_OF_PARAM.items()]


def facet_members(index: DataFrame) -> DataFrame:
    """(facet, value, dep) and every column of the index row, for each list a venue is in.

    One explode, no shuffle. `department` and `city` exist per department only; the other
    families are read both nationally and per department. "lanes" is cumulative: a venue
    with six lanes is in the lists 1 to 6.
    """
    dep = F.coalesce("d", F.lit(MISSING_DEP))
    city, parent = text.slug(c("v")), text.parent_city(c("v"))
    one = F.array_compact(F.array(
        _entry("department", dep),
        _when(city != "", _entry("city", city)),
        _when(parent.isNotNull(), _entry("city", text.slug(parent))),
        _when(c("lp").isNotNull(), _entry("length", c("lp"))),
        _when(c("s").isNotNull(), _entry("surface", text.label_of(c("s"), vocab.SURFACE_ENGLISH))),
        _when(c("nv") > 0, _entry("reviewed", F.lit("true"))),
        _when(c("al") == 1, _entry("free-access", F.lit("true"))),
        *_disciplines("g", lambda param, _: _entry("discipline", F.lit(param)))))
    lanes = F.transform(F.when(c("cl") > 0, F.sequence(F.lit(1), c("cl"))), lambda n: _entry("lanes", n))
    every = F.concat(one, F.coalesce(lanes, F.array().cast("array<struct<facet:string,value:string>>")))
    return index.withColumn("_f", F.explode(every)).select(
        c("_f.facet").alias("facet"), c("_f.value").alias("value"), dep.alias("dep"),
        *index.columns)


def facet_lists(index: DataFrame) -> DataFrame:
    """The published lists: national ones have a null `dep`. Sort with `in_list_order` to write."""
    members = facet_members(index).withColumnRenamed("i", "id")
    national = ~c("facet").isin("department", "city")
    scopes = F.when(national, F.array(F.lit(None).cast("string"), c("dep"))).otherwise(F.array(c("dep")))
    return members.withColumn("dep", F.explode(scopes))


def facet_counts(index: DataFrame) -> DataFrame:
    """Size of every non-empty list: counted per department, then nationally, in one pass."""
    members = facet_members(index)
    counted = members.groupingSets([["facet", "value"], ["facet", "value", "dep"]],
                                   "facet", "value", "dep").agg(F.count("*").alias("n"))
    return counted.where(c("dep").isNotNull() | ~c("facet").isin("department", "city"))


def list_key():
    """City then name, lower case: the order of every published list."""
    return [F.lower(F.coalesce("ville", F.lit(""))), F.lower(F.coalesce("nom", F.lit("")))]


def geo_cells(index: DataFrame, step=0.1) -> DataFrame:
    """(cell_y, cell_x, id): integer cell keys, round half even of coordinate / step."""
    return index.where(c("y").isNotNull() & c("x").isNotNull()).select(
        geo.degree_cell(c("y"), step).alias("cell_y"), geo.degree_cell(c("x"), step).alias("cell_x"),
        c("i").alias("id"))


def live_neighbours(cells: DataFrame) -> DataFrame:
    """(cell, neighbour) for each of the eight neighbours that holds at least one venue."""
    live = cells.select("cell_y", "cell_x").distinct()
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
                        for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    around = live.withColumn("o", F.explode(offsets)).select(
        "cell_y", "cell_x", (c("cell_y") + c("o.dy")).alias("near_y"),
        (c("cell_x") + c("o.dx")).alias("near_x"))
    there = live.select(c("cell_y").alias("near_y"), c("cell_x").alias("near_x"))
    return around.join(there, ["near_y", "near_x"], "left_semi").select(
        "cell_y", "cell_x", "near_y", "near_x")


# ------------------------------------------------------------------------------- criteria
def criterion_members(venues: DataFrame) -> DataFrame:
    """(kind, criterion, dep) per venue and axis: lengths, lanes 8 to 2, access, kit, surfaces."""
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("criterion"))
    one = F.array_compact(F.array(
        F.when(c("longueur_piste") > 0, entry("length", c("longueur_piste"))),
        F.when(c("acces_libre"), entry("free-access", F.lit("free-access"))),
        F.when(c("surface").isin(*vocab.SURFACES), entry("surface", c("surface"))),
        *_disciplines("agres", lambda _, value: entry("discipline", F.lit(value)))))
    lanes = F.transform(F.when(c("couloirs") >= 2, F.sequence(F.lit(2), F.least(c("couloirs"), F.lit(8)))),
                        lambda n: entry("lanes", n))
    every = F.concat(one, F.coalesce(lanes, F.array().cast("array<struct<kind:string,criterion:string>>")))
    return venues.withColumn("_c", F.explode(every)).select(
        c("_c.kind").alias("kind"), c("_c.criterion").alias("criterion"),
        F.coalesce("dep", F.lit(MISSING_DEP)).alias("dep"), "dep_nom", "id", F.struct(*list_key(), "id").alias("place"))


def criterion_counts(venues: DataFrame, min_length=MIN_LENGTH, min_lanes=MIN_LANES) -> DataFrame:
    """Axes worth a page: a lap length needs 15 venues, a lane count 5, the others one."""
    floor = F.when(c("kind") == "length", min_length).when(c("kind") == "lanes", min_lanes).otherwise(1)
    return criterion_members(venues).groupBy("kind", "criterion").agg(F.count("*").alias("n")).where(
        c("n") >= floor)


def criterion_by_department(venues: DataFrame, **floors) -> DataFrame:
    """(criterion, dep, n) of every retained axis."""
    per_dep = criterion_members(venues).groupBy("kind", "criterion", "dep").agg(
        F.count("*").alias("n"), F.min_by(F.struct("dep_nom"), "place")["dep_nom"].alias("dep_nom"))
    floor = F.when(c("kind") == "length", floors.get("min_length", MIN_LENGTH)).when(
        c("kind") == "lanes", floors.get("min_lanes", MIN_LANES)).otherwise(1)
    kept = per_dep.groupBy("kind", "criterion").agg(F.sum("n").alias("_all")).where(c("_all") >= floor)
    return per_dep.join(kept.drop("_all"), ["kind", "criterion"], "left_semi")


def criterion_links(per_department: DataFrame, minimum=MIN_PER_DEPARTMENT) -> DataFrame:
    """Where a criterion and department link to: a list of their own, or the department's."""
    return per_department.withColumn("target", F.when(c("n") >= minimum, F.lit("criterion"))
                                     .otherwise(F.lit("department")))


# ---------------------------------------------------------------------------- departments
def department_index(venues: DataFrame) -> DataFrame:
    """Code, name, region and count; order by region then name.

    Name and region are those of the department's first venue in list order.
    """
    first = F.min_by(F.struct("dep_nom", "region"), F.struct(*list_key(), "id"))
    return venues.groupBy("dep").agg(first.alias("first"), F.count("*").alias("n")).select(
        "dep", F.coalesce(F.nullif(c("first.dep_nom"), F.lit("")), "dep").alias("dep_nom"),
        F.coalesce("first.region", F.lit("")).alias("region"), "n")


def department_slugs(deps: DataFrame) -> DataFrame:
    """Unique slugs: the second and later department with a taken slug gets its code added.

    A window per slug over the department dimension, of about a hundred rows.
    """
    slug = F.coalesce(F.nullif(text.slug(c("dep_nom")), F.lit("")), c("dep"))
    w = Window.partitionBy("_s").orderBy("dep")
    taken = F.row_number().over(w) > 1
    return deps.withColumn("_s", slug).select("dep", "dep_nom", F.when(
        taken, F.concat_ws("-", "_s", "dep")).otherwise(c("_s")).alias("slug"))


# --------------------------------------------------------------------------------- cities
def city_members(venues: DataFrame, parents=PARENT_CITIES) -> DataFrame:
    """(slug, dep) per venue, plus one row under the parent city for its numbered districts.

    Districts are kept; a plain city of the same slug and department gives way to the parent.
    """
    own = venues.withColumn("slug", text.slug(c("ville"))).where(c("slug") != "").withColumns({
        "dep": F.coalesce("dep", F.lit(MISSING_DEP)), "parent": F.lit(None).cast("string")})
    mother = text.parent_city(c("ville"))
    listed = F.lit(False)
    for name, code in parents:
        listed = listed | ((mother == name) & (c("dep") == code))
    whole = venues.where(listed).withColumns({"slug": text.slug(mother), "parent": mother})
    replaced = whole.select("slug", "dep").distinct()      # at most one row per listed parent
    plain = own.join(replaced, ["slug", "dep"], "left_anti")
    return plain.unionByName(whole.select(plain.columns))


def cities(members: DataFrame) -> DataFrame:
    """One row per city page: final slug, name, size and centroid.

    A slug shared by several departments takes the department code. Two aggregations, because
    a window cannot count distinct departments.
    """
    first = F.min_by(F.coalesce("parent", "ville"),
                     F.struct(*list_key(), c("id")))
    per_city = members.groupBy("slug", "dep").agg(
        first.alias("name"), F.count("*").alias("n"), F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"))
    shared = per_city.groupBy("slug").agg(F.count("*").alias("_deps"))
    final = F.when(c("_deps") == 1, c("slug")).otherwise(F.concat_ws("-", "slug", "dep"))
    return per_city.join(shared, "slug").select(
        final.alias("city"), "slug", "dep", "name", "n", "lat", "lon")


def around_cities(cities_: DataFrame, venues: DataFrame, within_km=20.0, k=12,
                  parents=PARENT_CITIES, members=None) -> DataFrame:
    """The nearest venues within 20 km of a city's centroid that are not in the city.

    members: `city_members` of the venues, if at hand.

    Search cells cover the exact radius at any latitude. Candidates at one coordinate and in
    one city are folded to the k first ids before the search, which cannot change the answer.
    """
    members = city_members(venues, parents) if members is None else members
    membership = members.select(
        "id", F.concat_ws("/", "slug", "dep").alias("_city"))
    homes = membership.groupBy("id").agg(F.array_sort(F.collect_set("_city")).alias("homes"))  # one or two
    spots = venues.select("id", "lat", "lon").join(homes, "id", "left").withColumn(
        "homes", F.coalesce("homes", F.array().cast("array<string>")))
    # read by several steps of the search: kept once, narrow, in the shared folder
    spots = cut_lineage(spatial.keep_first(spots, ["lat", "lon", "homes"], ["id"], k).drop("rank"))
    mine = spots.select(F.explode("homes").alias("q_home")).groupBy("q_home").agg(
        F.count("*").alias("_mine"))
    queries = cities_.select(c("city").alias("q_id"), c("lat").alias("q_lat"), c("lon").alias("q_lon"),
                             F.concat_ws("/", "slug", "dep").alias("q_home"))
    queries = cut_lineage(queries.join(mine, "q_home", "left").withColumn("_mine", F.coalesce("_mine", F.lit(0))))
    candidates = spots.select(c("id").alias("c_id"), c("lat").alias("c_lat"), c("lon").alias("c_lon"), "homes")
    found = spatial.nearest(queries, candidates, k, within_m=within_km * 1000, need=c("_mine") + k,
                            exclude=F.array_contains(c("homes"), c("q_home")))
    return found.select(c("q_id").alias("city"), c("c_id").alias("id"),
                        (c("metres") / 1000).alias("km"), "rank")


def neighbours(venues: DataFrame, k=6) -> DataFrame:
    """The k nearest venues of the same department, for every venue.

    Venues at one coordinate share one search and stand for each other: only the k + 1
    smallest ids of a coordinate can ever be among anyone's nearest.
    """
    at = ["dep", "lat", "lon"]
    base = cut_lineage(located_rows(venues).select("id", *at))
    spots = base.select(*at).distinct().withColumn("q_id", F.concat_ws("/", *at))
    few = spatial.keep_first(base.select("id", *at), at, ["id"], k + 1)
    candidates = few.select(c("id").alias("c_id"), c("lat").alias("c_lat"), c("lon").alias("c_lon"), "dep")
    queries = spots.select("q_id", c("lat").alias("q_lat"), c("lon").alias("q_lon"), "dep")
    near = spatial.nearest(queries, candidates, k + 1, by=["dep"]).select(
        c("dep"), c("q_lat").alias("lat"), c("q_lon").alias("lon"), c("c_id").alias("near_id"), "metres")
    pairs = base.select("id", *at).join(near, at).where(c("id") != c("near_id"))
    return spatial.keep_first(pairs, ["id"], ["metres", "near_id"], k).select(
        "id", "near_id", (c("metres") / 1000).alias("km"), "rank")


def located_rows(venues):
    return venues.where(c("lat").isNotNull() & c("lon").isNotNull())


# ------------------------------------------------------------------------- lists and pages
def list_positions(members: DataFrame, keys, first=200) -> DataFrame:
    """1-based position of the first 200 venues of each list, in list order."""
    return spatial.keep_first(members, keys, [*list_key(), "id"], first, "position")


def list_headings(venues: DataFrame, keys=("dep",)) -> DataFrame:
    """City break headings of lists sorted by (lower city, lower name): (keys, heading, first id).

    A heading opens wherever the city as written, or the list, differs from the row before in the
    order of all lists; a city written in very many ways spreads over the parts of that order.
    """
    written = F.coalesce("ville", F.lit(""))
    order = [*keys, F.lower(written), F.lower(F.coalesce("nom", F.lit(""))), "id"]
    slim = venues.select(*keys, "ville", "nom", "id")
    seen = ranking.with_previous(slim, order, F.struct(*keys, written.alias("heading")))
    same = F.coalesce(c("before.heading") == written, F.lit(False))
    for k in keys:
        same = same & c(f"before.{k}").eqNullSafe(c(k))
    return seen.where(~same).select(*keys, written.alias("heading"), "id")


def criterion_slug(lang="fr") -> Column:
    """Address of a criterion's page in a language, from (kind, criterion). Addresses are public and fixed."""
    english = {code: param.replace("_", "-") for param, code in vocab.DISCIPLINE_OF_PARAM.items()}
    if lang == "fr":
        named = F.when(c("kind") == "free-access", "acces-libre").otherwise(c("criterion"))
    else:
        named = (F.when(c("kind") == "discipline", text.label_of(c("criterion"), english))
                 .when(c("kind") == "surface", text.label_of(c("criterion"), vocab.SURFACE_ENGLISH)).otherwise(c("criterion")))
    return (F.when(c("kind") == "length", F.concat("criterion", F.lit("m")))
            .when(c("kind") == "lanes", F.concat("criterion", F.lit("-couloirs" if lang == "fr" else "-lanes"))).otherwise(named))


def url_inventory(venues: DataFrame, photos: DataFrame, langs=("fr", "en")) -> DataFrame:
    """(kind, lang, key, priority, images) of every page of the site. Keys of criteria differ by language; the
    images of a venue's page, here only counted, are rows of `image_entries`."""
    pages = lambda df, kind, key, priority, images=F.lit(0).cast("long"): df.select(
        F.lit(kind).alias("kind"), F.array(*[F.struct(F.lit(x).alias("lang"), (key(x) if callable(key) else key).alias("key")) for x in langs]).alias("each"),
        F.lit(priority).alias("priority"), images.alias("images"))
    some = venues.sparkSession.range(1)
    deps = department_slugs(department_index(venues))
    per_dep = criterion_by_department(venues)
    crits = per_dep.select("kind", "criterion").distinct()
    both = per_dep.where(c("n") >= MIN_PER_DEPARTMENT).join(deps.select("dep", "slug"), "dep")
    shots = photos.groupBy("id").agg(F.count("*").alias("images"))
    sites = venues.select("id").join(shots, "id", "left")
    every = (pages(some, "home", F.lit(""), "1.0")
             .unionByName(pages(some, "departments", F.lit(""), "0.8"))
             .unionByName(pages(some, "contributors", F.lit(""), "0.7"))
             .unionByName(pages(deps, "department", c("dep"), "0.7"))
             .unionByName(pages(crits, "criterion", criterion_slug, "0.6"))
             .unionByName(pages(both, "criterion-department", lambda x: F.concat_ws("/", criterion_slug(x), "slug"), "0.5"))
             .unionByName(pages(cities(city_members(venues)), "city", c("city"), "0.6"))
             .unionByName(pages(sites, "venue", c("id"), "0.6", F.coalesce("images", F.lit(0).cast("long")))))
    return every.select("kind", F.inline("each"), "priority", "images")


def image_entries(venues: DataFrame, photos: DataFrame, url_base: str, langs=("fr", "en")) -> DataFrame:
    """(lang, id, loc, title, caption): the images that the page of a venue declares, in each language.

    photos: id, f (path), l (legend), as `publish.photo_entries` gives them. One row an image, however many a venue has.
    """
    shown = photos.select("id", "f", "l").join(venues.select("id", "nom", "ville"), "id")
    each = F.array(*[F.struct(F.lit(x).alias("lang"), publish.name_of(x).alias("title"), publish.photo_alt(F.coalesce("l", F.lit("")), x).alias("caption")) for x in langs])
    return shown.select("id", F.concat(F.lit(url_base), F.lit("/"), c("f")).alias("loc"), F.inline(each))
