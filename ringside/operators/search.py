"""Search and browse: validated parameters, conjunctive filters, ranking, paging.

A query becomes one `where` of built-in predicates - the cheap ones and the bounding box reach
the parquet scan - then a top-k sort. Nothing is collected.
"""
from dataclasses import dataclass, field
from functools import reduce
import math
import operator
import re
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from ringside import vocab
from ringside.functions import geo, text
from ringside.operators import ranking
from ringside.operators.publish import full_rows, lap

c = F.col
DEFAULT_LIMIT, MAX_LIMIT, DEFAULT_RADIUS_KM, MAX_RADIUS_KM = 50, 500, 10.0, 100.0
NEAR_ME_KM = 30.0
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")


class BadParameter(ValueError):
    """A refused parameter, with the hint the caller should see."""

    def __init__(self, message, parameter, hint="", status=400):
        super().__init__(f"{parameter}: {message} ({hint})")
        self.parameter, self.hint, self.status = parameter, hint, status


@dataclass(frozen=True)
class VenueQuery:
    """What was understood of the parameters of a search."""
    free_access: object = None          # True or "unknown"
    lat: float = None
    lon: float = None
    radius: float = DEFAULT_RADIUS_KM
    length: tuple = None                # (min, max)
    lanes_min: int = None
    surface: str = None
    has_reviews: bool = None
    certainty: str = "declared"
    disciplines: tuple = ()
    city: str = None
    department: str = None
    limit: int = DEFAULT_LIMIT
    page: int = 1
    echo: dict = field(default_factory=dict, compare=False)


def _number(raw, name, hint):
    try:
        value = float(str(raw).strip() or "0")
    except ValueError:
        raise BadParameter("invalid value", name, hint) from None
    if not math.isfinite(value):
        raise BadParameter("invalid value", name, hint)
    return value


def _whole(raw, name, hint, least=1):
    value = _number(raw, name, hint)
    if value != int(value) or value < least:
        raise BadParameter("invalid value", name, hint)
    return int(value)


def parse_query(params: dict) -> VenueQuery:
    """Check the parameters before any plan is built; raises BadParameter."""
    given = lambda name: str(params.get(name) or "").lower()
    out, echo = {}, {}

    access = given("free_access")
    if access in FALSE:
        raise BadParameter("no information on access is not a refusal", "free_access",
                           "use true, or unknown for the venues that say nothing")
    if access and access not in (*TRUE, "unknown"):
        raise BadParameter("invalid value", "free_access", "true | unknown")
    if access:
        out["free_access"] = echo["free_access"] = "unknown" if access == "unknown" else True

    if ("lat" in params) != ("lon" in params):
        raise BadParameter("lat and lon go together", "lon" if "lat" in params else "lat", "give both or none")
    if "lat" in params:
        lat, lon = (_number(params[k], "lat/lon", "WGS84 degrees") for k in ("lat", "lon"))
        if abs(lat) > 90 or abs(lon) > 180:
            raise BadParameter("invalid coordinates", "lat/lon", "WGS84 degrees")
        radius = DEFAULT_RADIUS_KM
        if "radius" in params:
            radius = _number(params["radius"], "radius", "kilometres")
            if radius <= 0:
                raise BadParameter("invalid radius", "radius", "kilometres")
            if radius > MAX_RADIUS_KM:
                raise BadParameter(f"at most {MAX_RADIUS_KM:.0f} km", "radius", "filter the index yourself", 413)
        out.update(lat=lat, lon=lon, radius=radius)
        echo.update(lat=lat, lon=lon, radius=radius)

    span = params.get("track_length") or params.get("length")
    if span:
        match = re.fullmatch(r"([0-9]+)(?:-([0-9]+))?", str(span))
        if not match:
            raise BadParameter("invalid format", "track_length", "400 or 300-400")
        out["length"] = (int(match[1]), int(match[2] or match[1]))
        echo["track_length"] = str(span)

    if "lanes_min" in params:
        out["lanes_min"] = echo["lanes_min"] = _whole(params["lanes_min"], "lanes_min", "positive integer")
    if "surface" in params:
        named = given("surface")
        codes = {english: code for code, english in vocab.SURFACE_ENGLISH.items()}
        code = codes.get(named, named if named in vocab.SURFACES else None)
        if code is None:
            raise BadParameter("unknown surface", "surface", " | ".join(codes))
        out["surface"] = echo["surface"] = code
    if "has_reviews" in params:
        if given("has_reviews") not in TRUE + FALSE:
            raise BadParameter("invalid value", "has_reviews", "true | false")
        out["has_reviews"] = echo["has_reviews"] = given("has_reviews") in TRUE

    certainty = given("certainty") or "declared"
    if certainty not in ("declared", "probable", "any"):
        raise BadParameter("invalid value", "certainty", "declared | probable | any")
    wanted = []
    for name, code in vocab.DISCIPLINE_OF_PARAM.items():
        if not given(name):
            continue
        if given(name) not in TRUE:
            raise BadParameter("a discipline is asked for with true", name, f"{name}=true")
        wanted.append(code)
        echo[name] = True
    out.update(certainty=certainty, disciplines=tuple(wanted))
    if certainty != "declared":
        echo["certainty"] = certainty
    for name in ("city", "department"):
        if params.get(name) and (name != "city" or plain_slug(params[name])):  # a city without letters is no filter
            out[name] = echo[name] = params[name]
    if "limit" in params:
        out["limit"] = min(_whole(params["limit"], "limit", f"1 to {MAX_LIMIT}"), MAX_LIMIT)
    if "page" in params:
        out["page"] = _whole(params["page"], "page", "from 1")
    return VenueQuery(**out, echo=echo)


def checked(requests: DataFrame, params="params") -> DataFrame:
    """`requests` with what `parse_query` makes of each map of parameters, as columns: `refusal` (parameter, hint,
    status) of the first rule that a request breaks, or null; `query` (its understood fields) where nothing is refused.
    """
    raw = lambda k: F.try_element_at(c(params), F.lit(k))
    has = lambda k: F.coalesce(F.map_contains_key(c(params), k), F.lit(False))
    given = lambda k: F.lower(F.coalesce(raw(k), F.lit("")))
    refuse = lambda when, name, hint, status=400: F.when(when, F.struct(
        (name if isinstance(name, Column) else F.lit(name)).alias("parameter"), F.lit(hint).alias("hint"), F.lit(status).alias("status")))

    def number(k):
        typed = F.trim(F.coalesce(raw(k), F.lit("")))
        plain = typed.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        value = F.when(typed == "", 0.0).when(plain, typed.try_cast("double"))
        return F.when(F.abs(value) != float("inf"), value)

    def whole(k):
        value = number(k)
        return F.when((value == F.floor(value)) & (value >= 1), value.try_cast("long"))

    lat, lon, radius = number("lat"), number("lon"), number("radius")
    span = F.coalesce(F.nullif(raw("track_length"), F.lit("")), F.nullif(raw("length"), F.lit("")))
    ends = lambda group: F.regexp_extract(span, "^([0-9]+)(?:-([0-9]+))?$", group)
    code_of = F.create_map(*[F.lit(x) for pair in [*((e, k) for k, e in vocab.SURFACE_ENGLISH.items()), *((k, k) for k in vocab.SURFACES)] for x in pair])
    surface = F.try_element_at(code_of, given("surface"))
    certainty = F.coalesce(F.nullif(given("certainty"), F.lit("")), F.lit("declared"))
    asked = [(k, given(k)) for k in vocab.DISCIPLINE_OF_PARAM]
    rules = [
        refuse(given("free_access").isin(*FALSE), "free_access", "use true, or unknown for the venues that say nothing"),
        refuse(~given("free_access").isin("", "unknown", *TRUE), "free_access", "true | unknown"),
        refuse(has("lat") != has("lon"), F.when(has("lat"), "lon").otherwise("lat"), "give both or none"),
        refuse(has("lat") & (lat.isNull() | lon.isNull() | (F.abs(lat) > 90) | (F.abs(lon) > 180)), "lat/lon", "WGS84 degrees"),
        refuse(has("lat") & has("radius") & (radius.isNull() | (radius <= 0)), "radius", "kilometres"),
        refuse(has("lat") & has("radius") & (radius > MAX_RADIUS_KM), "radius", "filter the index yourself", 413),
        refuse(span.isNotNull() & (ends(1) == ""), "track_length", "400 or 300-400"),
        refuse(has("lanes_min") & whole("lanes_min").isNull(), "lanes_min", "positive integer"),
        refuse(has("surface") & surface.isNull(), "surface", " | ".join(vocab.SURFACE_ENGLISH.values())),
        refuse(has("has_reviews") & ~given("has_reviews").isin(*TRUE, *FALSE), "has_reviews", "true | false"),
        refuse(~certainty.isin("declared", "probable", "any"), "certainty", "declared | probable | any"),
        *[refuse(~value.isin("", *TRUE), k, f"{k}=true") for k, value in asked],
        refuse(has("limit") & whole("limit").isNull(), "limit", f"1 to {MAX_LIMIT}"),
        refuse(has("page") & whole("page").isNull(), "page", "from 1")]
    optional = lambda k, value: F.when(has(k), value).alias(k)
    query = F.struct(
        F.when(given("free_access") != "", F.when(given("free_access") == "unknown", "unknown").otherwise("true")).alias("free_access"),
        optional("lat", lat), optional("lon", lon), F.when(has("lat") & has("radius"), radius).otherwise(DEFAULT_RADIUS_KM).alias("radius"),
        F.when(ends(1) != "", F.struct(ends(1).try_cast("int").alias("low"), F.coalesce(F.nullif(ends(2), F.lit("")), ends(1)).try_cast("int").alias("high"))).alias("length"),
        optional("lanes_min", whole("lanes_min")), optional("surface", surface), optional("has_reviews", given("has_reviews").isin(*TRUE)),
        certainty.alias("certainty"), F.array_compact(F.array(*[F.when(value != "", vocab.DISCIPLINE_OF_PARAM[k]) for k, value in asked])).alias("disciplines"),
        F.when(text.slug(raw("city")) != "", raw("city")).alias("city"), F.nullif(raw("department"), F.lit("")).alias("department"),
        F.least(F.coalesce(whole("limit"), F.lit(DEFAULT_LIMIT)), F.lit(MAX_LIMIT)).cast("int").alias("limit"), F.coalesce(whole("page"), F.lit(1)).cast("long").alias("page"))
    return requests.withColumn("refusal", F.coalesce(*rules)).withColumn("query", F.when(c("refusal").isNull(), query))


# -------------------------------------------------------------------- filters of the index
def all_of(conditions) -> Column:
    return reduce(operator.and_, conditions, F.lit(True))


def plain_slug(typed: str) -> str:
    """The slug of a typed text, made on the driver as `text.slug` makes a column's."""
    return re.sub(r"[^a-z0-9]+", "-", fold_words(typed)[0]).strip("-")


def in_city(city_text) -> Column:
    """Exact slug, or the slug followed by a dash: "lyon" catches its districts."""
    wanted = text.slug(F.lit(city_text))
    mine = text.slug(c("v"))
    return (mine == wanted) | mine.startswith(F.concat(wanted, F.lit("-")))


def reviewed(yes) -> Column:
    return F.coalesce("nv", F.lit(0)) > 0 if yes else F.coalesce("nv", F.lit(0)) == 0


def access(state) -> Column:
    """True: declared free. "unknown": says nothing. There is no "false"."""
    if state is True:
        return c("al") == 1
    if state == "unknown":
        return c("al").isNull()
    raise BadParameter("no information on access is not a refusal", "free_access", "true | unknown")


def length_between(low, high) -> Column:
    return c("lp").between(low, high)


def at_least_lanes(n) -> Column:
    return c("cl") >= n


def has_surface(code) -> Column:
    english = {e: k for k, e in vocab.SURFACE_ENGLISH.items()}
    return c("s") == english.get(code, code)


def has_disciplines(wanted, certainty="declared") -> Column:
    """All wanted disciplines in the declared, the probable, or either pool."""
    pools = {"declared": ["g"], "probable": ["gp"], "any": ["g", "gp"]}[certainty]
    holds = lambda d: reduce(operator.or_, [F.coalesce(F.array_contains(c(p), d), F.lit(False)) for p in pools])
    return all_of([holds(d) for d in wanted])


def box_around(lat, lon, km, lat_col="y", lon_col="x") -> Column:
    """A bounding box that holds the disc: plain comparisons the scan can skip row groups with."""
    angle = km / 6371.0
    d_lat = math.degrees(angle) + 1e-7
    inside = c(lat_col).between(max(-90.0, lat - d_lat), min(90.0, lat + d_lat))
    reach = math.sin(min(angle, math.pi / 2)) / max(math.cos(math.radians(lat)), 1e-12)
    if abs(lat) + d_lat >= 90 or reach >= 1:
        return inside
    d_lon = math.degrees(math.asin(reach)) + 1e-7
    low, high = lon - d_lon, lon + d_lon
    if low < -180:
        return inside & ((c(lon_col) >= low + 360) | (c(lon_col) <= high))
    if high > 180:
        return inside & ((c(lon_col) >= low) | (c(lon_col) <= high - 360))
    return inside & c(lon_col).between(low, high)


def within_km(index: DataFrame, lat, lon, km=DEFAULT_RADIUS_KM, lat_col="y", lon_col="x") -> DataFrame:
    """Rows within km of a point, with distance_km."""
    gap = geo.haversine_km(F.lit(float(lat)), F.lit(float(lon)), c(lat_col), c(lon_col))
    return index.where(box_around(lat, lon, km, lat_col, lon_col)).withColumn("distance_km", gap).where(
        c("distance_km") <= km)


def matching(index: DataFrame, query: VenueQuery) -> DataFrame:
    """Every row a query keeps; adds distance_km when a point is given."""
    q = query
    tests = []
    if q.department:
        tests.append(c("d") == q.department)
    if q.free_access is not None:
        tests.append(access(q.free_access))
    if q.has_reviews is not None:
        tests.append(reviewed(q.has_reviews))
    if q.length:
        tests.append(length_between(*q.length))
    if q.lanes_min:
        tests.append(at_least_lanes(q.lanes_min))
    if q.surface:
        tests.append(has_surface(q.surface))
    if q.disciplines:
        tests.append(has_disciplines(q.disciplines, q.certainty))
    if q.city:
        tests.append(in_city(q.city))
    kept = index.where(all_of(tests))
    return kept if q.lat is None else within_km(kept, q.lat, q.lon, q.radius)


def french_order(*columns):
    """French collation, as a dictionary sorts it."""
    return [F.collate(F.coalesce(c(x), F.lit("")), "FR") for x in columns]


def french_positions(rows: DataFrame, columns, ident="id") -> DataFrame:
    """(ident, position): every row's place from 0 in French order, ties by ident. The order as a column: it can be
    stored, joined and paged by comparison, and no task sees more than its range."""
    slim = rows.select(ident, *columns)
    return ranking.placed(slim, [*french_order(*columns), ident]).select(ident, "position")


def page_of(rows: DataFrame, order, limit=DEFAULT_LIMIT, page=1) -> DataFrame:
    """One page of a ranking: a top-k plan, no total sort."""
    ordered = rows.orderBy(*order)
    return ordered.offset((page - 1) * limit).limit(limit) if page > 1 else ordered.limit(limit)


def envelope(results: DataFrame, total: DataFrame, echo: dict, source: str, licence: str) -> DataFrame:
    """The common answer: what was understood, counts, provenance, one page of results.

    results is one page (at most 500 rows), total one row.
    """
    packed = results.agg(F.count("*").alias("count"), F.collect_list(F.struct(*results.columns)).alias("results"))
    said = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in echo.items()])) if echo else F.lit("{}")
    return packed.select(
        said.alias("query"), "count", total.scalar().alias("total"), F.lit(source).alias("source"),
        F.lit(licence).alias("license"), "results")


def search(index: DataFrame, params: dict, url_base: str, source: str, licence: str) -> DataFrame:
    """A whole search: one row holding the page, the total and whether a next page exists."""
    query = parse_query(params)
    kept = matching(index, query)
    near = query.lat is not None
    order = ["distance_km", "i"] if near else [*french_order("v", "n"), "i"]
    rows = full_rows(page_of(kept, order, query.limit, query.page), url_base,
                     c("distance_km") if near else None)
    total = kept.agg(F.count("*").alias("total"))
    answer = envelope(rows, total, query.echo, source, licence)
    after = query.page * query.limit
    return answer.withColumn("page", F.lit(query.page)).withColumn(
        "next", F.when(c("total") > after, F.lit(query.page + 1)))


def by_id(index: DataFrame, ident: str) -> DataFrame:
    """The venue of an id; an empty result is "not found"."""
    return index.where(c("i") == ident)


# ------------------------------------------------------------------------ browsing venues
def _has(*names) -> Column:
    return reduce(operator.or_, [F.coalesce(F.array_contains(c("agres"), n), F.lit(False)) for n in names])


def _some(name) -> Column:
    return F.coalesce(F.size(c(name)), F.lit(0)) > 0


BROWSE_TESTS = {
    "piste": lambda: c("piste"), "synth": lambda: c("surface") == "synthetique",
    "libre": lambda: c("acces_libre"), "perche": lambda: _has("perche"),
    "long": lambda: _has("longueur", "triple"), "haut": lambda: _has("hauteur"),
    "poids": lambda: _has("poids"), "lancer": lambda: _has("disque", "marteau", "javelot"),
    "sauts": lambda: c("nb_sautoirs") > 0, "ecl": lambda: c("eclairage"),
    "couv": lambda: c("couvert"), "vest": lambda: c("vestiaires"), "noeco": lambda: ~c("scolaire"),
    "photo": lambda: _some("photos"), "avis": lambda: _some("avis"), "noavis": lambda: ~_some("avis"),
}


def browse_test(name: str) -> Column:
    return BROWSE_TESTS[name]()


def lap_is(metres) -> Column:
    return lap(c("longueur_piste"), c("longueur_probable"))["metres"] == metres


def searchable_text() -> Column:
    """Accent-free "name city postcode department code"."""
    return text.fold(F.concat_ws(" ", *[F.coalesce(c(x), F.lit("")) for x in
                                        ("nom", "ville", "cp", "dep_nom", "dep")]))


def fold_words(typed: str):
    """The words of a typed query, folded on the driver like `text.fold` folds a column."""
    plain = "".join(ch for ch in unicodedata.normalize("NFD", typed or "")
                    if unicodedata.category(ch) != "Mn").lower().strip()
    return plain, plain.split()


def contains_words(typed: str) -> Column:
    _, words = fold_words(typed)
    return all_of([F.contains(searchable_text(), F.lit(w)) for w in words])


def relevance(typed: str) -> Column:
    """0 city, 1 postcode, 2 city prefix, 3 in name, 4 in city, 5 all words in name, 6 else."""
    whole, words = fold_words(typed)
    city, name = text.fold(c("ville")), text.fold(c("nom"))
    return (F.when(city == whole, 0).when(c("cp") == whole, 1).when(city.startswith(whole), 2)
            .when(F.contains(name, F.lit(whole)), 3).when(F.contains(city, F.lit(whole)), 4)
            .when(all_of([F.contains(name, F.lit(w)) for w in words]), 5).otherwise(6))


def browse(venues: DataFrame, tests=("piste",), typed="", dep=None, lap_m=None, near=None,
           near_only=False) -> DataFrame:
    """Filtered and ranked venues: by distance from `near`, else by relevance, else by city."""
    conditions = [browse_test(t) for t in tests]
    if dep:
        conditions.append(c("dep") == dep)
    if lap_m:
        conditions.append(lap_is(lap_m))
    kept = venues.where(all_of(conditions))
    if fold_words(typed)[1]:
        kept = kept.where(contains_words(typed))
    if near:
        if near_only:
            return within_km(kept, *near, NEAR_ME_KM, "lat", "lon").orderBy("distance_km", "id")
        gap = geo.haversine_km(F.lit(float(near[0])), F.lit(float(near[1])), c("lat"), c("lon"))
        return kept.withColumn("distance_km", gap).orderBy("distance_km", "id")
    if fold_words(typed)[1]:
        return kept.withColumn("level", relevance(typed)).orderBy("level", *french_order("ville", "nom"), "id")
    return kept.orderBy(*french_order("ville"), "id")


def result_box(ordered: DataFrame, first=2000, pad=0.15) -> DataFrame:
    """Bounding box of the first rows of a result, padded on each side."""
    box = ordered.limit(first).agg(F.min("lat").alias("s"), F.min("lon").alias("w"),
                                   F.max("lat").alias("n"), F.max("lon").alias("e"))
    dy, dx = (c("n") - c("s")) * pad, (c("e") - c("w")) * pad
    return box.select((c("s") - dy).alias("south"), (c("w") - dx).alias("west"),
                      (c("n") + dy).alias("north"), (c("e") + dx).alias("east"))


# ------------------------------------------------------------------------------ departments
def resolve_departments(typed: DataFrame, deps: DataFrame, column="typed", postcodes=True) -> DataFrame:
    """Code named by free text: code, then postcode, then exact name, then a unique prefix.

    Each step is an equi-join with the department dimension; the prefix step joins on every
    prefix a department name has.
    """
    canon = lambda v: F.regexp_replace(F.upper(F.trim(v)), r"^0+(?=[0-9]+$)", "")
    whole = F.trim(c(column))
    digits = F.regexp_replace(whole, r"\s", "")
    head = F.when(digits.startswith("97"), F.substring(digits, 1, 3)).otherwise(F.substring(digits, 1, 2))
    asked = typed.withColumns({
        "_code": canon(F.split(whole, "·")[0]),
        "_post": F.when(digits.rlike("^[0-9]{5}$") & F.lit(postcodes), canon(head)),
        "_name": text.fold(whole)})
    d = deps.select(c("dep"), canon(c("dep")).alias("_canon"), text.fold(c("dep_nom")).alias("_folded"),
                    text.fold(F.concat(F.when(c("dep").rlike("^[0-9]$"), F.concat(F.lit("0"), c("dep")))
                                       .otherwise(c("dep")), F.lit(" · "), c("dep_nom"))).alias("_label"))
    by_code = d.groupBy("_canon").agg(F.min("dep").alias("_d"))
    by_name = d.select("dep", F.explode(F.array("_folded", "_label")).alias("_k")).groupBy("_k").agg(
        F.min("dep").alias("_by_name"))
    prefixes = d.select("dep", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("_folded"), F.lit(1))),
        lambda n: F.substring(c("_folded"), F.lit(1), n))).alias("_k"))
    by_prefix = prefixes.groupBy("_k").agg(F.min("dep").alias("_by_prefix"), F.count("*").alias("_n")).where(
        c("_n") == 1).drop("_n")
    out = (asked.join(by_code.withColumnsRenamed({"_canon": "_code", "_d": "_by_code"}), "_code", "left")
           .join(by_code.withColumnsRenamed({"_canon": "_post", "_d": "_by_post"}), "_post", "left")
           .join(by_name.withColumnRenamed("_k", "_name"), "_name", "left")
           .join(by_prefix.withColumnRenamed("_k", "_name"), "_name", "left"))
    return out.select(*typed.columns, F.when(whole == "", F.lit("")).otherwise(
        F.coalesce("_by_code", "_by_post", "_by_name", "_by_prefix")).alias("dep"))
