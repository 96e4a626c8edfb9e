"""Coverage audit: measured laps, missing tracks, and places worth a look."""
from pyspark.sql import Column, DataFrame, functions as F

from ringside import vocab
from ringside.functions import geo, numbers, text
from ringside.operators import cluster, spatial
from ringside.session import shuffled
from ringside.sources.mapped import tag

c = F.col
MIN_POINTS, MIN_POINTS_OPEN, MIN_POINTS_LAP = 8, 2, 10
AUDIT_BOUNDS, LAP_BOUNDS = (60.0, 600.0), (150.0, 520.0)
TRACE = "array<struct<ring:array<struct<lat:double,lon:double>>,closed:boolean>>"


# --------------------------------------------------------------------------- tags and rings
def _tokens(name) -> Column:
    return F.split(F.lower(F.coalesce(tag(name), F.lit(""))), "[;,| ]+")


def may_be_athletics() -> Column:
    """No sport tag: worth a look. Otherwise one of its tokens must be athletic."""
    wanted = F.array(*[F.lit(s) for s in vocab.ATHLETICS_SPORTS])
    return ~text.present(tag("sport")) | F.arrays_overlap(_tokens("sport"), wanted)


def is_athletics() -> Column:
    sport = F.coalesce(tag("sport"), F.lit(""))
    return (sport.contains("athletics") | sport.contains("running")
            | F.coalesce(tag("athletics") == "running", F.lit(False)))


def is_field_event() -> Column:
    return F.arrays_overlap(_tokens("athletics"), F.array(*[F.lit(x) for x in vocab.CONTEST_TAGS]))


def traces(keep_open=True) -> Column:
    """array<struct<ring, closed>> of an element: its way, or its inner rings before its outer.

    With keep_open, open traces count when a role has no closed one.
    """
    def with_state(rings):
        return F.transform(F.filter(rings, lambda g: F.size(g) > 0),
                           lambda g: F.struct(g.alias("ring"), geo.is_closed(g).alias("closed")))
    closed = lambda found: F.filter(found, lambda t: t["closed"])
    role = lambda name: with_state(F.transform(
        F.filter(F.coalesce("members", F.array().cast("array<struct<role:string,geometry:array<struct<lat:double,lon:double>>>>")),
                 lambda m: (m["role"] == name) & (F.size(m["geometry"]) > 0)), lambda m: m["geometry"]))
    best = lambda found: F.when(F.size(closed(found)) > 0, closed(found)).when(
        F.lit(keep_open) & (F.size(found) > 0), found)
    way = with_state(F.array_compact(F.array("geometry")))
    way = way if keep_open else closed(way)
    inner, outer = role("inner"), role("outer")
    return F.coalesce(F.when(c("type") == "way", way), F.when(c("type") != "way", F.coalesce(best(inner), best(outer))),
                      F.array().cast(TRACE))


# ------------------------------------------------------------------------ lap estimation
def lap_rings(elements: DataFrame) -> DataFrame:
    """Closed rings that can be a lap: (ring_id, osm, m, pts, lat, lon, lanes)."""
    measured = F.transform(traces(keep_open=False), lambda t: F.struct(
        F.size(t["ring"]).alias("pts"), geo.perimeter(t["ring"]).alias("m"), geo.ring_centre(t["ring"]).alias("p")))
    one = elements.where(is_athletics()).select(
        F.concat(F.substring("type", 1, 1), c("id").cast("string")).alias("osm"),
        tag("lanes").alias("lanes"), F.posexplode(measured).alias("no", "t"))
    return one.where((c("t.pts") >= MIN_POINTS_LAP) & c("t.m").between(*LAP_BOUNDS)).select(
        F.concat_ws("#", "osm", "no").alias("ring_id"), "osm", "t.m", "t.pts", c("t.p.lat").alias("ring_lat"),
        c("t.p.lon").alias("ring_lon"), "lanes")


def match_laps(venues: DataFrame, rings: DataFrame, radius_m=200.0) -> DataFrame:
    """Each venue with the longest ring centred less than 200 m away, and the lap it snaps to.

    Venues at one coordinate share a search. Of the rings in a cell some 40 m wide that lies wholly within
    reach only the longest can win, so only it is met; single rings are met in the cells at the edge of reach.
    """
    spots = venues.where(c("lat").isNotNull() & c("lon").isNotNull()).select("lat", "lon").distinct()
    pairs = spatial.best_within(spots, rings, radius_m, F.struct((-c("m")).alias("s"), c("ring_id")), right_point=("ring_lat", "ring_lon"))
    won = pairs.groupBy("lat", "lon").agg(F.min_by(
        F.struct("best", "metres"), F.struct((-c("best.m")).alias("s"), c("best.ring_id"))).alias("w"))
    return venues.join(won, ["lat", "lon"]).select(
        *venues.columns, c("w.best.osm").alias("osm"), c("w.best.m").alias("ring_m"), c("w.metres").alias("metres"),
        geo.snap_lap(c("w.best.m")).alias("snapped"))


def lap_outcome() -> Column:
    """What a match says about the declared lap."""
    return (F.when(c("snapped").isNull(), F.lit("refused")).when(c("longueur_piste").isNull(), F.lit("new"))
            .when(c("snapped") == c("longueur_piste"), F.lit("agree")).otherwise(F.lit("disagree")))


def lap_outcomes(matches: DataFrame) -> DataFrame:
    return matches.groupBy(lap_outcome().alias("outcome")).agg(F.count("*").alias("n"))


def lap_patches(matches: DataFrame, current: DataFrame) -> DataFrame:
    """Patches (id, longueur_probable, note) for new estimates only; the note is appended once.

    current: id, note of the patches already there. Other keys are left alone.
    """
    said = F.format_string(vocab.ESTIMATE_NOTE, c("snapped"), c("osm"))
    new = matches.where(c("snapped").isNotNull() & c("longueur_piste").isNull()).select(
        "id", c("snapped").alias("longueur_probable"), said.alias("_said"))
    met = new.join(current.select("id", "note"), "id", "left")
    known = F.coalesce("note", F.lit(""))
    return met.select("id", "longueur_probable", F.when(F.contains(known, c("_said")), known).otherwise(
        F.concat_ws(" ", F.nullif(known, F.lit("")), "_said")).alias("note"))


# --------------------------------------------------------------------- candidates and rejects
def examine_traces(elements: DataFrame) -> DataFrame:
    """Every object or trace with the first rule it fails (`reason`, null when kept).

    One pass: sport and field event are judged per object, points and length per trace.
    Input columns other than the element's own are carried along.
    """
    own = ("type", "id", "tags", "geometry", "members", "center", "lat", "lon")
    keep = [x for x in elements.columns if x not in own]
    judged = elements.select(
        *keep, F.concat_ws("/", "type", "id").alias("osm"), "tags",
        F.when(~may_be_athletics(), "autre_sport").when(is_field_event(), "concours").alias("_why"),
        traces().alias("_all"))
    first = F.coalesce("_why", F.when(F.size("_all") == 0, F.lit("sans_trace")))
    # measured inside the array, before the explode: a filter on a measure further down then
    # reads a field, instead of being pushed below and measuring every ring again
    measured = F.transform("_all", lambda t: F.struct(
        t["ring"].alias("ring"), t["closed"].alias("closed"), F.size(t["ring"]).alias("pts"),
        geo.perimeter(t["ring"]).alias("p"), geo.ring_area(t["ring"]).alias("a"),
        geo.box_sides(t["ring"]).alias("box"), geo.ring_centre(t["ring"]).alias("c")))
    each = judged.withColumn("_first", first).select(
        *keep, "osm", "tags", "_first", F.posexplode_outer(F.when(first.isNull(), measured)).alias("no", "_t"))
    measured = each.select(*keep, "osm", "tags", "_first", "no", "_t", c("_t.ring").alias("ring"), c("_t.pts").alias("pts"),
                           c("_t.p").alias("_p"), c("_t.a").alias("_a"), c("_t.box").alias("_box"), c("_t.c").alias("_c"))
    straight = F.when(c("_t.closed"), geo.ribbon_length(c("_p"), c("_a"), c("_box.long_m"), c("_box.short_m")))
    shaped = measured.withColumn("_straight", straight).withColumns({
        "loop": c("_t.closed") & c("_straight").isNull(), "ribbon": c("_straight").isNotNull(),
        "m": F.coalesce("_straight", "_p")})
    floor = F.when(c("loop"), MIN_POINTS).otherwise(MIN_POINTS_OPEN)
    reason = F.coalesce("_first", F.when(c("pts") < floor, "trop_peu_de_points").when(
        ~c("m").between(*AUDIT_BOUNDS), "hors_bornes"))
    detail = (F.when(reason == "autre_sport", F.concat(F.lit(" (sport="), tag("sport"), F.lit(")")))
              .when(reason == "concours", F.concat(F.lit(" (athletics="), tag("athletics"), F.lit(")")))
              .when(reason == "trop_peu_de_points", F.concat(F.lit(" ("), c("pts").cast("string"), F.lit(" points)")))
              .when(reason == "hors_bornes", F.concat(F.lit(" ("), F.bround("m", 0).cast("bigint").cast("string"), F.lit(" m)")))
              .otherwise(F.lit("")))
    return shaped.select(
        *keep, F.concat_ws("#", "osm", F.coalesce("no", F.lit(0))).alias("trace_id"), "osm",
        reason.alias("reason"), F.concat("osm", detail).alias("example"), "tags", "ring", "pts", "m", "loop",
        "ribbon", c("_c.lat").alias("lat"), c("_c.lon").alias("lon"), c("_box.long_m").alias("long_m"),
        c("_box.short_m").alias("short_m"))


def rejects(examined: DataFrame) -> DataFrame:
    return examined.where(c("reason").isNotNull())


def candidates(examined: DataFrame, min_m=AUDIT_BOUNDS[0], max_m=AUDIT_BOUNDS[1]) -> DataFrame:
    return examined.where(c("reason").isNull() & c("m").between(min_m, max_m)).drop("reason", "example")


def rejection_counts(rejects_: DataFrame, examples=3) -> DataFrame:
    """Rejections by reason with their first examples; a reason with very many rows is cut to
    the examples before the shuffle."""
    counts = rejects_.groupBy("reason").agg(F.count("*").alias("n"))
    few = spatial.keep_first(rejects_, ["reason"], ["trace_id"], examples)
    shown = few.groupBy("reason").agg(F.array_sort(F.collect_list(F.struct("rank", "example"))).alias("e"))
    return counts.join(shown, "reason").select(
        "reason", "n", F.transform("e", lambda x: x["example"]).alias("examples"))


# ---------------------------------------------------------------------------- claims
def group_traces(traces_: DataFrame, radius_m=80.0, by=("dep",)) -> DataFrame:
    """One facility, one group: adds `leader`, the shortest trace around. Groups stay within
    a department, like the audit itself."""
    slim = traces_.select(c("trace_id").alias("id"), "lat", "lon", "m", *by)
    grouped = cluster.leader_groups(slim, radius_m, ["m"], by=by)
    return traces_.join(grouped.select(c("id").alias("trace_id"), "leader"), "trace_id")


def claims(groups: DataFrame, venues: DataFrame, radius_m=150.0, level=15) -> DataFrame:
    """(leader, venue_id, metres, certain) per group: a venue inside one of its loops is certain;
    else the nearest venue of the department claims it within the radius.

    groups: traces with leader, dep, ring, loop, m. venues: id, dep, lat, lon.
    """
    points = venues.where(c("lat").isNotNull() & c("lon").isNotNull()).select(
        c("id").alias("venue_id"), "dep", c("lat").alias("v_lat"), c("lon").alias("v_lon"))
    # of venues at one coordinate the first id answers for all
    spots = points.groupBy("dep", "v_lat", "v_lon").agg(F.min("venue_id").alias("venue_id"))
    loops = groups.where(c("loop")).select("leader", "dep", "trace_id", "m", "ring", c("lat").alias("t_lat"),
                                           c("lon").alias("t_lon"))
    inside = spatial.in_rings(spots, loops, level=level, by=["dep"], point=("v_lat", "v_lon"))
    sure = inside.groupBy("leader").agg(F.min_by(F.struct(
        "venue_id", geo.haversine(c("t_lat"), c("t_lon"), c("v_lat"), c("v_lon")).alias("metres")),
        F.struct("m", "trace_id", "venue_id")).alias("s"))
    heads = groups.where(c("trace_id") == c("leader")).select("leader", "dep", "lat", "lon")
    near = spatial.nearest(
        heads.select(c("leader").alias("q_id"), c("lat").alias("q_lat"), c("lon").alias("q_lon"), "dep"),
        spots.select(c("venue_id").alias("c_id"), c("v_lat").alias("c_lat"), c("v_lon").alias("c_lon"), "dep"),
        1, by=["dep"]).select(c("q_id").alias("leader"), F.struct(c("c_id").alias("venue_id"), "metres").alias("n"))
    best = heads.select("leader", "dep").join(sure, "leader", "left").join(near, "leader", "left")
    pick = lambda name: F.coalesce(f"s.{name}", f"n.{name}")
    return best.select("leader", "dep", pick("venue_id").alias("venue_id"), pick("metres").alias("metres"),
                       (c("s").isNotNull() | F.coalesce(c("n.metres") <= radius_m, F.lit(False))).alias("certain"))


def missing_tracks(groups: DataFrame, claims_: DataFrame) -> DataFrame:
    """One row per unclaimed group, with its nearest known venue."""
    sizes = groups.groupBy("leader").agg(F.count("*").alias("loops"))
    heads = groups.where(c("trace_id") == c("leader"))
    open_ = claims_.where(~c("certain")).select("leader", c("venue_id").alias("near_id"),
                                                F.bround("metres", 0).cast("int").alias("near_m"))
    return heads.join(open_, "leader").join(sizes, "leader").select(
        "dep", "osm", c("trace_id"), numbers.half_even(c("lat"), 5).alias("lat"),
        numbers.half_even(c("lon"), 5).alias("lon"), numbers.half_even(c("m"), 1).alias("perimeter"),
        c("pts").alias("points"), "loop", "ribbon", F.bround("long_m", 0).cast("int").alias("long_m"),
        F.bround("short_m", 0).cast("int").alias("short_m"), tag("lanes").alias("lanes"),
        tag("surface").alias("surface"), tag("name").alias("name"), "loops", "near_id", "near_m")


def audit_totals(elements: DataFrame, claims_: DataFrame) -> DataFrame:
    """(dep, objects, groups, known, missing)."""
    objects = elements.groupBy("dep").agg(F.count("*").alias("objects"))
    groups = claims_.groupBy("dep").agg(F.count("*").alias("groups"), F.count_if("certain").alias("known"),
                                        F.count_if(~c("certain")).alias("missing"))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return objects.join(groups, "dep", "left").select("dep", "objects", zero("groups"), zero("known"), zero("missing"))


# ---------------------------------------------------------------------------- context
def place_class() -> Column:
    """Rank of a named place: a sports centre beats a school, a school beats a park."""
    out = F.lit(len(vocab.PLACE_CLASSES))
    for rank, (key, values) in reversed(list(enumerate(vocab.PLACE_CLASSES))):
        out = F.when(tag(key).isin(*values), rank).otherwise(out)
    return out


def name_from_context(missing: DataFrame, facilities: DataFrame, radius_m=200.0) -> DataFrame:
    """(trace_id, place): the best named facility around, by class, distance and name.

    facilities: rank, name, f_lat, f_lon.
    """
    named = facilities.where(text.present(c("name")) & c("f_lat").isNotNull())
    # around one point, only the first name of each class can win; of each class, only the nearest
    slim = named.groupBy("f_lat", "f_lon", "rank").agg(F.min("name").alias("c_id")).withColumnsRenamed({"f_lat": "c_lat", "f_lon": "c_lon", "rank": "class"})
    asked = missing.select(c("trace_id").alias("q_id"), c("lat").alias("q_lat"), c("lon").alias("q_lon"), F.explode(
        F.sequence(F.lit(0), F.lit(len(vocab.PLACE_CLASSES)))).alias("class"))
    found = spatial.nearest(asked, slim, 1, by=["class"], within_m=radius_m)
    return found.groupBy(c("q_id").alias("trace_id")).agg(F.min(F.struct(c("class").alias("rank"), "metres", c("c_id").alias("place"))).alias("b")).select(
        "trace_id", "b.place", "b.rank", "b.metres")


def schools_around(missing: DataFrame, enclosures: DataFrame, level=14) -> DataFrame:
    """(trace_id, school): the first school enclosure a candidate lies in.

    enclosures: school_id, school, ring (closed).
    """
    inside = spatial.in_rings(missing.select("trace_id", "lat", "lon"), enclosures, level=level)
    return inside.groupBy("trace_id").agg(F.min_by("school", "school_id").alias("school"))


def nearest_address(places: DataFrame, addresses: DataFrame, key="trace_id") -> DataFrame:
    """City, street and postcode of the closest address of each place.

    addresses: a_id, city, street, postcode, a_lat, a_lon. Addresses at one coordinate are
    folded to the first.
    """
    spots = addresses.groupBy("a_lat", "a_lon").agg(F.min_by(
        F.struct("a_id", "city", "street", "postcode"), "a_id").alias("a")).select("a_lat", "a_lon", "a.*")
    found = spatial.nearest(
        places.select(c(key).alias("q_id"), c("lat").alias("q_lat"), c("lon").alias("q_lon")),
        spots.select(c("a_id").alias("c_id"), c("a_lat").alias("c_lat"), c("a_lon").alias("c_lon")), 1)
    return found.select(c("q_id").alias(key), c("c_id").alias("a_id"), "metres").join(
        shuffled(spots.select("a_id", "city", "street", "postcode")), "a_id")


# ------------------------------------------------------------------------- places to look at
def in_communes(places: DataFrame, rings: DataFrame, level=10, key="place_id") -> DataFrame:
    """Places inside any commune ring."""
    inside = spatial.in_rings(places.select(key, "lat", "lon"), rings.select("ring"), level=level)
    return places.join(inside.select(key).distinct(), key, "left_semi")


def cluster_heads(grouped: DataFrame, seq="seq") -> DataFrame:
    """The place that speaks for each cluster: best kind of source, then input order.

    The names of a cluster stay in long form (`cluster_names`); its sources are at most three.
    """
    rank = F.when(c("source") == vocab.SOURCE_NAMED, 0).when(c("source") == vocab.SOURCE_ROAD, 1).otherwise(2)
    kinds = [vocab.SOURCE_PITCH, vocab.SOURCE_NAMED, vocab.SOURCE_ROAD]
    heads = grouped.groupBy("leader").agg(
        F.min_by(F.struct("place_id", "source", "nom", "lat", "lon", "osm"), F.struct(rank.alias("r"), c(seq))).alias("h"),
        F.count("*").alias("members"),
        *[F.bool_or(c("source") == kind).alias(f"_k{i}") for i, kind in enumerate(kinds)])
    sources = F.array_sort(F.array_compact(F.array(*[F.when(c(f"_k{i}"), F.lit(k)) for i, k in enumerate(kinds)])))
    return heads.select("leader", "h.*", "members", sources.alias("sources"))


def cluster_names(grouped: DataFrame) -> DataFrame:
    return grouped.where(text.present(c("nom"))).select("leader", "nom").distinct()


def unknown_places(places: DataFrame, venues: DataFrame, radius_m=200.0, key="place_id") -> DataFrame:
    """Places farther than the radius from every known venue, with the nearest one."""
    spots = venues.where(c("lat").isNotNull() & c("lon").isNotNull()).groupBy("lat", "lon").agg(F.min("id").alias("id"))
    near = spatial.nearest(
        places.select(c(key).alias("q_id"), c("lat").alias("q_lat"), c("lon").alias("q_lon")),
        spots.select(c("id").alias("c_id"), c("lat").alias("c_lat"), c("lon").alias("c_lon")), 1)
    far = near.where(c("metres") > radius_m).select(
        c("q_id").alias(key), c("c_id").alias("near_id"), F.bround("metres", 0).cast("int").alias("near_m"))
    return places.join(shuffled(far), key)


def not_already_listed(places: DataFrame, listed: DataFrame, radius_m=200.0) -> DataFrame:
    """Places with no earlier candidate (lat, lon) within the radius."""
    return spatial.within_radius(listed.select("lat", "lon"), places, radius_m, how="left_anti")
