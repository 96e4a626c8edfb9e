"""The published shapes of a venue: compact record, filter index row, full row, display texts."""
from pyspark.sql import Column, DataFrame, functions as F

from ringside import vocab
from ringside.functions import geo, numbers, text

c = F.col
UNNAMED = {"fr": "Équipement d'athlétisme", "en": "Athletics facility"}      # fixed values
MISSING_DEP, MISSING_DEP_NAME = "00", "Département non renseigné"            # fixed values


# ----------------------------------------------------------------------------------- reviews
def newest_first(reviews) -> Column:
    """Reviews of one record, newest first, undated last, input order kept among equals."""
    keyed = F.transform(reviews, lambda r, i: F.struct(
        F.coalesce(r["date"], F.lit("")).alias("date"), (-i).alias("pos"), r.alias("r")))
    return F.transform(F.reverse(F.array_sort(keyed)), lambda k: F.struct(
        k["r"]["texte"].alias("t"), F.nullif(k["r"]["auteur"], F.lit("")).alias("a"),
        F.nullif(k["r"]["date"], F.lit("")).alias("d"),
        numbers.nonzero(k["r"]["note"].cast("int")).alias("n")))


def mean_note(reviews) -> Column:
    notes = F.filter(F.transform(reviews, lambda r: numbers.nonzero(r["note"].cast("int"))),
                     lambda n: n.isNotNull())
    total = F.aggregate(notes, F.lit(0), lambda a, n: a + n)
    return F.when(F.size(notes) > 0, numbers.half_even(total / F.size(notes), 1))


def review_summary(reviews: DataFrame, key="id", note="note") -> DataFrame:
    """Mean note and count per venue from review rows; partial sums, no list is built."""
    given = numbers.nonzero(c(note))
    return reviews.groupBy(key).agg(
        numbers.half_even(F.sum(given) / F.count(given), 1).alias("note_moyenne"),
        F.count("*").alias("nb_avis"))


def reviews_in_order(reviews: DataFrame, key="id", date="date", seq="seq") -> DataFrame:
    """Review rows by venue, newest first, undated last. A range-partitioned sort: the date is
    part of the key, so one venue with very many reviews spreads over several tasks."""
    return reviews.orderBy(key, F.desc(F.coalesce(c(date), F.lit(""))), seq)


# ---------------------------------------------------------------------------------- photos
def photo_entries(venues: DataFrame, files: DataFrame, root="data/photos") -> DataFrame:
    """(id, pos, f, t, l, c, missing): every listed photo met with the files that exist.

    files: id, file. The thumbnail is optional; a missing original is flagged.
    """
    listed = venues.select("id", F.posexplode("photos").alias("pos", "p")).select(
        "id", "pos", c("p.fichier").alias("file"), c("p.legende").alias("l"), c("p.credit").alias("c")
    ).where(text.present(c("file")))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    ending = F.regexp_extract("file", r"\.([^.]*)$", 1)
    listed = listed.withColumn("thumb", F.concat(stem, F.lit(".thumb."), ending))
    there = files.select("id", "file").distinct()
    original = there.withColumn("_is", F.lit(True))
    small = there.select("id", c("file").alias("thumb"), F.lit(True).alias("_small"))
    met = listed.join(original, ["id", "file"], "left").join(small, ["id", "thumb"], "left")
    where = lambda name: F.concat_ws("/", F.lit(root), c("id"), c(name))
    return met.select("id", "pos", where("file").alias("f"),
                      F.when(c("_small"), where("thumb")).alias("t"),
                      F.nullif("l", F.lit("")).alias("l"), F.nullif("c", F.lit("")).alias("c"),
                      c("_is").isNull().alias("missing"))


def attach_photos(venues: DataFrame, entries: DataFrame) -> DataFrame:
    """Photos back on their venue in listed order; as many as that one record listed."""
    packed = entries.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "f", "t", "l", "c"))).alias("_p"))
    listed = F.transform("_p", lambda p: F.struct(p["f"].alias("f"), p["t"].alias("t"),
                                                  p["l"].alias("l"), p["c"].alias("c")))
    return venues.drop("photos").join(packed, "id", "left").withColumn("photos", listed).drop("_p")


# ------------------------------------------------------------------------ published dataset
def located(venues: DataFrame) -> DataFrame:
    return venues.where(c("lat").isNotNull() & c("lon").isNotNull())


def compact(venues: DataFrame) -> DataFrame:
    """The 37 short keys; null, empty, false and zero are dropped (null here, absent in JSON)."""
    out = []
    types = dict(venues.dtypes)
    for key, short in vocab.SHORT_KEY.items():
        if key not in types:
            continue
        kind, value = types[key], c(key)
        if key == "piste":
            value = F.coalesce(value, F.lit(False)).cast("int")
        elif key in ("lat", "lon"):
            value = numbers.nonzero(numbers.rounded_coordinate(value))
        elif key == "source":
            value = numbers.nonzero(F.coalesce(text.label_of(value, vocab.SOURCE_CODE), F.lit(0)))
        elif key in vocab.PATCH_LISTS:
            value = F.when(F.size(value) > 0, F.array_sort(value))
        elif kind.startswith("array"):
            value = F.when(F.size(value) > 0, value)
        elif kind == "boolean":
            value = F.when(value, F.lit(1))
        elif kind == "string":
            value = F.nullif(value, F.lit(""))
        else:
            value = numbers.nonzero(value)
        out.append(value.alias(short))
    return venues.select(*out)


def expand(tracks: DataFrame) -> DataFrame:
    """Short keys back to long ones with the defaults of the application."""
    long_key = {short: key for key, short in vocab.SHORT_KEY.items()}
    out = []
    for name, kind in tracks.dtypes:
        key, value = long_key.get(name, name), c(name)
        if key in vocab.DEFAULT_FALSE:
            value = F.coalesce(value == 1, F.lit(False))
        elif key in ("nb_avis", "nb_sautoirs", "nb_aires_lancer", "source"):
            value = F.coalesce(value, F.lit(0))
        elif kind.startswith("array"):
            value = F.coalesce(value, F.array().cast(kind))
        out.append(value.alias(key))
    return tracks.select(*out)


def with_departments(venues: DataFrame, deps: DataFrame, dep="dep") -> DataFrame:
    """Name, region and imagery year of the department; blank when it is unknown.

    deps is a dimension of about a hundred rows; whether it is broadcast is left to the
    size Spark measures.
    """
    d = deps.select(c("dep"), c("dep_nom"), c("region"), c("ortho_annee"))
    plain = venues.drop("dep_nom", "region", "ortho_annee")
    return plain.join(d, plain[dep] == d["dep"], "left").drop(d["dep"]).withColumns({
        "dep_nom": F.coalesce("dep_nom", F.lit("")), "region": F.coalesce("region", F.lit(""))})


def department_dimension(venues: DataFrame) -> DataFrame:
    """Code, name and region of every department named by a located venue (last id wins)."""
    known = venues.where(text.present(c("dep")) & text.present(c("dep_nom")))
    return known.groupBy("dep").agg(F.max_by(F.struct("dep_nom", F.coalesce("region", F.lit(""))
                                                      .alias("region")), "id").alias("d")).select(
        "dep", "d.dep_nom", "d.region")


def publishable(venues: DataFrame) -> DataFrame:
    """URL-safe id and both coordinates; a venue without department is filed under 00."""
    safe = text.present(c("id")) & ~c("id").rlike(r"[^A-Za-z0-9._-]")
    no_dep = ~text.present(c("dep"))
    return located(venues).where(safe).withColumns({
        "dep_nom": F.when(no_dep & ~text.present(c("dep_nom")), F.lit(MISSING_DEP_NAME))
        .otherwise(c("dep_nom")),
        "dep": F.when(no_dep, F.lit(MISSING_DEP)).otherwise(c("dep"))})


def index_rows(venues: DataFrame) -> DataFrame:
    """The 17 keys one filters on. acces_libre is 1 or absent: absence is not a no."""
    filled = lambda a: F.when(F.size(a) > 0, F.array_sort(a))
    return located(venues).select(
        c("id").alias("i"), c("nom").alias("n"), c("ville").alias("v"), c("dep").alias("d"), "cp",
        c("lat").alias("y"), c("lon").alias("x"),
        F.coalesce("piste", F.lit(False)).cast("int").alias("p"),
        numbers.nonzero(c("longueur_piste")).alias("lp"),
        numbers.nonzero(c("longueur_probable")).alias("lpp"),
        numbers.nonzero(c("couloirs")).alias("cl"), F.nullif("surface", F.lit("")).alias("s"),
        F.when(c("acces_libre"), F.lit(1)).alias("al"), filled(c("agres")).alias("g"),
        filled(c("agres_probables")).alias("gp"), numbers.nonzero(c("nb_avis")).alias("nv"),
        numbers.nonzero(c("note_moyenne")).alias("nt"))


def full_rows(index: DataFrame, url_base: str, km=None, carry=()) -> DataFrame:
    """Full field names, explicit nulls. acces_libre is true or null; nb_avis is zero-filled."""
    nothing = F.array().cast("array<string>")
    out = [c("i").alias("id"), c("n").alias("nom"), c("v").alias("ville"),
           c("d").alias("departement"), c("cp").alias("code_postal"), c("y").alias("latitude"),
           c("x").alias("longitude")]
    if km is not None:
        out.append(numbers.half_up(km, 1).alias("distance_km"))
    return index.select(
        *carry, *out, (c("p") == 1).alias("piste"), c("lp").alias("longueur_piste_m"),
        c("lpp").alias("longueur_probable_m"), c("cl").alias("couloirs"),
        c("s").alias("revetement"), F.when(c("al") == 1, F.lit(True)).alias("acces_libre"),
        F.coalesce("g", nothing).alias("agres_declares"),
        F.coalesce("gp", nothing).alias("agres_probables"),
        F.coalesce("nv", F.lit(0)).alias("nb_avis"), c("nt").alias("note_moyenne"),
        F.concat(F.lit(url_base + "/site/"), c("i"), F.lit("/")).alias("url"))


def key_dictionary(tracks: DataFrame) -> DataFrame:
    """Short and long name of every published key, with the number of venues that fill it."""
    keys = [(short, key) for key, short in vocab.SHORT_KEY.items() if short in tracks.columns]
    filled = tracks.agg(*[F.count(short).alias(short) for short, _ in keys])
    rows = F.array(*[F.struct(F.lit(short).alias("short"), F.lit(key).alias("long"), c(short).alias("filled"))
                     for short, key in keys])
    return filled.select(F.inline(rows))


# --------------------------------------------------------------------------- display values
def lap(declared, estimated) -> Column:
    """struct<metres, declared>: the declared lap, else the estimated one, and which it is."""
    has = F.coalesce(declared != 0, F.lit(False))
    metres = F.when(has, declared).otherwise(numbers.nonzero(estimated))
    return F.struct(metres.alias("metres"), (has | metres.isNull()).alias("declared"))


def tri_state(flag, source, lang="fr") -> Column:
    """Yes, no, or silence: "no" is only said of venues the census knows."""
    return (F.when(flag, F.lit(vocab.YES[lang]))
            .when(F.coalesce(source, F.lit(0)) != vocab.COMMUNITY_SOURCE, F.lit(vocab.NO[lang])))


# fixed values: the three levels of access
ACCESS = {"fr": ("Oui", "Ouvert au public (horaires)", "Non / réservé"),
          "en": ("Yes", "Open to the public (set hours)", "No / members only")}


def access_level(free, public, source, lang="fr") -> Column:
    yes, hours, reserved = ACCESS[lang]
    return (F.when(free, F.lit(yes)).when(public, F.lit(hours))
            .when(F.coalesce(source, F.lit(0)) != vocab.COMMUNITY_SOURCE, F.lit(reserved)))


def display_order(items) -> Column:
    """The fixed order of the nine disciplines; unknown ones last, in input order."""
    order = F.array(*[F.lit(x) for x in vocab.DISPLAY_ORDER])
    keyed = F.transform(items, lambda x, i: F.struct(
        F.coalesce(F.nullif(F.array_position(order, x), F.lit(0)), F.lit(99)).alias("rank"),
        i.alias("pos"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def _labels(items, lang) -> Column:
    return F.array_compact(F.transform(
        display_order(items), lambda a: text.label_of(a, vocab.DISCIPLINE_LABEL[lang])))


def detail_items(lang="fr") -> Column:
    """The line under a name in a list: lap, surface, lanes, disciplines."""
    tour = lap(c("longueur_piste"), c("longueur_probable"))
    lanes = {"fr": " couloirs", "en": " lanes"}[lang]
    return F.array_compact(F.concat(F.array(
        F.concat(tour["metres"].cast("string"),
                 F.when(tour["declared"], F.lit(" m")).otherwise(F.lit(" m ?"))),
        text.label_of(F.nullif("surface", F.lit("")), vocab.SURFACE_LABEL[lang], c("surface")),
        F.concat(numbers.nonzero(c("couloirs")).cast("string"), F.lit(lanes))),
        _labels(c("agres"), lang)))


def detail_line(lang="fr") -> Column:
    return F.array_join(detail_items(lang), " · ")


def name_of(lang="fr") -> Column:
    return F.coalesce(F.nullif("nom", F.lit("")), F.lit(UNNAMED[lang]))


def description(lang="fr") -> Column:
    """Salient facts, cut to 160 characters at the last space."""
    tour = lap(c("longueur_piste"), c("longueur_probable"))
    say = vocab.DESCRIPTION_WORDS[lang]
    bits = F.concat_ws(", ", F.concat(tour["metres"].cast("string"), F.when(
        tour["declared"], F.lit(" m")).otherwise(F.lit(" m ?"))),
        text.label_of(F.nullif("surface", F.lit("")), vocab.SURFACE_LABEL[lang], c("surface")),
        F.concat(numbers.nonzero(c("couloirs")).cast("string"), F.lit(say[2])))
    track = F.when(c("piste"), F.when(bits != "", F.concat(F.lit(say[0]), bits))
                   .otherwise(F.lit(say[1])))
    facts = F.array_join(F.array_compact(F.concat(
        F.array(track), _labels(c("agres"), lang),
        F.array(F.when(c("eclairage"), F.lit(say[3])), F.when(c("acces_libre"), F.lit(say[4]))))), ", ")
    whole = F.concat(name_of(lang), F.lit(", "), F.coalesce("ville", F.lit("")), F.lit(say[5]),
                     facts, F.lit("."))
    cut = F.concat(F.regexp_replace(F.substring(whole, 1, 157), " [^ ]*$", ""), F.lit("…"))
    return F.when(F.length(whole) > 160, cut).otherwise(whole)


def summary(lang="fr") -> Column:
    """Introductory sentences, as plain text. An estimated lap never enters the prose."""
    pick = lambda key: F.lit(vocab.SENTENCES[key][lang])
    place = F.concat(F.coalesce("ville", F.lit("")), F.when(
        text.present(c("dep_nom")), F.concat(F.lit(" ("), c("dep_nom"), F.lit(")"))).otherwise(F.lit("")))
    region = text.present(c("region"))
    intro = F.concat(name_of(lang), pick("is_in"), place,
                     F.when(region, F.concat(pick("in_region"), c("region"), pick("end")))
                     .otherwise(pick("end")))
    metres = numbers.nonzero(c("longueur_piste")).cast("string")
    sol = F.lower(text.label_of(F.nullif("surface", F.lit("")), vocab.SURFACE_LABEL[lang], c("surface")))
    lanes = numbers.nonzero(c("couloirs")).cast("string")
    maybe = lambda before, value, after="": F.coalesce(
        F.concat(F.lit(before), value, F.lit(after)), F.lit(""))
    has, of, no_length, made, what, numbered, count = vocab.TRACK_WORDS[lang]
    track = F.concat(F.lit(has), F.coalesce(F.concat(F.lit(of), metres, F.lit(" m")), F.lit(no_length)),
                     maybe(made, sol), F.lit(what), maybe(numbered, lanes, count), F.lit("."))
    kit = F.transform(_labels(c("agres"), lang), lambda x: F.lower(x))
    offers = F.when(F.size(kit) > 0, F.concat(pick("offers"),
                                              text.natural_list(kit, lang), F.lit(".")))
    services = F.array_compact(F.array(
        F.when(c("eclairage"), pick("floodlighting")),
        F.when(c("couvert"), pick("indoor")),
        F.when(c("vestiaires"), pick("changing_rooms")),
        F.when(c("douches"), pick("showers"))))
    served = F.when(F.size(services) > 0, F.concat(
        pick("provides"), text.natural_list(services, lang), F.lit(".")))
    access = (F.when(c("acces_libre"), pick("free"))
              .when(c("ouvert_public"), pick("public")))
    return F.concat_ws(" ", intro, F.when(c("piste"), track), offers, served, access)


def photo_alt(caption, lang="fr") -> Column:
    """Caption without its final dots, then the venue and its city."""
    place = F.concat_ws(", ", name_of(lang), F.nullif("ville", F.lit("")))
    legend = F.nullif(F.regexp_replace(F.trim(caption), r"\.+$", ""), F.lit(""))
    return F.when(legend.isNotNull() & (place != ""), F.concat(legend, F.lit(" — "), place)) \
        .otherwise(F.coalesce(legend, place))


def display_tags(lang="fr") -> Column:
    """array<struct<label, uncertain>> in display order; counts only without named equipment."""
    tour = lap(c("longueur_piste"), c("longueur_probable"))
    tag = lambda label, unsure=False: F.when(label.isNotNull(), F.struct(
        label.alias("label"), (F.lit(unsure) if isinstance(unsure, bool) else unsure).alias("uncertain")))
    words = vocab.TAG_WORDS[lang]
    said = lambda cond, key: F.when(cond, F.lit(words[key]))
    lanes = F.concat(numbers.nonzero(c("couloirs")).cast("string"), F.lit(words["lanes"]))
    round_ = F.concat(tour["metres"].cast("string"), F.lit(" m"),
                      F.when(tour["declared"], F.lit("")).otherwise(F.lit(" ?")),
                      F.coalesce(F.concat(F.lit(" · "), lanes), F.lit("")))
    none = F.coalesce(F.size("agres"), F.lit(0)) <= 0
    many = lambda n, one, more: F.when(none & (n > 0), F.concat(
        n.cast("string"), F.when(n > 1, F.lit(more)).otherwise(F.lit(one))))
    named = F.transform(display_order(c("agres")), lambda a: F.struct(
        text.label_of(a, vocab.DISCIPLINE_LABEL[lang], a).alias("label"), F.lit(False).alias("uncertain")))
    head = F.array(
        tag(text.label_of(F.nullif("surface", F.lit("")), vocab.SURFACE_LABEL[lang], c("surface"))),
        tag(round_, ~tour["declared"]), tag(F.when(tour["metres"].isNull(), lanes)),
        tag(said(c("acces_libre"), "free")),
        tag(said(c("couvert"), "indoor")))
    tail = F.array(
        tag(many(c("nb_sautoirs"), *words["jumps"]), True),
        tag(many(c("nb_aires_lancer"), *words["throws"]), True),
        tag(said(c("scolaire"), "school")))
    return F.array_compact(F.concat(head, named, tail))


def aerial_box(tool="page") -> Column:
    """Box of the aerial view of a venue (16:9 for pages, square for the download tool)."""
    metres = lap(c("longueur_piste"), c("longueur_probable"))["metres"]
    if tool == "download":
        return geo.view_box(c("lat"), c("lon"), geo.view_field(c("longueur_piste"), tool))
    return geo.view_box(c("lat"), c("lon"), geo.view_field(metres, tool), 540 / 960)


def structured_data(url_base: str, updated: str, lang="fr") -> Column:
    """One schema.org record per venue as JSON. Only a declared lap is stated; a community
    venue silent on access states nothing about access."""
    url = F.concat(F.lit(f"{url_base}/" + ("site/" if lang == "fr" else "en/track/")), c("id"), F.lit("/"))
    known = (F.coalesce("source", F.lit(0)) != vocab.COMMUNITY_SOURCE) | c("acces_libre") | c("ouvert_public")
    filled = lambda a: F.when(F.size(a) > 0, a)
    lit = lambda v, name: F.lit(v).alias(name)
    feature = lambda label: F.struct(lit("LocationFeatureSpecification", "@type"), label.alias("name"),
                                     F.lit(True).alias("value"))
    extra = vocab.SERVICE_NAMES[lang]
    services = F.array_compact(F.array(*[F.when(c(flag), feature(F.lit(label))) for flag, label in
                                         zip(("eclairage", "vestiaires", "douches", "sanitaires",
                                              "couvert"), extra)]))
    kit = F.transform(display_order(c("agres")), lambda a: feature(
        text.label_of(a, vocab.DISCIPLINE_LABEL[lang], a)))
    names = vocab.PROPERTY_NAMES[lang]
    value = lambda name, v: F.when(v.isNotNull(), F.struct(lit("PropertyValue", "@type"),
                                                           lit(name, "name"), v.cast("string").alias("value")))
    facts = F.array_compact(F.array(
        value(names[0], text.label_of(F.nullif("surface", F.lit("")), vocab.SURFACE_LABEL[lang], c("surface"))),
        value(names[1], F.concat(numbers.nonzero(c("longueur_piste")).cast("string"), F.lit(" m"))),
        value(names[2], numbers.nonzero(c("couloirs")))))
    rating = F.when(c("note_moyenne") > 0, F.struct(
        lit("AggregateRating", "@type"), c("note_moyenne").alias("ratingValue"),
        c("nb_avis").alias("reviewCount"), F.lit(5).alias("bestRating")))
    blank = lambda name: F.nullif(c(name), F.lit(""))
    return F.to_json(F.struct(
        lit("https://schema.org", "@context"), lit("SportsActivityLocation", "@type"),
        F.concat(url, F.lit("#place")).alias("@id"), name_of(lang).alias("name"), url.alias("url"),
        summary(lang).alias("description"), lit("Athletics", "sport"), c("id").alias("identifier"),
        F.struct(lit("GeoCoordinates", "@type"), c("lat").alias("latitude"), c("lon").alias("longitude")).alias("geo"),
        F.struct(lit("PostalAddress", "@type"), blank("adresse").alias("streetAddress"),
                 blank("cp").alias("postalCode"), blank("ville").alias("addressLocality"),
                 blank("dep_nom").alias("addressRegion"), lit("FR", "addressCountry")).alias("address"),
        F.when(known, c("acces_libre")).alias("isAccessibleForFree"),
        F.when(known, c("acces_libre") | c("ouvert_public")).alias("publicAccess"),
        lit(lang, "inLanguage"),
        F.struct(lit("WebPage", "@type"), url.alias("@id"), lit(updated, "dateModified"),
                 lit(lang, "inLanguage")).alias("mainEntityOfPage"),
        filled(F.concat(kit, services)).alias("amenityFeature"),
        filled(facts).alias("additionalProperty"), blank("url").alias("sameAs"),
        rating.alias("aggregateRating")))


def list_item_data(url_base: str, lang="fr") -> Column:
    """The shorter record a venue has inside a list."""
    url = F.concat(F.lit(f"{url_base}/" + ("site/" if lang == "fr" else "en/track/")), c("id"), F.lit("/"))
    lit = lambda v, name: F.lit(v).alias(name)
    has_city = text.present(c("ville"))
    return F.to_json(F.struct(
        lit("SportsActivityLocation", "@type"), F.concat(url, F.lit("#place")).alias("@id"),
        name_of(lang).alias("name"), url.alias("url"), lit("Athletics", "sport"),
        c("id").alias("identifier"),
        F.when(has_city, F.struct(lit("PostalAddress", "@type"), c("ville").alias("addressLocality"),
                                  F.coalesce("dep_nom", F.lit("")).alias("addressRegion"),
                                  lit("FR", "addressCountry"))).alias("address"),
        F.struct(lit("GeoCoordinates", "@type"), c("lat").alias("latitude"), c("lon").alias("longitude")).alias("geo")))


def photo_data(url_base: str, lang="fr") -> Column:
    """A photo (columns f, t, l, c beside its venue's) as an ImageObject with its licence."""
    lit = lambda v, name: F.lit(v).alias(name)
    page = F.concat(F.lit(f"{url_base}/" + ("site/" if lang == "fr" else "en/track/")), c("id"), F.lit("/"))
    full = lambda name: F.concat(F.lit(url_base + "/"), c(name))
    return F.to_json(F.struct(
        lit("ImageObject", "@type"), full("f").alias("contentUrl"), full("f").alias("url"),
        photo_alt(c("l"), lang).alias("caption"),
        lit("https://opendatacommons.org/licenses/odbl/1-0/", "license"),
        page.alias("acquireLicensePage"),
        F.struct(lit("WebPage", "@type"), page.alias("@id")).alias("isPartOf"),
        full("t").alias("thumbnailUrl"), c("c").alias("creditText"), c("c").alias("copyrightNotice"),
        F.when(c("c").isNotNull(), F.struct(lit("Person", "@type"), c("c").alias("name"))).alias("author")))


# ---------------------------------------------------------------------------- head counts
def headline_counts(venues: DataFrame) -> DataFrame:
    some = lambda name: F.count_if(F.coalesce(F.size(name), F.lit(0)) > 0)
    return venues.agg(F.count("*").alias("total"), F.count_if("piste").alias("with_track"),
                      some("photos").alias("with_photos"), some("avis").alias("with_reviews"))


def coverage_counts(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("total"), F.count("lp").alias("longueur"),
                     F.count("cl").alias("couloirs"),
                     F.count_if(c("al").isNull()).alias("acces_inconnu"),
                     F.count_if(c("nv").isNull()).alias("sans_avis"))


def vocabulary(index: DataFrame, column: str) -> DataFrame:
    return index.where(c(column).isNotNull()).select(column).distinct().orderBy(column)
