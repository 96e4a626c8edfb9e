"""Published shapes and display values (P, A2-A4, F22, K2-K3, S9, J2, P13...)."""
from pyspark.sql import functions as F

from ringside import vocab
from ringside.checks.expressions import case_of
from ringside.checks.registry import check
from ringside.operators import publish, search
from ringside.sources import published

c = F.col
BASE_URL = "https://example.org/atlas"
joined = lambda x: F.array_join(x, ",")


def _tracks(t):
    """Venues as the build holds them: source in words, photo and review lists left out."""
    words = F.element_at(F.array(*[F.lit(s) for s in vocab.SOURCE_CODE]), c("source") + 1)
    return t.sites.withColumn("source", words)


FLAGS = ["couvert", "eclairage", "acces_libre", "ouvert_public", "vestiaires", "douches", "sanitaires", "scolaire"]
COMPACT = ("SELECT id AS i, nullif(nom, '') AS n, nullif(adresse, '') AS a, cp, nullif(ville, '') AS v, dep AS d, nullif(round_even(lat, 5), 0) AS y, nullif(round_even(lon, 5), 0) AS x, "
           "CAST(piste AS INTEGER) AS p, " + ", ".join(f"CASE WHEN {f} THEN 1 END AS {vocab.SHORT_KEY[f]}" for f in FLAGS) + ", "
           + ", ".join(f"nullif({n}, 0) AS {vocab.SHORT_KEY[n]}" for n in ("couloirs", "longueur_piste", "longueur_probable", "tribunes", "nb_sautoirs", "nb_aires_lancer", "annee", "renovation", "nb_avis", "note_moyenne"))
           + ", surface AS s, url AS u, note AS no, nullif(source, 0) AS sr, nullif(array_to_string(agres, ','), '') AS g, nullif(array_to_string(agres_probables, ','), '') AS gp FROM sites WHERE lat IS NOT NULL")


def _compact(t):
    return publish.compact(publish.located(_tracks(t)))


@check("p1_compact_encode", COMPACT, ["sites"])
def _(t):
    return _compact(t).withColumns({"g": joined(c("g")), "gp": joined(c("gp"))})


DECODED = ("SELECT id, coalesce(nullif(nom, ''), NULL) AS nom, nullif(ville, '') AS ville, dep, round_even(lat, 5) AS lat, nullif(round_even(lon, 5), 0) AS lon, piste, "
           + ", ".join(FLAGS) + ", nullif(couloirs, 0) AS couloirs, nb_avis, nb_sautoirs, nb_aires_lancer, source, array_to_string(agres, ',') AS agres, array_to_string(agres_probables, ',') AS agres_probables FROM sites WHERE lat IS NOT NULL")


def _decoded(t):
    return publish.expand(_compact(t))


@check("p2_decode_with_defaults", DECODED, ["sites"])
def _(t):
    return _decoded(t).select("id", "nom", "ville", "dep", "lat", "lon", "piste", *FLAGS, "couloirs", "nb_avis", "nb_sautoirs", "nb_aires_lancer", "source",
                              joined("agres").alias("agres"), joined("agres_probables").alias("agres_probables"))


@check("s9_reload_published", "SELECT s.*, coalesce(d.dep_nom, '') AS dep_nom, coalesce(d.region, '') AS region, d.ortho_annee FROM (" + DECODED + ") s LEFT JOIN deps d ON s.dep = d.dep", ["sites", "deps"])
def _(t):
    whole = publish.with_departments(_decoded(t), t.deps)
    return whole.select("id", "nom", "ville", "dep", "lat", "lon", "piste", *FLAGS, "couloirs", "nb_avis", "nb_sautoirs", "nb_aires_lancer", "source",
                        joined("agres").alias("agres"), joined("agres_probables").alias("agres_probables"), "dep_nom", "region", "ortho_annee")


@check("j2_department_lookup", "SELECT id, s.dep, coalesce(d.dep_nom, '') AS dep_nom, coalesce(d.region, '') AS region, d.ortho_annee FROM sites_raw s LEFT JOIN deps d ON s.dep = d.dep", ["sites_raw", "deps"])
def _(t):
    return publish.with_departments(t.sites_raw.select("id", "dep"), t.deps)


INDEX_SQL = "SELECT * EXCLUDE (g, gp), array_to_string(g, ',') AS g, array_to_string(gp, ',') AS gp FROM idx"


@check("p3_index_row", INDEX_SQL, ["idx"])
def _(t):
    return t.index.withColumns({"g": joined(c("g")), "gp": joined(c("gp"))})


@check("k2_index_json", "SELECT i, n, p, lp, al, array_to_string(g, ',') AS g, nv FROM idx", ["idx"])
def _(t):
    line = F.to_json(F.struct(*t.index.columns))       # what write_index puts on each line
    back = F.from_json(line, t.index.schema)
    return t.index.select(back.alias("r")).select("r.i", "r.n", "r.p", "r.lp", "r.al", joined(c("r.g")).alias("g"), "r.nv")


FULL_SQL = (f"SELECT i AS id, n AS nom, v AS ville, d AS departement, cp AS code_postal, y AS latitude, x AS longitude, p = 1 AS piste, lp AS longueur_piste_m, lpp AS longueur_probable_m, cl AS couloirs, s AS revetement, "
            f"CASE WHEN al = 1 THEN true END AS acces_libre, coalesce(array_to_string(g, ','), '') AS agres_declares, coalesce(array_to_string(gp, ','), '') AS agres_probables, coalesce(nv, 0) AS nb_avis, nt AS note_moyenne, '{BASE_URL}/site/' || i || '/' AS url FROM idx")


def _full(index):
    return publish.full_rows(index, BASE_URL).withColumns({"agres_declares": joined(c("agres_declares")), "agres_probables": joined(c("agres_probables"))})


@check("p4_full_row", FULL_SQL, ["idx"])
def _(t):
    return _full(t.index)


@check("k3_record_per_id", FULL_SQL + " ORDER BY id", ["idx"])
def _(t):
    return _full(t.index).orderBy("id")


@check("k1_dataset_header", """SELECT '2026-08-01' AS generated, 'census' AS source, count(*) AS count, count(*) FILTER (WHERE piste) AS with_track, count(*) FILTER (WHERE n_photos > 0) AS with_photos, count(*) FILTER (WHERE nb_avis > 0) AS with_reviews, 37 AS keys FROM sites_raw WHERE lat IS NOT NULL""", ["sites_raw"])
def _(t):
    tracks = _compact(t).withColumn("av", c("nv")).join(t.sites_raw.select(c("id").alias("i"), F.when(c("n_photos") > 0, 1).alias("ph")), "i")
    return published.header(tracks, "2026-08-01", "census").withColumn("keys", F.size("keymap")).drop("keymap")


@check("p5_envelope", """SELECT count(*) AS count, any_value(total) AS total, string_agg(i, ',' ORDER BY km, i) AS ids FROM (SELECT *, count(*) OVER () AS total FROM (
    SELECT i, 2 * 6371::DOUBLE * asin(sqrt(pow(sin(radians(y - 46.0::DOUBLE) / 2), 2) + cos(radians(46.0::DOUBLE)) * cos(radians(y)) * pow(sin(radians(x - 1.0::DOUBLE) / 2), 2))) AS km FROM idx) WHERE km <= 60 ORDER BY km, i LIMIT 20)""", ["idx"])
def _(t):
    answer = search.search(t.index, {"lat": "46", "lon": "1", "radius": "60", "limit": "20"}, BASE_URL, "census", "open licence")
    return answer.select("count", "total", F.array_join(F.transform("results", lambda r: r["id"]), ",").alias("ids"))


KEYS_SQL = " UNION ALL ".join(f"SELECT '{s}' AS short, '{k}' AS long, count({s}) AS filled FROM ({COMPACT})"
                             for k, s in vocab.SHORT_KEY.items() if k not in ("photos", "avis", "horaires", "acces_note"))


@check("p6_key_dictionary", KEYS_SQL, ["sites"])
def _(t):
    return publish.key_dictionary(_compact(t))


@check("p7_lap_with_provenance", """SELECT id, CASE WHEN coalesce(longueur_piste, 0) <> 0 THEN longueur_piste ELSE nullif(longueur_probable, 0) END AS metres,
    coalesce(longueur_piste, 0) <> 0 OR nullif(longueur_probable, 0) IS NULL AS declared FROM sites_raw""", ["sites_raw"])
def _(t):
    return t.sites_raw.select("id", publish.lap(c("longueur_piste"), c("longueur_probable")).alias("l")).select("id", "l.metres", "l.declared")


@check("p8_tri_state", """SELECT id, CASE WHEN eclairage THEN 'Oui' WHEN source <> 2 THEN 'Non' END AS eclairage, CASE WHEN acces_libre THEN 'Yes' WHEN ouvert_public THEN 'Open to the public (set hours)' WHEN source <> 2 THEN 'No / members only' END AS acces FROM sites_raw""", ["sites_raw"])
def _(t):
    return t.sites_raw.select("id", publish.tri_state(c("eclairage"), c("source")).alias("eclairage"),
                              publish.access_level(c("acces_libre"), c("ouvert_public"), c("source"), "en").alias("acces"))


ORDER = "list_filter(['steeple','longueur','triple','hauteur','perche','poids','disque','marteau','javelot'], lambda a: list_contains(agres, a))"
KIT = lambda lang: f"list_transform({ORDER}, lambda a: {case_of(vocab.DISCIPLINE_LABEL[lang], 'a')})"
SOL = lambda lang: case_of(vocab.SURFACE_LABEL[lang], "surface")
DECL = "nullif(longueur_piste, 0)"
TOUR = f"coalesce({DECL}, nullif(longueur_probable, 0))"
MARK = f"CASE WHEN {DECL} IS NOT NULL THEN ' m' ELSE ' m ?' END"
NAME = lambda lang: "coalesce(nullif(nom, ''), '" + publish.UNNAMED[lang].replace("'", "''") + "')"


@check("p9_detail_line", f"""SELECT id, array_to_string(list_concat(list_filter([{TOUR} || {MARK}, {SOL('fr')}, nullif(couloirs, 0) || ' couloirs'], lambda x: x IS NOT NULL), {KIT('fr')}), ' · ') AS fr,
   array_to_string(list_concat(list_filter([{TOUR} || {MARK}, {SOL('en')}, nullif(couloirs, 0) || ' lanes'], lambda x: x IS NOT NULL), {KIT('en')}), ' · ') AS en FROM sites""", ["sites"])
def _(t):
    return t.sites.select("id", publish.detail_line().alias("fr"), publish.detail_line("en").alias("en"))


BITS = f"concat_ws(', ', {TOUR} || {MARK}, {SOL('fr')}, nullif(couloirs, 0) || ' couloirs')"
FACTS = f"""array_to_string(list_filter(list_concat([CASE WHEN piste THEN CASE WHEN {BITS} <> '' THEN 'Piste ' || {BITS} ELSE 'Piste d''athlétisme' END END], {KIT('fr')}, [CASE WHEN eclairage THEN 'éclairée' END, CASE WHEN acces_libre THEN 'accès libre' END]), lambda x: x IS NOT NULL), ', ')"""


@check("p9_description", f"""SELECT id, CASE WHEN length(whole) > 160 THEN regexp_replace(substr(whole, 1, 157), ' [^ ]*$', '') || '…' ELSE whole END AS fr FROM (
   SELECT id, {NAME('fr')} || ', ' || coalesce(ville, '') || ' : ' || {FACTS} || '.' AS whole FROM sites)""", ["sites"])
def _(t):
    return t.sites.select("id", publish.description().alias("fr"))


LIST = lambda x, link: f"CASE len({x}) WHEN 1 THEN {x}[1] ELSE array_to_string({x}[:-2], ', ') || '{link}' || {x}[-1] END"
SERVED = "list_filter([CASE WHEN eclairage THEN 'floodlighting' END, CASE WHEN couvert THEN 'an indoor track' END, CASE WHEN vestiaires THEN 'changing rooms' END, CASE WHEN douches THEN 'showers' END], lambda x: x IS NOT NULL)"


@check("p9_summary", f"""SELECT id, concat_ws(' ', {NAME('en')} || ' is an athletics venue in ' || coalesce(ville, '') || CASE WHEN coalesce(dep_nom, '') <> '' THEN ' (' || dep_nom || ')' ELSE '' END || CASE WHEN coalesce(region, '') <> '' THEN ', ' || region ELSE '' END || ', France.',
   CASE WHEN piste THEN 'It has a' || coalesce(' ' || {DECL} || ' m', 'n') || coalesce(' ' || lower({SOL('en')}), '') || ' running track' || coalesce(' with ' || nullif(couloirs, 0) || ' lanes', '') || '.' END,
   CASE WHEN len(kit) > 0 THEN 'It also offers ' || {LIST('kit', ' and ')} || '.' END, CASE WHEN len(served) > 0 THEN 'The venue provides ' || {LIST('served', ' and ')} || '.' END,
   CASE WHEN acces_libre THEN 'Access is free and unrestricted.' WHEN ouvert_public THEN 'The venue is open to the public at set times.' END) AS en
   FROM (SELECT *, list_transform({KIT('en')}, lambda x: lower(x)) AS kit, {SERVED} AS served FROM sites)""", ["sites"])
def _(t):
    return t.sites.select("id", publish.summary("en").alias("en"))


@check("p10_photo_alt_text", f"""SELECT id, CASE WHEN legend <> '' THEN legend || ' — ' || place ELSE place END AS alt FROM (
   SELECT id, coalesce(rtrim(trim(caption), '.'), '') AS legend, concat_ws(', ', {NAME('fr')}, nullif(ville, '')) AS place
   FROM (SELECT *, CASE k % 4 WHEN 0 THEN ' La cage. ' WHEN 1 THEN '...' WHEN 2 THEN NULL ELSE 'Virage' END AS caption FROM sites_raw))""", ["sites_raw"])
def _(t):
    caption = F.expr("CASE k % 4 WHEN 0 THEN ' La cage. ' WHEN 1 THEN '...' WHEN 2 THEN NULL ELSE 'Virage' END")
    return t.sites_raw.select("id", publish.photo_alt(caption).alias("alt"))


@check("p12_structured_data", f"""SELECT id, CASE WHEN source <> 2 OR acces_libre OR ouvert_public THEN acces_libre::VARCHAR END AS free, {DECL} || ' m' AS lap, coalesce(nullif(nom, ''), 'Athletics facility') AS name, len(agres) + CAST(eclairage AS INT) + CAST(vestiaires AS INT) + CAST(douches AS INT) + CAST(sanitaires AS INT) + CAST(couvert AS INT) AS features,
   CASE WHEN note_moyenne > 0 THEN nb_avis::VARCHAR END AS reviews FROM sites WHERE lat IS NOT NULL""", ["sites"])
def _(t):
    ld = publish.structured_data(BASE_URL, "2026-08-01", "en")
    read = lambda path: F.get_json_object("ld", path)
    lap = F.filter(F.from_json(read("$.additionalProperty"), "array<struct<name:string,value:string>>"), lambda p: p["name"] == "Lap length")
    return publish.located(t.sites).select("id", ld.alias("ld")).select(
        "id", read("$.isAccessibleForFree").alias("free"), F.try_element_at(lap, F.lit(1))["value"].alias("lap"), read("$.name").alias("name"),
        F.coalesce(F.size(F.from_json(read("$.amenityFeature"), "array<string>")), F.lit(0)).alias("features"), read("$.aggregateRating.reviewCount").alias("reviews"))


@check("p12_list_item_and_photo_data", f"""SELECT id, '{BASE_URL}/site/' || id || '/#place' AS item_id, '{BASE_URL}/site/' || id || '/' AS item_url, id AS identifier, nullif(ville, '') AS locality,
     CASE WHEN coalesce(ville, '') <> '' THEN coalesce(dep_nom, '') END AS region, lat, lon, '{BASE_URL}/data/photos/' || id || '/a.jpg' AS content_url, '{BASE_URL}/site/' || id || '/' AS page, 'Zoé' AS credit, 'Zoé' AS author
   FROM sites WHERE lat IS NOT NULL AND lon IS NOT NULL""", ["sites"])
def _(t):
    shots = publish.located(t.sites).withColumns({"f": F.concat(F.lit("data/photos/"), c("id"), F.lit("/a.jpg")), "t": F.lit(None).cast("string"),
                                                  "l": F.lit("Virage."), "c": F.lit("Zoé")})
    both = shots.select("id", publish.list_item_data(BASE_URL).alias("item"), publish.photo_data(BASE_URL).alias("photo"))
    item, photo = (lambda path, of=of: F.get_json_object(of, path) for of in ("item", "photo"))
    return both.select("id", item("$.@id").alias("item_id"), item("$.url").alias("item_url"), item("$.identifier").alias("identifier"), item("$.address.addressLocality").alias("locality"),
                       item("$.address.addressRegion").alias("region"), item("$.geo.latitude").cast("double").alias("lat"), item("$.geo.longitude").cast("double").alias("lon"),
                       photo("$.contentUrl").alias("content_url"), photo("$.acquireLicensePage").alias("page"), photo("$.creditText").alias("credit"), photo("$.author.name").alias("author"))


@check("p13_display_tags", f"""SELECT id, array_to_string(list_filter(list_concat([{SOL('fr')}, CASE WHEN {TOUR} IS NOT NULL THEN {TOUR} || ' m' || CASE WHEN {DECL} IS NULL THEN ' ?' ELSE '' END || coalesce(' · ' || nullif(couloirs, 0) || ' couloirs', '') || CASE WHEN {DECL} IS NULL THEN '~' ELSE '' END END,
     CASE WHEN {TOUR} IS NULL THEN nullif(couloirs, 0) || ' couloirs' END, CASE WHEN acces_libre THEN 'Accès libre' END, CASE WHEN couvert THEN 'Couverte' END], {KIT('fr')},
     [CASE WHEN len(agres) = 0 AND nb_sautoirs > 0 THEN nb_sautoirs || CASE WHEN nb_sautoirs > 1 THEN ' aires de saut~' ELSE ' aire de saut~' END END, CASE WHEN len(agres) = 0 AND nb_aires_lancer > 0 THEN nb_aires_lancer || CASE WHEN nb_aires_lancer > 1 THEN ' aires de lancer~' ELSE ' aire de lancer~' END END,
      CASE WHEN scolaire THEN 'Site scolaire' END]), lambda x: x IS NOT NULL), '|') AS tags FROM sites""", ["sites"])
def _(t):
    shown = F.transform(publish.display_tags(), lambda g: F.concat(g["label"], F.when(g["uncertain"], F.lit("~")).otherwise(F.lit(""))))
    return t.sites.select("id", F.array_join(shown, "|").alias("tags"))


@check("p14_display_order", f"SELECT id, array_to_string(list_concat({ORDER}, list_filter(agres_probables, lambda a: a LIKE '%indetermine')), ',') AS ordered FROM sites", ["sites"])
def _(t):
    mixed = F.concat(F.filter("agres_probables", lambda a: a.endswith("indetermine")), c("agres"))
    return t.sites.select("id", joined(publish.display_order(mixed)).alias("ordered"))


def _listed_photos(t):
    """Venues listing photos, and the files there are: every third original has no thumbnail."""
    shots = F.transform(F.sequence(F.lit(1), c("n_photos")), lambda n: F.struct(
        F.concat(F.lit("p"), n.cast("string"), F.lit(".jpg")).alias("fichier"), F.when(c("k") % 3 == 0, F.lit("Légende")).alias("legende"), F.lit("").alias("credit")))
    venues = t.sites_raw.where("n_photos > 0").select("id", "k", shots.alias("photos"))
    one = venues.select("id", "k", F.explode("photos").alias("p"))
    stem = F.regexp_replace("p.fichier", ".jpg$", "")
    files = one.where(c("k") % 40 != 0).select("id", c("p.fichier").alias("file")).unionByName(
        one.where(c("k") % 3 != 0).select("id", F.concat(stem, F.lit(".thumb.jpg")).alias("file")))
    return venues, files


PHOTO_SQL = """SELECT id, CAST(n - 1 AS INTEGER) AS pos, 'data/photos/' || id || '/p' || n || '.jpg' AS f, CASE WHEN k % 3 <> 0 THEN 'data/photos/' || id || '/p' || n || '.thumb.jpg' END AS t, CASE WHEN k % 3 = 0 THEN 'Légende' END AS l, NULL::VARCHAR AS c, k % 40 = 0 AS missing
   FROM (SELECT *, unnest(range(1, n_photos + 1)) AS n FROM sites_raw WHERE n_photos > 0)"""


@check("p16_photo_entries", PHOTO_SQL, ["sites_raw"])
def _(t):
    return publish.photo_entries(*_listed_photos(t))


@check("j15_photo_files", f"SELECT id, f, t IS NOT NULL AS has_thumb, missing FROM ({PHOTO_SQL})", ["sites_raw"])
def _(t):
    return publish.photo_entries(*_listed_photos(t)).select("id", "f", c("t").isNotNull().alias("has_thumb"), "missing")


@check("v15_missing_photos", f"SELECT id, f FROM ({PHOTO_SQL}) WHERE missing", ["sites_raw"])
def _(t):
    return publish.photo_entries(*_listed_photos(t)).where("missing").select("id", "f")


@check("a2_review_summary", "SELECT id, round_even(avg(note), 1) AS note_moyenne, count(*) AS nb_avis FROM talks GROUP BY id", ["talks"])
def _(t):
    return publish.review_summary(t.talks)


@check("a2_reviews_newest_first", "SELECT id, seq, date, note, auteur FROM talks ORDER BY id, coalesce(date, '') DESC, seq", ["talks"])
def _(t):
    return publish.reviews_in_order(t.talks).select("id", "seq", "date", "note", "auteur")


REVIEW_ROWS = """SELECT k, [{'date': '2026-01-0' || (1 + k % 3), 'n': k % 6}, {'date': '', 'n': 4}, {'date': '2026-02-01', 'n': 0}, {'date': '2026-01-02', 'n': 5}] AS avis FROM sites_raw"""


@check("a2_review_array_of_a_record", """SELECT id, string_agg(coalesce(nullif(date, ''), '-') || ':' || coalesce(nullif(n, 0)::VARCHAR, ''), ',' ORDER BY date DESC, pos) AS avis, round_even(avg(nullif(n, 0)), 1) AS mean FROM (
   SELECT id, 1 AS pos, '2026-01-0' || (1 + k % 3) AS date, k % 6 AS n FROM sites_raw UNION ALL SELECT id, 2, '', 4 FROM sites_raw UNION ALL SELECT id, 3, '2026-02-01', 0 FROM sites_raw UNION ALL SELECT id, 4, '2026-01-02', 5 FROM sites_raw) GROUP BY id""", ["sites_raw"])
def _(t):
    avis = F.expr("""array(named_struct('auteur', '', 'date', concat('2026-01-0', 1 + k % 3), 'note', CAST(k % 6 AS INT), 'texte', 'a'), named_struct('auteur', 'x', 'date', CAST(NULL AS STRING), 'note', 4, 'texte', 'b'),
        named_struct('auteur', 'x', 'date', '2026-02-01', 'note', 0, 'texte', 'c'), named_struct('auteur', 'y', 'date', '2026-01-02', 'note', 5, 'texte', 'd'))""")
    sorted_ = F.transform(publish.newest_first(c("avis")), lambda r: F.concat(F.coalesce(r["d"], F.lit("-")), F.lit(":"), F.coalesce(r["n"].cast("string"), F.lit(""))))
    return t.sites_raw.select("id", avis.alias("avis")).select("id", joined(sorted_).alias("avis"), publish.mean_note(c("avis")).alias("mean"))


@check("a3_headline_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE piste) AS with_track, count(*) FILTER (WHERE n_photos > 0) AS with_photos, count(*) FILTER (WHERE nb_avis > 0) AS with_reviews FROM sites_raw", ["sites_raw"])
def _(t):
    some = lambda n: F.when(c(n) > 0, F.array_repeat(F.lit(1), 1)).otherwise(F.array().cast("array<int>"))
    return publish.headline_counts(t.sites_raw.withColumns({"photos": some("n_photos"), "avis": some("nb_avis")}))


@check("a4_field_coverage", "SELECT count(*) AS total, count(lp) AS longueur, count(cl) AS couloirs, count(*) FILTER (WHERE al IS NULL) AS acces_inconnu, count(*) FILTER (WHERE nv IS NULL) AS sans_avis FROM idx", ["idx"])
def _(t):
    return publish.coverage_counts(t.index)


@check("a22_vocabularies", "SELECT 'd' AS kind, d AS value FROM (SELECT DISTINCT d FROM idx WHERE d IS NOT NULL) UNION ALL SELECT 'lp', lp::VARCHAR FROM (SELECT DISTINCT lp FROM idx WHERE lp IS NOT NULL)", ["idx"])
def _(t):
    one = lambda name: publish.vocabulary(t.index, name).select(F.lit(name).alias("kind"), c(name).cast("string").alias("value"))
    return one("d").unionByName(one("lp"))


@check("f22_publishable", "SELECT id, dep, dep_nom FROM ready", ["ready"])
def _(t):
    return t.ready.select("id", "dep", "dep_nom")


@check("u5_unreviewed", "SELECT i FROM idx EXCEPT SELECT i FROM idx WHERE nv > 0", ["idx"])
def _(t):
    seen = t.index.where(search.reviewed(True)).select("i")
    return t.index.select("i").join(seen, "i", "left_anti")
