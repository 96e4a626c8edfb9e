"""Sources and sinks on real files, and whole jobs on tiny inputs."""
import json

from pyspark.sql import functions as F
import pytest

from ringside.operators import publish, validation
from ringside.plans import coverage, dataset, directory
from ringside.sources import mapped, patches, published
from test_functions import oval, ring
from test_rollup_and_overlay import JUMP, TRACK, equipment

c = F.col
REVIEW = {"texte": "Bien", "note": 4, "date": "2026-05-01", "auteur": "Zoé"}


def write_patches(folder, files):
    folder.mkdir()
    for name, content in files.items():
        (folder / name).write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(folder)


def photo(root, site, name, size=10):
    (root / site).mkdir(parents=True, exist_ok=True)
    (root / site / name).write_bytes(b"x" * size)


def test_patch_files(spark, tmp_path):
    folder = write_patches(tmp_path / "p", {"b.json": {"id": "I2"}, "a.json": [{"id": "I1", "note": None}, {"id": "I3"}], "_model.json": {"id": "no"},
                                           "c.json": "{bad", "notes.txt": "x", "d.json": '{"id":"a","id":"b"}'})
    rows = patches.split_records(patches.read_patch_files(spark, folder)).select(
        "file", "pos", "parse_error", F.try_variant_get("record", "$.id", "string"), patches.present_keys(c("record"))).orderBy("file", "pos").collect()
    assert [tuple(r) for r in rows] == [("a.json", 0, False, "I1", ["id", "note"]), ("a.json", 1, False, "I3", ["id"]), ("b.json", 0, False, "I2", ["id"]),
                                        ("c.json", 0, True, None, None), ("d.json", 0, True, None, None)]


def test_photo_manifest(spark, tmp_path):
    photo(tmp_path / "photos", "I1", "a.jpg", 12)
    photo(tmp_path / "photos", "I1", "a.thumb.jpg", 3)
    manifest = published.photo_manifest(spark, str(tmp_path / "photos"))
    assert sorted((r.id, r.file, r.length) for r in manifest.collect()) == [("I1", "a.jpg", 12), ("I1", "a.thumb.jpg", 3)]
    assert "content" not in manifest.columns


def inputs(spark, tmp_path, extra=None):
    census = equipment(spark, [
        {"inst_numero": "I100000001", "inst_nom": "STADE NORD", "equip_type_name": TRACK, "equip_coordonnees": (47.2, -1.55), "dep_code": "44", "dep_nom": "Loire", "reg_nom": "Pays", "new_name": "NANTES", "equip_piste_nb": "6"},
        {"inst_numero": "I100000002", "inst_nom": "Stade B", "equip_type_name": JUMP, "equip_coordonnees": (47.3, -1.5), "dep_code": "44", "dep_nom": "Loire", "reg_nom": "Pays", "new_name": "Nantes"},
        {"inst_numero": "I100000003", "inst_nom": "Nowhere", "dep_code": "49"}])
    files = {"I1.json": {"id": "I100000001", "couloirs": 8, "photos": [{"fichier": "a.jpg", "credit": "Zoé Dupont"}], "avis": [{"texte": "Vieux", "note": 2}, REVIEW]},
             "new.json": {"id": "c-new-one", "nom": "N", "ville": "Vannes", "lat": 47.65, "lon": -2.75}}
    folder = write_patches(tmp_path / "patches", {**files, **(extra or {})})
    photo(tmp_path / "photos", "I100000001", "a.jpg")
    records = patches.split_records(patches.read_patch_files(spark, folder))
    return census, records, published.photo_manifest(spark, str(tmp_path / "photos"))


def test_dataset_build(spark, tmp_path):
    census, records, photos = inputs(spark, tmp_path)
    samples = spark.createDataFrame([("44", 1, 2022), ("44", 2, 2022)], "dep string, seq int, year int")
    history = spark.createDataFrame([("I100000001", "A", "2026-02-01"), ("I100000001", "A", "2026-01-01"), ("I100000001", "M", "2025-01-01")], "id string, status string, date string")
    stamps = spark.createDataFrame([("I100000001", "2026-03-01")], "id string, mtime string")
    out = str(tmp_path / "out")
    venues = {r.id: r for r in dataset.build_dataset(census, records, photos, samples, history, stamps, out, "2026-08-01", "census").collect()}
    assert set(venues) == {"I100000001", "I100000002", "c-new-one"}
    a = venues["I100000001"]
    assert (a.nom, a.ville, a.couloirs, a.source, a.nb_avis, a.note_moyenne, a.ortho_annee, a.region) == ("Stade Nord", "Nantes", 8, 1, 2, 3.0, 2022, "Pays")
    assert [(p.f, p.t, p.c) for p in a.photos] == [("data/photos/I100000001/a.jpg", None, "Zoé Dupont")]
    assert [r.t for r in a.avis] == ["Bien", "Vieux"]
    assert (venues["c-new-one"].source, venues["c-new-one"].piste, venues["c-new-one"].dep_nom) == (2, True, "")
    head = spark.read.json(f"{out}/header").first()
    assert (head["count"], head.with_track, head.with_photos, head.with_reviews) == (3, 2, 1, 1)
    assert [tuple(r) for r in spark.read.parquet(f"{out}/board").select("name", "sites", "photos", "reviews").collect()] == [("Zoé Dupont", 1, 1, 1)]
    assert [tuple(r) for r in spark.read.parquet(f"{out}/latest").collect()] == [("I100000001", "2026-01-01")]


@pytest.mark.parametrize("extra,said", [({"z.json": {"id": "I100000002", "lanes": 3}}, "refused"), ({"z.json": {"nom": "x"}}, "refused"), ({"z.json": "{"}, "parse"),
                                        ({"z.json": {"id": "I100000002", "photos": [{"fichier": "gone.jpg"}]}}, "missing")])
def test_dataset_build_refuses(spark, tmp_path, extra, said):
    census, records, photos = inputs(spark, tmp_path, extra)
    with pytest.raises(validation.InvalidPatches, match=said):
        dataset.build_venues(census, records, photos)


def test_directory_build(spark, tmp_path):
    census, records, photos = inputs(spark, tmp_path)
    venues = dataset.build_venues(census, records, photos)
    venues = venues.withColumn("source", F.lit(0))
    out = str(tmp_path / "api")
    directory.build_facets(venues, out, "https://x")
    lines = [json.loads(r.value) for r in spark.read.text(f"{out}/index").collect()]
    assert len(lines) == 3 and all("al" not in line for line in lines)      # blank is not "no"
    lists = spark.read.parquet(f"{out}/facets")
    assert {(r.facet, r.value, r.dep) for r in lists.where("id = 'I100000001' and facet = 'lanes'").collect()} == {("lanes", str(n), d) for n in range(1, 9) for d in (None, "44")}
    assert spark.read.parquet(f"{out}/records").where("id = 'c-new-one'").first().departement == "00"
    assert spark.read.parquet(f"{out}/cells").count() == 3
    directory.build_neighbourhood(venues, out)
    assert {(r.city, r.n) for r in spark.read.parquet(f"{out}/cities").collect()} == {("nantes", 2), ("vannes", 1)}
    assert {(r.id, r.near_id) for r in spark.read.parquet(f"{out}/neighbours").collect()} == {("I100000001", "I100000002"), ("I100000002", "I100000001")}


def element(kind, ident, tags, geometry=None, members=None, dep="44"):
    return (kind, ident, tags, geometry, members, None, None, None, dep)




def elements(spark, rows):
    from pyspark.sql import types as T
    return spark.createDataFrame(rows, T.StructType(mapped.ELEMENT.fields + [T.StructField("dep", T.StringType())]))


def test_coverage_audit(spark):
    lap, known = ring(47.2, -1.55, oval(410)), ring(47.3, -1.5, oval(400))
    straight = ring(47.4, -1.4, [(0, 0), (100, 0), (100, 8), (0, 8), (0, 0)])
    outer = ring(47.2, -1.55, oval(450))
    mapped_objects = elements(spark, [
        element("way", 1, {"leisure": "track"}, lap), element("way", 2, {"leisure": "track"}, outer),             # one facility
        element("way", 3, {"leisure": "track", "sport": "athletics"}, known), element("way", 4, {"leisure": "track"}, straight),
        element("way", 5, {"leisure": "track", "sport": "horse_racing"}, lap), element("way", 6, {"leisure": "pitch", "athletics": "long_jump"}, lap),
        element("way", 7, {"leisure": "track"}, None), element("way", 8, {"leisure": "track"}, ring(47.9, -1.5, oval(100, 5))),
        element("way", 9, {"leisure": "track"}, ring(47.9, -1.5, oval(2000))),
        element("relation", 10, {"leisure": "track"}, None, [("outer", ring(47.8, -1.2, oval(460))), ("inner", ring(47.8, -1.2, oval(400)))])])
    venues = spark.createDataFrame([("I1", "A", "X", "44", 47.3, -1.5), ("I2", "B", "Y", "44", 47.25, -1.55), ("I3", "C", "Z", "49", 47.2, -1.55)], "id string, nom string, ville string, dep string, lat double, lon double")
    facilities = spark.createDataFrame([(2, "Parc", 47.2, -1.5501), (0, "Stade du Port", 47.2005, -1.55)], "rank int, name string, f_lat double, f_lon double")
    schools = spark.createDataFrame([("s1", "École X", ring(47.4, -1.4, [(-500, -500), (500, -500), (500, 500), (-500, 500), (-500, -500)]))], "school_id string, school string, ring array<struct<lat:double,lon:double>>")
    addresses = spark.createDataFrame([("a1", "Nantes", "Quai", "44000", 47.21, -1.55)], "a_id string, city string, street string, postcode string, a_lat double, a_lon double")
    out = coverage.audit_coverage(venues, mapped_objects, facilities, schools, addresses)
    missing = {r.osm: r for r in out["missing"].collect()}
    assert set(missing) == {"way/1", "way/4", "relation/10"}
    assert (missing["way/1"].loops, missing["way/1"].place, missing["way/1"].near_id, missing["way/1"].city) == (2, "Stade du Port", "I2", "Nantes")
    assert (missing["way/1"].near_name, missing["way/1"].near_city) == ("B", "Y") and missing["way/1"].url.endswith(".org/way/1")
    assert (missing["way/4"].ribbon, missing["way/4"].loop, missing["way/4"].school) == (True, False, "École X")
    assert missing["relation/10"].perimeter == pytest.approx(400, abs=2)
    assert {r.reason: r.n for r in out["rejections"].collect()} == {"autre_sport": 1, "concours": 1, "sans_trace": 1, "trop_peu_de_points": 1, "hors_bornes": 1}
    assert [tuple(r) for r in out["totals"].collect()] == [("44", 10, 4, 1, 3)]


def test_lap_estimation(spark):
    both = [element("way", 1, {"leisure": "track", "sport": "athletics"}, ring(47.2, -1.55, oval(300))), element("way", 2, {"leisure": "track", "sport": "running"}, ring(47.2, -1.55, oval(412)))]
    venues = spark.createDataFrame([("I1", 47.2005, -1.55, None), ("I2", 47.2, -1.5505, 250), ("I3", 47.5, -1.5, None)], "id string, lat double, lon double, longueur_piste int")
    current = spark.createDataFrame([("I1", "Beau stade.")], "id string, note string")
    matches, outcomes, made = coverage.estimate_laps(venues, elements(spark, both), current)
    assert {(r.id, r.osm, r.snapped) for r in matches.collect()} == {("I1", "w2", 400), ("I2", "w2", 400)}
    assert {r.outcome: r.n for r in outcomes.collect()} == {"new": 1, "disagree": 1}
    (patch,) = made.collect()
    assert (patch.id, patch.longueur_probable) == ("I1", 400) and patch.note.startswith("Beau stade. Développement estimé à 400 m")
    again = coverage.estimate_laps(venues, elements(spark, both), spark.createDataFrame([("I1", patch.note)], "id string, note string"))[2]
    assert again.first().note == patch.note


def test_places_to_look_at(spark):
    spot = lambda ident, name, lat, lon, **tags: ("node", ident, {"name": name, **tags}, None, None, None, lat, lon)
    found = spark.createDataFrame([spot(1, "Rue du Stade", 47.2, -1.55, highway="residential"), spot(2, "Gymnase", 47.201, -1.55, leisure="sports_centre"),
                                   spot(3, "Rue des Sports", 47.21, -1.5, highway="path"), spot(4, "Stade loin", 49.0, 2.0, leisure="stadium"), spot(5, "Rue Haute", 47.2, -1.5, highway="path")], mapped.ELEMENT)
    features = spark.createDataFrame([("Petit terrain multi-sports", None, [[[[-1.55, 47.2005]]]])], "nature string, nature_detaillee string, coordinates array<array<array<array<double>>>>")
    square = [[-2.0, 47.0], [-1.0, 47.0], [-1.0, 48.0], [-2.0, 48.0], [-2.0, 47.0]]
    communes = spark.createDataFrame([("44", "Polygon", [[square]])], "dep string, kind string, coordinates array<array<array<array<double>>>>")
    venues = spark.createDataFrame([("I1", "Stade A", 47.2105, -1.5), ("I2", "Stade B", 47.25, -1.55)], "id string, nom string, lat double, lon double")
    addresses = spark.createDataFrame([("a1", "Nantes", "Quai", "44000", 47.21, -1.55)], "a_id string, city string, street string, postcode string, a_lat double, a_lon double")
    nothing = spark.createDataFrame([], "lat double, lon double")
    out = coverage.places_to_look_at(venues, found, features, communes, nothing, addresses)
    (place,) = out["places"].collect()
    assert {(r.leader, r.nom) for r in out["names"].collect()} == {(place.leader, x) for x in ("Rue du Stade", "Gymnase", "Plateau multisports")}
    assert (place.nom, place.members, place.sources, place.near_id) == ("Gymnase", 3, ["BD TOPO (city-stade)", "OSM (equipement nomme)", "OSM (voie)"], "I1")
    assert (place.near_name, place.city, place.postcode) == ("Stade A", "Nantes", "44000")
    listed = spark.createDataFrame([(47.2011, -1.55)], "lat double, lon double")
    assert coverage.places_to_look_at(venues, found, features, communes, listed, addresses)["places"].count() == 0


def test_contribution_checks_fail_a_run(spark, tmp_path):
    folder = write_patches(tmp_path / "p", {"I1.json": {"id": "I000000042", "couloirs": "8"}, "I2.json": {"id": "I000000042", "photos": [{"fichier": "a.jpg"}]}})
    errors = coverage.check_contributions(patches.split_records(patches.read_patch_files(spark, folder)),
                                          spark.createDataFrame([("I000000042", "a.jpg", 500000)], "id string, file string, length int"))
    assert sorted((r.file, r.rule, r.detail) for r in errors.collect()) == [("I1.json", "not_int", "couloirs"), ("I2.json", "duplicate_id", "I1.json"), ("I2.json", "photo_too_large", "a.jpg")]
    with pytest.raises(validation.InvalidPatches):
        validation.require_none(errors, "contributions")
    validation.require_none(errors.limit(0), "contributions")


def test_candidates_are_written_as_json(spark, tmp_path):
    published.write_candidates(spark.createDataFrame([("way/1", None)], "osm string, place string"), str(tmp_path / "c"))
    (line,) = spark.read.text(str(tmp_path / "c")).collect()
    assert json.loads(line.value) == {"osm": "way/1", "place": None}


def test_compact_and_expand_are_inverse(spark):
    row = spark.createDataFrame([("I1", "N", True, False, 8, 0, ["poids"], [], "res+communaute", 47.123456, -1.5)],
                                "id string, nom string, piste boolean, acces_libre boolean, couloirs int, tribunes int, agres array<string>, agres_probables array<string>, source string, lat double, lon double")
    short = publish.compact(row).first()
    assert (short.p, short.al, short.cl, short["tr"], short.g, short.gp, short.sr, short.y) == (1, None, 8, None, ["poids"], None, 1, 47.12346)
    back = publish.expand(publish.compact(row)).first()
    assert (back.piste, back.acces_libre, back.agres_probables, back.source) == (True, False, [], 1)
