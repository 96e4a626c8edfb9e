from pyspark.sql import types as T

from ringside.operators import overlay, rollup, validation
from ringside.sources import census, patches

TRACK, JUMP = "Stade d'athlétisme", "Aire de saut"


def equipment(spark, rows):
    """Census rows from dicts; seq is the input order, shuffled over partitions."""
    names = [f.name for f in census.EQUIPMENT.fields]
    data = [tuple(r.get(n, "I1" if n == "inst_numero" else None) for n in names) + (i,) for i, r in enumerate(rows)]
    schema = T.StructType(census.EQUIPMENT.fields + [T.StructField("seq", T.LongType())])
    return spark.createDataFrame(data, schema).repartition(3)


def venue(spark, rows):
    out = rollup.rollup(equipment(spark, rows)).collect()
    assert len(out) == 1
    return out[0]


def test_first_row_gives_the_attributes(spark):
    v = venue(spark, [{"inst_nom": None, "new_name": "SAINT-JEAN", "inst_uai": ""}, {"inst_nom": "Stade", "inst_uai": "044"}])
    assert (v.nom, v.ville, v.scolaire) == (None, "Saint-Jean", False)


def test_coordinates_prefer_the_last_track_row(spark):
    at = lambda lat, lon: {"equip_coordonnees": (lat, lon)}
    on = lambda lat, lon: {**at(lat, lon), "equip_type_name": TRACK}
    assert venue(spark, [{}, on(1.0, 2.0), on(3.0, 4.0), at(5.0, 6.0)]).lat == 3.0
    assert venue(spark, [at(1.0, 2.0), at(5.0, 6.0)]).lat == 1.0
    assert venue(spark, [{}, at(5.0, 6.0), at(7.0, 8.0)]).lat == 5.0
    assert venue(spark, [at(0.0, 2.0), at(5.0, 6.0)]).lat == 0.0        # a first latitude is kept
    assert venue(spark, [at(1.0, 2.0), on(0.0, 4.0)]).lat == 1.0        # zero is no position


def test_track_fields_ignore_zero_and_other_rows(spark):
    v = venue(spark, [{"equip_type_name": TRACK, "equip_piste_nb": "0", "equip_piste_long": "400.7"},
                      {"equip_type_name": JUMP, "equip_piste_nb": "9"}, {"equip_type_name": TRACK, "equip_piste_nb": "6", "equip_piste_long": "abc"}])
    assert (v.couloirs, v.longueur_piste, v.piste) == (6, 400, True)


def test_synthetic_wins_whatever_the_order(spark):
    s = lambda sol: {"equip_type_name": TRACK, "equip_sol": sol}
    assert venue(spark, [s("Bitume"), s("Synthétique")]).surface == "synthetique"
    assert venue(spark, [s("Synthétique"), s("Bitume")]).surface == "synthetique"
    assert venue(spark, [s("inconnu"), s("Béton"), s("Sable")]).surface == "bitume"


def test_disciplines_and_areas(spark):
    v = venue(spark, [{"equip_nom": "Sautoir longeur"}, {"equip_nom": "Aire", "equip_type_name": JUMP}, {"equip_nom": "Lancer divers"},
                      {"equip_nom": "superpoidsx"}, {"equip_nom": "POIDS"}])
    assert v.agres == ["longueur", "poids"]
    assert v.agres_probables == ["lancer_indetermine", "saut_indetermine"]
    assert (v.nb_sautoirs, v.nb_aires_lancer) == (2, 1)


def test_services_extremes_and_url(spark):
    v = venue(spark, [{"equip_eclair": "false", "equip_vest_sport": "0", "equip_service_date": "1990", "equip_url": ""},
                      {"equip_eclair": "oui", "equip_vest_sport": "2", "equip_service_date": "0", "equip_travaux_date": "2010", "equip_url": " stade.fr "},
                      {"equip_service_date": "1985", "equip_travaux_date": "2001", "equip_url": "http://x"}])
    assert (v.eclairage, v.vestiaires, v.annee, v.renovation, v.url) == (True, True, 1985, 2010, "https://stade.fr")


def test_rows_without_a_venue_are_dropped(spark):
    assert rollup.rollup(equipment(spark, [{"inst_numero": ""}, {"inst_numero": None}])).count() == 0


def patched(spark, texts, base=({"equip_type_name": TRACK, "equip_nom": "Aire de saut", "equip_piste_nb": "6"},)):
    files = spark.createDataFrame([(f"p{i:03}.json", t) for i, t in enumerate(texts)], "file string, text string")
    typed = patches.typed_patches(patches.split_records(files))
    venues = rollup.rollup(equipment(spark, list(base)))
    return {r.id: r for r in overlay.apply_patches(venues, typed, ("file", "pos")).collect()}


def test_absent_null_and_value_are_three_states(spark):
    v = patched(spark, ['{"id":"I1","couloirs":8,"ville":"Nantes"}', '{"id":"I1","couloirs":null}'])["I1"]
    assert (v.couloirs, v.ville, v.source) == (None, "Nantes", "res+communaute")


def test_declared_kit_clears_the_guess_at_that_point_only(spark):
    assert patched(spark, ['{"id":"I1","agres":["poids"]}'])["I1"].agres_probables == []
    assert patched(spark, ['{"id":"I1","agres":["poids"]}', '{"id":"I1","agres_probables":["disque"]}'])["I1"].agres_probables == ["disque"]
    v = patched(spark, ['{"id":"I1","agres_probables":["disque"]}', '{"id":"I1","agres":["poids"]}', '{"id":"I1","note":"x"}'])["I1"]
    assert (v.agres, v.agres_probables, v.note) == (["poids"], [], "x")
    assert patched(spark, ['{"id":"I1","longueur_probable":250}', '{"id":"I1","longueur_piste":400}'])["I1"].longueur_probable is None


def test_new_and_deleted_venues(spark):
    out = patched(spark, ['[{"id":"c-a","nom":"A","lat":47.0,"lon":-1.5},{"id":"c-b","piste":false}]', '{"id":"c-b","nom":"B"}', '{"id":"I1","supprime":true}'])
    assert set(out) == {"c-a", "c-b"}
    assert (out["c-a"].source, out["c-a"].piste, out["c-a"].lat) == ("communaute", True, 47.0)
    assert (out["c-b"].source, out["c-b"].piste, out["c-b"].nom) == ("res+communaute", False, "B")


def test_lists_are_replaced_not_merged(spark):
    v = patched(spark, ['{"id":"I1","agres":["poids","poids","disque"]}', '{"id":"I1","agres":null}'])["I1"]
    assert v.agres == []


def test_mistyped_values_are_refused_not_lost(spark):
    texts = ['{"id":"I1","couloirs":"8 lanes"}', '{"id":"I1","longueur_piste":400.6}', '{"id":"I1","avis":[{"texte":"x","note":"five"}]}',
             '{"id":"I1","photos":["a.jpg",{"fichier":"b.jpg","legende":"l"}],"couloirs":null,"ville":"V"}', '{"id":"I1","photos":[[1]]}']
    files = spark.createDataFrame([(f"p{i}.json", t) for i, t in enumerate(texts)], "file string, text string")
    typed = patches.typed_patches(patches.split_records(files))
    refused = {r.file: r.mistyped for r in validation.build_refusals(typed).collect()}
    assert refused == {"p0.json": ["couloirs"], "p1.json": ["longueur_piste"], "p2.json": ["avis"], "p4.json": ["photos"]}
    photos = typed.where("file = 'p3.json'").first().photos
    assert [(p.fichier, p.legende) for p in photos] == [("a.jpg", None), ("b.jpg", "l")]


def test_written_integers_and_ids(spark):
    texts = ['{"id":"I1","longueur_piste":400.0}', '[{"id":"I2","couloirs":4e0},{"id":"I3","couloirs":4}]', '{"photos":[{"fichier":"a.jpg"}]}']
    records = patches.split_records(spark.createDataFrame([(f"p{i}.json", t) for i, t in enumerate(texts)], "file string, text string"))
    assert {(r.id, r.rule, r.detail) for r in validation.record_errors(records).collect() if r.rule == "not_int"} == {("I1", "not_int", "longueur_piste"), ("I2", "not_int", "couloirs")}
    none = spark.createDataFrame([], "id string, file string, length long")
    assert validation.photo_file_errors(records, none).count() == 0
