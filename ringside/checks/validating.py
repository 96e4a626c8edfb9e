"""Contribution checks (V1-V16) on records broken in known ways."""
from pyspark.sql import functions as F

from ringside.checks.registry import check
from ringside.operators import validation
from ringside.sources import patches as patch_source

c = F.col
GOOD = '"nom":"Stade","lat":47.2,"lon":-1.5'
# (JSON of a record, the errors it must raise); @ stands for the key of the row, ~ for 1201 letters
CASES = [
    ('{"id":"I@","couloirs":8,"agres":["poids","disque"],"agres_probables":["nimporte"],"photo":"x"}', []),
    ('{"id":"I@"', [("invalid_json", "file")]),
    ('"I@"', [("not_an_object", "record")]),
    ('{"nom":"x"}', [("missing_id", "id")]),
    ('{"id":12,"nom":3}', [("missing_id", "id")]),
    ('{"id":""}', [("missing_id", "id")]),
    ('{"id":"stade @"}', [("bad_id", "stade @")]),
    ('{"id":"I@","lanes":8,"length":1}', [("unknown_key", "lanes"), ("unknown_key", "length")]),
    ('{"id":"I@","piste":1,"couvert":"oui","scolaire":null}', [("not_bool", "piste"), ("not_bool", "couvert"), ("not_bool", "scolaire")]),
    ('{"id":"I@","couloirs":"8","annee":true,"longueur_piste":400.5,"tribunes":12}', [("not_int", "couloirs"), ("not_int", "annee"), ("not_int", "longueur_piste")]),
    ('{"id":"I@","couloirs":6,"longueur_piste":400.0}', [("not_int", "longueur_piste")]),
    ('{"id":"I@","lat":"47","lon":-1.5}', [("not_number", "lat")]),
    ('{"id":"I@","nom":5,"note":null,"ville":"x"}', [("not_string", "nom"), ("not_string", "note")]),
    ('{"id":"I@","agres":"poids","agres_probables":{},"photos":1,"avis":"x"}', [("not_list", "agres"), ("not_list", "agres_probables"), ("not_list", "photos"), ("not_list", "avis")]),
    ('{"id":"I@","agres":["poids","saut"]}', [("unknown_discipline", "saut")]),
    ('{"id":"I@","surface":"tartan"}', [("unknown_surface", "tartan")]),
    ('{"id":"I@","lat":47.2}', [("half_a_position", "lat/lon")]),
    ('{"id":"I@","lat":95.5,"lon":2}', [("out_of_world", "lat/lon"), ("out_of_territory", "lat/lon")]),
    ('{"id":"I@","lat":-21.1,"lon":55.5}', [("out_of_territory", "lat/lon")]),
    ('{"id":"c-stade-@","nom":"","lat":47.2,"lon":-1.5}', [("new_venue_without", "nom"), ("new_venue_without", "ville")]),
    ('{"id":"c-stade-@","nom":"N","ville":"V"}', [("new_venue_without", "lat"), ("new_venue_without", "lon")]),
    ('{"id":"I@","url":"stade.example.org"}', [("bad_url", "stade.example.org")]),
    ('{"id":"I@","photos":[{"legende":"x"},{"fichier":"a.png"},{"fichier":"x/a.jpg","auteur":"z"},{"fichier":".a.jpg"},{"fichier":"a.JPEG"},3]}',
     [("photo_without_file", "photos"), ("photo_not_jpeg", "a.png"), ("photo_unknown_key", "auteur"), ("photo_not_bare_name", "x/a.jpg"), ("photo_not_bare_name", ".a.jpg"), ("photo_without_file", "photos")]),
    ('{"id":"I@","avis":[3,{"note":6,"texte":"bien"},{"texte":"","age":2},{"texte":"~"},{"texte":"x","date":"3 mai","auteur":"' + "n" * 41 + '"},{"texte":"ok","note":5,"date":"2026-05-03"},{"texte":7,"note":null}]}',
     [("review_not_object", "avis"), ("review_bad_note", "note"), ("review_without_text", "texte"), ("review_unknown_key", "age"), ("review_too_long", "1201"),
      ("review_bad_date", "3 mai"), ("review_long_author", "auteur"), ("review_without_text", "texte"), ("review_bad_note", "note")]),
]
KEY = "lpad(CAST(c_custkey AS STRING), 9, '0')"
TEXT = (f"replace(replace(CASE c_custkey % {len(CASES)} " + " ".join(f"WHEN {i} THEN '{text}'" for i, (text, _) in enumerate(CASES)) + f" END, '@', {KEY}), '~', repeat('x', 1201))")
EXPECTED = (f"SELECT concat('r', {KEY}, '.json') AS file, replace(rule, '@', {KEY}) AS rule, replace(detail, '@', {KEY}) AS detail FROM customer JOIN (VALUES "
            + ", ".join(f"({i}, '{rule}', '{detail}')" for i, (_, errors) in enumerate(CASES) for rule, detail in errors) + f") e(i, rule, detail) ON i = c_custkey % {len(CASES)}")

GROUPS = {
    "v1_json_parses": ["invalid_json"], "v2_object_with_id": ["not_an_object", "missing_id"], "v3_id_pattern": ["bad_id"],
    "v4_unknown_key": ["unknown_key"], "v5_typed_fields": ["not_bool", "not_int", "not_number", "not_string"],
    "v6_lists_and_disciplines": ["not_list", "unknown_discipline"], "v7_surface": ["unknown_surface"],
    "v8_position": ["half_a_position", "out_of_world", "out_of_territory"], "v9_new_venue_fields": ["new_venue_without"],
    "v10_url_scheme": ["bad_url"], "v11_photo_entries": ["photo_without_file", "photo_unknown_key", "photo_not_bare_name", "photo_not_jpeg"],
    "v12_reviews": ["review_not_object", "review_unknown_key", "review_without_text", "review_too_long", "review_bad_note", "review_bad_date", "review_long_author"],
}


def records(t):
    files = t.customer.select(F.concat(F.lit("r"), F.expr(KEY), F.lit(".json")).alias("file"), F.expr(TEXT).alias("text"))
    return patch_source.split_records(files)


def _register(name, rules):
    listed = ", ".join(f"'{r}'" for r in rules)
    check(name, f"SELECT * FROM ({EXPECTED}) WHERE rule IN ({listed})")(
        lambda t: validation.record_errors(records(t)).where(c("rule").isin(*rules)).select("file", "rule", "detail"))


for _name, _rules in GROUPS.items():
    _register(_name, _rules)


@check("v_all_record_errors", EXPECTED)
def _(t):
    return validation.record_errors(records(t)).select("file", "rule", "detail")


# events as definitions: one id is defined by very many files
DEFINED = "SELECT concat('f', lpad(CAST(event_id AS STRING), 9, '0'), '.json') AS file, CAST(event_id % 2 AS INT) AS pos, CASE WHEN event_id % 3 = 0 THEN 'I000000000' WHEN event_id % 3 = 1 THEN concat('I', CAST(user_id AS STRING)) ELSE concat('c-', CAST(event_id AS STRING)) END AS id FROM {events}"


@check("v13_duplicate_ids", "SELECT file, pos, id, 'duplicate_id' AS rule, before AS detail FROM (SELECT *, lag(file) OVER (PARTITION BY id ORDER BY file, pos) AS before FROM (" + DEFINED.replace("{events}", "events") + ")) WHERE before IS NOT NULL")
def _(t):
    return validation.duplicate_ids(t.derive(DEFINED))


@check("v11_photo_files", """SELECT file, id, rule, detail FROM (SELECT concat('r', lpad(c_custkey::VARCHAR, 9, '0'), '.json') AS file, 'I' || lpad(c_custkey::VARCHAR, 9, '0') AS id, 'p.jpg' AS detail,
   CASE WHEN c_custkey % 5 = 0 THEN 'photo_missing' WHEN c_custkey % 7 = 0 THEN 'photo_too_large' END AS rule FROM customer) WHERE rule IS NOT NULL""")
def _(t):
    name = F.expr(f"concat('I', {KEY})")
    texts = t.customer.select(F.concat(F.lit("r"), F.expr(KEY), F.lit(".json")).alias("file"),
                              F.concat(F.lit('{"id":"'), name, F.lit('","photos":[{"fichier":"p.jpg"},{"fichier":"../q.jpg"}]}')).alias("text"))
    files = t.customer.where("c_custkey % 5 <> 0").select(name.alias("id"), F.lit("p.jpg").alias("file"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN 409601 ELSE 409600 END").alias("length"))
    return validation.photo_file_errors(patch_source.split_records(texts), files).select("file", "id", "rule", "detail")


@check("v14_build_refusals", f"""SELECT file, unknown FROM (SELECT concat('r', {KEY}, '.json') AS file, CASE c_custkey % {len(CASES)} WHEN 0 THEN 'photo' WHEN 3 THEN '' WHEN 5 THEN '' WHEN 7 THEN 'lanes,length' ELSE NULL END AS unknown FROM customer) WHERE unknown IS NOT NULL""")
def _(t):
    usable = records(t).where(~c("parse_error") & F.schema_of_variant("record").startswith("OBJECT"))
    refused = validation.build_refusals(patch_source.typed_patches(usable, ["nom"]))
    return refused.select("file", F.array_join("unknown", ",").alias("unknown"))


@check("v16_exit_status", f"SELECT CAST(count(*) > 0 AS INTEGER) AS exit_status, count(*) AS errors FROM ({EXPECTED})")
def _(t):
    return validation.record_errors(records(t)).agg((F.count("*") > 0).cast("int").alias("exit_status"), F.count("*").alias("errors"))
