import json
import random

import pytest

from ringside.operators import search

INDEX = ("i string, n string, v string, d string, cp string, y double, x double, p int, lp int, lpp int, cl int, s string, al int, "
         "g array<string>, gp array<string>, nv int, nt double")


def index(spark):
    row = lambda i, n, v, lat, lon, **k: (i, n, v, k.get("d", "44"), "44000", lat, lon, 1, k.get("lp"), None, k.get("cl"), k.get("s"), k.get("al"), k.get("g"), k.get("gp"), k.get("nv"), None)
    return spark.createDataFrame([
        row("a", "abc", "Zed", 47.0, -1.5, lp=400, cl=8, al=1, g=["poids", "disque"]), row("b", "Évry", "Évry", 47.01, -1.5, lp=250, gp=["poids"], nv=2),
        row("c", "Evian", "Evian", 47.02, -1.5, g=["poids"], gp=["disque"], s="gazon"), row("d", "x", "Lyon 3e Arrondissement", 45.7, 4.8, d="69"),
        row("e", "x", "Lyonnaise", 45.7, 4.8, d="69")], INDEX)


def ids(df):
    return [r.i for r in df.collect()]


@pytest.mark.parametrize("params,name", [
    ({"free_access": "false"}, "free_access"), ({"free_access": "maybe"}, "free_access"), ({"lat": "47"}, "lon"), ({"lon": "1"}, "lat"),
    ({"lat": "x", "lon": "1"}, "lat/lon"), ({"lat": "91", "lon": "1"}, "lat/lon"), ({"lat": "nan", "lon": "1"}, "lat/lon"),
    ({"lat": "47", "lon": "1", "radius": "0"}, "radius"), ({"lat": "47", "lon": "1", "radius": "101"}, "radius"), ({"track_length": "4-"}, "track_length"),
    ({"lanes_min": "2.5"}, "lanes_min"), ({"lanes_min": "0"}, "lanes_min"), ({"surface": "moon"}, "surface"), ({"has_reviews": "some"}, "has_reviews"),
    ({"certainty": "sure"}, "certainty"), ({"shot_put": "false"}, "shot_put"), ({"limit": "0"}, "limit"), ({"page": "0"}, "page")])
def test_refused_parameters(params, name):
    with pytest.raises(search.BadParameter) as refusal:
        search.parse_query(params)
    assert refusal.value.parameter == name and refusal.value.hint
    assert refusal.value.status == (413 if params.get("radius") == "101" else 400)


def test_what_was_understood():
    q = search.parse_query({"lat": "47", "lon": "-1.5", "limit": "9999", "track_length": "300-400", "surface": "Grass", "pole_vault": "yes", "certainty": "any", "free_access": "1"})
    assert (q.limit, q.radius, q.length, q.surface, q.disciplines, q.free_access) == (500, 10.0, (300, 400), "gazon", ("perche",), True)
    assert q.echo == {"free_access": True, "lat": 47.0, "lon": -1.5, "radius": 10.0, "track_length": "300-400", "surface": "gazon", "pole_vault": True, "certainty": "any"}


def test_checked_requests_equal_the_parser(spark):
    """Every rule on a table of requests says what the parser of one request says."""
    values = {"free_access": ["false", "maybe", "unknown", "TRUE", ""], "lat": ["47", "x", "91", "", " 3.5 ", "nan", "inf"], "lon": ["1", "-181", "1e1", "y"],
              "radius": ["0", "5", "100", "101", "wide"], "track_length": ["400", "4-", "300-400", ""], "length": ["250", "x"], "lanes_min": ["2", "2.5", "0", "a", "4.0"],
              "surface": ["Grass", "gazon", "moon"], "has_reviews": ["yes", "0", "some"], "certainty": ["any", "sure", ""], "shot_put": ["true", "false", "1"], "pole_vault": ["yes", "maybe"],
              "city": ["Lyon", "---"], "department": ["69", ""], "limit": ["10", "0", "9999", "x"], "page": ["2", "-1"]}
    pick, asked = random.Random(3), []
    for i in range(700):
        asked.append({k: pick.choice(v) for k, v in values.items() if pick.random() < (0.12 if i % 2 else 0.3)})
    found = search.checked(spark.createDataFrame([(i, p) for i, p in enumerate(asked)], "i int, params map<string,string>")).orderBy("i").collect()
    refused = 0
    for row, params in zip(found, asked):
        try:
            q = search.parse_query(params)
        except search.BadParameter as e:
            refused += 1
            assert (row.refusal.parameter, row.refusal.hint, row.refusal.status, row.query) == (e.parameter, e.hint, e.status, None), params
            continue
        assert row.refusal is None, params
        got = row.query
        access = {None: None, "true": True, "unknown": "unknown"}[got.free_access]
        assert (access, got.lat, got.lon, got.radius, got.length and tuple(got.length), got.lanes_min, got.surface, got.has_reviews, got.certainty, tuple(got.disciplines),
                got.city, got.department, got.limit, got.page) == (q.free_access, q.lat, q.lon, q.radius, q.length, q.lanes_min, q.surface, q.has_reviews, q.certainty, q.disciplines,
                                                                   q.city, q.department, q.limit, q.page), params
    assert 100 < refused < 600


@pytest.mark.parametrize("params,want", [
    ({}, "abcde"), ({"department": "69"}, "de"), ({"city": "Lyon"}, "d"), ({"free_access": "true"}, "a"), ({"free_access": "unknown"}, "bcde"),
    ({"track_length": "250"}, "b"), ({"lanes_min": "1"}, "a"), ({"has_reviews": "true"}, "b"), ({"has_reviews": "0"}, "acde"),
    ({"shot_put": "true"}, "ac"), ({"shot_put": "true", "certainty": "probable"}, "b"), ({"shot_put": "true", "discus": "true", "certainty": "any"}, "ac"),
    ({"lat": "47", "lon": "-1.5", "radius": "1.5"}, "ab")])
def test_filters(spark, params, want):
    assert "".join(sorted(ids(search.matching(index(spark), search.parse_query(params))))) == want


def test_french_order_puts_accents_where_a_dictionary_does(spark):
    assert ids(index(spark).where("d = '44'").orderBy(*search.french_order("v", "n"))) == ["c", "b", "a"]


ACCENTED = ["", "abbé", "abbesse", "Abbeville", "côte", "Côte", "coté", "cote", "côté", "Cote", "Évian", "évian", "Evian", "Évry", "Evry 2", "Evry-2", "evry 10", "Île", "ile", "L'Aigle",
            "Laon", "Œuilly", "Oetre", "of", "pêche", "péché", "pêché", "Zed", "zède", None]


def test_french_positions(spark):
    """Thirty names: base letters, then accents, then small before capital; blanks first; parts of any number alike."""
    rows = spark.createDataFrame([(f"i{n:02}", name) for n, name in enumerate(ACCENTED)], "id string, ville string")
    got = [ACCENTED[int(r.id[1:])] or "" for r in search.french_positions(rows, ["ville"]).orderBy("position").collect()]
    assert got == ["", "", "abbé", "abbesse", "Abbeville", "cote", "Cote", "coté", "côte", "Côte", "côté", "Evian", "évian", "Évian", "Évry", "evry 10", "Evry 2", "Evry-2", "ile", "Île",
                   "L'Aigle", "Laon", "Oetre", "Œuilly", "of", "péché", "pêche", "pêché", "Zed", "zède"]
    assert sorted(r.position for r in search.french_positions(rows, ["ville"]).collect()) == list(range(30))


def test_answer_holds_page_total_and_next(spark):
    answer = search.search(index(spark), {"limit": "2"}, "https://x", "census", "open").first()
    assert (answer["count"], answer.total, answer.page, answer.next, [r.id for r in answer.results]) == (2, 5, 1, 2, ["c", "b"])
    answer = search.search(index(spark), {"limit": "2", "page": "3", "department": "44"}, "https://x", "census", "open").first()
    assert (answer["count"], answer.total, answer.next, json.loads(answer.query)) == (0, 3, None, {"department": "44"})
    near = search.search(index(spark), {"lat": "47.02", "lon": "-1.5", "radius": "5"}, "https://x", "census", "open").first()
    assert [(r.id, r.distance_km) for r in near.results] == [("c", 0.0), ("b", 1.1), ("a", 2.2)]
    assert near.results[0].acces_libre is None and near.results[2].acces_libre is True and near.results[0].nb_avis == 0


def test_radius_over_the_antimeridian(spark):
    row = spark.createDataFrame([("w", 0.0, -179.99)], "i string, y double, x double")
    assert search.within_km(row, 0.0, 179.99, 5.0).count() == 1


def test_filters_reach_the_scan(spark, tmp_path):
    index(spark).write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    kept = search.matching(stored, search.parse_query({"lat": "47", "lon": "-1.5", "department": "44", "lanes_min": "4"})).select("i")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    for pushed in ("EqualTo(d,44)", "GreaterThanOrEqual(cl,4)", "GreaterThanOrEqual(y,", "LessThanOrEqual(x,"):
        assert pushed in plan
    assert "nt:double" not in plan.split("ReadSchema")[1]


def test_a_city_without_letters_is_no_filter():
    query = search.parse_query({"city": "---", "department": "44"})
    assert query.city is None and "city" not in query.echo
